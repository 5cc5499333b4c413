"""Texts whose sets of character trigrams are alike, found by sketches that no link escapes and confirmed by full sets.

A sketch has a bit for each class of trigrams: whether an odd number of the text's is in it. A trigram that only one of two
texts has turns one bit, so that two sets differ in as many trigrams as their sketches do in bits, at least; folding a sketch
keeps that. A Jaccard measure of `least` allows only a share of both sizes to differ, and two texts beyond it aren't linked.

Equal sets are taken as one first. Sets are dealt to blocks by size; blocks whose sizes allow links meet, each two in a task of
their own, which gives out pairs that join what its sketches allow. Their components are compared by full sets (see
operators.linking). Memory is that of two blocks. All pairs of alike sizes are looked at, so that time grows with the square
of the different texts, at some nanoseconds a pair; what is stored and shuffled per text grows with the blocks that one meets.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import stored
from .batches import slices
from .components import connected_components
from .linking import JaccardOfSets, spanning_links

#: Binary digits of the number of classes, by which it is at least and at most a power of two: sets of many trigrams have more classes.
LEAST, MOST = 10, 14
#: Sets of a block.
BLOCK = 16384
ODD = np.uint64(0x9E3779B97F4A7C15)


def trigrams(text: str | None) -> np.ndarray:
    """Distinct runs of three characters, as sorted numbers of their code points; a shorter text is one itself, an empty one has none."""
    x = np.frombuffer((text or "").encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
    if len(x) in (1, 2):
        x = np.concatenate([np.zeros(3 - len(x), np.uint64), x])
    return np.unique(x[:-2] | x[1:-1] << np.uint64(21) | x[2:] << np.uint64(42)) if len(x) else x


def sketch(grams: np.ndarray) -> bytes:
    x = grams * ODD
    x = (x ^ (x >> np.uint64(32))) * ODD
    classes = 1 << min(MOST, max(LEAST, (3 * len(grams) // 2).bit_length()))
    counts = np.bincount((x >> np.uint64(40)).astype(np.int64) % classes, minlength=classes)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def _one_width(sketches: list[bytes]) -> np.ndarray:
    """The sketches, a row each, those of more classes folded to the fewest."""
    widths = np.array([len(s) // 8 for s in sketches])
    out = np.empty((len(sketches), int(widths.min())), np.uint64)
    for w in np.unique(widths):
        at = np.flatnonzero(widths == w)
        out[at] = np.bitwise_xor.reduce(np.frombuffer(b"".join(sketches[i] for i in at), "<u8").reshape(len(at), -1, out.shape[1]), axis=1)
    return out


def marks(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, size, sketch) of documents (doc_id, text); digests of equal sets are equal, and null without trigrams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [trigrams(t) for t in b.column(1).to_pylist()]
            digests = [md5(s.tobytes(), usedforsecurity=False).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digests, pa.binary()), pa.array([len(s) for s in sets], pa.int32()), pa.array([sketch(s) for s in sets], pa.binary())], ["doc_id", "digest", "size", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, digest binary, size int, sketch binary")


def _blocks(of_size: list[tuple[int, int]], least: float, most: int) -> tuple[list, list]:
    """From (size, count): (size, before, count), and (block, cell, side) of each two blocks whose sizes allow links. A size's rows
    follow `before` others and are in the blocks of so many rows that these places fall in."""
    rows, low, high = [], {}, {}
    before = 0
    for size, count in sorted(of_size):
        rows.append((size, before, count))
        for k in range(before // most, (before + count - 1) // most + 1):
            low[k], high[k] = min(size, low.get(k, size)), size
        before += count
    cells, n = [], 0
    for k in high:
        for j in range(k, len(high)):
            if low[j] * least > high[k] + 1e-6:
                break
            cells += [(k, n, 0)] if j == k else [(k, n, 1), (j, n, 2)]
            n += 1
    return rows, cells


def _joins(sides: np.ndarray, reps: np.ndarray, sizes: np.ndarray, sketches: np.ndarray, least: float) -> np.ndarray:
    """Pairs (rep, rep) that join all that sketches and sizes allow to be linked: members of one block (side 0), or of sides 1 and 2."""
    order = np.lexsort((sizes, sides))
    sides, reps, sizes, sketches = sides[order], reps[order], sizes[order], sketches[order]
    folded = np.ascontiguousarray(np.bitwise_xor.reduce(sketches.reshape(len(reps), 4, -1), axis=1).T)  # to a quarter, a row for each word
    share = (1 - least) / (1 + least)
    may = np.minimum(share * sizes + 1, 30000).astype(np.uint16)  # two of these are as much as the share of both sizes, or more
    one, start = (len(reps), 0) if not sides.any() else (int(np.searchsorted(sides, 2)),) * 2
    others = sizes[start:]
    begins, ends = start + np.searchsorted(others, sizes * least - 1e-6), start + np.searchsorted(others, sizes / least + 1e-6, side="right")
    parts, out = np.arange(len(reps)), []
    differ, count, bits = np.empty(len(reps), np.uint64), np.empty(len(reps), np.uint8), np.empty(len(reps), np.uint16)
    for i in range(one):
        lo, hi = max(int(begins[i]), 0 if start else i + 1), int(ends[i])
        if lo >= hi:
            continue
        x, c, n = differ[: hi - lo], count[: hi - lo], bits[: hi - lo]
        n[:] = 0
        for w in folded:
            np.bitwise_xor(w[lo:hi], w[i], out=x)
            np.bitwise_count(x, out=c)
            n += c
        near = lo + np.flatnonzero(n <= may[lo:hi] + may[i])
        if len(near):
            near = near[parts[near] != parts[i]]
            whole = np.bitwise_count(sketches[near] ^ sketches[i]).sum(1, dtype=np.int64)
            for j in near[whole <= share * (sizes[near] + sizes[i]) + 1e-6]:
                if parts[j] != parts[i]:
                    out.append((reps[i], reps[j]))
                    parts[parts == parts[j]] = parts[i]
    return np.array(out, np.int64).reshape(-1, 2)


def candidates(sets: DataFrame, least: float, most: int = BLOCK) -> DataFrame:
    """Pairs (a, b) of sets (rep, size, sketch), a row each, that join whatever might have a Jaccard measure of `least` or more."""
    spark = sets.sparkSession
    rows, cells = _blocks([tuple(r) for r in sets.groupBy("size").count().collect()], least, most)
    at = F.floor((F.col("before") + F.pmod(F.xxhash64("rep"), F.col("count"))) / most).alias("block")
    placed = sets.join(F.broadcast(spark.createDataFrame(rows, "size int, before long, count long")), "size").select(at, "rep", "size", "sketch")
    dealt = placed.join(F.broadcast(spark.createDataFrame(cells, "block long, cell long, side int")), "block").select("cell", "side", "rep", "size", "sketch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []

        def close() -> pa.RecordBatch:
            *plain, sketches = zip(*held, strict=True)
            held.clear()
            pairs = _joins(*(np.concatenate(x) for x in plain[1:]), _one_width([s for part in sketches for s in part]), least)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            *plain, sketches = b.columns
            columns = [*(x.to_numpy() for x in plain), sketches.to_pylist()]
            cuts = [0, *(np.flatnonzero(np.diff(columns[0])) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if held and columns[0][lo] != cell:
                    yield close()
                cell = columns[0][lo]
                held.append([x[lo:hi] for x in columns])
        if held:
            yield close()

    tasks = max(1, len({c for _, c, _ in cells}))
    return dealt.repartition(tasks, "cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long")


def alike_texts(docs: DataFrame, least: float = 0.85, most: int = BLOCK) -> DataFrame:
    """(doc_id, component_id) of documents (doc_id, text), ids being longs: the smallest id that links lead to, which join texts whose
    sets of character trigrams have a Jaccard measure of `least` or more. Null and empty texts are linked to nothing."""
    marked = stored(marks(docs))
    reps = stored(marked.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min("size").alias("size"), F.min("sketch").alias("sketch")))
    near = connected_components(candidates(reps.select("rep", "size", "sketch"), least, most))
    groups = stored(near.select(F.col("root").alias("group"), F.col("node").alias("rep")))
    own = docs.join(groups.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([trigrams(t).astype("<u8").tobytes() for t in b.column(1).to_pylist()], pa.binary())], ["rep", "payload"])

    links = spanning_links(groups, stored(own.mapInArrow(run, "rep long, payload binary")), JaccardOfSets(least))
    roots = connected_components(links).toDF("rep", "component_id")
    of_set = reps.join(roots, "rep", "left").select("digest", F.coalesce("component_id", "rep").alias("component_id"))
    return marked.select("doc_id", "digest").join(of_set, "digest", "left").select("doc_id", F.coalesce("component_id", "doc_id").alias("component_id"))
