"""MinHash near duplicates: signatures of word shingles, bands, links that full sets confirm, and their components.

Rows of equal signatures are taken as one first, so that copies cost one row. Signatures that share a band are held against
each other in groups; those that agree in `least` - MARGIN of their values or more, which is four standard deviations below
it, join groups, whose full sets of shingles are compared, each sent once (see operators.linking: no pair of a group is given
out, and large groups are cut into cells). Only confirmed links count. Null and empty texts have no shingles and are linked to
nothing. Rows that share an id, a long, are taken as one document. Empty tables give no rows.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import stored
from .batches import slices
from .components import connected_components
from .linking import JaccardOfSets, groups_of_keys, spanning_links

# What signatures depend on.
HASHES, BANDS, PRIME, SEED = 128, 16, 4294967311, 42
#: Values of a band by which candidates are found: 25 bands of five miss a pair at 0.8 once in 20,000; full sets sort out the rest.
ROWS = 5
#: Words whose hashes a task keeps, and the factor by which a shingle's words count by place.
KEPT, ODD = 1 << 18, np.uint64(0x9E3779B97F4A7C15)
#: How far below the threshold an estimate may be for its pair to be compared by full sets.
MARGIN = 0.14


def parameters() -> tuple[np.ndarray, np.ndarray]:
    pick = random.Random(SEED)
    pairs = [(pick.randint(1, PRIME - 1), pick.randint(0, PRIME - 1)) for _ in range(HASHES)]
    return tuple(np.array(x, np.uint64) for x in zip(*pairs, strict=True))


def _least(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of (a * x + b) modulo PRIME over x, for each pair of a and b. With x under PRIME, no a * x + b of these
    parameters exceeds 64 bits; the remainder by way of the quotient, for which numpy has a fast division by one number."""
    p, out = np.uint64(PRIME), np.full(len(a), PRIME, np.uint64)
    a, b = a[:, None], b[:, None]
    for i in range(0, len(x), 256):
        r = a * x[i : i + 256]
        r += b
        quotient = r // p
        quotient *= p
        r -= quotient
        np.minimum(out, r.min(1), out=out)
    return out


def shingles_of(text: str | None, n: int) -> set[str]:
    words = (text or "").lower().split()
    return {" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def signature(text: str | None, n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    if not (shingles := shingles_of(text, n)):
        return None
    x = np.array([int.from_bytes(md5(s.encode(), usedforsecurity=False).digest()) % PRIME for s in shingles], np.uint64)
    return _least(x, a, b).astype(np.uint32)  # equal or not is all that is asked of them


class _Words(dict):
    """Hashes of words, kept for the next time; no more than KEPT."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT:
            self.clear()
        return self.setdefault(word, int.from_bytes(md5(word.encode(), usedforsecurity=False).digest()[:8]))


def hashed_shingles(text: str | None, n: int, known: _Words) -> np.ndarray:
    """A number under PRIME for each shingle of shingles_of, repeats included, made from its words' hashes."""
    words = (text or "").lower().split()
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    count = max(1, len(h) - n + 1) if words else 0
    x = np.zeros(count, np.uint64)
    for k in range(min(n, len(h))):
        x = x * ODD + h[k : k + count]
    x = (x ^ (x >> np.uint64(32))) * ODD
    return (x ^ (x >> np.uint64(29))) % np.uint64(PRIME)


def signatures(docs: DataFrame, n: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, sig): 128 values of 32 bits as binary; rows without shingles are left out. Shingles are hashed word by word, as
    signatures only propose links here: others than those of `signature`."""
    a, b = parameters()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for x in slices(batches):
            hashed = (hashed_shingles(t, n, known) for t in x.column(1).to_pylist())
            sigs = [_least(h, a, b).astype(np.uint32) if len(h) else None for h in hashed]
            keep = pa.array([s is not None for s in sigs])
            yield pa.RecordBatch.from_arrays([x.column(0).filter(keep), pa.array([s.astype("<u4").tobytes() for s in sigs if s is not None], pa.binary())], ["doc_id", "sig"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, sig binary")


def with_signatures(rows: DataFrame, n: int = 5, text: str = "text") -> DataFrame:
    """The rows with `sig` in the place of their text, null where it has no shingles; a text is mapped where it lies."""
    a, b = parameters()
    rows = rows.select(*(c for c in rows.columns if c != text), text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in slices(batches):
            sigs = [signature(t, n, a, b) for t in x.columns[-1].to_pylist()]
            found = pa.array([None if s is None else s.astype("<u4").tobytes() for s in sigs], pa.binary())
            yield pa.RecordBatch.from_arrays([*x.columns[:-1], found], [*x.schema.names[:-1], "sig"])

    return rows.mapInArrow(run, rows.drop(text).withColumn("sig", F.lit(None).cast("binary")).schema)


class _Agreement:
    """Kernel over signatures: so large a share of their values agree."""

    def __init__(self, least: float) -> None:
        self.least = least

    def __call__(self, members: list[bytes]):
        sigs = np.frombuffer(b"".join(members), "<u4").reshape(-1, HASHES)
        return lambda i, others: (sigs[others] == sigs[i]).mean(1) >= self.least


def links(sigs: DataFrame, docs: DataFrame, n: int = 5, least: float = 0.8, most: int = 1024) -> DataFrame:
    """Pairs (a, b) of representatives (rep, sig) of documents (doc_id, text) that join just those whose Jaccard measure is `least`
    or more and who share a band, directly or through others."""
    size = 4 * ROWS
    band = lambda i: F.xxhash64(F.lit(i), F.substring("sig", F.lit(i * size + 1), F.lit(size)))
    keys = stored(sigs.select("rep", F.array(*(band(i) for i in range(HASHES // ROWS))).alias("keys"))).select(F.explode("keys").alias("key"), "rep")
    alike = connected_components(spanning_links(groups_of_keys(keys), sigs.select("rep", F.col("sig").alias("payload")), _Agreement(least - MARGIN), most))
    groups = stored(alike.select(F.col("root").alias("group"), F.col("node").alias("rep")))
    own = docs.join(groups.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            sets = [np.sort(np.array([int.from_bytes(md5(s.encode(), usedforsecurity=False).digest()[:8]) for s in shingles_of(t, n)], "<u8")).tobytes() for t in x.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(sets, pa.binary())], ["rep", "payload"])

    return spanning_links(groups, stored(own.mapInArrow(run, "rep long, payload binary")), JaccardOfSets(least), most)


def near_duplicates(docs: DataFrame, n: int = 5, least: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, component_id): the smallest id that links lead to; a document without links has its own."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    sigs = stored(signatures(docs, n))
    reps = stored(sigs.groupBy("sig").agg(F.min("doc_id").alias("rep")))
    roots = connected_components(links(reps, docs, n, least)).toDF("rep", "component_id")
    of_sig = reps.join(roots, "rep", "left").select("sig", F.coalesce("component_id", "rep").alias("component_id"))
    grouped = sigs.join(of_sig, "sig").select("doc_id", "component_id")
    alone = docs.select("doc_id").join(grouped.select("doc_id"), "doc_id", "left_anti")
    return grouped.union(alone.select("doc_id", F.col("doc_id").alias("component_id")))
