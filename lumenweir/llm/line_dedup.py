"""Line dedup by pairwise alignment: documents that overlap are found through the rare runs of lines that they share, aligned
as patience diff does, and the common blocks are deleted from the later one.

Only lines with words count, so that blank lines don't break blocks. A line's hash is that of its words, ASCII letters
lower-cased and signs dropped. Short lines are anywhere; so the key of a line is the shortest run of lines from it, and the
shortest run up to it, that has `min_words` words: for a line of so many words the line itself. Every line of a block of
`min_words` words that two documents have in common lies in such a run within the block, and every such run is a block;
so the keys that an earlier document has as well cover just the lines that are to go, however the block's other keys are
spread over documents. A shared key names one pair for each later document: that document and the key's earliest holder.
A key of any frequency, rare or in a third of all documents, so costs one row per document, and no group is paired with
itself. Of a pair, the keys that either document has once are the anchors; their longest increasing run of places is the
alignment, by patience sorting, and keys beside it on an anchor's diagonal belong to it. Blocks that the alignment leaves
are moved or repeated ones; they are deleted as well, unless `moved` is False. Lines without words between deleted lines go.

Documents are ordered by (doc_id, text hash); a document is its id and text, so that rows repeated as a whole are one
document and no duplicate of themselves. Rows with a null id or text pass unchanged. A text whose lines are all deleted
becomes empty. Empty tables give no rows; texts without lines of words share nothing. Only lines' hashes and places are
shuffled to find overlaps; texts are joined once to what is to be deleted from them.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _arrow_schema, arrow_map, pick, place, stored, texts, without
from .decontamination import words

#: Words of a block that is deleted, at least.
MIN_WORDS = 8


def line_keys(docs: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, doc, place, first, end, hash, only) of each shortest run of lines with so many words; doc: the text's hash;
    place: of its first line among lines with words; first, end: among all lines; only: the key is in its text once."""
    rows = pick(docs, doc_id, text).toDF("doc_id", "text").where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("doc"), "text")

    def of(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("at", "place", "first", "end", "hash", "only")}
        for i, t in enumerate(texts(batch.column(2))):
            lines = [(at, w) for at, x in enumerate(t.split(b"\n")) if (w := words(x))]
            found = runs([len(w) for _, w in lines], min_words)
            hashes = [xxhash.xxh64_intdigest(b" ".join(w)) - (1 << 63) for _, w in lines] if found else []
            keys = [hashes[a] if b == a + 1 else xxhash.xxh64_intdigest(np.array(hashes[a:b], np.int64).tobytes()) - (1 << 63) for a, b in found]
            n = Counter(keys)
            out["at"] += [i] * len(keys)
            out["place"] += [a for a, _ in found]
            out["first"] += [lines[a][0] for a, _ in found]
            out["end"] += [lines[b - 1][0] + 1 for _, b in found]
            out["hash"] += keys
            out["only"] += [n[k] == 1 for k in keys]
        at = pa.array(out["at"], pa.int64())
        return out | {"doc_id": batch.column(0).take(at), "doc": batch.column(1).take(at)}

    return arrow_map(rows, of, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, doc long, place int, first int, end int, hash long, only boolean")


def runs(n: list[int], least: int) -> list[tuple[int, int]]:
    """The shortest runs of lines, as (first, end), that begin or that end at each line and have `least` words; n: words of each line."""
    upto = np.r_[0, np.cumsum(n)]
    ends = np.searchsorted(upto, upto[:-1] + least)
    firsts = np.searchsorted(upto, upto[1:] - least, side="right") - 1
    return sorted({(a, int(b)) for a, b in enumerate(ends) if b < len(upto)} | {(int(a), b + 1) for b, a in enumerate(firsts) if a >= 0})


def shared_keys(keys: DataFrame) -> DataFrame:
    """For each key and each later document that holds it, its place there and in the earliest holder (place of its first)."""
    key = F.struct("doc_id", "doc")
    first = keys.groupBy("hash").agg(F.min(F.struct("doc_id", "doc", "place", "only")).alias("f"), F.max(key).alias("last"))
    first = stored(first.where(F.struct("f.doc_id", "f.doc") != F.col("last")).select("hash", "f"))  # read again, so that the join can split a frequent key
    return keys.join(first, "hash").where(F.struct("doc_id", "doc") != F.struct("f.doc_id", "f.doc")).select(
        "doc_id", "doc", "place", "first", "end", F.col("f.doc_id").alias("of_id"), F.col("f.doc").alias("of_doc"), F.col("f.place").alias("of_place"), (F.col("only") & F.col("f.only")).alias("anchor")
    )


def aligned_blocks(rows: list[tuple[int, int, int, int, bool]]) -> list[tuple[int, int, bool]]:
    """Lines to delete from the later document of a pair, as (first, end, moved), from its shared keys (place, other place, first, end, anchor)."""
    anchors = sorted({(p, q) for p, q, _, _, anchor in rows if anchor})
    along = _increasing(anchors) if anchors else []
    places = np.array([p for p, _ in along])
    out: list[list] = []
    for p, q, first, end, _ in sorted(rows, key=lambda r: r[2:4]):
        at = int(np.searchsorted(places, p, side="right"))
        moved = not any(0 <= k < len(along) and along[k][0] - p == along[k][1] - q for k in (at - 1, at))
        if out and first <= out[-1][1] and out[-1][2] == moved:
            out[-1][1] = max(end, out[-1][1])
        else:
            out.append([first, end, moved])
    return [tuple(x) for x in out]


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs (sorted, not none) whose second places increase as the first do, by patience sorting."""
    tops, piles, back = [], [], []
    for i, (_, q) in enumerate(pairs):
        at = bisect_left(tops, q)
        tops[at : at + 1] = [q]
        piles[at : at + 1] = [i]
        back.append(piles[at - 1] if at else None)
    out, i = [], piles[-1]
    while i is not None:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def deletions(docs: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, doc, first, end, moved): the lines of each block that is deleted, by their places in the text; blocks may overlap."""
    keys = stored(line_keys(docs, min_words, doc_id, text))
    kind = keys.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, doc long, first int, end int, moved boolean"
    kinds = _arrow_schema(docs.sparkSession, schema)
    dealt = shared_keys(keys).repartition("doc_id", "doc").sortWithinPartitions("doc_id", "doc", "of_id", "of_doc", "place")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, held = None, []
        for b in batches:
            out = []
            for i, d, p, first, end, oi, od, op, anchor in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if pair != (i, d, oi, od):
                    out += [(*pair[:2], *x) for x in aligned_blocks(held)] if pair else []
                    pair, held = (i, d, oi, od), []
                held.append((p, op, first, end, anchor))
            if out:
                yield _table(out, kinds)
        if pair:
            yield _table([(*pair[:2], *x) for x in aligned_blocks(held)], kinds)

    return dealt.mapInArrow(blocks, schema)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, k.type) for v, k in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS, moved: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with the deleted blocks cut out of their texts, and lines_deleted (long): how many lines went.
    A column of that name is replaced."""
    docs = without(docs, "lines_deleted")
    gone = deletions(docs, min_words, doc_id, text).where(F.lit(moved) | ~F.col("moved"))
    gone = gone.groupBy(F.col("doc_id").alias("_id"), F.col("doc").alias("_doc")).agg(F.collect_list(F.struct("first", "end")).alias("_gone"))  # one document's blocks
    columns = docs.columns
    plain, at = docs.toDF(*(f"c{i}" for i in range(len(columns)))), place(columns, text)
    same = (F.col(f"c{place(columns, doc_id)}") == F.col("_id")) & (F.xxhash64(f"c{at}") == F.col("_doc"))
    joined = plain.join(gone, same, "left").select(*plain.columns, "_gone")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema) + ", lines_deleted long"

    def cut(batch: pa.RecordBatch) -> dict:
        blocks = batch.column(len(columns))
        some = np.flatnonzero(blocks.is_valid().to_numpy(zero_copy_only=False))
        if not len(some):
            return {f"c{i}": c for i, c in enumerate(batch.columns[:-1])} | {"lines_deleted": np.zeros(len(batch), np.int64)}
        new, n = batch.column(at).to_pylist(), np.zeros(len(batch), np.int64)
        for i in some:
            lines = new[i].split("\n")
            keep = np.ones(len(lines), bool)
            for s in blocks[i].as_py():
                keep[s["first"] : s["end"]] = False
            cuts = np.flatnonzero(~keep)
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a + 1 and not any(words(x.encode()) for x in lines[a + 1 : b]):
                    keep[a:b] = False
            new[i] = "\n".join(x for x, k in zip(lines, keep, strict=True) if k)
            n[i] = (~keep).sum()
        return {f"c{i}": c for i, c in enumerate(batch.columns[:-1])} | {f"c{at}": pa.array(new, pa.string()), "lines_deleted": n}

    return arrow_map(joined, cut, schema).toDF(*columns, "lines_deleted")
