"""SimHash near-dedup with pivot distance tables.

A text's fingerprint has a bit set where over half of the XXH64 hashes (seed 42) of its word shingles have it, repeats
counted. Fingerprints that differ in at most `distance` bits are linked; links join documents into components.

Linking, over distinct fingerprints, so that copies cost one row: a fingerprint is cut into `distance + 2` blocks, and has a
table of its Hamming distances to CELL_PIVOTS reference fingerprints within each block. Two linked fingerprints are equal in
at least two blocks, and so are their distances there: the distances of each pair of blocks name a cell, and the pairs of
fingerprints that share a cell are the candidates, which is complete. The references tell nearly all values of a block apart,
so that a cell's expected size is n / 2^32 for the default of four blocks. Within a cell, the distances of its fingerprints to
PIVOTS references over all bits are computed once; by the triangle inequality a pair whose tables differ by more than
`distance` in any coordinate is discarded, and the survivors are verified by their own Hamming distance. A cell gives links
that join its members, not all its pairs. A cell of more than `most_in_bucket` fingerprints isn't compared in one task: its
members meet by exact keys instead, each fingerprint with up to distance / 2 of its bits flipped (65 keys at the default;
`distance` is even), which is linear in members and complete as well.

Null, empty and blank texts have fingerprint zero and link like any other; texts of fewer words than a shingle are one
shingle. Repeated rows, and rows of one id, are documents of their own with one component. Rows with a null id get a
component's smallest id, which is null only if no member has an id. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from . import hyperminhash
from .common import arrow_map, partitions, pick, place, stored, texts

#: References over all bits, and those whose distances within a block name cells.
PIVOTS, CELL_PIVOTS = 24, 16
#: Rows of shingle bits summed at once.
_ROWS = 1 << 16


def fingerprint(text: bytes | None, k: int = 3) -> int:
    """Of UTF-8 bytes. bytes.lower and bytes.split treat just A-Z and ASCII white space, as the definition asks."""
    w = text.lower().split() if text else []
    if not w:
        return 0
    grams = map(b" ".join, zip(*(w[i:] for i in range(k)), strict=False)) if len(w) > k else iter([b" ".join(w)])
    n = max(1, len(w) - k + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), "<u8", n)
    set_bits = sum(np.unpackbits(hashes[i : i + _ROWS].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64) for i in range(0, n, _ROWS))
    return int(np.packbits(set_bits * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of each row as a signed long."""

    def of(batch: pa.RecordBatch) -> dict:
        fps = np.array([fingerprint(t, k) for t in texts(batch.column(1))], np.uint64)
        return {"doc_id": batch.column(0), "fp": pa.array(fps.view(np.int64))}

    plain = pick(docs, doc_id, text).toDF("doc_id", "text")
    return arrow_map(plain, of, f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, fp long")


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints, from their numbers."""
    return np.array([xxhash.xxh64_intdigest(str(i)) for i in range(n)], np.uint64)


def _links(keys: np.ndarray, fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that join what is linked within runs of equal keys."""
    bounds = np.flatnonzero(np.diff(keys)) + 1
    starts, ends = np.r_[0, bounds], np.r_[bounds, len(keys)]
    out, refs = [], pivots()
    for s, e in zip(starts, ends, strict=True):
        if e - s < 2:
            continue
        x = fps[s:e]
        table = np.bitwise_count(x[:, None] ^ refs).astype(np.int8)
        group = np.arange(len(x))
        for i in range(1, len(x)):
            near = np.flatnonzero(np.abs(table[:i] - table[i]).max(1) <= distance)
            near = near[np.bitwise_count(x[near] ^ x[i]) <= distance]
            joined, first = np.unique(group[near], return_index=True)
            out += [(int(x[i]), int(x[near[j]])) for j in first]
            if len(joined):
                group[: i + 1][np.isin(group[: i + 1], [*joined, i])] = joined[0]
    return out


def _bucket_links(distance: int, most: int):
    """Over rows (key, fp) sorted by key: links (a, b), and (a, null) for each member of a larger bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps, large = np.empty(0, np.int64), np.empty(0, np.uint64), None

        def out(pairs=(), alone=()) -> pa.RecordBatch:
            a = np.array([*(p[0] for p in pairs), *alone], np.uint64).view(np.int64)
            b = np.array([*(p[1] for p in pairs), *(0 for _ in alone)], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=np.arange(len(a)) >= len(pairs))], ["a", "b"])

        for batch in batches:
            keys = np.r_[keys, batch.column(0).to_numpy()]
            fps = np.r_[fps, batch.column(1).to_numpy().view(np.uint64)]
            cut = np.searchsorted(keys, keys[-1]) if len(keys) else 0  # the last bucket may go on
            done, rest = _split_large(keys[:cut], fps[:cut], large, most)
            yield out(_links(*done, distance), rest)
            keys, fps = keys[cut:], fps[cut:]
            if len(keys) > most or (len(keys) and keys[0] == large):
                large = keys[0]
                yield out(alone=fps)
                keys, fps = keys[:0], fps[:0]
        done, rest = _split_large(keys, fps, large, most)
        yield out(_links(*done, distance), rest)

    return run


def _split_large(keys, fps, large, most):
    """The rows of buckets to compare, and the members of larger ones."""
    _, back, n = np.unique(keys, return_inverse=True, return_counts=True)
    too = (n[back] > most) | (keys == large if large is not None else False)
    return (keys[~too], fps[~too]), fps[too]


def block_distances(fp: Column, block: int, blocks: int) -> list[Column]:
    """The Hamming distances of fingerprints to CELL_PIVOTS references within a block of their bits."""
    first, end = 64 * block // blocks, 64 * (block + 1) // blocks
    own = F.shiftrightunsigned(fp, first).bitwiseAND((1 << (end - first)) - 1)
    return [F.bit_count(own.bitwiseXOR(int(p) >> first & (1 << (end - first)) - 1)) for p in pivots(CELL_PIVOTS)]


def link(fps: DataFrame, distance: int = 2, most_in_bucket: int = 1024) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp), enough to join all that differ in at most `distance` bits."""
    if distance < 2 or distance % 2:
        raise ValueError("distance is even: the keys of large buckets flip half of it on either side")
    table = [block_distances(F.col("fp"), b, distance + 2) for b in range(distance + 2)]
    key = [F.xxhash64(F.lit(i), *table[a], *table[b]) for i, (a, b) in enumerate(combinations(range(distance + 2), 2))]
    distinct = fps.select("fp").distinct()
    rows = distinct.select(F.explode(F.array(*key)).alias("key"), "fp")
    rows = rows.repartition(partitions(fps.sparkSession), "key").sortWithinPartitions("key")
    found = stored(rows.mapInArrow(_bucket_links(distance, most_in_bucket), "a long, b long"))
    links, large = found.where("b is not null"), found.where("b is null").select("a").distinct()
    return links if large.isEmpty() else links.union(_flip_links(large, distance))


def _flip_links(large: DataFrame, distance: int) -> DataFrame:
    """Each fingerprint meets another at a key that half of the differing bits lead to from either side."""
    bits = [0, *(1 << i for i in range(63)), -(1 << 63)]
    at = large.select("a", F.col("a").alias("key"))
    for _ in range(distance // 2):
        at = at.select("a", F.explode(F.array(*(F.col("key").bitwiseXOR(F.lit(b).cast("long")) for b in bits))).alias("key")).distinct()
    least = at.groupBy("key").agg(F.min("a").alias("b"))
    return at.join(least, "key").where("a <> b").select("a", "b").distinct()


def near_duplicates(docs: DataFrame, k: int = 3, distance: int = 2, most_in_bucket: int = 1024, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row: 16 hex digits, and the smallest id of its component."""
    fps = stored(fingerprints(docs, k, doc_id, text))
    roots = connected_components(link(fps, distance, most_in_bucket)).toDF("fp", "root")
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    least = least.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    of_root = least.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = least.join(of_root, "root").select("fp", "component_id")
    return fps.join(of_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def similar_documents(docs: DataFrame, words: int = 5, least: float = 0.8, distance: int = 2) -> DataFrame:
    """(node, root) of documents (key, text) in groups: joined by fingerprints of so many words' shingles that differ in at
    most `distance` bits, or by a Jaccard measure of `least` or more over those shingles.

    Two bits catch few pairs at a measure of 0.8, where a tenth of the bits differ, and no bucket key that is complete for
    a tenth of 64 bits is selective. So candidates for that measure come from bands of HyperMinHash registers (which miss a
    pair at 0.8 once in 10^5 pairs), and full sets confirm each link."""
    close = near_duplicates(docs, words, distance, doc_id="key").select("doc_id", "component_id")
    alike = hyperminhash.near_duplicates(docs, words, least, doc_id="key").select("doc_id", "component_id")
    return connected_components(close.union(alike).where("doc_id <> component_id").toDF("a", "b"))


def deduplicated(docs: DataFrame, words: int = 5, least: float = 0.8, distance: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group of similar_documents: the row with the smallest id (nulls last; of equal ids that of the
    smaller hash of 128 bits), and of rows that agree in id and text the first in the order of their other columns."""
    columns = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(columns))))
    own, content = (f"c{place(columns, x)}" for x in (doc_id, text))
    key = F.struct(F.xxhash64(F.col(own).cast("string"), F.lit("|"), content).alias("a"), F.xxhash64(F.lit(1), F.col(own).cast("string"), F.lit("|"), content).alias("b"))
    rows = plain.select(key.alias("key"), F.col(own).alias("id"), F.col(content).alias("text"))
    groups = similar_documents(rows.select("key", "text"), words, least, distance)
    named = rows.select("key", "id").join(groups, F.col("key") == F.col("node"), "left").select("key", "id", F.coalesce("root", "key").alias("root"))
    first = named.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("f"))
    kept = stored(first.select(F.col("f.key").alias("_key")))
    out = plain.withColumn("_key", key).join(kept, "_key", "left_semi")
    many = stored(named.groupBy("key").count().where("count > 1").select(F.col("key").alias("_key")))
    if not many.isEmpty():
        again = out.join(many, "_key", "left_semi").groupBy("_key").agg(F.min(F.struct(*plain.columns)).alias("r")).select("_key", "r.*")
        out = out.join(many, "_key", "left_anti").unionByName(again)
    return out.select(*plain.columns).toDF(*columns)
