"""Near duplicates by HyperMinHash sketches.

A text's set is its distinct word shingles. Their 64-bit hashes fall into BUCKETS buckets, and a bucket keeps its smallest
hash, remixed, as a register of 16 bits: the number of leading zeros, and the MANTISSA bits after the first one. Bands of
ROWS registers are keys; documents that share a key are candidates, unless all of its registers are empty. Candidates' sizes
and registers are compared first: the share of equal registers among those that either has, less the share that would be
equal by chance for sets of these sizes, estimates the Jaccard measure. Pairs whose estimate is less than `least` by over
DEVIATIONS standard deviations are discarded; the others join groups, within which full sets are compared, each sent once.
Only links that full sets confirm count. At a measure of 0.85 all bands miss a pair of large sets once in 10^7 pairs; of
small sets each differing shingle changes one register at most.

Equal texts are one member, so that copies cost one row; groups are compared by operators.linking, which loses no link and
emits no group's pairs. What is shuffled: sketches of members that share a key, all texts once by their hash (copies are
dropped in the tasks), and the sets of candidates.

Null, empty and blank texts have no shingles and are linked with nothing. Texts of fewer words than a shingle are one
shingle. Rows of one id are documents of their own; a null id is no component's smallest, unless all its ids are null. An
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..operators.linking import JaccardOfSets, groups_of_keys, spanning_links
from .common import WordHashes, arrow_map, chunks, pick, stored, texts

BANDS, ROWS, MANTISSA = 30, 5, 10
BUCKETS = BANDS * ROWS
EMPTY = 0xFFFF
#: How far below the threshold, in standard deviations, an estimate may be for its pair to be compared by full sets.
DEVIATIONS = 5.0
_BASE = 0x9E3779B97F4A7C15
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _mixed(h: np.ndarray) -> np.ndarray:
    """64-bit numbers, stirred so that each bit depends on all."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(_MIX[0])
    h = (h ^ (h >> np.uint64(27))) * np.uint64(_MIX[1])
    return h ^ (h >> np.uint64(31))


def words(text: bytes | None) -> list[bytes]:
    """bytes.lower and bytes.split treat just A to Z and ASCII white space."""
    return text.lower().split() if text else []


def shingle_sets(all_words: list[list[bytes]], hashes: WordHashes, k: int = 3):
    """The sorted hashes of each document's distinct shingles."""
    for a, b in chunks(all_words):
        flat = hashes.of([w for x in all_words[a:b] for w in x])
        rolled = flat.copy()
        power = 1
        for j in range(1, k):  # a polynomial of the words' hashes, modulo 2^64
            power = power * _BASE & (1 << 64) - 1
            rolled[: max(0, len(flat) - j)] += flat[j:] * np.uint64(power)
        at = 0
        for x in all_words[a:b]:
            n = len(x)
            if n >= k:
                yield np.unique(_mixed(rolled[at : at + n - k + 1]))
            elif n:
                h = n
                for v in flat[at : at + n].tolist():
                    h = (h * _BASE + v) & (1 << 64) - 1
                yield _mixed(np.array([h], np.uint64))
            else:
                yield np.empty(0, np.uint64)
            at += n


def registers(sorted_hashes: np.ndarray) -> np.ndarray:
    """The sketch of a set: for each bucket the leading zeros and mantissa of its smallest hash, or EMPTY."""
    out = np.full(BUCKETS, EMPTY, np.uint16)
    if len(sorted_hashes):
        bucket = ((sorted_hashes >> np.uint64(32)) * np.uint64(BUCKETS) >> np.uint64(32)).astype(np.int64)
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        least = np.minimum.reduceat(_mixed(sorted_hashes), starts) | np.uint64(1)
        zeros = 63 - np.minimum(np.frexp(least.astype(np.float64))[1] - 1, 63).astype(np.int64)
        zeros += (least << zeros.astype(np.uint64) >> np.uint64(63) == 0).astype(np.int64)  # where rounding up gave one bit more
        mantissa = least << zeros.astype(np.uint64) << np.uint64(1) >> np.uint64(64 - MANTISSA)
        out[bucket[starts]] = (zeros.astype(np.uint64) << np.uint64(MANTISSA) | mantissa).astype(np.uint16)
    return out


def chance(n: np.ndarray | int, others: np.ndarray) -> np.ndarray:
    """The share of registers that two sets without a common shingle have equal, of those that either has."""
    step = 0.5 ** np.arange(64)

    def of(m):  # the chance of each number of leading zeros: the smallest of so many hashes lies between two powers
        rate = np.asarray(m, float)[..., None] / BUCKETS
        return np.exp(-rate * step / 2) - np.exp(-rate * step)

    some = 1 - np.exp(-(np.asarray(n, float) + others) / BUCKETS)
    return (of(n) * of(others)).sum(-1) / (1 << MANTISSA) / np.maximum(some, 1e-12)


class Estimate:
    """Kernel over (size as 8 bytes, registers): the corrected estimate is not below `least` by over DEVIATIONS deviations."""

    def __init__(self, least: float) -> None:
        self.least = least

    def __call__(self, members: list[bytes]) -> Callable[[int, np.ndarray], np.ndarray]:
        sizes = np.frombuffer(b"".join(m[:8] for m in members), "<i8")
        table = np.frombuffer(b"".join(m[8:] for m in members), "<u2").reshape(-1, BUCKETS)

        def linked(i: int, others: np.ndarray) -> np.ndarray:
            n, of = sizes[i], sizes[others]
            out = np.minimum(n, of) >= self.least * np.maximum(n, of) - 1e-9
            js = others[out]
            own, theirs = table[i], table[js]
            used = ((own != EMPTY) | (theirs != EMPTY)).sum(1)
            equal = ((own == theirs) & (own != EMPTY)).sum(1)
            by_chance = chance(n, sizes[js])
            measure = (equal / used - by_chance) / (1 - by_chance)
            out[out] = measure >= self.least - DEVIATIONS * np.sqrt(self.least * (1 - self.least) / used)
            return out

        return linked


def sketches(docs: DataFrame, k: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, key, n_shingles, payload): the text's 128-bit key, the size of its set, and size and registers as bytes."""
    kept: list[WordHashes] = []

    def of(batch: pa.RecordBatch) -> dict:
        kept[:] = kept or [WordHashes()]
        sets = list(shingle_sets([words(t) for t in texts(batch.column(2))], kept[0], k))
        sizes = [len(s) for s in sets]
        sketched = pa.array([n.to_bytes(8, "little") + registers(s).astype("<u2").tobytes() for n, s in zip(sizes, sets, strict=True)], pa.binary())
        return {"doc_id": batch.column(0), "key": batch.column(1), "n_shingles": sizes, "payload": sketched}

    plain = pick(docs, doc_id, text).toDF("doc_id", "text").select("doc_id", text_key("text").alias("key"), "text")
    return arrow_map(plain, of, f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, key struct<a: long, b: long>, n_shingles long, payload binary")


def text_key(text: str):
    """128 bits of two hashes; null as the empty text."""
    own = F.coalesce(F.col(text), F.lit(""))
    return F.struct(F.xxhash64(own).alias("a"), F.xxhash64(F.lit(1), own).alias("b"))


def _sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(rep, payload): the sets of the texts (key, rep) that are wanted, from the documents (key, text)."""
    kept: list[WordHashes] = []

    def of(batch: pa.RecordBatch) -> dict:
        kept[:] = kept or [WordHashes()]
        sets = shingle_sets([words(t) for t in texts(batch.column(1))], kept[0], k)
        return {"rep": batch.column(0), "payload": pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())}

    one_of_each = docs.groupBy("key").agg(F.first("text").alias("text"))  # copies are dropped before the shuffle
    return arrow_map(one_of_each.join(wanted, "key").select("rep", "text"), of, "rep long, payload binary")


def near_duplicates(docs: DataFrame, k: int = 3, least: float = 0.85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row: the size of its set, the smallest id that links of `least` or more
    lead to, itself included, and whether that is its own."""
    found = stored(sketches(docs, k, doc_id, text))
    distinct = found.where("n_shingles > 0").groupBy("key").agg(F.first("payload").alias("payload"), F.min("doc_id").alias("least"))
    reps = stored(distinct.withColumn("rep", F.monotonically_increasing_id()))

    size = 2 * ROWS
    band = lambda i: F.substring("payload", F.lit(9 + i * size), F.lit(size))
    some = lambda i: F.when(band(i) != F.lit(b"\xff" * size), F.xxhash64(F.lit(i), band(i)))
    keys = stored(reps.select("rep", F.array_compact(F.array(*(some(i) for i in range(BANDS)))).alias("keys"))).select(F.explode("keys").alias("key"), "rep")
    alike = connected_components(spanning_links(groups_of_keys(keys), reps.select("rep", "payload"), Estimate(least)))
    groups = stored(alike.select(F.col("root").alias("group"), F.col("node").alias("rep")))
    wanted = reps.select("key", "rep").join(groups.select("rep"), "rep")
    sets = stored(_sets(pick(docs, text).toDF("text").select(text_key("text").alias("key"), "text"), wanted, k))
    roots = connected_components(spanning_links(groups, sets, JaccardOfSets(least))).toDF("rep", "root")

    named = reps.select("rep", "key", "least").join(roots, "rep", "left").select("key", F.coalesce("root", "rep").alias("root"), "least")
    of_root = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_key = named.join(of_root, "root").select("key", "component_id")
    joined = found.drop("payload").where("n_shingles > 0").join(of_key, "key").select("doc_id", "n_shingles", "component_id")
    alone = found.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return joined.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
