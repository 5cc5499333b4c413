"""Document fingerprints from prefix polynomial hashes.

The hash of a span of code points is a polynomial in a base modulo a prime below 2^31, for two primes. A modular prefix
array of a text (prefix i: the sum of c[j] * base^j over j < i) gives the hash of any span by one subtraction, so that
spans compare in constant time and the longest common extension of two places is found by binary search.

A fingerprint keeps the length, the whole text's hash, and its prefix array thinned out to the cells of a grid: the smallest
power-of-two step with at most CELLS cells, laid from the front and laid from the end, all in both moduli. A thinned-out
array is a prefix array whose places are cells: it gives the hash of any span of cells. Equal texts have equal fingerprints.
Fingerprints of different steps are compared at the coarser step, whose sums the finer one has as well. The likeness of two
fingerprints is the share of the longer text in cells that are equal at the same distance from the front, or from the end:
the longest common extensions from either end, found by binary search over span equality, and cells beyond them one by one.

Null texts are treated as empty. The likeness of two empty texts is 1, that of an empty and another text 0; different
texts have a likeness below 1.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, pick

PRIMES = (2147483647, 2147483629)
BASES = (1000003, 999983)
CELLS = 32


class Powers:
    """Powers of the bases, grown by doubling to the longest text met."""

    def __init__(self) -> None:
        self.of = [np.ones(1, np.uint64) for _ in PRIMES]

    def upto(self, n: int, k: int) -> np.ndarray:
        while len(self.of[k]) < n:
            x = self.of[k]
            self.of[k] = np.r_[x, x * np.uint64(pow(BASES[k], len(x), PRIMES[k])) % np.uint64(PRIMES[k])]
        return self.of[k][:n]


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def prefix(codes: np.ndarray, powers: Powers, k: int = 0) -> np.ndarray:
    """The prefix array in modulus k, from 0 at the start, not yet reduced: under 2^32 terms below 2^31 fit 64 bits."""
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers.upto(len(codes), k) % np.uint64(PRIMES[k]), out=out[1:])
    return out


def span_hash(sums, start: int, end: int, k: int = 0, step: int = 1) -> int:
    """A span's hash in modulus k, moved to the start of the text: equal spans have equal hashes wherever they stand. step: points for each place of sums."""
    return (int(sums[end]) - int(sums[start])) * pow(BASES[k], -start * step, PRIMES[k]) % PRIMES[k]


def spans_equal(a: list, i: int, b: list, j: int, n: int, step: int = 1) -> bool:
    """Whether n places from i of one text and from j of the other are equal, by their prefix arrays in all moduli."""
    if i == j:  # spans that stand at one distance needn't be moved
        return all((int(x[i + n]) - int(x[i]) - int(y[i + n]) + int(y[i])) % p == 0 for x, y, p in zip(a, b, PRIMES, strict=False))
    return all(span_hash(x, i, i + n, k, step) == span_hash(y, j, j + n, k, step) for k, (x, y) in enumerate(zip(a, b, strict=True)))


def common_extension(a: list, i: int, b: list, j: int, step: int = 1) -> int:
    """The length of the longest common run from place i of one text and j of the other, whose prefix arrays are given."""
    low, high = 0, min(len(a[0]) - 1 - i, len(b[0]) - 1 - j)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if spans_equal(a, i, b, j, mid, step) else (low, mid - 1)
    return low


def step_of(n: int) -> int:
    step = 1
    while n > CELLS * step:
        step *= 2
    return step


def fingerprint(codes: np.ndarray, powers: Powers) -> str:
    """Hex: the length (16 digits), the whole text's hash (8 for each modulus), and the grid's sums from the front and from the
    end, first all in one modulus, then in the other (8 each)."""
    n, step = len(codes), step_of(len(codes))
    sums = [[prefix(x, powers, k) for k in range(len(PRIMES))] for x in (codes, codes[::-1])]
    whole = [int(sums[0][k][-1]) % p for k, p in enumerate(PRIMES)]
    cells = np.concatenate([x[k][step::step] % np.uint64(p) for x in sums for k, p in enumerate(PRIMES)])
    return f"{n:016x}" + "".join(f"{v:08x}" for v in whole) + cells.astype(">u4").tobytes().hex()


def likeness(one: str, two: str) -> float:
    """The share of the longer text in common cells, from the fingerprints alone."""
    if one == two:
        return 1.0
    n, m = sorted(int(s[:16], 16) for s in (one, two))
    if not n:
        return 0.0
    step = step_of(m)
    front, back = (_common_cells(x, y, step) for x, y in zip(_grids(one, step), _grids(two, step), strict=True))
    total = m // step
    covered = len(front | {total - 1 - k for k in back})
    return min(covered * step / m, 1 - 1 / (m + 1))


def _grids(print_: str, step: int) -> list[list[list[int]]]:
    """The prefix arrays over cells of a coarser step, from the front and from the end, in each modulus."""
    n = int(print_[:16], 16)
    cells = np.frombuffer(bytes.fromhex(print_[16 + 8 * len(PRIMES) :]), ">u4").reshape(2, len(PRIMES), -1)
    every = step // step_of(n)
    return [[[0, *c[every - 1 :: every].tolist()] for c in side] for side in cells]


def _common_cells(a: list[list[int]], b: list[list[int]], step: int) -> set[int]:
    low, last = common_extension(a, 0, b, 0, step), min(len(a[0]), len(b[0])) - 1
    return {*range(low), *(k for k in range(low, last) if spans_equal(a, k, b, k, 1))}


def edited(text: str, following: str) -> str:
    """The text with its last half (rounded down) replaced by as many first code points of the following one, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _work(schema: pa.Schema):
    """Over rows (doc_id, text, part, ahead) in that order of parts: a result for each row that is not ahead, from the row after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, held = Powers(), None
        for batch in batches:
            out = []
            for i, t, ahead in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "ahead")), strict=True):
                if ahead and not held:
                    continue
                own = fingerprint(points(t), powers)
                if held:
                    j, u, before = held
                    new = edited(u, t)
                    new_print = fingerprint(points(new), powers)
                    out.append((j, len(u), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), before, new_print, likeness(before, new_print), likeness(before, own)))
                held = None if ahead else (i, t, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, k.type) for v, k in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def edit_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each row: n_chars, the edited text's sha256, both fingerprints, and the likeness of the text's fingerprint to the
    edited text's and to that of the next document, in order of (doc_id, text), nulls first; after the last comes the first.

    Texts are shuffled once, into ranges of ids whose first ids the table has; the first row of a range is sent to the
    range before it as well, so that each range is worked through alone. Rows of one id are in one range, in order of their
    texts. A single row is its own next; an empty table gives no rows.
    """
    from .common import _arrow_schema

    spark = docs.sparkSession
    rows = pick(docs, doc_id, text).toDF("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {RESULT}"
    ranged = rows.select("doc_id").repartitionByRange(partitions(spark), F.col("doc_id").asc_nulls_first()).groupBy(F.spark_partition_id().alias("part"))
    firsts = ranged.agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id")).alias("first"))
    cuts = [r["first"]["doc_id"] for r in firsts.orderBy("part").collect()]  # one for each range
    if not cuts:
        return spark.createDataFrame([], schema)
    edges, names = np.array(cuts[1:]), ["doc_id", "text", "part", "ahead"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, t = b.column(0), b.column(1).cast(pa.string()).fill_null("")
            part = np.array([0 if i is None else np.searchsorted(edges, i, side="right") for i in ids.to_pylist()], np.int32)
            yield pa.RecordBatch.from_arrays([ids, t, pa.array(part), pa.array(np.zeros(len(part), bool))], names)
            at = [k for k, (i, p) in enumerate(zip(ids.to_pylist(), part, strict=True)) if i == cuts[p]]
            if at:
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), t.take(pa.array(at)), pa.array((part[at] - 1) % np.int32(len(cuts))), pa.array(np.ones(len(at), bool))], names)

    dealt = rows.mapInArrow(deal, f"doc_id {kind}, text string, part int, ahead boolean").repartitionById(len(cuts), "part")
    return dealt.sortWithinPartitions("part", "ahead", F.col("doc_id").asc_nulls_first(), "text").mapInArrow(_work(_arrow_schema(spark, schema)), schema)
