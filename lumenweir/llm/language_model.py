"""Stupid-backoff language-model scores over word n-grams of orders 1 to ORDER.

Words are runs without ASCII white space, ASCII letters lower-cased; all words are in the vocabulary. A word scores
count(n-gram) / count(n-gram without it) for the longest n-gram that ends there, in its text, and occurs at least `least`
times in the corpus; each order that is stepped down costs a factor of BACKOFF, and a word alone scores its count / words of
the corpus. Counts are those of all documents; the cut-off keeps a document from being scored by n-grams that it alone has.
Per document the logarithms are summed.

An n-gram is known by a hash of _KEY_BITS bits, mixed from its words' XXH64, so that no table of words is sent anywhere. A block
(BLOCK_BYTES of a batch's documents) takes its n-grams as distinct keys with their counts in it, and deals them by ranges of
the key: a part adds up the counts of its keys over all blocks, and gives each block the sums of that block's keys in their
order. A frequent n-gram is one key of a block like any other, so that no part is uneven. The block's own row (documents,
places of words, hashes of words) meets the sums again, which are in the order that the keys give. Keys and counts travel as
compressed byte planes, keys as sorted differences: as a row for each n-gram and document they take more disk than the
corpus has bytes (see the README). The number of parts follows the bytes of text. The words of the corpus are those of all
results, which are written first.

Null, empty and blank texts have no words: score 0, mean null. Repeated rows are scored each for itself, and count each.
An empty table gives no rows. Long texts are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, _arrow_schema, partitions, pick, stored, texts

ORDER, BACKOFF = 3, 0.4
#: Text of a block, about: what bounds a worker's memory; text of a part.
BLOCK_BYTES, PART_BYTES = 8_000_000, 8_000_000
#: Bits of a key: of 10 billion n-grams one in two million shares another's count.
_KEY_BITS = 54
_MASK = np.uint64((1 << _KEY_BITS) - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of about BLOCK_BYTES of text together; a longer text is a slice of its own."""
    for batch in batches:
        at, n = 0, 0
        sizes = pa.compute.binary_length(batch.column(1)).fill_null(0).to_pylist()
        for i, size in enumerate(sizes):
            if n and n + size > BLOCK_BYTES:
                yield batch.slice(at, i - at)
                at, n = i, 0
            n += size
        if at < batch.num_rows:
            yield batch.slice(at)


def _planes(x: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes(), 6)


def _unplaned(raw: bytes, kind: str) -> np.ndarray:
    raw, size = zstandard.decompress(raw), np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, len(raw) // size).T).reshape(-1).view(kind)


def _schemas(kind: str) -> tuple[str, str]:
    own = f"doc_ids array<{kind}>, n_words array<long>, words binary, hashes binary"
    return f"part int, block long, keys binary, counts binary, {own}", f"block long, part int, counts binary, {own}"


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), k.type) for c, k in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _keys(flat: np.ndarray, n: np.ndarray, order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of documents' word hashes, one after the other: each word's place in its document, and for each order the keys of the
    n-grams that end at the words that have one, in their order."""
    place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    key, out = flat, [flat]
    for k in range(1, order):
        key = np.r_[np.zeros(min(len(key), 1), np.uint64), key[:-1] * _MIX] + flat + np.uint64(k)
        out.append(key[place >= k] & _MASK)
    return place, out


def _explode(order: int, parts: int, schema: pa.Schema):
    """Blocks: for each part the keys of a slice and their counts in it; and one row of its documents and words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = WordHashes()
        for i, batch in enumerate(_slices(batches)):
            block = TaskContext.get().partitionId() << 32 | i
            split = [hashed.of(words(t)) for t in texts(batch.column(1))]
            n = np.array([len(x) for x in split], np.int64)
            flat = np.concatenate([*split, np.zeros(0, np.uint64)]) & _MASK
            hashes, at, n_words = np.unique(flat, return_inverse=True, return_counts=True)
            ranked = np.argsort(-n_words, kind="stable")  # frequent words get small numbers, which compress
            number = np.empty(len(ranked), np.uint32)
            number[ranked] = np.arange(len(ranked), dtype=np.uint32)
            keys, counts = np.unique(np.concatenate(_keys(flat, n, order)[1]), return_counts=True)
            part = (keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(_KEY_BITS - 32)
            present, first = np.unique(part, return_index=True)
            ends = np.r_[first[1:], len(part)][: len(first)]
            counts = counts.astype(np.uint32)
            rows = [(int(p), block, _planes(np.diff(keys[s:e], prepend=np.uint64(0))), _planes(counts[s:e]), None, None, None, None) for p, s, e in zip(present, first, ends, strict=True)]
            rows.append((block % parts, block, None, None, batch.column(0).to_pylist(), n, _planes(number[at]), _planes(np.diff(hashes[ranked], prepend=np.uint64(0)))))
            yield _table(rows, schema)

    return run


def _count(schema: pa.Schema):
    """Over blocks sorted by part: the sums of each part's keys over all blocks, for each block in the order of its keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finish(part: int | None, held: list[tuple]) -> Iterator[pa.RecordBatch]:
            if not held:
                return
            ends = np.cumsum([len(k) for _, k, _ in held])
            _, at = np.unique(np.concatenate([k for _, k, _ in held]), return_inverse=True)
            n = np.bincount(at, np.concatenate([c for _, _, c in held])).astype(np.int64)
            for i in range(0, len(held), 64):
                yield _table([(block, part, _planes(n[at[e - len(k) : e]]), None, None, None, None) for (block, k, _), e in zip(held[i : i + 64], ends[i : i + 64], strict=True)], schema)

        part, held = None, []
        for b in batches:
            for i, p in enumerate(b.column(0).to_pylist()):
                if p != part:
                    yield from finish(part, held)
                    part, held = p, []
                if b.column(2)[i].is_valid:
                    held.append((b.column(1)[i].as_py(), np.cumsum(_unplaned(b.column(2)[i].as_py(), "u8")), _unplaned(b.column(3)[i].as_py(), "u4")))
                else:
                    yield _table([(b.column(1)[i].as_py(), None, None, *(b.column(k)[i].as_py() for k in (4, 5, 6, 7)))], schema)
        yield from finish(part, held)

    return run


def _add_up(order: int, least: int, schema: pa.Schema):
    """Over rows sorted by block, the row of its documents first and its sums by part: a row for each document, with how
    many of its words are to be divided by the words of the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, []

        def out() -> pa.RecordBatch:
            ids, n = now[0], np.array(now[1], np.int64)
            flat = np.cumsum(_unplaned(now[3], "u8"))[_unplaned(now[2], "u4")] if n.sum() else np.zeros(0, np.uint64)
            place, keys = _keys(flat, n, order)
            _, of = np.unique(np.concatenate(keys), return_inverse=True)
            logs = np.log(np.concatenate([*sums, np.zeros(0, np.int64)]))
            ends, cut = np.cumsum([len(k) for k in keys]), np.log(least) - 1e-9
            alone = before = logs[of[: ends[0]]]
            score, found = alone + np.log(BACKOFF) * np.minimum(place, order - 1), np.zeros(len(flat), bool)
            for k in range(1, order):
                has = np.flatnonzero(place >= k)
                own = np.full(len(flat), -np.inf)
                own[has] = logs[of[ends[k - 1] : ends[k]]]
                seen = has[own[has] >= cut]
                score[seen] = own[seen] - before[seen - 1] + np.log(BACKOFF) * (np.minimum(place[seen], order - 1) - k)
                found[seen], before = True, own
            doc = np.repeat(np.arange(len(n)), n)
            apart = np.bincount(doc[~found], minlength=len(n))
            return pa.RecordBatch.from_arrays([pa.array(ids, schema[0].type), pa.array(n), pa.array(np.bincount(doc, score, len(n))), pa.array(apart.astype(np.int64))], schema=schema)

        for b in batches:
            for i in range(b.num_rows):
                if b.column(2)[i].is_valid:
                    sums.append(_unplaned(b.column(2)[i].as_py(), "i8"))
                else:
                    if now:
                        yield out()
                    now, sums = [b.column(k)[i].as_py() for k in (3, 4, 5, 6)], []
        if now:
            yield out()

    return run


def scores(docs: DataFrame, order: int = ORDER, least: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, score, mean): the sum of the words' log scores, and their mean."""
    spark = docs.sparkSession
    rows = pick(docs, doc_id, text).toDF("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(partitions(spark), size // PART_BYTES)
    exploded, counted = _schemas(kind)
    result = f"doc_id {kind}, n_words long, score double, apart long"
    blocks = rows.mapInArrow(_explode(order, parts, _arrow_schema(spark, exploded)), exploded)
    summed = blocks.repartitionById(parts, "part").sortWithinPartitions("part", "block").mapInArrow(_count(_arrow_schema(spark, counted)), counted)
    dealt = summed.repartition(parts, "block").sortWithinPartitions("block", F.col("counts").isNotNull(), "part")
    found = stored(dealt.mapInArrow(_add_up(order, least, _arrow_schema(spark, result)), result))
    total = found.agg(F.sum("n_words")).first()[0] or 0
    score = F.col("score") - F.col("apart") * float(np.log(max(total, 1)))
    return found.select("doc_id", "n_words", score.alias("score")).withColumn("mean", F.when(F.col("n_words") > 0, F.col("score") / F.col("n_words")))
