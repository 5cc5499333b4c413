"""Benchmark decontamination: a broadcast hash set of the benchmark's word n-grams, met by scanning every window of the documents.

Words are runs of ASCII letters and digits or any non-ASCII characters, ASCII letters lower-cased. An item's windows are
its runs of `n` consecutive words; an item of fewer words, but not none, is one window. Documents are only mapped: nothing
of them is shuffled. The bytes of the windows are added up before they are broadcast; above `most_bytes` the windows of both
sides are joined instead.

Null, empty and wordless texts have no words: nothing hit, no items, not contaminated. Items without words have no windows;
items whose id is null count under the id "null". Equal windows of several items name all of them. Repeated document rows
are scanned each for itself, in any order. An empty benchmark or document table gives no hits or no rows. Input columns that
bear a result's name are replaced by it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, arrow_map, chunks, pick, place, stored, texts, without

#: Upper-case ASCII to lower case; other ASCII characters that are no letter or digit to a space.
_CLEAN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_BASE = 0x9E3779B97F4A7C15
#: Bytes of windows, items and keys that are broadcast at most; a worker holds just these arrays, and 4 MB for each length.
MOST_BYTES = 64_000_000
FOUND = "n_words long, n_hit long, item_ids array<string>, hit_spans array<struct<start: long, end: long>>"


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_CLEAN).split() if text else []


def benchmark_windows(benchmark: DataFrame, n: int = 10, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct (length, window, item_id, hash) of the items; window: its words, joined by a space; hash: as _rolled gives it."""
    kept: list[WordHashes] = []

    def of(batch: pa.RecordBatch) -> dict:
        kept[:] = kept or [WordHashes()]
        out = {"length": [], "window": [], "item_id": [], "hash": []}
        for item, t in zip(batch.column("id").to_pylist(), texts(batch.column("text")), strict=True):
            w = words(t)
            k = min(n, len(w))
            for i in range(len(w) - k + 1 if w else 0):
                out["length"].append(k)
                out["window"].append(b" ".join(w[i : i + k]))
                out["item_id"].append("null" if item is None else item)
            if w:
                out["hash"] += _rolled(kept[0].of(w), k).view(np.int64).tolist()
        return out

    plain = pick(benchmark, item_id, text).toDF("id", "text").select(F.col("id").cast("string").alias("id"), "text")
    return arrow_map(plain, of, "length int, window binary, item_id string, hash long").distinct()


class _Windows:
    """The benchmark's windows by length, as arrays in order of their hashes: hashes, windows, items."""

    def __init__(self, rows: pa.Table) -> None:
        self.lengths: dict[int, tuple] = {}
        for length in sorted(set(rows.column("length").to_pylist())):
            own = rows.filter(pc.equal(rows.column("length"), length))
            keys = own.column("hash").to_numpy().view(np.uint64)
            order = np.argsort(keys, kind="stable")
            maybe = np.zeros(1 << 22, bool)
            maybe[keys >> np.uint64(42)] = True
            window, item = (own.column(c).take(pa.array(order)).combine_chunks() for c in ("window", "item_id"))
            self.lengths[length] = (keys[order], maybe, window, item)

    def hits(self, flat: list[bytes], hashes: np.ndarray):
        """(place, length, items) of each verified window in a run of words."""
        for length, (keys, maybe, windows, items) in self.lengths.items():
            if len(hashes) < length:
                continue
            rolled = _rolled(hashes, length)
            at = np.flatnonzero(maybe[rolled >> np.uint64(42)])
            first, end = (np.searchsorted(keys, rolled[at], side=s) for s in ("left", "right"))
            for i, a, b in zip(at[first < end].tolist(), first[first < end].tolist(), end[first < end].tolist(), strict=True):
                window = b" ".join(flat[i : i + length])
                found = [items[k].as_py() for k in range(a, b) if windows[k].as_py() == window]
                if found:
                    yield i, length, found


def _rolled(hashes: np.ndarray, length: int) -> np.ndarray:
    """A polynomial hash (modulo 2^64) of each run of so many words."""
    n, power = len(hashes) - length + 1, 1
    out = hashes[:n].copy()
    for j in range(1, length):
        power = power * _BASE % (1 << 64)
        out += hashes[j : j + n] * np.uint64(power)
    return out


def _spans(hits: list[tuple[int, int]]) -> list[dict]:
    out: list[list[int]] = []
    for start, end in sorted(hits):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [{"start": s, "end": e} for s, e in out]


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text", most_bytes: int = MOST_BYTES) -> DataFrame:
    """The documents with n_words, n_hit (words inside any occurring window), item_ids (sorted) and hit_spans (word places)."""
    spark = docs.sparkSession
    windows = stored(benchmark_windows(benchmark, n, item_id, item_text))
    docs = without(docs, "n_words", "n_hit", "item_ids", "hit_spans")
    if (windows.agg(F.sum(F.octet_length("window") + F.octet_length("item_id") + 24)).first()[0] or 0) > most_bytes:
        return _joined(docs, windows.drop("hash"), text)
    known, cache = spark.sparkContext.broadcast(_Windows(windows.toArrow())), []  # `most_bytes` at most
    columns = docs.columns
    at = place(columns, text)

    def of(batch: pa.RecordBatch) -> dict:
        cache[:] = cache or [WordHashes()]
        all_words = [words(t) for t in texts(batch.column(at))]
        found: list[tuple[list, set]] = [([], set()) for _ in all_words]
        for a, b in chunks(all_words):
            flat = [w for x in all_words[a:b] for w in x]
            ends = np.cumsum([len(x) for x in all_words[a:b]])
            for i, length, items in known.value.hits(flat, cache[0].of(flat)):
                k = int(np.searchsorted(ends, i, side="right"))
                if i + length <= ends[k]:
                    first = int(ends[k]) - len(all_words[a + k])
                    found[a + k][0].append((i - first, i - first + length))
                    found[a + k][1].update(items)
        spans = [_spans(h) for h, _ in found]
        return dict(zip([f"c{i}" for i in range(len(columns))], batch.columns, strict=True)) | {
            "n_words": [len(w) for w in all_words],
            "n_hit": [sum(s["end"] - s["start"] for s in x) for x in spans],
            "item_ids": [sorted(i) for _, i in found],
            "hit_spans": spans,
        }

    plain = docs.toDF(*(f"c{i}" for i in range(len(columns))))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema) + ", " + FOUND
    return arrow_map(plain, of, schema).toDF(*columns, "n_words", "n_hit", "item_ids", "hit_spans")


def _joined(docs: DataFrame, windows: DataFrame, text: str) -> DataFrame:
    """The same result for a benchmark too large to broadcast: windows of both sides meet in a join; only hits return to the documents."""
    lengths = sorted(r["length"] for r in windows.select("length").distinct().collect())  # n at most
    keyed = docs.withColumn("_row", F.xxhash64(F.coalesce(F.col(text), F.lit("")))).withColumn("_null", F.col(text).isNull())

    def of(batch: pa.RecordBatch) -> dict:
        out = {"_row": [], "_text": [], "n_words": [], "place": [], "length": [], "window": []}
        for row, t in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
            w, key = words(t), hashlib.sha256(t or b"").digest()
            for k in lengths:
                for i in range(len(w) - k + 1):
                    for name, v in zip(out, (row, key, len(w), i, k, b" ".join(w[i : i + k])), strict=True):
                        out[name].append(v)
        return out

    one_of_each = keyed.select("_row", F.col(text).alias("_t")).distinct()
    scanned = arrow_map(one_of_each, of, "_row long, _text binary, n_words long, place long, length int, window binary")
    hits = scanned.join(windows, ["length", "window"]).groupBy("_row", "_text").agg(
        F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.collect_set(F.struct("place", (F.col("place") + F.col("length")).alias("end"))).alias("_at")
    )

    def merged(batch: pa.RecordBatch) -> dict:
        spans = [_spans([(x["place"], x["end"]) for x in h]) for h in batch.column(3).to_pylist()]
        return {"_row": batch.column(0), "_text": batch.column(1), "item_ids": batch.column(2), "n_hit": [sum(s["end"] - s["start"] for s in x) for x in spans], "hit_spans": spans}

    hits = arrow_map(hits, merged, "_row long, _text binary, item_ids array<string>, n_hit long, hit_spans array<struct<start: long, end: long>>")
    count = arrow_map(keyed.select("_row", F.col(text).alias("_t")).distinct(), lambda b: {"_row": b.column(0), "_text": [hashlib.sha256(t or b"").digest() for t in texts(b.column(1))], "n_words": [len(words(t)) for t in texts(b.column(1))]}, "_row long, _text binary, n_words long")
    counted = count.distinct().join(hits, ["_row", "_text"], "left")
    keyed = keyed.withColumn("_text", F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)))
    return keyed.join(counted, ["_row", "_text"], "left").select(
        *docs.columns, "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        F.coalesce("hit_spans", F.array().cast("array<struct<start: long, end: long>>")).alias("hit_spans"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, remove: str = "documents", text: str = "text", **options) -> DataFrame:
    """The documents without contaminated ones (remove="documents"), or with the hit words cut out of their texts
    (remove="spans"; the words left of a cut text are kept as written, joined as they stood)."""
    found = scan(docs, benchmark, n, text, **options)
    if remove == "documents":
        return found.where("n_hit = 0").select(*without(docs, "n_words", "n_hit", "item_ids", "hit_spans").columns)
    if remove != "spans":
        raise ValueError(f"remove is documents or spans, not {remove!r}")
    cut = F.pandas_udf(_cut_all, "string")
    return found.withColumn(text, F.when(F.col("n_hit") > 0, cut(F.col(text), F.col("hit_spans"))).otherwise(F.col(text))).drop("n_words", "n_hit", "item_ids", "hit_spans")


def _cut_all(text, spans):
    import pandas as pd

    return pd.Series([_cut(t, s) for t, s in zip(text, spans, strict=True)])


def _cut(text: str | None, spans) -> str | None:
    import re

    if text is None or not len(spans):
        return text
    raw, clean = text.encode(), text.encode().translate(_CLEAN)
    at = [m.span() for m in re.finditer(rb"[^ ]+", clean)]
    out, last = [], 0
    for s in spans:
        out.append(raw[last : at[s["start"]][0]])
        last = at[s["end"] - 1][1]
    return b"".join([*out, raw[last:]]).decode()


def digest(found: DataFrame) -> DataFrame:
    """The query's columns of a scan."""
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
