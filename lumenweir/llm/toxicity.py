"""Toxicity by compression distance: one zstandard dictionary trained on toxic and one on ordinary text, and the difference
of the lengths to which they compress each window of a document.

A window is `window` neighbouring words, written REPEATS times over: zstandard stores inputs of a few bytes as they are, and
the repeats cost either dictionary alike. What is toxic about a toxic document are few of its words, so the toxic
dictionary is trained on those windows that are markedly more frequent in toxic than in ordinary documents; the ordinary
one on the most frequent windows of ordinary documents. A window counts from a number of saved bytes on; that cut, and the
logistic curve which turns a document's counted windows into its score, are calibrated on the labelled sample.

The model is fitted on a bounded sample of labelled documents, about TOXIC and ORDINARY of either label, chosen by a hash of
the id; Spark counts its windows. Scoring is a map over whole texts; lengths of windows are kept by the workers.

Null, empty and wordless texts have no windows and score as any text without a counted window. Without both labels the score
is the share of label 1 among the labelled, or 0. Repeated rows are scored each for itself.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_WORDS, arrow_map, chunks, place, stored, texts, without
from .decontamination import words
from .quality import sample

TOXIC, ORDINARY = 3_000, 9_000
REPEATS, LEVEL = 2, 19
TOXIC_BYTES, ORDINARY_BYTES = 8_192, 16_384
#: Copies of a window in one sample for the toxic dictionary: its trainer looks at runs of more bytes than a word may have.
COPIES = 4
#: A toxic window is in so many toxic documents, that share of them, and so many times as often as in ordinary ones.
LEAST, LEAST_SHARE, LEAST_TIMES = 3, 0.01, 8
#: Standard deviations beyond chance; which of these is the best is found by calibration.
DEVIATIONS = (6, 8, 12)
ORDINARY_WINDOWS = 20_000
CUTS = range(2, 9)


def windows(text: bytes | None, window: int) -> list[bytes]:
    w = words(text)
    return w if window == 1 else [b" ".join(x) for x in zip(*(w[i:] for i in range(window)), strict=False)]


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; of samples too few to train on, the samples themselves, the last ones nearest."""
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(reversed(dict.fromkeys(samples)))[-size:]


class Lengths(dict):
    """How many bytes fewer the toxic dictionary needs for a window than the ordinary one."""

    def __init__(self, toxic: bytes, ordinary: bytes) -> None:
        options = zstandard.ZstdCompressionParameters.from_level(LEVEL, min_match=3, source_size=64, dict_size=ORDINARY_BYTES, write_content_size=False, write_checksum=False, write_dict_id=False)
        raw = [zstandard.ZstdCompressionDict(x, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for x in (toxic, ordinary)]
        for d in raw:
            d.precompute_compress(compression_params=options)
        self.toxic, self.ordinary = (zstandard.ZstdCompressor(dict_data=d, compression_params=options) for d in raw)

    def __missing__(self, window: bytes) -> int:
        text = (b" " + window) * REPEATS + b" "
        saved = len(self.ordinary.compress(text)) - len(self.toxic.compress(text))
        if len(self) < CACHE_WORDS:
            self[window] = saved
        return saved


@dataclass
class Model:
    """window, dictionaries; cut: saved bytes from which a window counts; curve: of (1, log(1 + counted), counted in a hundred)."""

    window: int
    toxic: bytes
    ordinary: bytes
    cut: int
    curve: np.ndarray

    def lengths(self) -> Lengths:
        return Lengths(self.toxic, self.ordinary)

    def scores(self, items: list[bytes | None], lengths: Lengths) -> np.ndarray:
        return 1 / (1 + np.exp(-_traits(*_counted(items, self.window, lengths), self.cut) @ self.curve))


def _counted(items, window: int, lengths: Lengths) -> tuple[np.ndarray, np.ndarray]:
    """For each text how many windows save at least 0, 1, 2, ... bytes (by column), and how many it has."""
    split = [windows(t, window) for t in items]
    most, n = max(CUTS) + 1, np.array([len(x) for x in split], np.int64)
    out = np.zeros((len(items), most), np.int64)
    for a, b in chunks(split):
        flat = [w for x in split[a:b] for w in x]
        saved = np.clip(np.fromiter(map(lengths.__getitem__, flat), np.int64, len(flat)), 0, most - 1)
        at = np.repeat(np.arange(b - a), n[a:b])
        table = np.bincount(at * most + saved, minlength=(b - a) * most).reshape(b - a, most)
        out[a:b] = table[:, ::-1].cumsum(1)[:, ::-1]
    return out, n


def _traits(counted: np.ndarray, n: np.ndarray, cut: int) -> np.ndarray:
    hits = counted[:, cut]
    return np.stack([np.ones(len(n)), np.log1p(hits), np.minimum(100 * hits / np.maximum(n, 1), 10)], 1)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Newton's method with a light ridge; the curve and its mean loss."""
    curve = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ curve))
        slope = x.T @ (weight * (p - y)) + 1e-2 * curve
        bend = (x.T * (weight * p * (1 - p))) @ x + 1e-2 * np.eye(len(curve))
        curve -= np.clip(np.linalg.solve(bend, slope), -3, 3)
    p = np.clip(1 / (1 + np.exp(-x @ curve)), 1e-9, 1 - 1e-9)
    return curve, float(-(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / weight.sum())


def window_counts(rows: DataFrame, window: int) -> DataFrame:
    """(window, toxic, ordinary, n): in how many documents of either label, and how often in ordinary ones, from rows (label, text)."""

    def of(batch: pa.RecordBatch) -> dict:
        found: dict[bytes, list[int]] = {}
        for label, t in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
            w = windows(t, window)
            for x in set(w):
                found.setdefault(x, [0, 0, 0])[0 if label else 1] += 1
            if not label:
                for x in w:
                    found[x][2] += 1
        return {"window": list(found)} | {k: [v[i] for v in found.values()] for i, k in enumerate(("toxic", "ordinary", "n"))}

    return arrow_map(rows, of, "window binary, toxic long, ordinary long, n long").groupBy("window").agg(*(F.sum(k).alias(k) for k in ("toxic", "ordinary", "n")))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", toxic: int = TOXIC, ordinary: int = ORDINARY, window: int = 1, **columns) -> Model:
    rows, n = sample(docs, labels, label, {1: toxic, 0: ordinary}, **columns)
    if not n.get(0) or not n.get(1):
        share = (n.get(1, 0) + 1e-6) / (sum(n.values()) + 1e-6) if n else 1e-9
        return Model(window, b" ", b" ", 2, np.array([np.log(share / (1 - share + 1e-9)), 0.0, 0.0]))
    rows = stored(rows.dropDuplicates(["text"]))  # copies of one text aren't evidence of many
    of_label = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    counts = stored(window_counts(rows, window))
    toxics, ordinaries = of_label.get(1, 0), of_label.get(0, 0)
    both, q = F.col("toxic") + F.col("ordinary"), toxics / max(toxics + ordinaries, 1)
    beyond = (F.col("toxic") - both * q) / F.sqrt(both * max(q * (1 - q), 1e-9))
    times = (F.col("toxic") + 0.5) / (toxics + 1) / ((F.col("ordinary") + 0.5) / (ordinaries + 1))
    marked = counts.where((F.col("toxic") >= max(LEAST, LEAST_SHARE * toxics)) & (times >= LEAST_TIMES) & (beyond >= min(DEVIATIONS)))
    marked = marked.select("window", "toxic", beyond.alias("beyond")).orderBy("toxic", "window").collect()  # under 100 / LEAST_SHARE windows of a document each
    common = counts.where("n > 0").orderBy(F.desc("n"), "window").limit(ORDINARY_WINDOWS).collect()
    usual = _dictionary([b" " + bytes(r["window"]) + b" " for i in range(4) for r in common if i < r["n"]], ORDINARY_BYTES) or b" "
    pairs = []
    for least in DEVIATIONS:
        chosen = [(bytes(r["window"]), r["toxic"]) for r in marked if r["beyond"] >= least]
        # The trainer tries its dictionaries on the last quarter of the samples: every window is among the first, too.
        samples = [(b" " + w) * COPIES + b" " for i in range(50) for w, k in chosen if i < k]
        pairs.append((_dictionary(samples, TOXIC_BYTES) or b" ", usual))

    def of(batch: pa.RecordBatch) -> dict:
        items = texts(batch.column(1))
        got = [_counted(items, window, Lengths(*pair)) for pair in pairs]
        return {"label": batch.column(0), "counted": list(np.concatenate([x for x, _ in got], 1)), "size": got[0][1]}

    seen = arrow_map(rows, of, "label int, counted array<long>, size long").toPandas()  # bounded by the sample
    y, counted, size = seen["label"].to_numpy(float), np.stack(seen["counted"].to_numpy()), seen["size"].to_numpy()
    order = np.lexsort((*counted.T, size, y))  # however the rows arrived
    y, counted, size = y[order], counted[order], size[order]
    weight = np.where(y == 1, n[1] / max(y.sum(), 1), n[0] / max((1 - y).sum(), 1))
    columns_of = np.split(counted, len(pairs), 1)
    fits = {(k, cut): _logistic(_traits(columns_of[k], size, cut), y, weight / weight.mean()) for k in range(len(pairs)) for cut in CUTS}
    k, cut = min(fits, key=lambda x: fits[x][1])
    return Model(window, *pairs[k], cut, fits[k, cut][0])


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows with a score; a column of that name is replaced."""
    docs = without(docs, "score")
    shared, columns, kept = docs.sparkSession.sparkContext.broadcast(model), docs.columns, []
    at = place(columns, text)

    def of(batch: pa.RecordBatch) -> dict:
        kept[:] = kept or [shared.value.lengths()]
        return dict(zip([f"c{i}" for i in range(len(columns))], batch.columns, strict=True)) | {"score": shared.value.scores(texts(batch.column(at)), kept[0])}

    plain = docs.toDF(*(f"c{i}" for i in range(len(columns))))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema) + ", score double"
    return arrow_map(plain, of, schema).toDF(*columns, "score")
