"""Quality classification by supervised subword embeddings.

A text's features are its words, pairs of neighbouring words and byte n-grams (which hold the letters of words and their
edges), each hashed to a bucket; a pair of one word twice is one bucket of its own for all words. Each bucket has a learned
vector; the vectors are averaged over all features of the document, and a softmax over two classes reads the average. It is
trained by stochastic gradient descent in numpy on a bounded sample of labelled documents: about `each` of either label,
chosen by a hash of the id, each featurized as a whole by Spark. The prior is set back to that of all labelled rows.

Scoring is a map: as the model is linear in the average, a bucket's vector comes down to one number.

Null, empty and blank texts have no features and score as the prior alone. Null labels are not learned from; without both
labels the score is the share of label 1, or 0.5 if nothing is labelled. Repeated rows are scored each for itself.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, arrow_map, chunks, pick, place, texts, without

#: log2 of the buckets, the vectors' dimension, the byte n-grams' lengths.
BITS, DIMENSION, ORDERS = 16, 8, (3, 4)
#: Labelled documents of either label that the model learns from, about.
EACH = 1_500
EPOCHS, RATE = 6, 1.0
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SAME = 1


def _bucket(x: np.ndarray) -> np.ndarray:
    return (x * _MIX >> np.uint64(64 - BITS)).astype(np.uint32)


def features(items: list[bytes | None], hashes: WordHashes):
    """For each text the buckets of its features, in runs of texts: (first text, ends of the texts' features, buckets) by kind."""
    split = [t.split() if t else [] for t in items]
    for a, b in chunks(split):
        words = split[a:b]
        flat = hashes.of([w for x in words for w in x])
        ends = np.cumsum([len(x) for x in words])
        pairs = np.where(flat[:-1] == flat[1:], np.uint64(_SAME), flat[:-1] * np.uint64(3) + flat[1:]) if len(flat) > 1 else flat[:0]
        inside = np.ones(len(pairs), bool)
        inside[ends[(ends > 0) & (ends <= len(pairs))] - 1] = False  # a pair across two texts
        of_pair = np.cumsum(np.r_[0, inside])
        kinds = [(ends, _bucket(flat)), (of_pair[np.minimum(np.maximum(ends - 1, 0), len(pairs))] if len(pairs) else ends * 0, _bucket(pairs[inside]))]
        joined = [b" " + b" ".join(x) + b" " if x else b"" for x in words]
        raw = np.frombuffer(b"".join(joined), np.uint8).astype(np.uint64)
        sizes = np.array([len(x) for x in joined], np.int64)
        starts = np.cumsum(sizes) - sizes
        for k in ORDERS:
            grams = sum(raw[i : len(raw) - k + 1 + i] << np.uint64(8 * i) for i in range(k)) + np.uint64(k << 40) if len(raw) >= k else raw[:0]
            own = np.maximum(sizes - k + 1, 0)
            keep = np.zeros(len(grams) + 1, np.int64)
            np.add.at(keep, starts[own > 0], 1)
            np.add.at(keep, (starts + own)[own > 0], -1)
            kinds.append((np.cumsum(own), _bucket(grams[np.cumsum(keep[:-1]) > 0])))
        yield a, kinds


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def scores(self, items: list[bytes | None], hashes: WordHashes) -> np.ndarray:
        out = np.full(len(items), self.bias)
        for a, kinds in features(items, hashes):
            total, n = 0.0, 0
            for ends, buckets in kinds:
                sums = np.r_[0.0, np.cumsum(self.weights[buckets], dtype=np.float64)][np.r_[0, ends]]
                total, n = total + np.diff(sums), n + np.diff(np.r_[0, ends])
            out[a : a + len(n)] += total / np.maximum(n, 1)
        return 1 / (1 + np.exp(-out))


def featurized(rows: DataFrame) -> DataFrame:
    """(label, buckets, counts) of each row (label, text): its distinct buckets."""
    kept: list[WordHashes] = []

    def of(batch: pa.RecordBatch) -> dict:
        kept[:] = kept or [WordHashes()]
        buckets, counts = [], []
        for t in texts(batch.column(1)):
            got = [x for _, kinds in features([t], kept[0]) for _, x in kinds]
            b, n = np.unique(np.concatenate(got) if got else np.zeros(0, np.uint32), return_counts=True)
            buckets.append(b.astype(np.int32))
            counts.append(n.astype(np.int32))
        return {"label": batch.column(0), "buckets": buckets, "counts": counts}

    return arrow_map(rows, of, "label int, buckets array<int>, counts array<int>")


def sample(docs: DataFrame, labels: DataFrame, label: str, each: dict[int, int], doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """(label, text) of about so many documents of each label, chosen by a hash of the id; and how many are labelled with each.

    Only ids are joined to find and count the labelled documents; the chosen ids, whose number `each` bounds, are then sent
    to the texts, which aren't shuffled. Null texts and labels other than 0 and 1 are left out.
    """
    rows = pick(docs, doc_id, text).toDF("id", "text")
    known = pick(labels, doc_id, label).toDF("id", "label").where("label in (0, 1)").select("id", F.col("label").cast("int").alias("label"))
    ids = rows.where("text is not null").select("id").join(known, "id")
    n = {r["label"]: r["count"] for r in ids.groupBy("label").count().collect()}  # two rows
    share = F.when(F.col("label") == 1, each[1] / max(n.get(1, 0), 1)).otherwise(each[0] / max(n.get(0, 0), 1))
    chosen = ids.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) / 1_000_000 < share).distinct()
    return rows.where("text is not null").join(F.broadcast(chosen), "id").select("label", "text"), n


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", each: int = EACH, epochs: int = EPOCHS, rate: float = RATE, seed: int = 1, **columns) -> Model:
    rows, n = sample(docs, labels, label, {0: each, 1: each}, **columns)
    if not n.get(0) or not n.get(1):
        return Model(np.zeros(1 << BITS, np.float32), float(np.log((n.get(1, 0) + 0.01) / (n.get(0, 0) + 0.01))))
    got = featurized(rows).toArrow()  # bounded by the sample
    y = got.column("label").to_numpy()
    buckets, counts = (got.column(c).combine_chunks() for c in ("buckets", "counts"))
    at, x, c = buckets.offsets.to_numpy(), buckets.values.to_numpy(), counts.values.to_numpy()
    order = np.lexsort((c[np.minimum(at[:-1], len(c) - 1)], np.diff(at), y)) if len(c) else np.arange(len(y))  # however the rows arrived
    weights, bias = _descend(order, y, at, x, c, epochs, rate, seed)
    prior = np.log(n[1] / n[0]) - np.log(max(y.sum(), 1) / max((1 - y).sum(), 1))
    return Model(weights.astype(np.float32), float(bias + prior))


def _descend(order, y, at, x, c, epochs: int, rate: float, seed: int) -> tuple[np.ndarray, float]:
    """Vectors of buckets and the softmax layer by stochastic gradient descent; what each bucket adds to label 1's log odds."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1, 1, (1 << BITS, DIMENSION)) / DIMENSION
    out, bias, steps, step = np.zeros((2, DIMENSION)), np.zeros(2), epochs * len(order), 0
    for _ in range(epochs):
        for i in rng.permutation(order):
            f, w = x[at[i] : at[i + 1]], c[at[i] : at[i + 1]]
            step += 1
            if not len(f):
                continue
            share = w / w.sum()
            hidden = share @ vectors[f]
            logits = out @ hidden + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y[i]] -= 1
            now = rate * (1 - (step - 1) / steps)
            # Shares of thousands of features are tiny: the step of a vector is scaled to its share of the squared norm.
            back = now * (p @ out) / np.square(share).sum()
            out -= now * 0.1 * np.outer(p, hidden)
            bias -= now * 0.01 * p
            vectors[f] -= 0.5 * share[:, None] * back
    return vectors @ (out[1] - out[0]), bias[1] - bias[0]


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows with a score; a column of that name is replaced."""
    docs = without(docs, "score")
    shared, columns, kept = docs.sparkSession.sparkContext.broadcast(model), docs.columns, []
    at = place(columns, text)

    def of(batch: pa.RecordBatch) -> dict:
        kept[:] = kept or [WordHashes()]
        return dict(zip([f"c{i}" for i in range(len(columns))], batch.columns, strict=True)) | {"score": shared.value.scores(texts(batch.column(at)), kept[0])}

    plain = docs.toDF(*(f"c{i}" for i in range(len(columns))))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema) + ", score double"
    return arrow_map(plain, of, schema).toDF(*columns, "score")
