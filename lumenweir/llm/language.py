"""Language identification, word first: known words score by their log frequency in each language; an unseen word is cut
into character n-grams, longest first, backing off to shorter ones where a longer one is unknown.

Words are lower-cased runs of letters. The model is fitted on a bounded sample of labelled documents: `sample` of each
language, chosen by a hash of the text; word and n-gram counts of the sample are summed by Spark. Frequencies are smoothed by adding
one half. A document's language is the one with the largest mean log score over its words; the score is that language's
share of the exponentiated means, times the number of words up to SHARPEN.

Null texts and texts without a letter are `und`, with score 0; so is every text if there is nothing labelled to learn from.
Ties go to the first language in alphabetical order. Repeated rows are scored each for itself. Long texts are scored whole.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_WORDS, arrow_map, pick, place, texts, without

#: Labelled documents of each language that the model learns from, about.
SAMPLE = 1_000
#: Character n-grams, longest first.
ORDERS = (5, 4, 3, 2, 1)
#: What a step to shorter n-grams costs, as in stupid backoff.
BACKOFF = math.log(0.4)
SHARPEN = 20
_LETTERS = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


@dataclass
class Model:
    """words, grams: the row of each key in scores, log frequencies by language; grams hold `^` and `$` at a word's ends.
    unknown: for characters never met."""

    langs: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    scores: np.ndarray
    unknown: np.ndarray

    def of_word(self, word: str) -> np.ndarray:
        known = self.words.get(word)
        return self._of_grams(f"^{word}$") if known is None else self.scores[known]

    def _of_grams(self, marked: str) -> np.ndarray:
        """The mean score of a chain of n-grams that covers the word: at each place the longest known one; a step down costs BACKOFF."""
        rows, steps, n, i, unknown = [], 0, 0, 0, 0
        while i < len(marked):
            for down, k in enumerate(ORDERS):
                if i + k <= len(marked) and (known := self.grams.get(marked[i : i + k])) is not None:
                    rows.append(known)
                    steps += down
                    i += max(1, k - 2)
                    break
            else:
                unknown += 1
                i += 1
            n += 1
        return (self.scores[rows].sum(0) + steps * BACKOFF + unknown * (self.unknown + len(ORDERS) * BACKOFF)) / n


def word_counts(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, word, n) over the documents, pre-aggregated by batch."""

    def of(batch: pa.RecordBatch) -> dict:
        counts: dict[tuple[str, str], int] = {}
        for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for w in words(t):
                counts[name, w] = counts.get((name, w), 0) + 1
        return {"lang": [k[0] for k in counts], "word": [k[1] for k in counts], "n": list(counts.values())}

    rows = pick(docs, lang, text).toDF("lang", "text").where("lang is not null and text is not null")
    return arrow_map(rows, of, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def sample(docs: DataFrame, each: int, lang: str = "lang", text: str = "text") -> DataFrame:
    """About so many labelled rows of each language, chosen by a hash of the text."""
    rows = pick(docs, lang, text).toDF("lang", "text").where("lang is not null and text is not null")
    share = rows.groupBy("lang").agg((F.lit(float(each)) / F.count("*")).alias("share"))
    place = F.pmod(F.xxhash64("text"), F.lit(1_000_000)) / 1_000_000
    return rows.join(F.broadcast(share), "lang").where(place < F.col("share")).select("lang", "text")  # one row for each language


def fit(docs: DataFrame, each: int = SAMPLE, lang: str = "lang", text: str = "text", least: int = 2) -> Model:
    """A model of the labelled documents; words met fewer than `least` times are left to the n-grams."""
    rows = word_counts(sample(docs, each, lang, text)).toPandas()  # bounded by the sample
    langs = sorted(rows["lang"].unique())
    at = {x: i for i, x in enumerate(langs)}
    counts: dict[str, np.ndarray] = {}
    grams: dict[str, np.ndarray] = {}
    for name, word, n in zip(rows["lang"], rows["word"], rows["n"], strict=True):
        for table, key in [(counts, word), *((grams, g) for g in _grams(f"^{word}$"))]:
            if (row := table.get(key)) is None:
                row = table[key] = np.zeros(len(langs))
            row[at[name]] += n
    totals = sum(counts.values(), np.zeros(len(langs)))
    of_order = {k: np.zeros(len(langs)) for k in ORDERS}
    for g, row in grams.items():
        of_order[len(g)] += row
    score = lambda row, total: np.log((row + 0.5) / (total + 0.5 * max(1, len(counts))))
    known = [(0, w, score(row, totals)) for w, row in counts.items() if row.sum() >= least]
    known += [(1, g, score(row, of_order[len(g)])) for g, row in grams.items() if row.sum() >= least]
    places: tuple[dict[str, int], dict[str, int]] = ({}, {})
    for i, (which, key, _) in enumerate(known):
        places[which][key] = i
    table = np.array([row for _, _, row in known], np.float32).reshape(len(known), len(langs))
    return Model(langs, *places, table, score(np.zeros(len(langs)), of_order[1]))


def _grams(marked: str):
    for k in ORDERS:
        for i in range(len(marked) - k + 1):
            yield marked[i : i + k]


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows with lang_pred and score; columns of these names are replaced."""

    docs = without(docs, "lang_pred", "score")
    shared, columns = docs.sparkSession.sparkContext.broadcast(model), docs.columns
    at, kept = place(columns, text), []

    def of(batch: pa.RecordBatch) -> dict:
        m, names, scores = shared.value, [], []
        if not kept or len(kept[0]) > CACHE_WORDS:
            kept[:] = [_Index(m)]
        index = kept[0]
        for t in texts(batch.column(at)):
            w = words(t.decode()) if t else []
            if not m.langs or not any(any(map(str.isalpha, x)) for x in w):  # other numbers count as word characters, too
                names.append("und")
                scores.append(0.0)
                continue
            places = np.fromiter(map(index.__getitem__, w), np.int64, len(w))
            mean = index.table[places].mean(0)
            x = np.exp((mean - mean.max()) * min(len(w), SHARPEN))
            names.append(m.langs[int(mean.argmax())])
            scores.append(float(x.max() / x.sum()))
        return dict(zip([f"c{i}" for i in range(len(columns))], batch.columns, strict=True)) | {"lang_pred": names, "score": scores}

    plain = docs.toDF(*(f"c{i}" for i in range(len(columns))))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema) + ", lang_pred string, score double"
    return arrow_map(plain, of, schema).toDF(*columns, "lang_pred", "score")


class _Index(dict):
    """Rows of scores by number, for the words met so far."""

    def __init__(self, model: Model) -> None:
        self.model, self.table, self.n = model, np.empty((4096, len(model.langs)), np.float32), 0

    def __missing__(self, word: str) -> int:
        if self.n == len(self.table):
            self.table = np.concatenate([self.table, np.empty_like(self.table)])
        self.table[self.n] = self.model.of_word(word)
        self[word] = self.n
        self.n += 1
        return self.n - 1
