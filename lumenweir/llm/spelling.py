"""Spelling variants of a corpus vocabulary, by sorted permuterm rotations.

A word, ended by a marker, has a rotation for each of its places. Skipping the character at one place leaves the rotation
that starts behind it without its last character: y$x for a word x c y. All words x ? y have rotations that begin so, and the
word x y, one character shorter, has just this rotation: replacements and indels at a place are the prefix range y$x of the
sorted rotations. Rotations are dealt by that prefix and sorted within partitions, so that a range is a run of rows: the
word x y first, if there is one, then the words x ? y. A scan of the runs emits each near pair once from either side.

A run holds at most one word for each letter of the alphabet, and one more: no run grows with the corpus. Counts are added
up in tasks before they are shuffled; texts never are. The words' table is as large as the vocabulary, and nothing of it is
sent to the driver.

Null and empty texts have no runs of letters. Rows count each for themselves, repeated ones and rows of one id too; a null
id is the empty text. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, slices, stored, texts

#: A run of letters in lower-cased UTF-8: a to z and U+00C0 to U+00FF.
_RUN = re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+")
#: Ends a word; sorts before all letters.
MARK = "$"
#: One run in so many loses a character.
EVERY = 199
#: Different words that a task counts before it hands them on.
MOST_COUNTS = 400_000


def runs(text: bytes | None) -> list[bytes]:
    """Maximal runs of letters; bytes.lower changes A to Z alone."""
    return _RUN.findall(text.lower()) if text else []


def _counts(every: int):
    """Over rows (id as text, text): words with how often they occur in a part of the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def out() -> pa.RecordBatch:
            rows = [pa.array(list(total), pa.binary()).cast(pa.string()), pa.array(list(total.values()), pa.int64())]
            total.clear()
            return pa.RecordBatch.from_arrays(rows, ["word", "n"])

        for batch in (s for b in batches for s in slices(b)):
            for i, t in zip(texts(batch.column(0)), texts(batch.column(1)), strict=True):
                seed = zlib.crc32((i or b"") + b":")
                for w, n in Counter(runs(t)).items():
                    h = zlib.crc32(w, seed)
                    if h % every == 0:
                        whole = w.decode()
                        at = h % len(whole)
                        w = (whole[:at] + whole[at + 1 :]).encode()
                    total[w] += n
            if len(total) >= MOST_COUNTS:
                yield out()
        yield out()

    return run


def vocabulary(docs: DataFrame, least: int = 5, shortest: int = 6, every: int = EVERY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): runs of letters with at least `shortest` code points and `least` occurrences, after one run in `every`,
    named by the crc32 of its document's id and itself, has lost a character."""
    rows = pick(docs, doc_id, text).toDF("doc_id", "text").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    counted = rows.mapInArrow(_counts(every), "word string, n long").where(F.char_length("word") >= shortest)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def rotations(words: DataFrame) -> DataFrame:
    """(prefix, last, first, word, n): of each rotation of a marked word that ends in a letter, what is before that letter,
    the letter, and whether it is the first of a run of equal letters; and each whole rotation as a prefix, with no letter."""
    marked, size = F.concat("word", F.lit(MARK)), F.char_length("word")
    turned = words.select("word", "n", marked.alias("m"), F.posexplode(F.sequence(F.lit(0), size)).alias("at", "_")).select(
        "word", "n", "at", F.concat(F.expr("substring(m, at + 1)"), F.expr("left(m, at)")).alias("rotation")
    )
    own = F.struct(F.col("rotation").alias("prefix"), F.lit("").alias("last"), F.lit(True).alias("first"))
    letter = F.expr("substring(word, at, 1)")
    skipped = F.struct(F.expr("left(rotation, length(word))").alias("prefix"), letter.alias("last"), ((F.col("at") == 1) | (F.expr("substring(word, at - 1, 1)") != letter)).alias("first"))
    return turned.select("word", "n", F.explode(F.when(F.col("at") > 0, F.array(own, skipped)).otherwise(F.array(own))).alias("r")).select("r.*", "word", "n")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (prefix, last, first, word, n) in order of prefix and last: (word, n_near, near_word, near_n) for each word of
    a run that has near words there: their number, and of those with the largest n the first in order."""
    names = ["word", "n_near", "near_word", "near_n"]
    prefix, group, out = None, [], ([], [], [], [])

    def best(rows, but=None):
        return min(((-n, w) for _, _, w, n in rows if w != but), default=None)

    def close() -> None:
        if len(group) < 2:
            return
        shorter, longer = (group[:1], group[1:]) if group[0][0] == "" else ([], group)
        for last, first, w, _ in group:
            near = longer if last == "" else longer + shorter if first else longer
            near = [r for r in near if r[2] != w and (last or r[1])]
            if near:
                n, other = best(near)
                for column, v in zip(out, (w, len(near), other, -n), strict=True):
                    column.append(v)

    def batch_of() -> pa.RecordBatch:
        rows = [pa.array(v, k) for v, k in zip(out, (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)]
        for column in out:
            column.clear()
        return pa.RecordBatch.from_arrays(rows, names)

    for b in batches:
        for p, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if p != prefix:
                close()
                prefix, group = p, []
            group.append(row)
        yield batch_of()
    close()
    yield batch_of()


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, near_word, near_n) of the words (word, n) that have near ones, which differ by exactly one inserted,
    deleted or replaced code point: their number, and of those with the largest n the first in code-point order."""
    rows = rotations(words)
    dealt = rows.repartition("prefix").sortWithinPartitions("prefix", "last")  # the prefix ranges of the sorted rotations
    found = dealt.select("prefix", "last", "first", "word", "n").mapInArrow(_scan, "word string, n_near long, near_word string, near_n long")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near_word"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.near_word").alias("near_word"), (-F.col("b.less")).alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of a table (word, form): where following forms from each word ends. Forms may not run in circles; the
    number of rounds is the logarithm of the longest chain."""
    now = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = stored(now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if after.where("moved").isEmpty():
            return after.select("word", "root")
        now = after.select("word", "root")


def variants(docs: DataFrame, least: int = 5, shortest: int = 6, ratio: int = 5, every: int = EVERY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of the vocabulary: form, its near word of largest n, if that is at
    least `ratio` times (over 1) its own; root, where forms lead to. Forms have larger n each, so that they end."""
    words = stored(vocabulary(docs, least, shortest, every, doc_id, text))
    joined = words.join(near_words(words), "word", "left")
    is_form = F.col("near_n") >= ratio * F.col("n")
    named = stored(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("near_word")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n")))
    ends = roots(named.where("form is not null"))
    return named.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
