"""Packing of token sequences by the linear grouping scheme, finished by best fit.

Texts are tokenized and cut into pieces of at most `capacity` tokens. The work per piece is spread over the cluster; the
packing itself is worked out on the histogram of lengths, at most `capacity` numbers whatever the corpus:

1. Lengths above `small` of the capacity are sorted into groups of equal cardinality and rounded up to their group's largest.
2. Which few-size configurations to fill, and how often, is a linear program over the group sizes, solved by column
   generation (a knapsack prices configurations); whole multiples of the configurations are taken.
3. Actual lengths take the places of rounded ones; the bins are held as runs of equal content.
4. What is left over, largest first, goes by best fit into the space left, the small lengths last; new bins open as needed.

The plan lists for each length which ranks go to which run of bins and where. Pieces get their rank among those of their
length from counts of (length, salt) groups, so that a length that a large part of all pieces have is numbered in parts.

Null and empty texts are one piece of the end token alone. Repeated rows are packed each for itself; pieces that agree in
all columns are interchangeable. An empty table gives no rows. Texts of any length are tokenized whole.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _arrow_schema, arrow_map, pick, stored

CAPACITY = 2048
#: Groups of large lengths, and what part of the capacity is large.
GROUPS = 96
SMALL = 0.4
#: Groups in which pieces are numbered at most, besides one for each length; pieces of one length in a group at least.
RANK_GROUPS, RANK_ROWS = 20_000, 50
#: A word's end and an ASCII sign after it; the apostrophe begins tokens of its own.
_WORD_AND_SIGN = r"([\p{L}\p{N}])([!-&(-/:-@\[-`{-~])"
_SIGN = _WORD_AND_SIGN[_WORD_AND_SIGN.index(")") + 1 :]
#: Runs whose ids a worker keeps.
RUNS_KEPT = 300_000
#: Columns that the linear program tries at most; what it has by then is feasible.
MOST_COLUMNS = 600


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: What a tokenizer's file says if its vocabulary drops white space, never joins across it, lower-cases and parts letters from signs.
_BY_WORD = {
    "normalizer": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    "pre_tokenizer": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
}


@cache
def _odd_letters() -> str:
    """A pattern of letters that turn into more than letters when composed and lower-cased, as a capital I with a dot does, and a
    sign after them: the mark that such a letter ends in belongs to the sign. All such letters are of the basic plane. Or of an
    I that marks compose to such a letter, as lower-casing ASCII comes first here."""
    plain = lambda s: all(unicodedata.category(c)[0] in "LN" for c in s)
    letters = (c for c in map(chr, range(0x80, 0x10000)) if plain(c))
    return "[" + "".join(c for c in letters if not plain("".join(x.lower() for x in unicodedata.normalize("NFC", c)))) + "]" + _SIGN + r"|I\p{M}*\x{0307}"


class Tokenizer:
    """Ids as 32-bit numbers. With a vocabulary that works word by word (see _BY_WORD), a slice of texts is lower-cased and cut
    into runs at ASCII white space and between a letter or digit and an ASCII sign; each run is encoded once, and a text's
    ids are taken from those of its runs. Words of letters are encoded many at once and parted after each token that ends
    a word, unless the numbers of words and ends differ: then each is encoded alone. A text that may hold the string of a
    special token, or has a letter before a sign whose lower case isn't all letters, and every text with another kind of vocabulary, is encoded as a whole."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers

        self.own = tokenizers.Tokenizer.from_file(path)
        vocabulary, (normalizer, split) = self.own.get_vocab(), (json.loads(x.__getstate__()) if x else {} for x in (self.own.normalizer, self.own.pre_tokenizer))
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.by_word = (
            normalizer.get("normalizers") == _BY_WORD["normalizer"]
            and (split.get("pretokenizers") or [{}])[0].get("pattern") == {"Regex": _BY_WORD["pre_tokenizer"]}
            and getattr(self.own.model, "end_of_word_suffix", None) == "</w>"
            and all(x.content.startswith("<|") for x in self.own.get_added_tokens_decoder().values())
        )
        # Two generations: a run that is met again moves to the newer one, the older one goes when the newer is full.
        self.newer: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _encode(self, items: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.own.encode_batch_fast(items, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        plain, other = [], []
        for w in new:
            (plain if w.isalpha() and (w.isascii() or unicodedata.normalize("NFC", w).lower().isalpha()) else other).append(w)
        groups = [plain[i : i + 200] for i in range(0, len(plain), 200)]
        for group, ids in zip(groups, self._encode([" ".join(g) for g in groups]), strict=True):
            to = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(to) != len(group):
                other += group
                continue
            raw = ids.tobytes()
            self.newer.update(zip(group, (raw[a:b] for a, b in zip([0, *to[:-1]], to, strict=True)), strict=True))
        self.newer.update(zip(other, (x.tobytes() for x in self._encode(other)), strict=True))

    def _unknown(self, runs) -> list[str]:
        """The runs that neither generation has; those of the older one are moved to the newer."""
        out = []
        for w in runs:
            if w not in self.newer:
                if (x := self.older.get(w)) is None:
                    out.append(w)
                else:
                    self.newer[w] = x
        return out

    def of_runs(self, runs: list[str]) -> list[bytes]:
        self._learn(self._unknown(runs))
        out = list(map(self.newer.__getitem__, runs))
        if len(self.newer) > RUNS_KEPT // 2:
            self.older, self.newer = self.newer, {}
        return out

    def encode(self, column: pa.Array, last: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each text's followed by the end token; and where each text's end."""
        items = pc.fill_null(column.cast(pa.large_string()), "")
        whole = np.arange(len(items))
        if self.by_word:
            whole = np.flatnonzero(pc.or_(pc.match_substring(items, "<|"), pc.match_substring_regex(items, _odd_letters())).to_numpy(zero_copy_only=False))
        own = [x.tobytes() for x in self._encode(items.take(pa.array(whole)).to_pylist())]
        mask = np.zeros(len(items), bool)
        mask[whole] = True
        plain = pc.ascii_lower(pc.if_else(pa.array(mask), "", items))
        runs = pc.ascii_split_whitespace(pc.replace_substring_regex(plain, _WORD_AND_SIGN, r"\1 \2"))
        ends = np.asarray(runs.offsets)
        coded = runs.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
        ends = ends - ends[0]
        known = self.of_runs(coded.dictionary.to_pylist())
        index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        index[ends[:-1][whole]] = len(known) + np.arange(len(whole))  # such a text was left with one empty run
        index = np.insert(index, ends[1:], len(known) + len(whole))
        ids = pa.array([*known, *own, np.array([last], "<u4").tobytes()], pa.large_binary()).take(pa.array(index))
        upto = np.frombuffer(ids.buffers()[1], np.int64)[: len(ids) + 1] // 4
        return np.frombuffer(ids.buffers()[2], "<u4")[: upto[-1]], upto[ends[1:] + np.arange(1, len(items) + 1)]


_LOADED: dict[str, Tokenizer] = {}


def loaded(path: str) -> Tokenizer:
    """The worker's tokenizer of that file, with the runs that it has met in earlier tasks."""
    if path not in _LOADED:
        _LOADED[path] = Tokenizer(path)
    return _LOADED[path]


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each text's ids and the end token, cut at multiples of the capacity."""
    path = tokenizer or default_tokenizer()
    rows = pick(docs, doc_id, text).toDF("doc_id", "text")

    def of(batch: pa.RecordBatch) -> dict:
        ids, ends = loaded(path).encode(batch.column(1), end)
        sizes = np.diff(ends, prepend=0)
        n = -(-sizes // capacity)
        at = np.repeat(np.arange(len(n)), n)
        piece = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        start = piece * capacity
        length = np.minimum(sizes[at] - start, capacity)
        first, raw = (ends - sizes)[at] + start, memoryview(ids).cast("B")
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(first.tolist(), (first + length).tolist(), strict=True)]
        return {"doc_id": batch.column(0).take(pa.array(at)), "piece": piece.astype(np.int32), "start": start, "length": length, "ids_crc32": crc}

    return arrow_map(rows, of, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


# The plan, from a histogram of lengths.


@dataclass
class Run:
    """Bins of equal content: how many, and the lengths in each, in order."""

    n: int
    lengths: list[int]


@dataclass
class Bins:
    """Runs by the space left, for best fit."""

    capacity: int
    runs: list[Run] = field(default_factory=list)
    open: dict[int, list[Run]] = field(default_factory=dict)
    spaces: list[int] = field(default_factory=list)

    def add(self, run: Run) -> None:
        space = self.capacity - sum(run.lengths)
        if not run.n:
            return
        if not space:
            self.runs.append(run)
            return
        if space not in self.open:
            insort(self.spaces, space)
        self.open.setdefault(space, []).append(run)

    def fit(self, length: int, n: int) -> None:
        """Each of n items to the bin with the least space that holds it."""
        while n:
            at = bisect_left(self.spaces, length)
            if at == len(self.spaces):
                each = self.capacity // length
                self.add(Run(n // each, [length] * each))
                self.add(Run(1, [length] * (n % each)) if n % each else Run(0, []))
                return
            space = self.spaces[at]
            run = self.open[space].pop()
            if not self.open[space]:
                del self.open[space], self.spaces[at]
            each = space // length  # a bin stays the best one until it is full
            whole = min(run.n, n // each)
            self.add(Run(whole, run.lengths + [length] * each))
            n -= whole * each
            if whole < run.n and n:
                self.add(Run(1, run.lengths + [length] * n))
                whole, n = whole + 1, 0
            self.add(Run(run.n - whole, run.lengths))

    def all(self) -> list[Run]:
        return self.runs + [r for s in self.spaces for r in self.open[s]]


def grouped(counts: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """Lengths, largest first, in groups of equal cardinality (a length may be in two), as (length, count) runs."""
    left = sorted(counts.items(), reverse=True)
    if len(left) <= groups:
        return [[x] for x in left]
    total, out, taken = sum(counts.values()), [], 0
    ends = [total * (i + 1) // groups for i in range(groups)]
    now: list[tuple[int, int]] = []
    for length, n in left:
        while n:
            take = min(n, ends[len(out)] - taken)
            if take:
                now.append((length, take))
            taken, n = taken + take, n - take
            if taken == ends[len(out)]:
                if now:
                    out.append(now)
                else:
                    ends.pop(len(out))
                    continue
                now = []
                if len(out) == len(ends):
                    break
    return out


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[np.ndarray, float]]:
    """The basis of the cutting-stock linear program's solution: how many of each size, and how often."""
    k = len(sizes)
    basis = np.diag([capacity // s for s in sizes]).astype(float)
    need = np.array(demand, float)
    for _ in range(MOST_COLUMNS):
        inverse = np.linalg.inv(basis)
        prices = inverse.sum(0)
        column, worth = _best_configuration(sizes, prices, capacity)
        if worth <= 1 + 1e-7:
            break
        often, way = inverse @ need, inverse @ column
        if not (way > 1e-9).any():
            break
        ratio = np.where(way > 1e-9, np.maximum(often, 0) / np.where(way > 1e-9, way, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    often = np.linalg.solve(basis, need)
    return [(basis[:, i].astype(int), float(often[i])) for i in range(k)]


def _best_configuration(sizes: list[int], prices: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """A knapsack: best[c] after as many rounds as items fit, one item more a round."""
    best, took = np.zeros(capacity + 1), []
    for _ in range(capacity // min(sizes)):
        new, item = best.copy(), np.full(capacity + 1, -1)
        for j, (s, y) in enumerate(zip(sizes, prices, strict=True)):
            if y > 0:
                with_j = best[: capacity + 1 - s] + y
                better = with_j > new[s:] + 1e-12
                new[s:][better] = with_j[better]
                item[s:][better] = j
        if (item < 0).all():
            break
        took.append(item)
        best = new
    column, c = np.zeros(len(sizes)), capacity
    for item in reversed(took):
        if item[c] >= 0:
            column[item[c]] += 1
            c -= sizes[item[c]]
    return column, float(column @ prices)


def packed(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: float = SMALL) -> list[Run]:
    """Runs of bins that hold all items of a histogram of lengths."""
    bins = Bins(capacity)
    bins.add(Run(counts.get(capacity, 0), [capacity]))
    left = {length: n for length, n in counts.items() if length < capacity and n}
    large = {length: n for length, n in left.items() if length > small * capacity}
    if large:
        queues = grouped(large, groups)
        sizes, demand = [q[0][0] for q in queues], [sum(n for _, n in q) for q in queues]
        for column, often in configurations(sizes, demand, capacity):
            for run in _substituted(column, int(often + 1e-6), queues):
                for length in run.lengths:
                    left[length] -= run.n
                bins.add(run)
    for length in sorted(left, reverse=True):
        bins.fit(length, left[length])
    return bins.all()


def _substituted(column: np.ndarray, often: int, queues: list[list[tuple[int, int]]]) -> Iterator[Run]:
    """Bins of a configuration with actual lengths from the groups' queues, in runs of equal content."""
    slots = [j for j, n in enumerate(column) for _ in range(n)]
    often = min([often, *(sum(n for _, n in queues[j]) // int(column[j]) for j in set(slots))]) if slots else 0
    if often <= 0:
        return
    taken: list[list[tuple[int, int]]] = []
    for j in slots:  # each slot takes a stretch of its group's queue
        stretch, need = [], often
        while need:
            length, n = queues[j][0]
            take = min(n, need)
            stretch.append((length, take))
            need -= take
            queues[j][0] = (length, n - take)
            if n == take:
                queues[j].pop(0)
        taken.append(stretch)
    while taken[0]:
        n = min(s[0][1] for s in taken)
        yield Run(n, [s[0][0] for s in taken])
        for s in taken:
            s[0] = (s[0][0], s[0][1] - n)
            if not s[0][1]:
                s.pop(0)


class Plan:
    """For each (length, rank): sequence and offset, by the last stretch of ranks that begins at or before it."""

    def __init__(self, runs: list[Run]) -> None:
        rank: dict[int, int] = {}
        rows, bin_ = [], 0
        for run in runs:
            offset = 0
            for length in run.lengths:
                rows.append((length << 44 | rank.get(length, 0), rank.get(length, 0), bin_, offset))
                rank[length] = rank.get(length, 0) + run.n
                offset += length
            bin_ += run.n
        self.sequences = bin_
        self.keys, self.ranks, self.bins, self.offsets = (np.array(x, np.int64) for x in zip(*sorted(rows), strict=True)) if rows else [np.zeros(0, np.int64)] * 4

    def at(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted(self.keys, length << 44 | rank, side="right") - 1
        return self.bins[i] + rank - self.ranks[i], self.offsets[i]


def pack(cut: DataFrame, capacity: int = CAPACITY, length: str = "length") -> DataFrame:
    """The rows with sequence_id and offset. Columns: a length from 1 to the capacity, and any that tell rows apart."""
    spark = cut.sparkSession
    counts = {r[length]: r["count"] for r in cut.groupBy(length).count().collect()}  # a row for each length
    plan = spark.sparkContext.broadcast(Plan(packed(counts, capacity)))  # runs follow the lengths and groups, not the rows

    each = max(RANK_ROWS, sum(counts.values()) // RANK_GROUPS)
    salts = F.create_map(*(F.lit(x) for n, c in counts.items() if c > each for x in (n, c // each + 1)), F.lit(-1).cast("long"), F.lit(1))
    columns = cut.columns
    salted = cut.withColumn("_salt", F.pmod(F.xxhash64(*columns), F.coalesce(F.try_element_at(salts, F.col(length)), F.lit(1)).cast("long")))
    sizes = salted.groupBy(length, "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(length).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(length, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long")).alias("_base"))
    rank = F.row_number().over(Window.partitionBy(length, "_salt").orderBy(*columns))
    ranked = salted.withColumn("_rn", rank).join(F.broadcast(bases), [length, "_salt"])  # a row for each length and group
    ranked = ranked.select(*columns, (F.col("_base") + F.col("_rn") - 1).alias("_rank"))
    at = columns.index(length)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"
    kinds = _arrow_schema(spark, schema)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bins, offsets = plan.value.at(b.column(at).to_numpy(), b.column(len(columns)).to_numpy())
            yield pa.RecordBatch.from_arrays([*(x.cast(k.type) for x, k in zip(b.columns[:-1], kinds, strict=False)), pa.array(bins), pa.array(offsets)], schema=kinds)

    return ranked.mapInArrow(place, schema)


def packed_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, **columns) -> DataFrame:
    """Pieces of all documents, each with its sequence_id and its offset there."""
    return pack(stored(pieces(docs, tokenizer, capacity, **columns)), capacity)
