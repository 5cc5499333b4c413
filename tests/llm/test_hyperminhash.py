"""HyperMinHash sketches and near duplicates against exact sets."""

import random
import statistics

import numpy as np
from pyspark.sql import functions as F

from lumenweir.llm import hyperminhash as h
from lumenweir.llm.common import WordHashes


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                root[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)] = min(d, ids.get(find(i), d))
    out = []
    for i, (d, _) in enumerate(rows):
        least = ids.get(find(i)) if sets[i] else d
        out.append((d, len(sets[i]), least, d == least))
    return sorted(out, key=str)


def test_brute_force(spark):
    """Copies, near copies on either side of the threshold, chains of them, boilerplate, short, empty and repeated rows."""
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(3000)] + ["Été", "naïve"]
    line, rows = " ".join(rng.choices(vocabulary, k=12)), [(None, "null id a b"), (None, "null id a b"), (None, None), (1, None), (2, ""), (3, " \t\x0b\n"), (4, "A b"), (5, "a  B"), (6, "a"), (7, "a\x1fb"), (7, "a b c d"), (7, "x " * 5000)]
    for i in range(150):
        text = rng.choices(vocabulary, k=rng.choice((5, 20, 60, 300)))
        for k in range(rng.choice((1, 1, 2, 5))):
            rows.append((1000 - 5 * i - k, " ".join(text) + (" " + line if i % 3 == 0 else "")))
            for _ in range(rng.randint(0, max(1, len(text) // 25))):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
    rows += rows[-20:]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"rep": F.lit("x"), "KEY": F.lit(1), "n_shingles": F.lit(0.5), "payload": F.lit(None).cast("int")})
    want = brute(rows)
    assert sorted((tuple(r) for r in h.near_duplicates(docs).collect()), key=str) == want
    assert sum(r[1] > 0 and not r[3] for r in want) > 50
    assert h.near_duplicates(docs.limit(0)).count() == 0


def test_registers():
    """Leading zeros and the bits after the first one, of the smallest remixed hash in each bucket."""
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 5000):
        hashes = np.unique(rng.integers(0, 1 << 64, n, np.uint64, endpoint=False)) if n else np.empty(0, np.uint64)
        least = {}
        for x, v in zip(hashes.tolist(), h._mixed(hashes).tolist(), strict=True):
            b = (x >> 32) * h.BUCKETS >> 32
            least[b] = min(v | 1, least.get(b, 1 << 64))
        want = [h.EMPTY if b not in least else (64 - least[b].bit_length() << h.MANTISSA) + ((least[b] << 64 - least[b].bit_length() + 1 & (1 << 64) - 1) >> 64 - h.MANTISSA) for b in range(h.BUCKETS)]
        assert h.registers(hashes).tolist() == want
    assert h.registers(np.array([0], np.uint64)).max() == h.EMPTY


def test_estimate():
    """The corrected estimate is right on average, and that of sets without a common shingle is chance alone."""
    rng = np.random.default_rng(2)
    for measure in (0.0, 0.5, 0.9):
        found, by_chance = [], []
        for _ in range(300):
            n = 600
            both = round(2 * n * measure / (1 + measure))
            x = rng.integers(0, 1 << 63, 2 * n - both, np.uint64)
            a, b = h.registers(np.unique(x[:n])), h.registers(np.unique(x[n - both :]))
            some, equal = ((a != h.EMPTY) | (b != h.EMPTY)).sum(), ((a == b) & (a != h.EMPTY)).sum()
            c = float(h.chance(n, np.array([n]))[0])
            found.append((equal / some - c) / (1 - c))
            by_chance.append(c)
        assert abs(statistics.mean(found) - measure) < 0.01 and 0 < by_chance[0] < 0.001


def test_shingle_sets():
    """As many hashes as distinct shingles, equal for equal shingles in other documents and chunks."""
    texts = ["a b c a b c a", "c a b c", "x", "x y", "x y z", "", "q " * 300]
    sets = list(h.shingle_sets([h.words(t.encode()) for t in texts], WordHashes()))
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    for k in (1, 3, 5):
        alone = [next(h.shingle_sets([h.words(t.encode())], WordHashes(), k)) for t in texts]
        assert all((a == b).all() for a, b in zip(alone, h.shingle_sets([h.words(t.encode()) for t in texts], WordHashes(), k), strict=True))
    assert len(np.intersect1d(sets[0], sets[1])) == len(shingles(texts[0]) & shingles(texts[1])) and len({*sets[2].tolist(), *sets[3].tolist(), *sets[4].tolist()}) == 3
