"""Groups of alike sets of trigrams, against all pairs."""

import random

import numpy as np
from pyspark.sql import functions as F
from test_linking import components

from lumenweir.operators import near_duplicates, trigrams
from lumenweir.operators.linking import groups_of_keys


def _texts(count: int, rng: random.Random) -> list[str]:
    """Texts of few syllables, which share half of their trigrams but aren't alike."""
    syllables = [a + b for a in "thernos" for b in "aeionrst"]
    return ["".join(rng.choice(syllables) for _ in range(rng.randrange(60, 400))) for _ in range(count)]


def _alike(sets, least):
    return [(i, j) for i in sets for j in sets if i < j and len(sets[i]) and len(sets[j]) and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]) - 1e-9]


def test_alike_texts_in_any_blocks(spark):
    """All links are found, near the threshold and at any size, whether rows are in one block or many."""
    rng = random.Random(11)
    texts = [None, "", "", "a", "ab", "ab", "abc", "abcd", "x\U0001f600y\U0001f600z"]
    for x in _texts(25, rng):
        texts.append(x)
        for edits in (0, 2, 8, 14, 20):
            y = list(x)
            for at in rng.sample(range(len(y)), min(edits * len(y) // 300, len(y))):
                y[at] = chr(rng.randrange(0x4E00, 0x9FFF))
            texts.append("".join(y))
    wide = "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(9000))
    texts += [wide, wide[:-600], wide[2000:], wide[:4000] + "-" + wide[4000:]]
    ids = {100 + 7 * i: x for i, x in enumerate(texts)}
    sets = {i: {x[k : k + 3] for k in range(max(1, len(x) - 2))} if x else set() for i, x in ids.items()}
    assert all(len(trigrams.trigrams(x)) == len(sets[i]) for i, x in ids.items())
    links = _alike(sets, 0.85)
    want = components(ids, links)
    assert len(links) > 60 and sum(want[i] != i for i in ids) > 40
    docs = spark.createDataFrame(list(ids.items()), "doc_id long, text string").repartition(3)
    for most in (16384, 20):
        got = trigrams.alike_texts(docs, 0.85, most).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == want and len(got) == len(ids)


def test_unlike_texts_are_no_candidates(spark):
    """Texts that share many trigrams share bands of few hashes, too, by which groups grew with the square of the rows; sketches part them."""
    texts = _texts(300, random.Random(3))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marked = trigrams.marks(docs).select(F.col("doc_id").alias("rep"), "size", "sketch")
    assert trigrams.candidates(marked, 0.85, 64).isEmpty()
    words = docs.select("doc_id", F.array_join(F.transform(F.sequence(F.lit(1), F.length("text") - 2), lambda i: F.col("text").substr(i, F.lit(3))), " ").alias("text"))
    size = 4 * near_duplicates.ROWS
    band = lambda i: F.xxhash64(F.lit(i), F.substring("sig", F.lit(i * size + 1), F.lit(size)))
    keys = near_duplicates.signatures(words, 1).select(F.col("doc_id").alias("rep"), F.explode(F.array(*(band(i) for i in range(25)))).alias("key"))
    assert groups_of_keys(keys).count() > 300


def test_sketches_are_bounds(spark):
    """Sets differ in as many trigrams as their sketches in bits, or in more, at any width."""
    rng = np.random.default_rng(2)
    for n in (5, 400, 3000, 20000):
        a = np.unique(rng.integers(0, 1 << 60, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[n // 10 :], rng.integers(0, 1 << 60, n // 20 + 1).astype(np.uint64)]))
        x, y = trigrams._one_width([trigrams.sketch(a), trigrams.sketch(b)])
        assert 0 < np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))
