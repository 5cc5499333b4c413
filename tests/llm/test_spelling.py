"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from lumenweir.llm import spelling


def brute(rows, least, shortest, ratio, every=199):
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            at = h % len(run)
            counts[run if h % every else run[:at] + run[at + 1 :]] += 1
    words = {w: n for w, n in counts.items() if n >= least and len(w) >= shortest}

    def near(a, b):
        if len(a) < len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))

    out, form = {}, {}
    for w, n in words.items():
        others = sorted((-words[v], v) for v in words if near(w, v))
        form[w] = others[0][1] if others and -others[0][0] >= ratio * n else None
        out[w] = (n, len(others), form[w] and words[form[w]])
    result = set()
    for w, (n, k, m) in out.items():
        root = w
        while form[root]:
            root = form[root]
        result.add((w, form[w], root, n, k, m))
    return result


def test_brute_force(spark):
    """Words over few letters, so that runs of equal letters, ties and chains of forms are frequent."""
    rng = random.Random(13)
    words = ["".join(rng.choice("abé") for _ in range(rng.randint(3, 6))) for _ in range(120)]
    rows = [(i if i % 7 else None, " ".join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=rng.randint(0, 200)))) for i in range(60)]
    rows += [(1, None), (2, ""), (3, "aab ÀB_aab×÷"), (3, "aab ÀB_aab×÷"), (4, "Ab" * 20000), (5, "12 !? Ā")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"Word": F.lit("x"), "n": F.lit(1), "TEXT2": F.lit(None).cast("string")})
    for every in (199, 3):
        got = {tuple(r) for r in spelling.variants(docs, least=3, shortest=3, ratio=2, every=every).collect()}
        want = brute(rows, 3, 3, 2, every)
        assert got == want and any(r[1] and r[1] != r[2] for r in want)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id string, text string")
    assert spelling.variants(none).count() == 0
    assert spelling.variants(none).columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_rotations(spark):
    """Each place of a word gives the rotation behind it as a prefix; only first letters of a run stand for a deletion."""
    got = {tuple(r) for r in spelling.rotations(spark.createDataFrame([("aab", 9)], "word string, n long")).collect()}
    want = {("aab$", "", True), ("ab$a", "", True), ("b$aa", "", True), ("$aab", "", True), ("ab$", "a", True), ("b$a", "a", False), ("$aa", "b", True)}
    assert got == {(*x, "aab", 9) for x in want}
