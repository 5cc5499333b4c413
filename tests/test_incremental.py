"""Incremental deduplication against one pass over the documents in order; paths, fused search and disambiguation."""

import random

import numpy as np
from pyspark.sql import functions as F

from lumenweir.operators import graph, matching
from lumenweir.operators import incremental as inc
from lumenweir.operators.near_duplicates import parameters, signature


def brute(rows):
    """Results of (arrival, doc_id, text, vec) in order, each against all that were indexed before it."""
    a, b = parameters()
    indexed, hashes, out = [], {}, []
    width = inc.HASHES // inc.BANDS
    for _, i, t, v in sorted(rows):
        key = (t or "").strip(" ").lower()
        if key in hashes:
            out.append((i, "exact", hashes[key], 1.0, "delete", 1))
            continue
        hashes[key] = i
        sig = signature(t or "", 5, a, b)
        near = [(float((sig == s).mean()), -k, j) for k, (j, s, _) in enumerate(indexed) if sig is not None and s is not None and any((sig[x : x + width] == s[x : x + width]).all() for x in range(0, inc.HASHES, width))]
        best = max(near, default=(0.0, 0, None))
        result = (i, "unique", None, 0.0, "keep", 2)
        if best[0] >= inc.NEAR:
            result = (i, "near", best[2], best[0], "review" if best[0] < inc.VERIFY else "merge", 3 if best[0] >= inc.VERIFY else 2)
            unit = lambda x: np.array(x) / np.linalg.norm(x)
            alike = [(round(float(unit(v) @ unit(w)), 9), -k, j) for k, (j, _, w) in enumerate(indexed) if v and w and len(v) == len(w)]
            if best[0] >= inc.VERIFY and alike and max(alike)[0] >= inc.SEMANTIC:
                result = (i, "semantic", max(alike)[2], max(alike)[0], "review", 3)
        out.append(result)
        indexed.append((i, sig, v))
    return sorted(out)


def test_any_split(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    rows = []
    for base in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(120)]
        vec = [rng.gauss(0, 1) for _ in range(6)]
        for _ in range(rng.randint(1, 12)):
            own = list(words)
            for _ in range(rng.choice((0, 0, 1, 2, 4))):
                own[rng.randrange(120)] = f"n{rng.random()}"
            v = rng.choice([None, [], [x + rng.gauss(0, 0.2) for x in vec], [1.0] * 4])
            rows.append((" ".join(own), v))
    rows += [(None, None), ("", None), (" A b ", None), ("a B", [1.0, 2.0])]
    rng.shuffle(rows)
    rows = [(k * 3 - 20, 1000 - k, t, v) for k, (t, v) in enumerate(rows)]
    want = brute(rows)
    assert {r[1] for r in want} == {"unique", "exact", "near", "semantic"}
    exact = spark.createDataFrame(rows, "arrival long, doc_id long, text string, vec array<double>")
    for name, cuts, most in (("one", [], 4096), ("three", [20, 21, 90], 4096), ("blocks", [60], 7)):
        monkeypatch.setattr(inc, "MOST", most)
        index = inc.DedupIndex(spark, str(tmp_path / name))
        for k, (low, high) in enumerate(zip([-99, *cuts], [*cuts, 9999], strict=True)):
            part = exact.where((F.col("arrival") >= low) & (F.col("arrival") < high))
            index.add(part, k)
            if name == "three" and k == 1:
                index.add(part, k)  # a batch that is run again replaces its part
        got = sorted((r[0], r[1], r[2], r[3], r[4], r[5]) for r in index.results().collect())
        assert [(r[:3], round(r[3], 6), r[4:]) for r in got] == [(r[:3], round(r[3], 6), r[4:]) for r in want], name


def test_nearest_signatures(spark):
    """Of a group only those that share a band are compared, also where a signature joins groups."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 32, (3, inc.HASHES), dtype=np.uint32)
    sigs = np.repeat(base, 30, axis=0)
    for k, s in enumerate(sigs):
        s[rng.permutation(inc.HASHES)[: k % 6]] = k
    links = base[0].copy()
    links[:8], links[120:] = base[1][:8], base[2][120:]  # shares a band with each
    sigs = np.vstack([sigs, links])
    rows = [(k, 1000 + k, s.astype("<u4").tobytes()) for k, s in enumerate(sigs)]
    index = spark.createDataFrame(rows, "arrival long, doc_id long, sig binary")
    asked = {}
    got = {r["arrival"]: (r["agreement"], r["other"]) for r in inc._nearest_signatures(index.where("arrival >= 40"), index).collect()}
    width = inc.HASHES // inc.BANDS
    for k in range(40, len(sigs)):
        same = sigs[:k] == sigs[k]
        near = [(m, -j) for j, m in enumerate(same.mean(1)) if same[j].reshape(inc.BANDS, width).all(1).any()]
        asked[k] = (max(near)[0], 1000 - max(near)[1]) if near else None
    assert got == {k: v for k, v in asked.items() if v}


def test_trails(spark):
    """Walks that use no edge twice, through a branch and a cycle."""
    edges = spark.createDataFrame([(1, "a", "b"), (2, "b", "c"), (3, "b", "d"), (4, "c", "a"), (5, "d", "b")], "edge long, src string, dst string")
    got = {(r["node"], "".join(r["nodes"])) for r in graph.trails(edges, spark.createDataFrame([("a",), ("x",)], "node string")).collect()}
    want = {("x", "x"), ("a", "a"), ("b", "ab"), ("c", "abc"), ("d", "abd"), ("a", "abca"), ("b", "abdb"), ("c", "abdbc"), ("a", "abdbca")}
    assert got == want
    assert graph.trails(edges, spark.createDataFrame([("a",)], "node string"), 1).count() == 2


def test_disambiguated(spark):
    rows = [(1, p, k, t, c) for p, ts in enumerate([["x", "y"], ["y", "x"], ["x", None], [None, "z"], ["q", "x"]]) for k, (t, c) in enumerate(zip(ts, (None, 0.4), strict=True), 1)]
    got = {r["place"]: (r["word_type"], r["reason"]) for r in matching.disambiguated(spark.createDataFrame(rows, "text long, place int, rank int, word_type string, confidence double"), 2).collect()}
    # of equally many neighbours' types the first wins; place 3 has no candidate of it
    assert got == {0: ("y", "majority"), 1: ("x", "majority"), 2: ("x", "majority"), 3: (None, "confidence"), 4: ("x", "majority")}
