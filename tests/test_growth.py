"""What queries write and hold doesn't grow faster than their input."""

import numpy as np
from conftest import DATA
from pyspark.sql import functions as F

from lumenweir.functions import text
from lumenweir.operators import graph, near_duplicates
from lumenweir.plans import catalog


def test_process_walks(spark, monkeypatch):
    """Walks are made where a process lies: one table is stored, and a result needs one shuffle and no join. Where walks are
    many, they go on as rows of their own, with the same result."""
    real, made, tables, chain = graph.stored, graph.process_chain, [], []
    monkeypatch.setattr(graph, "stored", lambda df: tables.append(df) or real(df))
    monkeypatch.setattr(graph, "process_chain", lambda *a: chain.append(a) or made(*a))
    df = catalog.queries()["process_walks"](spark, DATA)
    rows = sorted(map(tuple, df.collect()))
    assert len(tables) == 1 and rows
    plans = [x._jdf.queryExecution().executedPlan().toString() for x in (tables[0], df)]
    assert sum(p.count("Exchange hashpartitioning") for p in plans) == 1 and not any("Join" in p for p in plans)
    assert sorted(map(tuple, made(chain[0][0], most_walks=2).collect())) == rows and len(tables) > 2


def test_signatures_of_words():
    """A word is hashed once, not each shingle that it is in: equal shingles are equal numbers, others differ, and the least
    remainders are the exact ones."""
    words = [f"w{i % 40}" for i in range(400)] + ["x", "y"]
    joined, known = " ".join(words), near_duplicates._Words()
    x = near_duplicates.hashed_shingles(joined, 5, known)
    shingles = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    assert len(known) == 42 and len(set(zip(shingles, x.tolist(), strict=True))) == len(set(shingles)) == len(set(x.tolist()))
    assert not len(near_duplicates.hashed_shingles(" ", 5, known)) and len(near_duplicates.hashed_shingles("x y", 5, known)) == 1
    a, b = near_duplicates.parameters()
    largest = np.array([near_duplicates.PRIME - 1, 0, *x], np.uint64)
    assert near_duplicates._least(largest, a, b).tolist() == [min((int(i) * int(v) + int(j)) % near_duplicates.PRIME for v in largest) for i, j in zip(a, b, strict=True)]
    assert int(a.max()) * (near_duplicates.PRIME - 1) + int(b.max()) < 1 << 64


def test_char_ngrams(spark):
    """Characters are parted once, not sought from the text's beginning for each n-gram; null, short and wide ones as ever."""
    texts = [None, "", "ab", "abc", "abcabc", "a\nb\nc", "x\U0001f600y\U0001f600z", "üßü"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").repartition(2).select("i", text.char_ngrams(F.col("x")).alias("g"))
    want = {i: [x] if x is None or len(x) < 3 else list(dict.fromkeys(x[k : k + 3] for k in range(len(x) - 2))) for i, x in enumerate(texts)}
    assert {r["i"]: r["g"] for r in df.collect()} == want
    assert "substring(" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_lexical_scores(spark, duck, tmp_path):
    """Rows are given out from arrays of keys, one run of others for term after term, above
    the last join. Terms without a name are there, as the statement has them."""
    one = spark.read.parquet(f"{DATA}/part.parquet")
    more = one.crossJoin(spark.range(40)).withColumn("p_partkey", F.col("p_partkey") + 200 * F.col("id")).drop("id")
    more.withColumn("p_name", F.when(F.col("p_partkey") % 17 != 0, F.col("p_name"))).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    df = catalog.queries()["lexical_scores"](spark, str(tmp_path))
    df.write.parquet(f"{tmp_path}/out")
    here = duck.cursor()
    here.sql(f"CREATE TEMP VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    here.sql(f"CREATE TEMP VIEW ours AS SELECT a, b, distance, score FROM '{tmp_path}/out/*.parquet'")
    here.sql(f"CREATE TEMP TABLE theirs AS SELECT a, b, distance, round(score, 6) AS score FROM ({catalog.oracle_sql()['lexical_scores']})")
    assert here.sql("(FROM ours EXCEPT ALL FROM theirs) UNION ALL (FROM theirs EXCEPT ALL FROM ours)").fetchall() == []
    assert here.sql("SELECT count(*) FROM ours WHERE score IS NULL").fetchall()[0][0] > 0
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("explode(of_b") < plan.index("explode(of_a") < plan.index("Join")
