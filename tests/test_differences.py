"""Cases in which a query and its statement differed, or a statement was cut down."""

import duckdb
from conftest import same_rows
from pyspark.sql import functions as F

from lumenweir.functions import search
from lumenweir.operators import chunking
from lumenweir.plans import catalog, document_queries


def test_sentences_keep_digits_at_their_ends(spark):
    x = spark.createDataFrame([("See it. 1st of 101!  22 left\n3 or 3",)], "text string")
    assert x.select(chunking.sentences(F.col("text")).alias("s")).first()["s"] == ["See it.", "1st of 101!", "22 left", "3 or 3"]


def test_overlap_of_variations_of_one_length(spark, tmp_path):
    turns = [(1, 0, "user", "abcdefgh"), (1, 1, "assistant", "x"), (1, 2, "user", "aaaaaaab"), (2, 0, "user", "aaaaaaab"), (2, 1, "assistant", "x"), (2, 2, "user", "abcdefgh")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    df = catalog.queries()["question_variations"](spark, str(tmp_path))
    same_rows(df, con.sql(catalog.oracle_sql()["question_variations"]))
    assert {(r.conv_id, r.overlap, r.valid) for r in df.collect()} == {(1, 0.25, True), (2, 1.0, False)}  # of the original's characters, those in the variation
    a, b = F.lit("abcdefgh"), F.lit("aaaaaaab")
    assert spark.range(1).select(search.valid_variation(b, a).alias("x")).first()["x"]


def test_stream_of_events_in_many_files(spark, duck, tmp_path):
    path = f"{tmp_path}/events.parquet"
    events = duck.sql("SELECT event_id, ts, user_id % 5 AS user_id, event_type, value, props FROM events")
    for i in range(4):
        con = duckdb.connect()
        rows = sorted(r for r in events.fetchall() if r[0] % 4 == i)
        con.sql("CREATE TABLE e (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
        con.executemany("INSERT INTO e VALUES (?, ?, ?, ?, ?, ?)", rows)
        (tmp_path / "events.parquet").mkdir(exist_ok=True)
        con.sql(f"COPY e TO '{path}/{i}.parquet' (FORMAT parquet)")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{path}/*.parquet'")
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")  # a task for each file
    try:
        same_rows(catalog.queries()["limited_stream"](spark, str(tmp_path)), con.sql(catalog.oracle_sql()["limited_stream"]))
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)


def test_all_categories_are_scored():
    sql = catalog.oracle_sql()["l1_categories"]
    assert all(f"'{w}'" in sql for words in document_queries.CATEGORIES.values() for w in words)
    assert all(set(words) <= set(document_queries._TOPICS[name]) for name, words in document_queries.CATEGORIES.items())


def test_synonym_patterns_at_runs(spark):
    """Searched from the begins of runs, the patterns find what they find from everywhere, and long runs take no square of their length."""
    import random
    import time

    from pyspark.sql import functions as F

    from lumenweir.plans.document_queries import _AT_RUN, SYNONYM_PATTERNS, synonym_pairs

    rng = random.Random(3)
    pieces = ["(", ")", "（", "）", "이하 ", ",", ", ", "일명", "또는 ", "로도 알려진", "라고도 불리는 ", "이", "가", " ", "  ", "ab", "c", "가나", "\u00a0", "1."]
    texts = ["".join(rng.choices(pieces, k=rng.randrange(1, 25))) for _ in range(1500)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, x string")
    for p, _ in SYNONYM_PATTERNS:
        found = df.select("x", *(F.regexp_extract_all("x", F.lit(f"{head}{p}"), F.lit(0)).alias(n) for n, head in (("every", "(?U)"), ("run", _AT_RUN)))).collect()
        assert all(r["every"] == r["run"] for r in found) and any(r["every"] for r in found)
    began = time.time()
    assert synonym_pairs(spark.createDataFrame([(1, "x" * 60_000 + " (")], "id long, x string"), "id", "x", ("pos",)).count() == 0
    assert time.time() - began < 20
