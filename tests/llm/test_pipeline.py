"""The stages over a small corpus with planted copies, passages and junk."""

import corpus_pipeline
from conftest import DATA


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert now.columns == docs.columns and 0 < now.count() <= docs.count()
            assert now.join(docs, "doc_id", "left_anti").count() == 0
        docs = now
    sums = docs.groupBy("sequence_id").agg({"length": "sum"}).toPandas()
    assert (sums["sum(length)"] <= 2048).all()


def test_run(spark):
    got = corpus_pipeline.run(spark, DATA)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(got.columns) and got.count() > 0


def test_stages_take_edges(spark):
    """Nulls, empty and repeated rows, and columns whose names clash with those that stages add or differ in case only."""
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "a b", None, None, None), (3, "a b", None, None, None)]
    rows = [(*r, f"own {i}", -1.0, 7, "k", "T", [1]) for i, r in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, extra string, score double, lines_deleted int, _key string, n_hit string, c0 array<int>")
    docs = docs.withColumn("Score2", docs.score)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        if name != "packing":
            assert out.columns == docs.columns
            known = {tuple(map(str, r)) for r in docs.collect()}
            assert {tuple(map(str, r)) for r in out.collect()} <= known
        else:
            assert out.count() == len(rows)
        assert stage(spark, docs.limit(0), DATA).count() == 0
