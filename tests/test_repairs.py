"""Cases that earlier forms of operators got wrong."""

import datetime as dt

import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from lumenweir.functions import search as q
from lumenweir.operators import merging, structure
from lumenweir.plans import catalog


@pytest.mark.parametrize(
    ("answer", "chunks", "note", "replaced"),
    [
        ("제공된 문서에는 환불 규정이 포함되어 있지 않습니다.", 3, None, True), ("제공된  문서들에는\n그 내용이 포함되어 있지 않습니다", 3, "", True), ("답: 제공된 문서에는 포함되어 있지 않습니다", 3, None, False),
        ("제공된 문서에는 포함되어 있지 않습니다" + " 길게" * 100, 3, None, False), ("환불은 7일 안에 됩니다", 3, "검색된 근거 문서 없이 생성되었습니다", True), ("환불은 7일 안에 됩니다", 3, "주의", False),
        ("환불은 7일 안에 됩니다", 0, None, True), (" \n", 2, None, True), ("자세한 것은 담당자에게 문의 바랍니다", 1, None, True), ("담당자에게 문의 바랍니다만 됩니다", 1, None, False),
    ],
)
def test_no_answer(spark, answer, chunks, note, replaced):
    row = spark.createDataFrame([(answer, chunks, note)], "a string, n int, d string")
    assert row.select(q.is_no_answer(F.col("a"), F.col("n"), F.col("d"))).first()[0] is replaced


def test_query_tokens(spark):
    row = spark.createDataFrame([("환불 대해 알려줘 The REFUND policy 어떻게 궁금",)], "t string")
    assert row.select(q.query_tokens(F.col("t"))).first()[0] == ["환불", "REFUND", "policy"]


def test_archived_takes_the_last_of_several(spark):
    at = [dt.datetime(2024, m, 1) for m in (1, 2, 3)]
    old = spark.createDataFrame([("a", "IN", "x", at[0], None), ("b", "IN", "x", at[0], None), ("c", "IN", "x", at[0], None)], "src string, type string, dst string, created_at timestamp, archived_at timestamp")
    new = spark.createDataFrame([("a", "IN", "y", at[1]), ("a", "IN", "z", at[2]), ("b", "IN", "y", at[1]), ("b", "IN", "x", at[2])], "src string, type string, dst string, at timestamp")
    got = {tuple(r) for r in merging.archived(old, new, "at").collect()}
    assert got == {("a", "WAS_IN", "x", at[0], at[2]), ("a", "IN", "z", at[2], None), ("b", "IN", "x", at[0], None), ("c", "IN", "x", at[0], None)}


def test_upsert_matches_null_keys(spark):
    old = spark.createDataFrame([(None, "a", 1), (2, "b", 1)], "k int, v string, t int")
    new = spark.createDataFrame([(None, "c", 2), (None, None, 3), (3, "d", 1)], "k int, v string, t int")
    assert {tuple(r) for r in merging.upsert(old, new, ["k"], "t").collect()} == {(None, None, 3), (2, "b", 1), (3, "d", 1)}
    assert {tuple(r) for r in merging.upsert(old, new, ["k"], "t", keep_null=True).collect()} == {(None, "a", 3), (2, "b", 1), (3, "d", 1)}


def test_heading_paths():
    text = "intro\n# A\nx\n### C\ny\n## B\nz\n# D\n### E\nu\n### G\nv"
    assert list(structure.sections(text)) == [("", "intro"), ("A", "x"), ("A > C", "y"), ("A > B", "z"), ("D > E", "u"), ("D > G", "v")]
    # by place, a heading that skips a level is where the skipped one would be, and a second one of its level comes below it
    assert list(structure.sections(text, by_place=True))[-2:] == [("D > E", "u"), ("D > E > G", "v")]
    assert list(structure.sections("")) == [("", "")] and list(structure.sections("# A")) == []
    assert structure.heading_chunks("# A\none\n\n## B\ntwo") == [("A", "one"), ("A > B", "two")]


def test_impact_of_documents_without_author(spark, tmp_path):
    """Documents of one author share counts; those without an author stand alone, as the statement has it."""
    from lumenweir.plans import catalog

    spark.createDataFrame([(1, 7), (2, 7), (3, None), (4, None), (5, 8)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, 10), (2, 10), (2, 11), (2, 11), (3, 12), (3, 13)], "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {tuple(r) for r in catalog.queries()["document_impact"](spark, str(tmp_path)).collect()}
    assert got == {(1, 1, 2), (2, 1, 2), (3, 0, 2), (4, 0, 0), (5, 0, 0)}


def test_document_sentences_of_odd_texts(spark, duck, tmp_path):
    """Null and empty texts, white space only, ends without a sentence after them: as the statement has them, and no error."""
    texts = [None, "", " \n ", "\n\n", "A. B!\n\nc", "  a  ", "ends. ", "\t", "a.\r\nb", "ü. \U0001f600x?y"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    here = duck.cursor()
    here.sql(f"CREATE TEMP VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    same_rows(catalog.queries()["document_sentences"](spark, str(tmp_path)), here.sql(catalog.oracle_sql()["document_sentences"]))
