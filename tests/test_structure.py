"""Chunking, cleaning and trees against literal rows; whole-table queries without SQL against brute force."""

import re

from conftest import DATA
from pyspark.sql import functions as F

from lumenweir.operators import merging, structure
from lumenweir.operators.near_duplicates import shingles_of
from lumenweir.plans import catalog


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()["x"]


def test_clean_passage():
    assert structure.clean_passage("short") == "short"
    assert structure.clean_passage("A  line here.\n\n\n\nNext one.\na LINE here.\nNext one.") == "A line here.\n\nNext one."
    assert structure.clean_passage("A first sentence that is done. And then a frag") == "A first sentence that is done."
    assert structure.clean_passage("설정을 마칩니다. 다음 단계는 조각") == "설정을 마칩니다."
    assert structure.clean_passage("x" * 200 + ". " + "y" * 150) == "x" * 200 + ". " + "y" * 150


def test_paragraph_chunks():
    assert structure.paragraph_chunks("a\n\nb\n\n\n\nc", 6) == ["a\n\nb", "c"]
    assert structure.paragraph_chunks("", 10) == [""]
    assert structure.paragraph_chunks("One two. Three four. Five.\n\nx", 12) == ["One two.", "Three four.", "Five.\n\nx"]
    text = "\n\n".join("p" * n for n in (5, 40, 7, 3))
    assert all(len(c) <= 40 for c in structure.paragraph_chunks(text, 20))


def test_sections_and_articles():
    text = "intro\n# A\na\n### C\nc\n### D\nd\n## B\n\nb"
    assert list(structure.sections(text)) == [("", "intro"), ("A", "a"), ("A > C", "c"), ("A > D", "d"), ("A > B", "\nb")]
    assert structure.heading_chunks("plain text") == [("", "plain text")]
    law = "# 법\n##### 제1조\n" + "가" * 50 + "\n##### 제2조\n" + "문장입니다. " * 10
    made = structure.legal_chunks(law, most=20, article=55)
    assert made[0] == ("법 > 제1조", "가" * 50) and {p for p, _ in made} == {"법 > 제1조", "법 > 제2조"} and len(made) > 2


def test_ocr(spark):
    assert one(spark, structure.ocr_spacing(F.col("a")), a="회 의 자 료 및 기록") == "회의자료 및 기록"
    assert one(spark, structure.ocr_numbers(F.col("a")), a="159,0008 and 95,840") == "159,000 and 95,840"
    assert one(spark, structure.initial_consonants(F.col("a")), a="서버 ab 까치") == "ㅅㅂㄲㅊ"
    assert structure.unrepeated_ocr("[OCR] x [Page 1 OCR]same text[Image 2 OCR] same  text [Page 2 OCR]other") == "[OCR] x [Page 1 OCR]same text[Page 2 OCR]other"
    assert structure.unrepeated_ocr("[Page 1 OCR]a[Page 2 OCR]a") == "[Page 1 OCR]a[Page 2 OCR]a"
    assert one(spark, structure.ocr_noise(F.col("a")), a="") == 0.0 and one(spark, structure.ocr_noise(F.col("a")), a="====ㅋ") == 1.0


def test_edges_of_texts(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (None, "a b"), (3, "word " * 20_000), (3, "word " * 20_000)], "doc_id long, text string")
    for f in (structure.heading_chunks, structure.legal_chunks):
        assert structure.each_text(rows, f, "path string, text string").count() > 0
    assert structure.clean_passages(rows).count() == 2 and structure.clean_passages(rows.limit(0)).count() == 0


def test_context_prefix(spark):
    c = lambda **v: one(spark, structure.context_prefix(F.col("t"), F.col("a"), F.col("p"), F.col("k"), F.lit(0), F.lit(3), F.col("s")), **v)
    assert c(t="1234567890_Guide.PDF", a="Kim", p="A > B", k="table", s="short") == "[Context] Guide | Kim | §1/3\n[Summary] short\n[섹션: A > B]\n[유형: table]\n\n"
    assert len(c(t="x" * 80, a="y" * 60, p="z" * 60, k="body", s=None)) == 150


def test_tree_of_pages(spark):
    rows = spark.createDataFrame([(1, f"c{i}", None, i) for i in range(7)] + [(2, "c", "A > B", 0)], "doc_id long, chunk_id string, heading_path string, chunk_index int")
    sections, edges = structure.document_tree(rows, "kb")
    assert [(r["title"], r["place"]) for r in sections.where("doc_id = 1").orderBy("place").collect()] == [("p.1-5", 0), ("p.6-10", 1)]
    assert [r["level"] for r in sections.where("doc_id = 2").orderBy("place").collect()] == [1, 2]
    kinds = {r["type"]: r["count"] for r in edges.groupBy("type").count().collect()}
    assert kinds == {"HAS_TREE_ROOT": 2, "HAS_TREE_SECTION": 4, "HAS_TREE_PAGE": 8, "TREE_NEXT_SIBLING": 5 + 1}


def test_upsert_of_equal_keys(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, at int")
    new = spark.createDataFrame([(2, "c", 2), (2, "d", 3), (3, "e", 2)], "k int, v string, at int")
    assert sorted(map(tuple, merging.upsert(old, new, ["k"], "at").collect())) == [(1, "a", 1), (2, "d", 3), (3, "e", 2)]
    assert merging.upsert(old, new.limit(0), ["k"], "at").count() == 2
    assert sorted(map(tuple, merging.upsert(old, new.withColumn("v", F.lit(None).cast("string")), ["k"], "at", keep_null=True).collect())) == [(1, "a", 1), (2, "b", 3), (3, None, 2)]


def test_staged_dedup(spark):
    """Against all pairs: exact copies name the first; pairs alike by 0.8 or more of five-word shingles are one group."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in catalog.queries()["staged_dedup"](spark, DATA).collect()}
    sets = {i: shingles_of(t, 5) for i, t in docs.items()}
    ids = sorted(docs)
    for i in ids:
        same = [j for j in ids if docs[j].strip().lower() == docs[i].strip().lower()]
        assert (got[i]["state"] == "exact") == (same[0] != i)
    near = [(i, j) for i in ids for j in ids if j < i and got[i]["state"] != "exact" and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert near and sum(got[i]["state"] != "near" for i, _ in near) <= max(1, 0.1 * len(near))
    alike = lambda i, j: len(sets[i] & sets[j]) >= 0.7 * len(sets[i] | sets[j])
    assert all(any(alike(i, j) for j in ids if j != i) for i in ids if got[i]["state"] == "near")


def test_deduplicated_qa(spark):
    turns = {(r["conv_id"], r["turn"]): r for r in spark.read.parquet(f"{DATA}/conversations.parquet").collect()}
    grams = {}
    for (c, n), r in turns.items():
        a = turns.get((c, n + 1))
        if r["role"] == "user" and a and a["role"] == "assistant":
            x = re.sub(r"\s+", "", r["text"] + " " + a["text"]).lower()
            grams[c * 1_000_000 + n] = {x[i : i + 3] for i in range(max(1, len(x) - 2))}
    kept = {r["doc_id"] for r in catalog.queries()["deduplicated_qa"](spark, DATA).collect()}
    for i in grams:
        alike = [j for j in grams if j != i and len(grams[i] & grams[j]) >= 0.85 * len(grams[i] | grams[j])]
        assert i in kept or alike
        assert not (i in kept and any(j in kept for j in alike))
