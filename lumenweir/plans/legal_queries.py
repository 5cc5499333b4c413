"""Queries over legal texts and mistyped requests, which orders' and customers' rows give."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matching
from .registry import Registry, table
from .storage import stored

r = Registry()

# Patterns of articles and references, and known typing errors.
ARTICLE = r"(?m)^#{3,6}\s*제\s*(\d+)\s*조(?:의\s*(\d+))?\s*\(([^)]+)\)"
REFERENCE = r"「([^」\n]{2,80})」(?:\s*제\s*(\d+)\s*조(?:의\s*(\d+))?(?:\s*제\s*(\d+)\s*항)?(?:\s*제\s*(\d+)\s*호)?)?"
TYPOS = {
    "kuberenetes": "kubernetes", "kubernates": "kubernetes", "kuberentes": "kubernetes", "kubernets": "kubernetes", "argocdc": "argocd", "argoc": "argocd", "confluance": "confluence", "conflunce": "confluence",
    "jenkin": "jenkins", "쿠버네티즈": "쿠버네티스", "큐버네티스": "쿠버네티스", "쿠버네테스": "쿠버네티스", "쿠베네티스": "쿠버네티스", "파드드": "파드", "컨플루언스": "콘플루언스", "콘플루언쓰": "콘플루언스",
    "쉐어포인트": "셰어포인트", "셰어포인": "셰어포인트",
}


def law_slug(c):
    return F.regexp_replace(F.regexp_replace(F.trim(c), r"(?U)\s+", ""), "[「」]", "")


def article_id(slug, article, sub, clause=None, item=None):
    """The id of an article, with its sub-article, clause and item where there are any (empty: none)."""
    def part(before: str, c, after: str = ""):
        return F.lit("") if c is None else F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(before), c.cast("int"), F.lit(after))).otherwise("")

    return F.concat(slug, F.lit(":제"), article.cast("int"), F.lit("조"), part("의", sub), part("제", clause, "항"), part("제", item, "호"))


def articles(rows, key: str):
    """(key, id, title) of laws (key, slug, text): articles by their headings; of a number that comes twice, the first."""
    groups = [F.regexp_extract_all("text", F.lit(ARTICLE), F.lit(i)).alias(n) for i, n in ((1, "a"), (2, "s"), (3, "t"))]
    found = rows.select(key, "slug", F.posexplode(F.arrays_zip(*groups)).alias("n", "m"))
    named = found.select(key, "n", article_id(F.col("slug"), F.col("m.a"), F.col("m.s")).alias("id"), F.trim("m.t").alias("title"))
    return named.groupBy(key, "id").agg(F.min_by("title", "n").alias("title"))


def references(rows, key: str):
    """(key, source, target, scope) of laws (key, slug, text): references to other laws' articles, or to other laws as a whole; each once."""
    groups = [F.regexp_extract_all("text", F.lit(REFERENCE), F.lit(i)).alias(n) for i, n in enumerate(("law", "a", "s", "c", "i"), 1)]
    found = rows.select(key, "slug", F.explode(F.arrays_zip(*groups)).alias("m")).select(key, "slug", law_slug(F.col("m.law")).alias("law"), "m.a", "m.s", "m.c", "m.i")
    whole = F.coalesce("a", F.lit("")) == ""
    target = F.when(whole, F.col("law")).otherwise(article_id(F.col("law"), F.col("a"), F.col("s"), F.col("c"), F.col("i")))
    other = found.where((F.col("law") != "") & (F.col("law") != F.col("slug")))
    return other.select(key, F.col("slug").alias("source"), target.alias("target"), F.when(whole, "law").otherwise("article").alias("scope")).distinct()


def corrected(words, vocabulary, cutoff: float = 0.89):
    """(word, corrected, reason) of distinct words: by the table of typing errors; else, if it is of four ASCII letters and digits
    or more, the vocabulary's word of the best ratio of matching blocks, if that is `cutoff` or more; else as it is."""
    own = words.select("word", F.lower("word").alias("low"))
    known = F.try_element_at(F.create_map(*(F.lit(x) for kv in TYPOS.items() for x in kv)), F.col("low"))
    plain = own.where(F.col("low").rlike("^[a-z0-9]{4,}$")).select(F.col("low").alias("word"))
    close = matching.close_words(plain, vocabulary, cutoff).select(F.col("word").alias("low"), "match")
    found = own.withColumn("typo", known).join(close, "low", "left")
    fuzzy = F.col("match").isNotNull() & (F.col("match") != F.col("low"))
    return found.select("word", F.when(F.col("typo").isNotNull(), F.col("typo")).when(fuzzy, F.col("match")).otherwise(F.col("word")).alias("corrected"), F.when(F.col("typo").isNotNull(), "typo_map").when(fuzzy, "fuzzy").alias("reason"))


@r.query()
def corrected_words(spark, sf_dir):
    """The distinct words of users' questions, some with a letter too many or too few, corrected by the words of the documents."""
    letters = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("word")
    vocabulary = table(spark, sf_dir, "documents").select(letters).groupBy("word").agg(F.count("*").alias("n")).where("n >= 5")
    asked = table(spark, sf_dir, "conversations").where("role = 'user'").select(letters).distinct()
    k = F.pmod(F.crc32(F.col("word").cast("binary")), F.lit(4))
    typed = F.when(k == 0, F.concat(F.expr("left(word, 2)"), F.expr("substring(word, 4)"))).when(k == 1, F.concat(F.expr("left(word, 3)"), F.expr("substring(word, 3)"))).otherwise(F.col("word"))
    extra = spark.range(1).select(F.explode(F.array(*map(F.lit, ("Kubernates", "쿠버네티즈", "회의록")))).alias("word"))
    return corrected(asked.select(typed.alias("word")).union(extra).distinct(), stored(vocabulary))
