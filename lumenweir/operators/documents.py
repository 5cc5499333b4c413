"""Ingestion gate, quality grading and exact dedup over document tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t

# Thresholds that results depend on.
GOLD, GOLD_STRUCTURED, SILVER, SILVER_STRUCTURED, BRONZE = 2000, 1000, 500, 200, 50
MOST_BYTES = 100 * 1024 * 1024


def first_seen(docs: DataFrame, key: str, order: str = "doc_id") -> DataFrame:
    """With duplicate_of: the first row's id of an equal key, null for that row itself and for null keys. The keys' least
    ids are summed up before they are joined, so that a key of many rows isn't gathered."""
    first = docs.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min(order).alias("_first"))
    keyed = docs.where(F.col(key).isNotNull()).join(first, F.col(key) == F.col("_key"))
    keyed = keyed.select(*docs.columns, F.when(F.col("_first") != F.col(order), F.col("_first")).alias("duplicate_of"))
    return keyed.unionByName(docs.where(F.col(key).isNull()).withColumn("duplicate_of", F.lit(None).cast(docs.schema[order].dataType)))


def gate_checks(docs: DataFrame, text: str = "text") -> DataFrame:
    """Verdicts of the checks that a text alone allows; a null text is an empty one, which fails."""
    docs = docs.withColumn("_body", t.trimmed(F.col(text)))
    body, whole = F.col("_body"), F.coalesce(F.col(text), F.lit(""))
    n = F.length(body)
    words = F.regexp_count(body, F.lit(r"[0-9A-Za-z_À-ÖØ-öø-ÿ가-힣]+"))
    ko, en = F.regexp_count(F.substring(body, 1, 2000), F.lit("[가-힣]")), F.regexp_count(F.substring(body, 1, 2000), F.lit("[A-Za-z]"))
    verdict = {
        "ig03": F.when(n == 0, "fail").when(n < BRONZE, "warn").otherwise("pass"),
        "ig04": F.when(whole.rlike(t.DEPRECATED), "fail").otherwise("pass"),
        "ig07": F.when(F.octet_length(whole) > MOST_BYTES, "fail").otherwise("pass"),
        "ig10": F.when(n < 25, "fail").when((n < SILVER) | (words < 10), "warn").otherwise("pass"),
        "ig11": F.when(n < 20, "skip").when((ko > en) | (en > 0), "pass").otherwise("warn"),
        "ig12": F.when(n < BRONZE, "fail").otherwise("pass"),
    }
    return docs.withColumns(verdict).drop("_body")


def gate_action(checked: DataFrame) -> DataFrame:
    """With ig05, from duplicate_of (see first_seen), and the gate's action."""
    out = checked.withColumn("ig05", F.when(F.col("duplicate_of").isNotNull(), "fail").otherwise("pass"))
    core = sum(((F.col(k) == "fail").cast("int") for k in ("ig03", "ig04", "ig10", "ig11")), F.lit(0))
    hard = (F.col("ig05") == "fail") | (F.col("ig12") == "fail")
    return out.withColumn("action", F.when(F.col("ig07") == "fail", "quarantine").when(hard | (core >= 2), "reject").when(core == 1, "hold").otherwise("proceed"))


def quality_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    c = F.col(text)
    return docs.withColumns({
        "content_length": F.length(c), "has_tables": c.rlike(r"\|.*\|.*\|"), "has_code": c.rlike(r"```|<code>"), "has_headers": c.rlike(r"(?m)^#{1,6}\s") | c.rlike(r"<h[1-6]>"),
        "has_images": c.rlike(r"!\[.*\]\(.*\)|<img"), "has_links": c.rlike(r"\[.*\]\(.*\)|<a\s+href"), "word_count": F.size(t.tokens(c)), "paragraph_count": F.regexp_count(c, F.lit(r"\n\n+")) + 1,
    })


def quality_tier() -> Column:
    """From the columns of quality_metrics."""
    n = F.col("content_length")
    rich = F.col("has_tables") | F.col("has_code")
    gold = (n >= GOLD) | ((n >= GOLD_STRUCTURED) & rich)
    silver = (n >= SILVER) | ((n >= SILVER_STRUCTURED) & (rich | F.col("has_headers")))
    return F.when(gold, "GOLD").when(silver, "SILVER").when(n >= BRONZE, "BRONZE").otherwise("NOISE")


def quality_score(tier: Column) -> Column:
    """0 to 100: up to 60 for the logarithm of the length, 8 for each mark of structure, and a bonus by tier; 50 without metrics."""
    n = F.col("content_length")
    base = F.when(n > 0, F.least(F.lit(60.0), F.log1p(n) / F.log1p(F.lit(5000)) * 60)).otherwise(0.0)
    marks = sum((F.col(k).cast("int") for k in ("has_tables", "has_code", "has_headers", "has_images", "has_links")), F.lit(0)) * 8
    bonus = F.when(tier == "GOLD", 15).when(tier == "SILVER", 10).when(tier == "BRONZE", 5).otherwise(0)
    return F.when(n.isNull(), 50.0).otherwise(F.least(F.lit(100.0), F.round(base + marks + bonus, 1)))


def latest_version(pages: DataFrame, key: str, *order: str) -> DataFrame:
    """The row of each key that is last in order; partial maxima first, so that a key of many rows isn't gathered."""
    rest = [c for c in pages.columns if c != key]
    best = pages.groupBy(key).agg(F.max(F.struct(*order, *(c for c in rest if c not in order))).alias("_r"))
    return best.select(key, *(F.col(f"_r.{c}").alias(c) for c in rest))


def capped_per_group(rows: DataFrame, group: str, order: str, most: int) -> DataFrame:
    """At most so many rows of each group, chosen by a hash of the order column: groups are first cut to candidates by
    hash range, which keeps the window's input near `most` for large groups."""
    place = F.conv(F.substring(F.sha2(F.col(order).cast("string"), 256), 1, 8), 16, 10).cast("bigint")
    sized = rows.join(rows.groupBy(group).agg(F.count("*").alias("_n")), group).withColumn("_place", place)
    near = sized.where(F.col("_place") <= (F.lit(2.0) ** 32) * F.least(F.lit(1.0), 4 * most / F.col("_n") + 1e-3))
    ranked = near.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy("_place", order)))
    return ranked.where(F.col("_rank") <= most).drop("_n", "_place", "_rank")
