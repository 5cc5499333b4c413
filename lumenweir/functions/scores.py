"""Column functions for trust, freshness, confidence and rank scores. Ages are counted from a given day, never from now."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights and thresholds that results depend on.
HALF_LIFE_DAYS = {"policy": 90, "technical": 60, "faq": 120, "general": 180}
KTS_WEIGHTS = {"source": 0.20, "freshness": 0.20, "validation": 0.25, "usage": 0.10, "hallucination": 0.15, "consistency": 0.10}
TIERS = ((85, "high"), (70, "medium"), (50, "low"))
USAGE_WEIGHTS = {"views": 0.2, "citations": 0.3, "ctr": 0.3, "bookmarks": 0.2}
USAGE_MOST = {"views": 10_000, "citations": 500, "bookmarks": 1_000}
CRAG_WEIGHTS = {"relevance": 0.40, "coverage": 0.25, "freshness": 0.20, "specificity": 0.15}
RERANK = {"model": 0.6, "base": 0.3, "source": 0.1, "faq": 1.2, "graph": 0.15, "decay": 0.3}


def age_days(c: Column, as_of: str) -> Column:
    return F.datediff(F.lit(as_of).cast("date"), c.cast("date"))


def exact_age(c: Column, as_of: str) -> Column:
    """In days and parts of a day, from 0 on."""
    at = F.unix_micros(F.lit(as_of).cast("timestamp"))
    return F.greatest((at - F.unix_micros(c.cast("timestamp"))) / 86_400_000_000, F.lit(0.0))


def validation(up: Column, down: Column, reviews: Column, reports: Column) -> Column:
    """Votes, an expert's review as five, an open report as three."""
    return wilson(up + 5 * reviews, down + 3 * reports)


def wilson(positive: Column, negative: Column, z: float = 1.96) -> Column:
    """The lower bound of the 95 % interval of a share; 0.5 without votes."""
    n = positive + negative
    p = positive / n
    return F.when(n == 0, 0.5).otherwise((p + z * z / (2 * n) - z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n))


def exponential_freshness(age: Column, half_life: Column, least: float = 0.1) -> Column:
    return F.greatest(F.lit(least), F.pow(F.lit(2.0), -F.greatest(age, F.lit(0)) / half_life))


def cosine_freshness(age: Column, lifespan: Column) -> Column:
    """1 when new, 0 from the end of its life, along half a cosine."""
    p = F.least(F.greatest(age / lifespan, F.lit(0.0)), F.lit(1.0))
    return F.lit(0.5) * (1 + F.cos(F.lit(3.141592653589793) * p))


def stale_after_days(lifespan: Column, threshold: float = 0.5) -> Column:
    """The age at which cosine freshness falls to a threshold."""
    return F.ceil(lifespan * F.acos(F.lit(2 * threshold - 1)) / 3.141592653589793)


def freshness_status(age: Column) -> Column:
    return F.when(age.isNull(), "unknown").when(age <= 90, "current").when(age <= 365, "stale").when(age <= 730, "outdated").otherwise("archived")


def step_freshness(age: Column) -> Column:
    return F.when(age.isNull(), 0.5).when(age <= 30, 1.0).when(age <= 90, 0.8).when(age <= 180, 0.5).otherwise(0.3)


def usage_score(views: Column, citations: Column, ctr: Column, bookmarks: Column) -> Column:
    norm = lambda c, k: F.log1p(c) / F.log1p(F.lit(USAGE_MOST[k]))
    total = USAGE_WEIGHTS["views"] * norm(views, "views") + USAGE_WEIGHTS["citations"] * norm(citations, "citations") + USAGE_WEIGHTS["ctr"] * F.least(F.greatest(ctr, F.lit(0.0)), F.lit(1.0)) + USAGE_WEIGHTS["bookmarks"] * norm(bookmarks, "bookmarks")
    return F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0))


def trust_score(**parts: Column) -> Column:
    """0 to 100, to two digits, from source, freshness, validation, usage, hallucination and consistency."""
    total = sum((parts[k] * w for k, w in KTS_WEIGHTS.items()), F.lit(0.0))
    return F.round(F.least(F.greatest(total * 100, F.lit(0.0)), F.lit(100.0)), 2)


def tier(score: Column) -> Column:
    out = None
    for least, name in TIERS:
        out = F.when(score >= least, name) if out is None else out.when(score >= least, name)
    return out.otherwise("uncertain")


def sigmoid(x: Column, temperature: float = 3.0) -> Column:
    return 1 / (1 + F.exp(-x / temperature))


def graph_bonus(distance: Column) -> Column:
    return F.when(distance > 0, RERANK["graph"] / (1 + (distance - 1) * RERANK["decay"])).otherwise(0.0)


def crag_score(relevance: Column, coverage: Column, freshness: Column, specificity: Column) -> Column:
    w = CRAG_WEIGHTS
    return w["relevance"] * relevance + w["coverage"] * coverage + w["freshness"] * freshness + w["specificity"] * specificity


def crag_action(score: Column, chunks: Column, correct: float = 0.7, ambiguous: float = 0.4) -> Column:
    return F.when(chunks == 0, "incorrect").when(score >= correct, "correct").when(score >= ambiguous, "ambiguous").otherwise("incorrect")
