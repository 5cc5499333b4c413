"""Column functions that score search results, and predicates over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from .search import words_of

# Weights that results depend on.
MODEL, BASE, SOURCE, POSITION, FAQ_BOOST, GRAPH, GRAPH_DECAY = 0.6, 0.3, 0.1, 0.0, 1.2, 0.15, 0.3
SOURCES = {"qdrant": 1.0, "web": 0.95, "web_search": 0.95, "graph": 0.98, "graph_search": 0.98, "cross_kb_graph": 1.0, "faq": 1.0, "faq_direct": 1.0, "faq-direct": 1.0}
AXES = {"causal": 1.2, "definitional": 1.0, "concept": 0.9, "temporal": 0.9, "process": 1.0, "actor": 0.8}
SECTION_BONUS, KEYWORD_BONUS, ENTITY_BONUS = 0.05, 0.1, 0.12
FRESH_DAYS, STALE_DAYS, OUTDATED_DAYS = 90, 365, 730


def _looked_up(table: dict[str, float], key: Column, default: float) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key), F.lit(default))


def source_contribution(kind: Column) -> Column:
    """A source type's part of a score; unknown and missing types count as the plain index."""
    kind = F.lower(F.coalesce(kind, F.lit("qdrant")))
    boost = _looked_up(SOURCES, kind, 1.0) * F.when(kind == "faq", FAQ_BOOST).otherwise(1.0)
    return F.least(boost, F.lit(FAQ_BOOST)) / FAQ_BOOST * SOURCE


def graph_bonus(distance: Column, axis: Column) -> Column:
    """For chunks found in the graph: less with each hop, weighted by the axis that led there."""
    return F.when(distance > 0, GRAPH / (1 + (distance - 1) * GRAPH_DECAY) * _looked_up(AXES, F.coalesce(axis, F.lit("")), 1.0)).otherwise(0.0)


def position_prior(index: Column, total: Column, weight: float = POSITION) -> Column:
    return weight * (1.0 - index / F.greatest(total, F.lit(1)))


def keyword_bonus(query: Column, content: Column) -> Column:
    """For the share of the query's words of two letters or more that the content holds."""
    words = F.filter(words_of(F.lower(query)), lambda w: F.length(w) >= 2)
    found = F.filter(words, lambda w: F.contains(F.lower(content), w))
    return F.when(F.size(words) > 0, KEYWORD_BONUS * (F.size(found) / F.size(words))).otherwise(0.0)


def entity_bonus(query: Column, name: Column) -> Column:
    """If the document's name has a store or a person that the query names."""
    named = F.concat(F.regexp_extract_all(query, F.lit(r"(?U)[\w가-힣]+점"), F.lit(0)), F.regexp_extract_all(query, F.lit("[가-힣]{2,4}M"), F.lit(0)))
    return F.when(F.exists(named, lambda x: F.contains(F.lower(name), F.lower(x))), ENTITY_BONUS).otherwise(0.0)


def composite_score(model: Column, base: Column, *parts: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), reduce(lambda a, b: a + b, parts, MODEL * model + BASE * base)))


def section_bonus(score: Column, section: Column, *by: str) -> Column:
    """A little more for sections that give two hits of a query or more."""
    many = F.count("*").over(Window.partitionBy(*by, section)) >= 2
    return F.when((section != "") & many, F.least(F.lit(1.0), score + SECTION_BONUS)).otherwise(score)


def freshness_weight(days: Column, versions: Column) -> Column:
    age = F.when(days.isNull(), 1.0).when(days <= FRESH_DAYS, 1.2).when(days <= STALE_DAYS, 1.0).when(days <= OUTDATED_DAYS, 0.8).otherwise(0.5)
    return age * F.when(versions >= 10, 1.10).when(versions >= 5, 1.05).otherwise(1.0)


def not_outdated(days: Column, most: int = OUTDATED_DAYS) -> Column:
    return days.isNull() | (days <= most)


def boosted_by_graph(score: Column, distance: Column, boost: float = 0.15) -> Column:
    """Chunks in the expanded set (a distance that isn't null): twice the boost for neighbours, half of it from three hops on."""
    return F.when(distance.isNull(), score).when(distance <= 1, score + 2.0 * boost).when(distance == 2, score + boost).otherwise(score + 0.5 * boost)


def trend(kts: Column, freshness: Column) -> Column:
    """Trust scores of 0 to 100 or of 0 to 1, and freshness."""
    return 0.7 * F.when(kts > 1.0, kts / 100.0).otherwise(kts) + 0.3 * freshness


def base_trust(quality: Column, source: Column, freshness: Column, category: Column, owner: Column) -> Column:
    """A document's trust from 0 to 1, from its quality (0 to 100) and what is known of it."""
    known = lambda c: F.when(F.coalesce(c, F.lit("")) != "", 0.8).otherwise(0.3)
    category = F.when(category == "기타", "").otherwise(category)
    return 0.25 * F.coalesce(quality, F.lit(50)) / 100 + 0.2 * (F.coalesce(source, F.lit("")) != "").cast("int") + 0.2 * freshness + 0.15 * known(category) + 0.1 * 0.5 + 0.1 * known(owner)


def base_tier(score: Column) -> Column:
    return F.when(score >= 0.7, "high").when(score >= 0.4, "medium").otherwise("low")


def payload_filter(conditions: dict) -> Column:
    """All of: equality for a value, membership for a list (an empty one is no condition), and for {"match_text": words} a
    text that holds each of the words."""
    out = F.lit(True)
    for name, value in conditions.items():
        c = F.col(name)
        if isinstance(value, list):
            out = out & c.isin(*value) if value else out
        elif isinstance(value, dict):
            for w in value["match_text"].lower().split():
                out = out & F.lower(c).rlike(rf"(?U)(^|\W){w}(\W|$)")
        else:
            out = out & (c == value)
    return out


def named_like(name: Column, parts: list[str]) -> Column:
    """Names that hold one of the parts in any case; all names if there are none."""
    return reduce(lambda a, b: a | b, (F.contains(F.lower(name), F.lit(p.lower())) for p in parts)) if parts else F.lit(True)


def base_match(query: Column, name: Column, base_id: Column) -> Column:
    """How well a knowledge base fits a query: 3 for each of its words, and the query itself, in its name; 2 in its id."""
    q = F.lower(F.trim(query))
    words = F.array_distinct(F.concat(F.array(q), F.filter(F.split(q, r"[\s,()\[\].?!\-/]+"), lambda w: F.length(w) >= 2)))
    hit = lambda text: F.size(F.filter(words, lambda w: (w != "") & F.contains(F.lower(text), w)))
    return 3 * hit(name) + 2 * hit(base_id)
