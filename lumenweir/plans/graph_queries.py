"""Queries over graphs made of customers, orders, parts and suppliers, and over embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import graph as g
from ..operators import retrieval as v
from .registry import Registry, table
from .storage import spread

r = Registry()
_SUPPLIES = "SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem"


def _supplies(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()


def _geo(spark, sf_dir):
    """Customers to nations to regions, as named nodes."""
    c, n, rg = (table(spark, sf_dir, x) for x in ("customer", "nation", "region"))
    up = c.select(F.concat(F.lit("c"), "c_custkey").alias("src"), F.concat(F.lit("n"), "c_nationkey").alias("dst"))
    up = up.union(n.select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey")))
    return g.both_ways(up), rg


_GEO = "WITH e0 AS (SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation), e AS (SELECT src, dst FROM e0 UNION SELECT dst, src FROM e0)"


@r.query(_GEO + ", w AS (SELECT 'r' || r_regionkey AS seed, 'r' || r_regionkey AS node, 0 AS d FROM region), h1 AS (SELECT DISTINCT seed, dst AS node FROM w JOIN e ON e.src = w.node), h2 AS (SELECT DISTINCT seed, dst AS node FROM h1 JOIN e ON e.src = h1.node), u AS (SELECT seed, node, 1 AS d FROM h1 UNION ALL SELECT seed, node, 2 FROM h2) SELECT seed, node, min(d) AS distance, round(1 / (1 + (min(d) - 1) * 0.3), 6) AS relevance FROM u WHERE seed <> node GROUP BY seed, node")
def related_nodes(spark, sf_dir):
    edges, regions = _geo(spark, sf_dir)
    found = g.neighbours(edges, regions.select(F.concat(F.lit("r"), "r_regionkey").alias("node")), 2)
    return found.withColumn("relevance", F.round(g.hop_relevance(F.col("distance")), 6))


@r.query(_GEO + " SELECT 'n' || a.n_nationkey AS seed, 'n' || b.n_nationkey AS node, 2 AS distance, 'n' || a.n_nationkey || '>r' || a.n_regionkey || '>n' || b.n_nationkey AS path FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey")
def shortest_paths(spark, sf_dir):
    edges, _ = _geo(spark, sf_dir)
    nations = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node"))
    return g.shortest_paths(edges.where("src not like 'c%' and dst not like 'c%'"), nations, nations, 3).select("seed", "node", "distance", F.array_join("path", ">").alias("path"))


@r.query(f"WITH e AS ({_SUPPLIES}) SELECT x.src AS a, y.src AS b, count(*) AS shared FROM e x JOIN e y ON x.dst = y.dst AND x.src <> y.src GROUP BY 1, 2")
def similar_by_shared(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))
    return g.shared_by_all(edges)


@r.query(f"SELECT p_type AS topic, s_suppkey, count(DISTINCT p_partkey) AS parts FROM ({_SUPPLIES}) e JOIN part ON p_partkey = e.dst JOIN supplier ON s_suppkey = e.src GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY count(DISTINCT p_partkey) DESC, s_suppkey) <= 5")
def topic_experts(spark, sf_dir):
    from pyspark.sql import Window

    edges = _supplies(spark, sf_dir)
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("dst"), F.col("p_type").alias("topic"))
    known = edges.join(table(spark, sf_dir, "supplier"), edges.src == F.col("s_suppkey"), "left_semi")
    n = known.join(parts, "dst").groupBy("topic", F.col("src").alias("s_suppkey")).agg(F.count("*").alias("parts"))
    return n.withColumn("k", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("parts"), "s_suppkey"))).where("k <= 5").drop("k")


@r.query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def orphan_customers(spark, sf_dir):
    nodes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"))
    edges = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), F.col("o_custkey").alias("dst"))
    return g.orphans(nodes, edges).select(F.col("node").alias("c_custkey"))


@r.query("SELECT (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS orphans, (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS unowned, (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS dangling")
def integrity_summary(spark, sf_dir):
    c, o, li = (table(spark, sf_dir, x) for x in ("customer", "orders", "lineitem"))
    n = lambda df, name: df.agg(F.count("*").alias(name))
    parts = n(c.join(o, c.c_custkey == o.o_custkey, "left_anti"), "orphans"), n(o.join(c, c.c_custkey == o.o_custkey, "left_anti"), "unowned"), n(li.join(o, li.l_orderkey == o.o_orderkey, "left_anti"), "dangling")
    return parts[0].crossJoin(parts[1]).crossJoin(parts[2])  # one row each


@r.query("WITH h AS (SELECT o_custkey, o_orderstatus, o_orderkey, o_orderdate AS valid_from, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to FROM orders) SELECT o_custkey, o_orderkey, o_orderstatus FROM h WHERE valid_from <= TIMESTAMP '1998-01-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1998-01-01')")
def point_in_time(spark, sf_dir):
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders").withColumn("valid_from", F.col("o_orderdate"))
    h = o.withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy("o_custkey").orderBy("valid_from", "o_orderkey")))
    return g.as_of(h, "1998-01-01").select("o_custkey", "o_orderkey", "o_orderstatus")


@r.query("SELECT l.l_orderkey, l.l_linenumber, x.l_linenumber AS sibling, abs(x.l_linenumber - l.l_linenumber) AS away FROM lineitem l JOIN lineitem x ON x.l_orderkey = l.l_orderkey AND x.l_linenumber BETWEEN l.l_linenumber - 1 AND l.l_linenumber + 1 AND x.l_linenumber <> l.l_linenumber")
def sibling_lines(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    x = li.select("l_orderkey", F.col("l_linenumber").alias("sibling"))
    return li.join(x, "l_orderkey").where("sibling between l_linenumber - 1 and l_linenumber + 1 and sibling <> l_linenumber").withColumn("away", F.abs(F.col("sibling") - F.col("l_linenumber")))


_DOT = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))"
_COS = f"{_DOT.format(a='q.embedding', b='d.embedding')} / (sqrt({_DOT.format(a='q.embedding', b='q.embedding')}) * sqrt({_DOT.format(a='d.embedding', b='d.embedding')}))"
_TOP = f"WITH s AS (SELECT q.vec_id AS query, d.vec_id AS id, round({_COS}, 9) AS score FROM embeddings q JOIN embeddings d ON TRUE WHERE q.vec_id % 20 = 0), k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s)"


def _vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vec")), e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


@r.query(_TOP + " SELECT query, id, round(score, 5) AS score, rank FROM k WHERE rank <= 10")
def dense_top_k(spark, sf_dir):
    return v.dense_top_k(*_vectors(spark, sf_dir), 10).withColumn("score", F.round("score", 5))


@r.query("SELECT vec_id, CASE WHEN len(embedding) = 0 THEN 'empty' WHEN len(embedding) <> 64 THEN 'dimension' WHEN list_sum(list_transform(embedding, lambda x: x * x)) = 0 THEN 'zero' END AS problem FROM embeddings")
def vector_problems(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", v.vector_problem(F.col("embedding"), 64).alias("problem"))


_WORDS = r"list_distinct(list_filter(string_split(lower(trim(regexp_replace(coalesce({0}, ''), '[ \t\n\x0B\f\r]+', ' ', 'g'))), ' '), lambda x: x <> ''))"
_SPARSE = f"WITH q AS (SELECT item_id AS query, unnest({_WORDS.format('text')}) AS term FROM benchmark), d AS (SELECT doc_id AS id, unnest({_WORDS.format('text')}) AS term FROM documents), n AS (SELECT query, count(*) AS n FROM q GROUP BY query), s AS (SELECT query, id, count(*) / any_value(n.n) AS score FROM q JOIN d USING (term) JOIN n USING (query) GROUP BY query, id), k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s)"


def _sparse(spark, sf_dir, k):
    named = lambda name, i, n: table(spark, sf_dir, name).select(F.col(i).alias(n), "text")
    return v.sparse_top_k(named("benchmark", "item_id", "query"), spread(named("documents", "doc_id", "id")), k)


@r.query(_SPARSE + " SELECT query, id, round(score, 6) AS score, rank FROM k WHERE rank <= 10")
def sparse_top_k(spark, sf_dir):
    return _sparse(spark, sf_dir, 10).withColumn("score", F.round("score", 6))


@r.query(_SPARSE + ", o AS (SELECT query, id, rank AS r1, row_number() OVER (PARTITION BY query ORDER BY length(text), id) AS r2 FROM k JOIN documents ON doc_id = id WHERE rank <= 40) SELECT query, id, round(1 / (60 + r1) + 1 / (60 + r2), 9) AS score FROM o")
def fused_ranks(spark, sf_dir):
    from pyspark.sql import Window

    first = _sparse(spark, sf_dir, 40)
    size = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.length("text").alias("n"))
    second = first.select("query", "id").join(size, "id").withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("n", "id")))
    return v.reciprocal_rank_fusion(60, first, second).withColumn("score", F.round("score", 9))


@r.query(_SPARSE + ", p AS (SELECT query, id, score, source FROM k JOIN documents ON doc_id = id WHERE rank <= 40), g AS (SELECT *, row_number() OVER (PARTITION BY query, source ORDER BY score DESC, id) AS in_group FROM p) SELECT query, id, source, in_group, row_number() OVER (PARTITION BY query ORDER BY (in_group > 2)::INT, score DESC, id) AS place FROM g")
def diverse_results(spark, sf_dir):
    pool = _sparse(spark, sf_dir, 40).drop("rank").join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source"), "id")
    return v.diversified(pool, "source", 2).select("query", "id", "source", "in_group", "place")


@r.query()
def mmr_results(spark, sf_dir):
    pool = _sparse(spark, sf_dir, 20).drop("rank").join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.array_distinct(t.tokens(F.col("text"))).alias("words")), "id")
    return v.mmr(pool, 5)


@r.query(_SPARSE + ", p AS (SELECT query, id, score, CASE WHEN max(score) OVER w = min(score) OVER w THEN 0.5 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS base, rank FROM k WHERE rank <= 20 WINDOW w AS (PARTITION BY query)) SELECT query, id, round(0.6 / (1 + exp(-score / 3)) + 0.3 * base + 0.1 / 1.2 + CASE WHEN rank > 1 THEN 0.15 / (1 + (rank - 2) * 0.3) ELSE 0 END, 6) AS composite FROM p")
def composite_scores(spark, sf_dir):
    from ..functions import scores as s

    pool = _sparse(spark, sf_dir, 20).withColumn("base", v.normalized(F.col("score"), "query"))
    return pool.select("query", "id", F.round(0.6 * s.sigmoid(F.col("score")) + 0.3 * F.col("base") + 0.1 / 1.2 + s.graph_bonus(F.col("rank") - 1), 6).alias("composite"))


@r.query(_SPARSE + ", p AS (SELECT query, score, rank, source FROM k JOIN documents ON doc_id = id WHERE rank <= 10), f AS (SELECT query, sum(score / rank) / sum(1.0 / rank) AS relevance, count(DISTINCT source) / 10.0 AS coverage, count(*) AS n FROM p GROUP BY query), c AS (SELECT query, n, 0.4 * relevance + 0.25 * coverage + 0.2 * 0.5 + 0.15 AS score FROM f) SELECT query, round(score, 6) AS score, CASE WHEN n = 0 THEN 'incorrect' WHEN score >= 0.7 THEN 'correct' WHEN score >= 0.4 THEN 'ambiguous' ELSE 'incorrect' END AS action FROM c")
def retrieval_confidence(spark, sf_dir):
    from ..functions import scores as s

    pool = _sparse(spark, sf_dir, 10).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source"), "id")
    f = pool.groupBy("query").agg((F.sum(F.col("score") / F.col("rank")) / F.sum(F.lit(1.0) / F.col("rank"))).alias("relevance"), (F.countDistinct("source") / F.lit(10.0)).alias("coverage"), F.count("*").alias("n"))
    f = f.withColumn("score", s.crag_score(F.col("relevance"), F.col("coverage"), F.lit(0.5), F.lit(1.0)))
    return f.select("query", F.round("score", 6).alias("score"), s.crag_action(F.col("score"), F.col("n")).alias("action"))
