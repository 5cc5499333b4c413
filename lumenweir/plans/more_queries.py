"""Queries for vectors, term pairs, boosts, budgets, conflicts, JSON graphs and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import vectors as v
from .graph_queries import _SPARSE, _sparse
from .registry import Registry, table
from .storage import stored

r = Registry()
_TOKENS = r"list_filter(string_split(lower(trim(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g'))), ' '), lambda x: x <> '')"


@r.query(f"WITH w AS (SELECT item_id, unnest({_TOKENS}) AS token FROM benchmark), n AS (SELECT item_id, (md5_number(token)::UHUGEINT % 100000)::BIGINT AS slot, count(*) AS n FROM (SELECT item_id, token FROM w) GROUP BY ALL) SELECT item_id, slot, round(n / max(n) OVER (PARTITION BY item_id), 6) AS weight FROM n".replace("md5_number(token)::UHUGEINT", "('0x' || md5(token))::UHUGEINT"))
def sparse_vectors(spark, sf_dir):
    words = table(spark, sf_dir, "benchmark").select("item_id", F.explode(t.tokens(F.col("text"))).alias("token"))
    return v.sparse_vectors(words, "item_id").withColumn("weight", F.round("weight", 6))


@r.query("WITH x AS (SELECT label, unnest(range(1, 65)) AS i, embedding FROM embeddings), m AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM x GROUP BY label, i) SELECT label, (SELECT count(*) FROM embeddings e WHERE e.label = m.label) AS n, round(sqrt(sum(m * m)), 6) AS norm FROM m GROUP BY label")
def label_centroids(spark, sf_dir):
    from ..operators.retrieval import norm

    return v.mean_vectors(table(spark, sf_dir, "embeddings"), "label", "embedding", 64).select("label", "n", F.round(norm(F.col("vec")), 6).alias("norm"))


_UNITS = "WITH u AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.label, avg(list_cosine_similarity(a.v, b.v)) AS m FROM u a JOIN u b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY a.label)"


@r.query(_UNITS + ", s AS (SELECT a.vec_id, a.label, sum(list_cosine_similarity(a.v, b.v)) AS s FROM u a JOIN u b ON a.label = b.label GROUP BY ALL) SELECT s.label, count(*) AS n, round(coalesce(any_value(m), 1), 6) AS mean_cosine, arg_min(vec_id, (-round(s, 9), vec_id)) AS nearest FROM s LEFT JOIN p USING (label) GROUP BY s.label")
def label_consistency(spark, sf_dir):
    """How alike the vectors of each label are: the mean over all pairs, and the vector nearest to the centre."""
    return v.consistency(table(spark, sf_dir, "embeddings"), "label", "embedding", 64, "vec_id").withColumn("mean_cosine", F.round("mean_cosine", 6))


_FACTS = r"""list_sort(list_distinct(regexp_extract_all(x, '\d{4}[-/년]\s*\d{1,2}[-/월]\s*\d{1,2}일?'))) AS dates, list_sort(list_distinct(regexp_extract_all(x, '[vV]?\d+\.\d+(?:\.\d+)?'))) AS versions, list_sort(list_distinct(regexp_extract_all(x, '\d+(?:,\d{3})*(?:\.\d+)?\s*(?:원|달러|%|개|명|건)'))) AS amounts"""


@r.query(_SPARSE + rf""", h AS (SELECT query, id FROM k WHERE rank <= 6), f AS (SELECT query, id, {_FACTS} FROM (SELECT query, id, 'v' || (length(text) % 3) || '.' || (length(text) % 4) || ' of 2024-0' || (1 + length(text) % 3) || '-1' || (length(text) % 2) || ', ' || (length(text) % 5) || '개. ' || text AS x FROM h JOIN documents ON doc_id = id))
SELECT a.query, a.id AS a, b.id AS b, concat_ws(',', CASE WHEN len(a.dates) > 0 AND len(b.dates) > 0 AND a.dates <> b.dates THEN 'date' END, CASE WHEN len(a.versions) > 0 AND len(b.versions) > 0 AND a.versions <> b.versions THEN 'version' END, CASE WHEN len(a.amounts) > 0 AND len(b.amounts) > 0 AND a.amounts <> b.amounts THEN 'amount' END) AS hints FROM f a JOIN f b ON a.query = b.query AND a.id < b.id""")
def conflict_hints(spark, sf_dir):
    """In what the best six documents of each item differ pairwise: dates, versions, amounts that either states."""
    n = F.length("text")
    x = F.concat(F.lit("v"), n % 3, F.lit("."), n % 4, F.lit(" of 2024-0"), 1 + n % 3, F.lit("-1"), n % 2, F.lit(", "), n % 5, F.lit("개. "), "text")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), x.alias("x"))
    patterns = {"date": r"\d{4}[-/년]\s*\d{1,2}[-/월]\s*\d{1,2}일?", "version": r"[vV]?\d+\.\d+(?:\.\d+)?", "amount": r"\d+(?:,\d{3})*(?:\.\d+)?\s*(?:원|달러|%|개|명|건)"}
    facts = {k: F.array_sort(F.array_distinct(F.regexp_extract_all("x", F.lit(p), F.lit(0)))) for k, p in patterns.items()}
    f = stored(_sparse(spark, sf_dir, 6).select("query", "id").join(d, "id").select("query", "id", *(e.alias(k) for k, e in facts.items())))
    both = f.alias("a").join(f.alias("b"), (F.col("a.query") == F.col("b.query")) & (F.col("a.id") < F.col("b.id")))
    differs = [F.when((F.size(f"a.{k}") > 0) & (F.size(f"b.{k}") > 0) & (F.col(f"a.{k}") != F.col(f"b.{k}")), k) for k in patterns]
    return both.select("a.query", F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.concat_ws(",", *differs).alias("hints"))


@r.query("WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) AS used, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) AS k FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, round(pow(0.85, k - 1), 6) AS decayed FROM p WHERE used <= 80 AND k <= 4")
def budgeted_siblings(spark, sf_dir):
    order = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber", "l_partkey")
    ranked = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.sum("l_quantity").over(order).alias("used"), F.row_number().over(order).alias("k"))
    return ranked.where("used <= 80 and k <= 4").select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.pow(F.lit(0.85), F.col("k") - 1), 6).alias("decayed"))


@r.query("SELECT p_partkey, p_retailprice + CASE WHEN contains(lower(p_name), 'red') OR contains(lower(p_name), 'small') THEN 0.3 * ((contains(lower(p_name), 'red'))::INT + (contains(lower(p_name), 'small'))::INT) / 2 ELSE 0 END AS score, contains(lower(p_name), 'red') OR contains(lower(p_name), 'small') AS matched FROM part ORDER BY matched DESC, score DESC, p_partkey LIMIT 50")
def keyword_boost(spark, sf_dir):
    has = [F.lower("p_name").contains(k) for k in ("red", "small")]
    hits = has[0].cast("int") + has[1].cast("int")
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_retailprice") + F.when(hits > 0, 0.3 * hits / 2).otherwise(0)).alias("score"), (hits > 0).alias("matched"))
    return rows.orderBy(F.desc("matched"), F.desc("score"), "p_partkey").limit(50)


@r.query("SELECT event_id, json_extract_string(props, '$.k')::INT AS k, CASE WHEN json_extract_string(props, '$.k')::INT >= 75 THEN 'high' WHEN json_extract_string(props, '$.k')::INT >= 40 THEN 'medium' ELSE 'low' END AS level FROM events WHERE event_type = 'view' AND props LIKE '%k%'")
def parsed_context(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("event_type = 'view' and props like '%k%'").select("event_id", F.from_json("props", "k int")["k"].alias("k"))
    return rows.withColumn("level", F.when(F.col("k") >= 75, "high").when(F.col("k") >= 40, "medium").otherwise("low"))


@r.query("SELECT c_custkey AS id FROM customer WHERE c_acctbal > 9000 UNION SELECT o_custkey FROM orders WHERE o_totalprice > 490000 EXCEPT SELECT c_custkey FROM customer WHERE c_nationkey < 5")
def expanded_minus_known(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    found = c.where("c_acctbal > 9000").select(F.col("c_custkey").alias("id")).union(o.where("o_totalprice > 490000").select("o_custkey")).distinct()
    return found.join(c.where("c_nationkey < 5").select(F.col("c_custkey").alias("id")), "id", "left_anti")


@r.query("WITH d AS (SELECT lower(p_name) AS term, p_partkey, row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) AS k FROM part) SELECT term, p_partkey AS first FROM d WHERE k = 1")
def distinct_terms(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.lower("p_name").alias("term")).agg(F.min("p_partkey").alias("first"))


@r.query("SELECT d.doc_id, d.lang, d.source, k.votes FROM (SELECT doc_id, quality + toxic AS votes FROM labels ORDER BY votes DESC, doc_id LIMIT 30) k JOIN documents d USING (doc_id)")
def hydrated_top(spark, sf_dir):
    """Ranked by a narrow table first; the wide rows are fetched for the kept ids alone."""
    top = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") + F.col("toxic")).alias("votes")).orderBy(F.desc("votes"), "doc_id").limit(30)
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(F.broadcast(top), "doc_id")


@r.query("SELECT l.source, approx, exact FROM (SELECT source, count(DISTINCT lang) AS exact, count(DISTINCT lang) AS approx FROM documents GROUP BY source) l")
def distinct_estimates(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.countDistinct("lang").alias("exact"), F.approx_count_distinct("lang").alias("approx"))


@r.query("SELECT o.o_orderkey, l.l_linenumber AS first_line, o.o_totalprice FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey AND l.l_shipdate >= o.o_orderdate WHERE o.o_orderstatus = 'P' QUALIFY row_number() OVER (PARTITION BY o.o_orderkey ORDER BY l.l_shipdate, l.l_linenumber) = 1")
def next_event_after(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_orderkey", "o_orderdate", "o_totalprice")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    after = o.join(li, (o.o_orderkey == li.l_orderkey) & (li.l_shipdate >= o.o_orderdate))
    return after.groupBy("o_orderkey").agg(F.min(F.struct("l_shipdate", "l_linenumber")).alias("m"), F.max("o_totalprice").alias("o_totalprice")).select("o_orderkey", F.col("m.l_linenumber").alias("first_line"), "o_totalprice")


@r.query("SELECT source, lang, n FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY CUBE (source, lang))")
def category_cube(spark, sf_dir):
    return table(spark, sf_dir, "documents").cube("source", "lang").agg(F.count("*").alias("n"))
