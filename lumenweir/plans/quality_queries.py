"""Queries over extracted graphs and model answers in JSON, staged dedup and matching, evaluation runs, and maintenance of
stored chunks and nodes. Extracted JSON is written from orders and line items, as an extractor would give it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import documents as d
from ..operators import merging as m
from ..operators import near_duplicates, retrieval, structure, trigrams
from .graph_queries import _SPARSE, _sparse
from .registry import Registry, table
from .storage import spread
from .text_queries import _METRICS, _TIER

r = Registry()

# Kinds of nodes and relationships that an extraction may give.
NODES = ("Person", "Team", "System", "Document", "Policy", "Topic")
RELATIONSHIPS = ("AUTHORED", "MENTIONS", "MANAGES", "RELATED_TO")


def repaired_json(c):
    """The outermost object of a model's answer: without fences, and without commas before a closing bracket."""
    inner = F.regexp_extract(F.coalesce(c, F.lit("")), r"(?s)\{.*\}", 0)
    return F.regexp_replace(inner, r",\s*([}\]])", "$1")


_GRAPH = "nodes array<struct<id:string,type:string>>, relationships array<struct<source:string,target:string,type:string>>"


def _extracted(spark, sf_dir):
    """An answer for each order: its customer, parts by number, an unknown kind, a relationship to nowhere; some of it broken."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    text = F.concat(
        F.lit('```json\n{"nodes": [{"id": "c'), "o_custkey", F.lit('", "type": "Person"}, {"id": "o'), k, F.lit('", "type": "Document"}, {"id": "x'), k % 7, F.lit('", "type": "'),
        F.when(k % 3 == 0, "Gadget").otherwise("System"), F.lit('"}'), F.when(k % 5 == 0, ",").otherwise(""), F.lit('], "relationships": [{"source": "c'), "o_custkey", F.lit('", "target": "o'), k,
        F.lit('", "type": "AUTHORED"}, {"source": "o'), k, F.lit('", "target": "x'), k % 7, F.lit('", "type": "SOMETHING"}, {"source": "", "target": "o'), k, F.lit('"}]}\n```'),
    )
    broken = F.when(k % 11 == 0, F.lit("no answer")).otherwise(text)
    return o.select("o_orderkey", F.from_json(repaired_json(broken), _GRAPH).alias("g"))


@r.query("""SELECT o_orderkey, 'c' || o_custkey AS id, 'Person' AS type FROM orders WHERE o_orderkey % 11 <> 0 UNION ALL SELECT o_orderkey, 'o' || o_orderkey, 'Document' FROM orders WHERE o_orderkey % 11 <> 0 UNION ALL SELECT o_orderkey, 'x' || o_orderkey % 7, 'System' FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 3 <> 0""")
def extracted_nodes(spark, sf_dir):
    """Nodes of an allowed kind, from answers that can be read after repair."""
    n = _extracted(spark, sf_dir).select("o_orderkey", F.explode("g.nodes").alias("n")).select("o_orderkey", "n.id", "n.type")
    return n.where(F.col("type").isin(*NODES) & (F.col("id") != ""))


@r.query("SELECT o_orderkey, 'c' || o_custkey AS source, 'o' || o_orderkey AS target, 'AUTHORED' AS type, true AS known FROM orders WHERE o_orderkey % 11 <> 0 UNION ALL SELECT o_orderkey, 'o' || o_orderkey, 'x' || o_orderkey % 7, 'RELATED_TO', o_orderkey % 3 <> 0 FROM orders WHERE o_orderkey % 11 <> 0")
def extracted_relationships(spark, sf_dir):
    """Relationships with both ends named; unknown kinds become RELATED_TO, and it is said whether both ends are nodes."""
    x = _extracted(spark, sf_dir)
    ids = F.transform(F.filter("g.nodes", lambda n: n["type"].isin(*NODES)), lambda n: n["id"])
    rel = x.select("o_orderkey", ids.alias("ids"), F.explode("g.relationships").alias("r")).where("r.source <> '' and r.target <> ''")
    known = F.array_contains("ids", F.col("r.source")) & F.array_contains("ids", F.col("r.target"))
    return rel.select("o_orderkey", "r.source", "r.target", F.when(F.col("r.type").isin(*RELATIONSHIPS), F.col("r.type")).otherwise("RELATED_TO").alias("type"), known.alias("known"))


_VERDICT = "CASE WHEN length(text) % 5 = 0 THEN text WHEN length(text) % 5 = 1 THEN 'Sure: {\"has_conflict\": ' || (length(text) % 2 = 0) || ', \"conflict_type\": \"' || role || '\"' ELSE 'Sure:' || chr(10) || '{\"has_conflict\": ' || (length(text) % 2 = 0) || ', \"conflict_type\": \"' || role || '\"} ' || text END"


@r.query(f"""WITH x AS (SELECT conv_id, turn, {_VERDICT} AS x FROM conversations), j AS (SELECT conv_id, turn, regexp_extract(x, '"has_conflict": (true|false), "conflict_type": "[^"]*"}}', 1) AS c, regexp_extract(x, '"conflict_type": "([^"]*)"}}', 1) AS k FROM x)
SELECT conv_id, turn, c = 'true' AS has_conflict, CASE WHEN k = '' THEN 'unknown' ELSE k END AS kind FROM j""")
def parsed_conflicts(spark, sf_dir):
    """A model's verdict on a conflict, with words before and after it or cut off; none can be read: no conflict of an unknown kind."""
    n = F.length("text")
    verdict = F.concat(F.lit('{"has_conflict": '), (n % 2 == 0).cast("string"), F.lit(', "conflict_type": "'), "role", F.lit('"'))
    x = F.when(n % 5 == 0, F.col("text")).when(n % 5 == 1, F.concat(F.lit("Sure: "), verdict)).otherwise(F.concat(F.lit("Sure:\n"), verdict, F.lit("} "), "text"))
    j = F.from_json(repaired_json(x), "has_conflict boolean, conflict_type string")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(j["has_conflict"], F.lit(False)).alias("has_conflict"), F.coalesce(j["conflict_type"], F.lit("unknown")).alias("kind"))


@r.query("SELECT c_custkey, c_mktsegment AS label, 'Topic' AS parent, round((c_custkey % 10) / 10.0, 2)::DOUBLE AS confidence FROM customer WHERE c_custkey % 10 >= 3")
def discovered_schema(spark, sf_dir):
    """Candidates for a schema from a discovery's answer, sure ones only."""
    k = F.col("c_custkey")
    x = F.concat(F.lit('{"candidates": [{"label": "'), "c_mktsegment", F.lit('", "parent": "Topic", "confidence": '), k % 10 / 10, F.lit('}, {"label": "", "confidence": 1}]}'))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.explode(F.from_json(x, "candidates array<struct<label:string,parent:string,confidence:double>>")["candidates"]).alias("c"))
    return rows.where("c.label <> '' and c.confidence >= 0.3").select("c_custkey", "c.label", "c.parent", F.round("c.confidence", 2).alias("confidence"))


@r.query("""WITH l AS (SELECT DISTINCT c_nationkey AS kb, 0 AS layer, c_mktsegment AS node FROM customer WHERE c_custkey % 2 = 0 UNION SELECT DISTINCT c_nationkey, 1, 'KB' || c_custkey % 3 FROM customer WHERE c_custkey % 3 > 0)
SELECT kb, string_agg(DISTINCT node, ',' ORDER BY node) AS nodes, max(layer) AS version, count(DISTINCT layer) AS layers FROM l GROUP BY kb""")
def merged_schemas(spark, sf_dir):
    """Nodes of a base's layers united; options and version of the top layer."""
    c = table(spark, sf_dir, "customer")
    low = c.where("c_custkey % 2 = 0").select(F.col("c_nationkey").alias("kb"), F.lit(0).alias("layer"), F.col("c_mktsegment").alias("node"))
    top = c.where("c_custkey % 3 > 0").select(F.col("c_nationkey").alias("kb"), F.lit(1).alias("layer"), F.concat(F.lit("KB"), F.col("c_custkey") % 3).alias("node"))
    return low.unionByName(top).groupBy("kb").agg(F.array_join(F.array_sort(F.collect_set("node")), ",").alias("nodes"), F.max("layer").alias("version"), F.countDistinct("layer").alias("layers"))


# Dedup and matching


@r.query()
def staged_dedup(spark, sf_dir):
    """Each document's state: an exact copy of an earlier one, else in a group of near duplicates of an earlier one, else unique."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("h", t.content_hash(F.col("text")))
    seen = d.first_seen(docs, "h").select("doc_id", "duplicate_of")
    near = near_duplicates.near_duplicates(docs.select("doc_id", "text"))
    both = seen.join(near, "doc_id")
    state = F.when(F.col("duplicate_of").isNotNull(), "exact").when(F.col("component_id") != F.col("doc_id"), "near").otherwise("unique")
    return both.select("doc_id", state.alias("state"), F.coalesce("duplicate_of", F.when(F.col("component_id") != F.col("doc_id"), F.col("component_id"))).alias("of"))


@r.query()
def deduplicated_qa(spark, sf_dir):
    """Questions with answers, one of each group whose character trigrams have a Jaccard measure of 0.85 or more."""
    turns = table(spark, sf_dir, "conversations")
    a = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    qa = turns.where("role = 'user'").join(a, ["conv_id", "turn"]).select((F.col("conv_id") * 1_000_000 + F.col("turn")).alias("doc_id"), F.lower(F.regexp_replace(F.concat_ws(" ", "text", "answer"), r"\s+", "")).alias("text"))
    groups = trigrams.alike_texts(spread(qa), 0.85)
    return groups.where("doc_id = component_id").select("doc_id")


@r.query("""WITH s AS (SELECT q.vec_id AS query, d.vec_id AS id, round(list_inner_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]) / sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]) * list_inner_product(d.embedding::DOUBLE[], d.embedding::DOUBLE[])), 9) AS score FROM embeddings q JOIN embeddings d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0)
SELECT query, id, round(score, 5) AS score FROM s WHERE score >= 0.9 * 0.3 QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, id) <= 9""")
def semantic_candidates(spark, sf_dir):
    """The documents most alike each stated one, from nine tenths of a threshold on."""
    e = table(spark, sf_dir, "embeddings")
    q, rows = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vec")), e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    found = retrieval.dense_top_k(q, rows, 10).where("query <> id and score >= 0.27")
    return retrieval.top_per_query(found.drop("rank"), 9).select("query", "id", F.round("score", 5).alias("score"))


_RESOLVED = "SELECT DISTINCT lower(split_part(p_name, ' ', 1)) AS term FROM part"


@r.query(f"""WITH g AS ({_RESOLVED}), x AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN ' K8S ' WHEN 1 THEN 'Red' WHEN 2 THEN 'Blue시스템' ELSE c_mktsegment || '?' END AS name FROM customer)
SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'kubernetes' WHEN g.term IS NOT NULL THEN g.term WHEN c_custkey % 4 = 2 THEN 'Blue' ELSE name END AS canonical, CASE WHEN c_custkey % 4 = 0 OR g.term IS NOT NULL THEN 'glossary' ELSE 'rule' END AS stage, CASE WHEN c_custkey % 4 = 0 OR g.term IS NOT NULL THEN 1.0 WHEN c_custkey % 4 = 2 THEN 0.7 ELSE 0.5 END::DOUBLE AS confidence FROM x LEFT JOIN g ON g.term = lower(trim(name))""")
def resolved_entities(spark, sf_dir):
    """Names by abbreviation, by glossary, by rule (a suffix), or as they are."""
    k = F.col("c_custkey") % 4
    name = F.when(k == 0, " K8S ").when(k == 1, "Red").when(k == 2, "Blue시스템").otherwise(F.concat("c_mktsegment", F.lit("?")))
    x = table(spark, sf_dir, "customer").select("c_custkey", name.alias("name"), F.lower(F.trim(name)).alias("key"))
    terms = table(spark, sf_dir, "part").select(F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("term")).distinct()
    full = F.try_element_at(F.create_map(F.lit("k8s"), F.lit("kubernetes"), F.lit("pg"), F.lit("payment gateway")), F.col("key"))
    stem = F.regexp_replace("name", "(시스템|서비스|팀)$", "")
    found = x.join(terms, x.key == terms.term, "left")
    known = F.coalesce(full, F.col("term"))
    stage = F.when(known.isNotNull(), "glossary").otherwise("rule")
    sure = F.when(known.isNotNull(), 1.0).when(stem != F.col("name"), 0.7).otherwise(0.5)
    return found.select("c_custkey", F.coalesce(known, stem).alias("canonical"), stage.alias("stage"), sure.alias("confidence"))


_CASC = """WITH g AS (SELECT min(p_partkey) AS id, lower(regexp_replace(p_name, '[-\\s_]', '', 'g')) AS norm, any_value(lower(p_name)) AS name FROM part GROUP BY 2), c AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name || '에서' WHEN 2 THEN p_name[2:] ELSE 'qq' || p_brand END AS x FROM part),
n AS (SELECT p_partkey, x, lower(regexp_replace(x, '[-\\s_]', '', 'g')) AS norm FROM c), e AS (SELECT n.p_partkey, g.id, 1.0 AS score, 'exact' AS kind FROM n JOIN g USING (norm)), pt AS (SELECT n.p_partkey, g.id, 0.98, 'particle' FROM n JOIN g ON g.norm = regexp_replace(n.norm, '에서$', '') WHERE n.norm LIKE '%에서'),
gq AS (SELECT p_partkey, norm, list_distinct(list_transform(range(1, greatest(length(norm) - 1, 2)), lambda i: norm[i:i + 2])) AS gr FROM n WHERE p_partkey NOT IN (SELECT p_partkey FROM e) AND p_partkey NOT IN (SELECT p_partkey FROM pt)),
gg AS (SELECT id, norm, list_distinct(list_transform(range(1, greatest(length(norm) - 1, 2)), lambda i: norm[i:i + 2])) AS gr FROM g),
s AS (SELECT p_partkey, id, len(list_intersect(gq.gr, gg.gr)) / len(list_distinct(list_concat(gq.gr, gg.gr))) AS j, 1 - levenshtein(gq.norm, gg.norm) / greatest(length(gq.norm), length(gg.norm)) AS l FROM gq JOIN gg ON len(list_intersect(gq.gr, gg.gr)) >= 2),
b AS (SELECT p_partkey, id, CASE WHEN l >= 0.8 AND l > CASE WHEN j >= 0.7 THEN j ELSE 0 END THEN l WHEN j >= 0.7 THEN j END AS score, CASE WHEN l >= 0.8 AND l > CASE WHEN j >= 0.7 THEN j ELSE 0 END THEN 'levenshtein' ELSE 'jaccard' END AS kind FROM s),
f AS (SELECT * FROM e UNION ALL SELECT * FROM pt UNION ALL SELECT * FROM b WHERE score IS NOT NULL)
""".replace("\\\\", "\\")


@r.query(_CASC + "SELECT p_partkey, id, kind, round(score, 4) AS score FROM f QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, id) = 1")
def term_cascade(spark, sf_dir):
    """Exact after normalizing, then without a particle, then the best candidate by n-grams or edits among those that share
    two n-grams. Each step takes only what the steps before left."""
    p = table(spark, sf_dir, "part")
    terms = p.groupBy(t.comparable_term(F.col("p_name")).alias("norm")).agg(F.min("p_partkey").alias("id"))
    k = F.col("p_partkey") % 4
    x = F.when(k == 0, F.upper("p_name")).when(k == 1, F.concat("p_name", F.lit("에서"))).when(k == 2, F.expr("substring(p_name, 2)")).otherwise(F.concat(F.lit("qq"), "p_brand"))
    asked = p.select("p_partkey", t.comparable_term(x).alias("own"))
    exact = asked.join(terms, asked.own == terms.norm).select("p_partkey", "id", F.lit(1.0).alias("score"), F.lit("exact").alias("kind"))
    left = asked.join(exact.select("p_partkey"), "p_partkey", "left_anti")
    bare = left.withColumn("bare", t.strip_particles(F.col("own"))).where("bare <> own")
    particle = bare.join(terms, bare.bare == terms.norm).select("p_partkey", "id", F.lit(0.98).alias("score"), F.lit("particle").alias("kind"))
    left = left.join(particle.select("p_partkey"), "p_partkey", "left_anti")
    grams = lambda df, i, c: df.select(i, c, t.char_ngrams(F.col(c)).alias("g"))
    q, g = grams(left, "p_partkey", "own"), grams(terms, "id", "norm")
    pairs = q.select("p_partkey", F.explode("g").alias("x")).join(g.select("id", F.explode("g").alias("x")), "x").groupBy("p_partkey", "id").count().where("count >= 2")
    both = pairs.join(q, "p_partkey").join(g.select("id", "norm", F.col("g").alias("h")), "id")
    j, lev = t.jaccard(F.col("g"), F.col("h")), t.normalized_levenshtein(F.col("own"), F.col("norm"))
    by_gram = F.when(j >= 0.7, j).otherwise(0.0)
    edits = (lev >= 0.8) & (lev > by_gram)
    close = both.select("p_partkey", "id", F.when(edits, lev).otherwise(by_gram).alias("score"), F.when(edits, "levenshtein").otherwise("jaccard").alias("kind")).where("score > 0")
    best = exact.unionByName(particle).unionByName(close).groupBy("p_partkey").agg(F.max(F.struct("score", (-F.col("id")).alias("n"), "kind")).alias("b"))
    return best.select("p_partkey", (-F.col("b.n")).alias("id"), F.col("b.kind").alias("kind"), F.round("b.score", 4).alias("score"))


@r.query("SELECT o_custkey, CASE WHEN max(o_totalprice) / 500000 >= 0.85 THEN 0.9 WHEN max(o_totalprice) / 500000 >= 0.7 THEN 0.7 WHEN max(o_totalprice) / 500000 >= 0.5 THEN 0.5 ELSE 0.3 END::DOUBLE AS confidence FROM orders GROUP BY o_custkey")
def answer_confidence(spark, sf_dir):
    top = F.max("o_totalprice") / 500000
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.when(top >= 0.85, 0.9).when(top >= 0.7, 0.7).when(top >= 0.5, 0.5).otherwise(0.3).alias("confidence"))


# Evaluation


@r.query(_SPARSE + " , h AS (SELECT DISTINCT query FROM k WHERE rank <= 3 AND id = query) SELECT count(*) AS questions, count(h.query) AS found, round(count(h.query) / count(*), 6) AS recall FROM benchmark b LEFT JOIN h ON h.query = b.item_id")
def source_recall(spark, sf_dir):
    """In how many questions the document of the item's id is among the three retrieved."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"))
    hit = _sparse(spark, sf_dir, 3).where("id = query").select("query").distinct().withColumn("found", F.lit(True))
    return b.join(hit, "query", "left").agg(F.count("*").alias("questions"), F.count("found").alias("found"), F.round(F.count("found") / F.count("*"), 6).alias("recall"))


_RUNS = "SELECT 'faithfulness' AS metric, o_orderkey AS q, (o_custkey % 100) / 100.0 AS a, (o_custkey % 97) / 95.0 AS b FROM orders UNION ALL SELECT 'completeness', o_orderkey, (o_orderkey % 90) / 100.0, (o_orderkey % 90) / 100.0 + 0.04 + (o_orderkey % 5) / 100.0 FROM orders UNION ALL SELECT 'latency', o_orderkey, o_totalprice / 1000, o_totalprice / 1000 + 150 + o_orderkey % 30 FROM orders"


def _deltas(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    run = lambda name, a, b: o.select(F.lit(name).alias("metric"), (b - a).alias("d"), a.alias("a"), b.alias("b"))
    rows = run("faithfulness", c % 100 / 100, c % 97 / 95).unionByName(run("completeness", k % 90 / 100, k % 90 / 100 + 0.04 + k % 5 / 100)).unionByName(run("latency", F.col("o_totalprice") / 1000, F.col("o_totalprice") / 1000 + 150 + k % 30))
    return rows.groupBy("metric").agg(F.count("*").alias("n"), F.avg("a").alias("before"), F.avg("b").alias("after"), F.avg("d").alias("delta"), F.stddev_samp("d").alias("sd"))


@r.query(f"WITH r AS ({_RUNS}), s AS (SELECT metric, count(*) AS n, avg(a) AS before, avg(b) AS after, avg(b - a) AS delta, stddev_samp(b - a) AS sd FROM r GROUP BY metric) SELECT metric, n, round(before, 4) AS before, round(after, 4) AS after, round(delta, 4) AS delta, round(delta / (sd / sqrt(n)), 3) AS t FROM s")
def evaluation_deltas(spark, sf_dir):
    """Two runs joined by question: means, their difference, and the paired t statistic."""
    x = _deltas(spark, sf_dir)
    return x.select("metric", "n", *(F.round(c, 4).alias(c) for c in ("before", "after", "delta")), F.round(F.col("delta") / (F.col("sd") / F.sqrt("n")), 3).alias("t"))


@r.query(f"WITH r AS ({_RUNS}), s AS (SELECT metric, avg(b - a) AS delta FROM r GROUP BY metric), k AS (SELECT metric, CASE metric WHEN 'completeness' THEN delta < 0.05 WHEN 'faithfulness' THEN delta < 0 ELSE delta > 200 END AS fails FROM s) SELECT NOT bool_or(fails) AS go, coalesce(string_agg(metric, ',' ORDER BY metric) FILTER (fails), '') AS reasons FROM k")
def go_no_go(spark, sf_dir):
    """Whether a run may be released: completeness up by 0.05, faithfulness not down, latency up by 200 at most."""
    metric, delta = F.col("metric"), F.col("delta")
    fails = F.when(metric == "completeness", delta < 0.05).when(metric == "faithfulness", delta < 0).otherwise(delta > 200)
    x = _deltas(spark, sf_dir).select("metric", fails.alias("fails"))
    return x.agg((~F.bool_or("fails")).alias("go"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("fails"), F.col("metric")))), ",").alias("reasons"))


@r.query("WITH c AS (SELECT c_nationkey AS kb, avg(c_acctbal) / 10000 AS s FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1), b AS (SELECT c_nationkey AS kb, avg(c_acctbal) / 10000 AS s FROM customer WHERE c_custkey % 2 = 1 GROUP BY 1) SELECT b.kb, round(c.s, 4) AS score, round(b.s, 4) AS baseline FROM b JOIN c USING (kb) WHERE c.s + 0.02 < b.s")
def regressions(spark, sf_dir):
    """Bases whose score falls short of the baseline by more than the tolerance; those without a score are left out."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("kb"), "c_custkey", (F.col("c_acctbal") / 10000).alias("s"))
    run = lambda k, name: c.where(F.col("c_custkey") % 2 == k).groupBy("kb").agg(F.avg("s").alias(name))
    both = run(1, "baseline").join(run(0, "score"), "kb").where("score + 0.02 < baseline")
    return both.select("kb", F.round("score", 4).alias("score"), F.round("baseline", 4).alias("baseline"))


@r.query(f"WITH m AS ({_METRICS}), q AS (SELECT doc_id, content_length, {_TIER} AS tier FROM m) SELECT doc_id, tier, content_length FROM q WHERE tier <> 'NOISE' ORDER BY CASE tier WHEN 'GOLD' THEN 0 WHEN 'SILVER' THEN 1 ELSE 2 END, content_length DESC, doc_id LIMIT 20")
def golden_set(spark, sf_dir):
    """Chunks to write questions for: the best tiers, the longest first."""
    g = d.quality_metrics(table(spark, sf_dir, "documents")).withColumn("tier", d.quality_tier()).where("tier <> 'NOISE'")
    place = F.when(F.col("tier") == "GOLD", 0).when(F.col("tier") == "SILVER", 1).otherwise(2)
    return g.select("doc_id", "tier", "content_length", place.alias("_p")).orderBy("_p", F.desc("content_length"), "doc_id").limit(20).drop("_p")


# Maintenance


@r.query()
def changed_chunks(spark, sf_dir):
    """Documents that cleaning changes, with the new lengths: what a batch writes back."""
    docs = spread(table(spark, sf_dir, "documents"))
    clean = structure.clean_passages(docs).select("doc_id", F.col("text").alias("clean"))
    return docs.select("doc_id", "text").join(clean, "doc_id").where("clean <> text").select("doc_id", F.length("text").alias("before"), F.length("clean").alias("after"))


@r.query("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN 'own' END, CASE WHEN c_acctbal > 0 THEN c_name END, '') AS owner FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def backfilled_owners(spark, sf_dir):
    """Owners of documents that have none, from the crawl's pages."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    crawl = c.where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("crawled"))
    own = F.when(F.col("o_orderkey") % 3 == 0, "own")
    return o.join(crawl, "o_custkey", "left").select("o_orderkey", F.coalesce(own, F.col("crawled"), F.lit("")).alias("owner"))


@r.query(f"""WITH m AS ({_METRICS}), q AS (SELECT *, {_TIER} AS tier FROM m)
SELECT doc_id, CASE WHEN contains(source, '1') THEN 'guide' ELSE 'reference' END AS type, tier, least(100.0, round(least(60.0, ln(1 + content_length) / ln(5001) * 60) + 8 * (has_tables::INT + has_code::INT + has_headers::INT + has_images::INT + has_links::INT) + CASE tier WHEN 'GOLD' THEN 15 WHEN 'SILVER' THEN 10 WHEN 'BRONZE' THEN 5 ELSE 0 END, 1)) AS score FROM q""")
def backfilled_metadata(spark, sf_dir):
    """Kind, tier and score of each stored document, worked out anew."""
    g = d.quality_metrics(table(spark, sf_dir, "documents")).withColumn("tier", d.quality_tier())
    return g.select("doc_id", F.when(F.contains("source", F.lit("1")), "guide").otherwise("reference").alias("type"), "tier", d.quality_score(F.col("tier")).alias("score"))


# Sources as tables


@r.query("""WITH a AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 9), b AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN sha256(text || '!') ELSE sha256(text) END AS h FROM documents WHERE doc_id % 10 <> 3)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'new' WHEN b.doc_id IS NULL THEN 'deleted' ELSE 'changed' END AS state FROM a FULL JOIN b ON a.doc_id = b.doc_id WHERE a.h IS DISTINCT FROM b.h""")
def scan_changes(spark, sf_dir):
    """New, changed and deleted documents between two scans, by ids and hashes alone."""
    x = table(spark, sf_dir, "documents")
    before = x.where("doc_id % 10 <> 9").select("doc_id", F.sha2("text", 256).alias("a"))
    after = x.where("doc_id % 10 <> 3").select("doc_id", F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("b"))
    both = before.join(after, "doc_id", "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    return both.select("doc_id", F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "deleted").otherwise("changed").alias("state"))


@r.query("WITH v AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+') AS site, page_id % 3 AS version, DATE '2024-01-01' + (page_id % 50)::INT AS updated FROM pages) SELECT site, page_id, version, updated FROM v QUALIFY row_number() OVER (PARTITION BY site ORDER BY version DESC, updated DESC, page_id DESC) = 1")
def latest_page_versions(spark, sf_dir):
    """Of each site's crawled rows the one with the highest version, then the latest."""
    p = table(spark, sf_dir, "pages")
    v = p.select("page_id", F.regexp_extract("url", "^https?://[^/]+", 0).alias("site"), (F.col("page_id") % 3).alias("version"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 50).cast("int")).alias("updated"))
    return d.latest_version(v, "site", "version", "updated", "page_id").select("site", "page_id", "version", "updated")


@r.query("SELECT page_id, kind, value FROM (SELECT page_id, 'mention' AS kind, 'user' || page_id % 5 AS value FROM pages UNION ALL SELECT page_id, 'macro', 'toc' FROM pages UNION ALL SELECT page_id, 'macro', 'code' FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT page_id, 'mail', 'a' || page_id || '@example.org' FROM pages)")
def page_marks(spark, sf_dir):
    """Mentions of users, macros and mail addresses in pages' HTML."""
    i = F.col("page_id")
    html = F.concat(
        F.regexp_replace("html", "mailto:", "x:"), F.lit('<a class="user-mention" data-username="user'), i % 5, F.lit('">@u</a><ac:structured-macro ac:name="toc"/>'),
        F.when(i % 2 == 0, '<ac:structured-macro ac:name="code"><p>x</p></ac:structured-macro>').otherwise(""), F.lit('<a href="mailto:a'), i, F.lit('@example.org?subject=x">mail</a>'),
    )
    rows = table(spark, sf_dir, "pages").select("page_id", html.alias("html"))
    kinds = {"mention": r'class="user-mention"[^>]*data-username="([^"]+)"', "macro": r'<ac:structured-macro[^>]*ac:name="([^"]+)"', "mail": r'href="mailto:([^"?]+)'}
    found = [rows.select("page_id", F.lit(k).alias("kind"), F.explode(F.regexp_extract_all("html", F.lit(p), F.lit(1))).alias("value")) for k, p in kinds.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


@r.query("SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def points_by_ids(spark, sf_dir):
    e, o = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "orders")
    return e.select("vec_id", "label").join(o.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("vec_id")), "vec_id", "left_semi")


@r.query("SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src3')")
def points_by_sources(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.col("source").isin("src1", "src3")).select("doc_id", "source")


@r.query("SELECT p_partkey, lower(trim(p_name)) AS term, p_type AS definition, CASE WHEN p_size > 25 THEN 'global' ELSE 'kb' END AS scope FROM part WHERE p_partkey % 13 <> 0")
def imported_terms(spark, sf_dir):
    """A glossary from lines of comma-separated values with other names for its columns; rows without a term are left out."""
    p = table(spark, sf_dir, "part")
    line = F.to_csv(F.struct(F.when(F.col("p_partkey") % 13 != 0, F.concat(F.lit(" "), "p_name", F.lit(" "))).alias("용어"), F.col("p_type").alias("설명"), F.when(F.col("p_size") > 25, "global").otherwise("kb").alias("범위")))
    row = F.from_csv(line, "a string, b string, c string")
    got = p.select("p_partkey", row.alias("r")).select("p_partkey", F.lower(F.trim("r.a")).alias("term"), F.col("r.b").alias("definition"), F.col("r.c").alias("scope"))
    return got.where("coalesce(term, '') <> ''")


@r.query("WITH n AS (SELECT event_type || user_id % 4 AS flag, max((ts, event_id, value)) AS v FROM events GROUP BY 1), o AS (SELECT c_mktsegment || '0' AS flag, 0.0 AS value FROM customer GROUP BY 1 UNION SELECT 'view' || k, -1.0 FROM range(0, 6) t(k)) SELECT coalesce(n.flag, o.flag) AS flag, coalesce(v[3], value) AS value FROM n FULL JOIN o ON n.flag = o.flag".replace("v[3]", "struct_extract(v, 3)"))
def feature_flags(spark, sf_dir):
    """Flags after a batch of changes: new ones are added, old ones take the last value."""
    e, c = table(spark, sf_dir, "events"), table(spark, sf_dir, "customer")
    old = c.select(F.concat("c_mktsegment", F.lit("0")).alias("flag")).distinct().withColumn("value", F.lit(0.0)).unionByName(spark.range(6).select(F.concat(F.lit("view"), "id").alias("flag"), F.lit(-1.0).alias("value")))
    new = e.select(F.concat("event_type", F.col("user_id") % 4).alias("flag"), "value", F.struct("ts", "event_id").alias("at"))
    none = F.lit(None).cast(new.schema["at"].dataType)
    return m.upsert(old.withColumn("at", none), new, ["flag"], "at").select("flag", "value")
