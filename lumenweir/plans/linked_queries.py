"""Queries of joins by likeness, paths, arrivals, streams with state, transactional writes and lifecycles."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph as g
from ..operators import lifecycle as lc
from ..operators import matching
from ..operators import retrieval as v
from ..operators.incremental import DedupIndex
from ..operators.similarity import similar_vectors
from ..sources import points, tree
from ..streaming import collect, keyed
from .registry import Registry, table
from .storage import shared_dir, spread, stored

r = Registry()


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/lumenweir/{uuid.uuid4().hex}"


# Likeness


@r.query("""WITH RECURSIVE v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings UNION ALL SELECT -vec_id - 1, list_transform(range(1, len(embedding) + 1), lambda i: CASE WHEN i % 16 = vec_id % 16 THEN 0 ELSE embedding[i] END)::DOUBLE[] FROM embeddings),
l AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.id <> b.id AND list_cosine_similarity(a.v, b.v) >= 0.97), w AS (SELECT id AS a, id AS b FROM v UNION SELECT w.a, l.b FROM w JOIN l ON l.a = w.b)
SELECT a AS id, min(b) AS class_id, (SELECT count(*) FROM l WHERE l.a = w.a) AS n_links FROM w GROUP BY a""")
def vector_links(spark, sf_dir):
    """All links of a cosine of 0.97 or more among vectors and copies of them that lack every sixteenth entry."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    edited = F.transform("v", lambda x, i: F.when((i + 1) % 16 == F.col("vec_id") % 16, 0.0).otherwise(x))
    rows = e.select(F.col("vec_id").alias("id"), F.col("v").alias("vec")).union(e.select(-F.col("vec_id") - 1, edited))
    return similar_vectors(rows, 0.97).select("id", "class_id", "n_links")


# Paths


_WALKS = """WITH RECURSIVE s AS (SELECT l_orderkey AS process, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS step, l_partkey AS action, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
e AS (SELECT process, step * 10 + 1 AS edge, step AS src, step + 1 AS dst FROM s WHERE step < n UNION ALL SELECT process, step * 10 + 2, step, step + 2 FROM s WHERE step + 2 <= n AND action % 3 = 0 UNION ALL SELECT process, step * 10 + 3, step, 1 FROM s WHERE step = n AND n > 1 AND action % 2 = 0),
w AS (SELECT process, 1::BIGINT AS at, 0 AS hops, [1::BIGINT] AS nodes, []::BIGINT[] AS edges FROM s WHERE step = 1 UNION ALL SELECT w.process, e.dst, hops + 1, list_append(nodes, e.dst), list_append(edges, e.edge) FROM w JOIN e ON e.process = w.process AND e.src = w.at WHERE NOT list_contains(edges, e.edge))"""


@r.query(_WALKS + " SELECT process, step, action, hops, row_number() OVER (PARTITION BY process ORDER BY step, hops, nodes) AS place FROM w JOIN s USING (process) WHERE s.step = w.at QUALIFY place <= 20")
def process_walks(spark, sf_dir):
    """All walks from each process's first step over NEXT_STEP edges, some of which skip a step or lead back to the first."""
    line = F.struct("l_linenumber", "l_partkey", "l_extendedprice")
    s = table(spark, sf_dir, "lineitem").where("l_orderkey is not null").groupBy(F.col("l_orderkey").alias("process")).agg(F.array_sort(F.collect_list(line))["l_partkey"].alias("actions"))
    n = F.size("actions")
    hop = lambda kind, step, to: F.struct((step * 10 + kind).alias("edge"), step.alias("src"), to.alias("dst"))
    edges = lambda action, i: F.array_compact(F.array(
        F.when(i + 1 < n, hop(1, i + 1, i + 2)), F.when((i + 3 <= n) & (action % 3 == 0), hop(2, i + 1, i + 3)),
        F.when((i + 1 == n) & (n > 1) & (action % 2 == 0), hop(3, i + 1, F.lit(1))),
    ))
    steps = F.transform("actions", lambda action, i: F.struct((i + 1).alias("step"), action.alias("action")))
    return g.process_chain(s.select("process", F.lit(1).alias("first"), steps.alias("steps"), F.flatten(F.transform("actions", edges)).alias("edges")))


_TOUCHED = "WITH o AS (SELECT o_orderkey AS d, o_custkey AS c FROM orders), m AS (SELECT DISTINCT l_orderkey AS d, l_partkey AS p FROM lineitem), e AS (SELECT 'd' || d AS a, 'c' || c AS b FROM o UNION SELECT 'd' || d, 'p' || p FROM m), x AS (SELECT a, b FROM e UNION SELECT b, a FROM e), q AS (SELECT 'd' || d AS s FROM o WHERE d % 20 = 0)"


@r.query(_TOUCHED + ", h1 AS (SELECT DISTINCT s, b AS n FROM q JOIN x ON a = s), h2 AS (SELECT DISTINCT s, b AS n FROM h1 JOIN x ON a = n WHERE b <> s), h3 AS (SELECT DISTINCT s, b AS n FROM h2 JOIN x ON a = n), u AS (SELECT s, n, 1 AS k FROM h1 UNION ALL SELECT s, n, 2 FROM h2 UNION ALL SELECT s, n, 3 FROM h3), f AS (SELECT s, n, min(k) AS distance FROM u GROUP BY s, n) SELECT s AS document, n AS node, distance, round(1 / (1 + (distance - 1) * 0.3), 6) AS relevance FROM f QUALIFY row_number() OVER (PARTITION BY s ORDER BY distance, n) <= 50")
def touched_nodes(spark, sf_dir):
    """What each queried document touches over up to three hops, by relevance, 50 nodes at most."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    # customers and parts as one kind of numbers: twice the key, and one more for parts
    e = o.select(F.col("o_orderkey").alias("src"), (F.col("o_custkey") * 2).alias("dst")).union(li.select("l_orderkey", F.col("l_partkey") * 2 + 1))
    found = g.neighbours_across(e, o.where("o_orderkey % 20 = 0").select(F.col("o_orderkey").alias("node")), 3, 50)
    d = lambda c: F.concat(F.lit("d"), c)
    name = F.when(F.col("side") == "src", d("node")).otherwise(F.concat(F.when(F.pmod("node", F.lit(2)) == 0, "c").otherwise("p"), F.shiftright("node", 1)))
    found = found.select(d("seed").alias("seed"), name.alias("node"), "distance")
    best = found.withColumn("k", F.row_number().over(Window.partitionBy("seed").orderBy("distance", "node"))).where("k <= 50")
    return best.select(F.col("seed").alias("document"), "node", "distance", F.round(g.hop_relevance(F.col("distance")), 6).alias("relevance"))


# Arrivals


@r.query()
def incremental_dedup(spark, sf_dir):
    """Documents in order of their ids, in four batches, each against what came before it."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("arrival"), F.col("embedding").alias("vec"))
    rows = docs.select(F.col("doc_id").alias("arrival"), "doc_id", "text")
    least, most = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    index = DedupIndex(spark, _folder(spark))
    cuts = [least + (most - least + 1) * i // 4 for i in range(5)] if least is not None else [0, 1]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        index.add(rows.where((F.col("arrival") >= a) & (F.col("arrival") < b)), i, vectors)
    return index.results()


_EVENTS = "event_id long, user_id long, event_type string, ts timestamp"


def _event_stream(spark, sf_dir):
    """Events in files that arrive in order of their time, as a stream of several micro-batches. A user's events of a quarter are in
    one file, as the files of a quarter come in any order."""
    path = _folder(spark)
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    day = F.unix_micros("ts")
    cuts = e.select(F.percentile_approx(day, F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias("c")).first()["c"] or []
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = (F.lit(True) if low is None else day > low) & (F.lit(True) if high is None else day <= high)
        e.where(part).repartition("user_id").write.mode("append").parquet(path)  # one after the other: the source takes files by their age
    return spark.readStream.schema(_EVENTS).option("maxFilesPerTrigger", 1).parquet(path)


def _all_of(stream):
    spark, path = stream.sparkSession, _folder(stream.sparkSession)
    keyed.use_state_store(spark)
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}-state").option("path", path).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@r.query("""WITH RECURSIVE e AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
w AS (SELECT *, [ts] AS held, true AS allowed, 0::BIGINT AS retry_after FROM e WHERE k = 1
 UNION ALL SELECT event_id, user_id, ts, k, CASE WHEN len(live) < 3 THEN list_append(live, ts) ELSE live END, len(live) < 3, CASE WHEN len(live) < 3 THEN 0 ELSE greatest((epoch_us(live[1]) - epoch_us(ts) + 86400000000) // 1000000 + 1, 1) END
 FROM (SELECT e.*, list_filter(w.held, lambda x: x > e.ts - INTERVAL 86400 SECOND) AS live FROM w JOIN e ON e.user_id = w.user_id AND e.k = w.k + 1))
SELECT user_id, event_id, allowed, retry_after FROM w""")
def limited_stream(spark, sf_dir):
    """Three events of a user are accepted in any day; the state is a stream's, over several micro-batches."""
    return _all_of(keyed.rate_limited(_event_stream(spark, sf_dir), "user_id", "ts", "event_id", 3, 86400, "365 days"))


# Writes


@r.query("SELECT vec_id, len(embedding)::INT AS entries, label, true AS in_bound FROM embeddings WHERE len(embedding) > 0")
def stored_points(spark, sf_dir):
    """Points written through the transactional sink and read again: each once, in requests of 64 at most."""
    path = _folder(spark)
    points.write(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), "label"), path)
    found = points.read(spark, path)
    return found.select(F.col("id").alias("vec_id"), F.size("vector").alias("entries"), F.col("payload")["label"].cast("int").alias("label"), (F.col("in_request") <= 64).alias("in_bound"))


@r.query("SELECT event_id::VARCHAR AS id, 'edge' AS profile_name, CASE WHEN user_id % 7 = 0 THEN 'unknown' ELSE 's' || user_id % 7 END AS store_id, event_type AS query, CASE WHEN event_id % 5 = 0 THEN 'again' ELSE '' END AS answer, floor(value)::BIGINT AS latency_ms, event_type <> 'error' AS success, NULL::VARCHAR AS model_version, ts AS edge_timestamp FROM events")
def collected_logs(spark, sf_dir):
    """Events as JSON lines in files that a stream collects in two runs; every fifth comes again with an answer in the second."""
    source, target = _folder(spark), _folder(spark)
    e = table(spark, sf_dir, "events")
    store = F.when(F.col("user_id") % 7 != 0, F.concat(F.lit("s"), F.col("user_id") % 7))
    entry = lambda answer: F.to_json(F.struct(F.col("event_id").cast("string").alias("id"), store.alias("store_id"), F.col("event_type").alias("query"), answer.alias("answer"), F.floor("value").alias("latency_ms"), F.when(F.col("event_type") == "error", False).alias("success"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts")))
    for rows in (e.select(entry(F.lit(None).cast("string"))), e.where("event_id % 5 = 0").select(entry(F.lit("again"))).union(spark.range(1).select(F.lit("{broken")))):
        rows.write.mode("append").text(source)
        collect.collect(spark, source, target, f"{target}-state", "edge", 2).awaitTermination()
    return collect.collected(spark, target).withColumn("edge_timestamp", F.col("edge_timestamp").cast("timestamp_ntz"))


# Lifecycles


_STATES = "['draft', 'published', 'under_review', 'archived', 'deleted']"


@r.query(f"""WITH RECURSIVE e AS (SELECT event_id, user_id, {_STATES}[1 + event_id % 4] AS f, {_STATES}[CASE WHEN event_id % 97 = 0 THEN 5 ELSE 1 + (event_id // 4) % 4 END] AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
a AS (SELECT * FROM (VALUES ('draft', 'published'), ('draft', 'deleted'), ('published', 'archived'), ('published', 'under_review'), ('published', 'deleted'), ('under_review', 'published'), ('under_review', 'archived'), ('under_review', 'deleted'), ('archived', 'published'), ('archived', 'deleted')) x(f, t)),
w AS (SELECT user_id, 0::BIGINT AS event_id, 0::BIGINT AS k, false AS accepted, 'draft' AS status FROM (SELECT DISTINCT user_id FROM events) UNION ALL SELECT e.user_id, e.event_id, e.k, e.f = w.status AND EXISTS (SELECT 1 FROM a WHERE a.f = e.f AND a.t = e.t), CASE WHEN e.f = w.status AND EXISTS (SELECT 1 FROM a WHERE a.f = e.f AND a.t = e.t) THEN e.t ELSE w.status END FROM w JOIN e ON e.user_id = w.user_id AND e.k = w.k + 1)
SELECT event_id, user_id, accepted, status FROM w WHERE k > 0""")
def lifecycle_states(spark, sf_dir):
    """Events as asked transitions, replayed for each user: whether each is accepted, and the state after it."""
    states = F.array(*map(F.lit, lc.ALLOWED))
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", states[(F.col("event_id") % 4).cast("int")].alias("from_state"), F.when(F.col("event_id") % 97 == 0, "deleted").otherwise(states[(F.floor(F.col("event_id") / 4) % 4).cast("int")]).alias("to_state"))
    return lc.replay(e, "user_id", ["ts", "event_id"]).select("event_id", "user_id", "accepted", "status")


# Matching


@r.query("""WITH o AS (SELECT l_orderkey AS text, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS place, l_partkey, l_suppkey FROM lineitem),
c AS (SELECT text, place, t.* FROM o JOIN LATERAL (SELECT unnest([1, 2, 3]) AS rank) x ON TRUE JOIN LATERAL (SELECT rank AS k, 't' || (l_partkey + rank) % 9 AS term, CASE WHEN (l_partkey + rank) % 5 < 4 THEN 'type' || (l_partkey + rank) % 3 END AS word_type, CASE WHEN (l_suppkey + rank) % 4 > 0 THEN ((l_suppkey * rank) % 10) / 10.0 END AS confidence) t ON TRUE),
s AS (SELECT text, place, word_type AS own FROM c WHERE k = 1), near AS (SELECT a.text, a.place, b.own, count(*) AS n, min(b.place) AS first FROM s a JOIN s b ON a.text = b.text AND b.place BETWEEN a.place - 2 AND a.place + 2 AND b.place <> a.place WHERE b.own IS NOT NULL GROUP BY ALL),
major AS (SELECT text, place, own FROM near QUALIFY row_number() OVER (PARTITION BY text, place ORDER BY n DESC, first) = 1)
SELECT c.text, c.place, c.k AS rank, c.term, CASE WHEN c.word_type = m.own THEN 'majority' ELSE 'confidence' END AS reason FROM c LEFT JOIN major m USING (text, place) QUALIFY row_number() OVER (PARTITION BY c.text, c.place ORDER BY (c.word_type IS NOT DISTINCT FROM m.own AND m.own IS NOT NULL) DESC, CASE WHEN c.word_type = m.own THEN -c.k END DESC, coalesce(c.confidence, 1.0) DESC, c.k) = 1""")
def disambiguated(spark, sf_dir):
    """Of three candidates at each place of a text, the first of the type that most neighbours have, or the most confident."""
    own = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice")
    o = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("text"), F.row_number().over(own).alias("place"), "l_partkey", "l_suppkey")
    c = o.select("text", "place", "l_partkey", "l_suppkey", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("rank"))
    k = F.col("l_partkey") + F.col("rank")
    c = c.select("text", "place", "rank", F.concat(F.lit("t"), k % 9).alias("term"), F.when(k % 5 < 4, F.concat(F.lit("type"), k % 3)).alias("word_type"), F.when((F.col("l_suppkey") + F.col("rank")) % 4 > 0, ((F.col("l_suppkey") * F.col("rank")) % 10) / 10.0).alias("confidence"))
    return matching.disambiguated(c, 2).select("text", "place", "rank", "term", "reason")


# Fused rankings


_DENSE = "WITH q AS (SELECT item_id AS query, text, embedding AS v FROM benchmark JOIN embeddings ON vec_id = item_id), d AS (SELECT doc_id AS id, embedding AS v FROM documents JOIN embeddings ON vec_id = doc_id), c AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY round(list_cosine_similarity(q.v::DOUBLE[], d.v::DOUBLE[]), 9) DESC, id) AS rank FROM q JOIN d ON TRUE QUALIFY rank <= 50)"
_SHARED = r", qw AS (SELECT item_id AS query, unnest(list_distinct(list_filter(string_split(lower(trim(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g'))), ' '), lambda x: x <> ''))) AS term FROM benchmark), dw AS (SELECT doc_id AS id, unnest(list_distinct(list_filter(string_split(lower(trim(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g'))), ' '), lambda x: x <> ''))) AS term FROM documents), n AS (SELECT query, count(*) AS n FROM qw GROUP BY query), b AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY count(*) / any_value(n.n) DESC, id) AS rank FROM qw JOIN dw USING (term) JOIN n USING (query) GROUP BY query, id QUALIFY rank <= 50)"


@r.query(_DENSE + _SHARED + ", f AS (SELECT query, id, sum(1 / (60 + rank)) AS score, count(*) AS channels FROM (SELECT * FROM c UNION ALL SELECT * FROM b) GROUP BY query, id) SELECT query, id, round(score, 9) AS score, channels, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS place FROM f QUALIFY place <= 10")
def hybrid_search(spark, sf_dir):
    """The ten best of dense and sparse candidates, five times as many of either, fused by reciprocal ranks. Items and documents
    whose id has a vector are ranked by it."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    b, d = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    queries = b.join(e, F.col("item_id") == F.col("vec_id"), "left").select(F.col("item_id").alias("query"), "text", "vec")
    rows = spread(d.select("doc_id", "text")).join(e, F.col("doc_id") == F.col("vec_id"), "left").select(F.col("doc_id").alias("id"), "text", "vec")
    return v.hybrid_top_k(queries, stored(rows), 10)


# Page structure


def edited_page(html):
    """Pages with headings, tables, code and mentions in the place of some paragraphs' first words."""
    for letters, to in (("A-E", "<h2>$1</h2><p>$2"), ("F-K", "<h3>$1</h3><p>$2"), ("L-N", "<table><tr><th>담당자</th><th>$1</th></tr><tr><td>$2</td><td>x</td></tr></table><p>"), ("O-R", '<pre><code class="language-sql">$1\n$2</code></pre><p>@김철수 '), ("S-T", '<a class="user-mention" data-username="$1">@$2</a><p>')):
        html = F.regexp_replace(html, f"<p>([{letters}]\\p{{L}}*) (\\p{{L}}+)", to)
    return html


@r.query()
def page_trees(spark, sf_dir):
    """Every block of the pages with its section's path, as the pages' trees have them."""
    pages = spread(table(spark, sf_dir, "pages")).select("page_id", tree.page_tree(edited_page(F.col("html"))).alias("t"))
    s = pages.select("page_id", F.explode("t.sections").alias("s"))
    blocks = s.select("page_id", F.col("s.id").alias("section"), F.col("s.path").alias("path"), F.size("s.mentions").alias("mentions"), F.explode("s.blocks").alias("b"))
    return blocks.select("page_id", "section", "path", "mentions", "b.place", "b.kind", "b.table_type", "b.language", F.col("b.text").alias("text"))


# New terms


@r.query("""WITH a AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE label < 5), c AS (SELECT vec_id, CASE WHEN vec_id % 40 = 0 THEN list_reverse(embedding) ELSE list_transform(range(1, len(embedding) + 1), lambda i: CASE WHEN i % 4 = 0 THEN 0 ELSE embedding[i] END) END::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0)
SELECT c.vec_id AS term, round(max(round(list_cosine_similarity(c.v, a.v), 9)), 5) AS best, coalesce(max(round(list_cosine_similarity(c.v, a.v), 9)) < 0.75, true) AS is_new FROM c LEFT JOIN a ON TRUE GROUP BY c.vec_id""")
def new_terms(spark, sf_dir):
    """Candidate terms by their vectors: those that no approved term is as alike as 0.75 to are new."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    edited = F.when(F.col("vec_id") % 40 == 0, F.reverse("v")).otherwise(F.transform("v", lambda x, i: F.when((i + 1) % 4 == 0, 0.0).otherwise(x)))
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), edited.alias("vec"))
    best = v.dense_top_k(asked, e.where("label < 5").select(F.col("vec_id").alias("id"), F.col("v").alias("vec")), 1)
    found = asked.select("query").join(best.select("query", "score"), "query", "left")
    return found.select(F.col("query").alias("term"), F.round("score", 5).alias("best"), F.coalesce(F.col("score") < 0.75, F.lit(True)).alias("is_new"))
