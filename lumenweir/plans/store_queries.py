"""Queries that write as merges, count what is stored, read the graph, and sweep by time.

Customers stand for persons, orders for documents that they author, parts for topics that documents mention (line items),
suppliers for persons who are mentioned; events for usage logs, votes and jobs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph as g
from ..operators import merging as m
from ..operators import retrieval as v
from .registry import Registry, table

r = Registry()
_AT = "2024-01-20"


def _t(spark, sf_dir, *names):
    return [table(spark, sf_dir, n) for n in names]


# Writes


_STATES = "SELECT user_id, event_type AS state, value, ts, event_id FROM events"


@r.query(f"""WITH o AS ({_STATES} WHERE ts < TIMESTAMP '{_AT}'), n AS ({_STATES} WHERE ts >= TIMESTAMP '{_AT}'), a AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1), b AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT user_id, state, ts FROM b UNION ALL SELECT user_id, state, ts FROM a WHERE user_id NOT IN (SELECT user_id FROM b)""")
def upserted_states(spark, sf_dir):
    """A status row for each user: later events replace it."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("state"), "value", F.struct("ts", "event_id").alias("at"))
    old = m.last_of_key(e.where(F.col("at.ts") < _AT), ["user_id"], "at")
    return m.upsert(old, e.where(F.col("at.ts") >= _AT), ["user_id"], "at").select("user_id", "state", F.col("at.ts").alias("ts"))


@r.query("""WITH n AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE upper(p_name) END AS name, CASE WHEN p_partkey % 2 = 0 THEN p_retailprice * 2 END AS price FROM part WHERE p_partkey % 4 = 0)
SELECT p.p_partkey, coalesce(n.name, p.p_name) AS p_name, coalesce(n.price, p.p_retailprice) AS p_retailprice FROM part p LEFT JOIN n USING (p_partkey)""")
def upserted_glossary(spark, sf_dir):
    """Terms updated in a batch; columns that an update leaves null stay."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    k = F.col("p_partkey")
    new = p.where(k % 4 == 0).select("p_partkey", F.when(k % 3 != 0, F.upper("p_name")).alias("p_name"), F.when(k % 2 == 0, F.col("p_retailprice") * 2).alias("p_retailprice"))
    return m.upsert(p, new, ["p_partkey"], "p_name", keep_null=True)


@r.query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' OR o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 8000)")
def deleted_by_filter(spark, sf_dir):
    """What is left when all orders of a status go, but those of customers to be kept."""
    o, c = _t(spark, sf_dir, "orders", "customer")
    keep = c.where("c_acctbal > 8000").select(F.col("c_custkey").alias("o_custkey"))
    return m.without_matching(o.select("o_custkey", "o_orderkey", "o_orderstatus"), F.col("o_orderstatus") == "F", keep, "o_custkey").select("o_orderkey")


@r.query("SELECT count(*) AS n, count(DISTINCT vec_id) AS ids, (SELECT ceil(count(*) / 64.0)::BIGINT FROM embeddings WHERE len(embedding) > 0) AS batches FROM embeddings WHERE len(embedding) > 0")
def point_batches(spark, sf_dir):
    """Points with vectors in batches of about 64 for a writer."""
    b = m.storable_points(table(spark, sf_dir, "embeddings"), "embedding")
    return b.agg(F.count("*").alias("n"), F.countDistinct("vec_id").alias("ids"), (F.max("batch") + 1).alias("batches"))


_NODES = "SELECT 'c' || o_custkey AS id, 'Person' AS type, o_orderdate AS t, 1 AS n, o_orderkey FROM orders UNION ALL SELECT 'p' || l_partkey, 'Topic', l_shipdate, 1, l_orderkey FROM lineitem"


@r.query(f"SELECT id, any_value(type) AS type, max(t) AS updated_at, count(*) AS mentions FROM ({_NODES}) GROUP BY id")
def merged_nodes(spark, sf_dir):
    """Nodes of two loads merged by id: mentions add up."""
    o, li = _t(spark, sf_dir, "orders", "lineitem")
    one = o.select(F.concat(F.lit("c"), "o_custkey").alias("id"), F.lit("Person").alias("type"), F.col("o_orderdate").alias("updated_at"), F.lit(1).alias("mentions"))
    two = li.select(F.concat(F.lit("p"), "l_partkey").alias("id"), F.lit("Topic").alias("type"), F.col("l_shipdate").alias("updated_at"), F.lit(1).alias("mentions"))
    both = one.unionByName(two)
    early = F.col("updated_at") < "1997-01-01"
    return m.merged_nodes(both.where(early), both.where(~early))


@r.query("SELECT l_orderkey AS src, 'MENTIONS' AS type, l_partkey AS dst, max(l_quantity) AS weight FROM lineitem WHERE l_linestatus = 'F' OR (l_orderkey IN (SELECT o_orderkey FROM orders) AND l_partkey % 2 = 0) GROUP BY l_orderkey, l_partkey")
def merged_edges(spark, sf_dir):
    """Edges merged by ends and type, new ones only between known nodes."""
    li, o, p = _t(spark, sf_dir, "lineitem", "orders", "part")
    e = li.select(F.col("l_orderkey").alias("src"), F.lit("MENTIONS").alias("type"), F.col("l_partkey").alias("dst"), F.col("l_quantity").alias("weight"), "l_linestatus")
    sources, ends = o.select(F.col("o_orderkey").alias("id")), p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"))
    new = e.where("l_linestatus <> 'F'").drop("l_linestatus")
    new = new.join(sources, new.src == sources.id, "left_semi").join(ends, new.dst == ends.id, "left_semi")
    return m.merged_edges(e.where("l_linestatus = 'F'").drop("l_linestatus"), new, sources.union(table(spark, sf_dir, "part").select("p_partkey")).distinct())


@r.query("""SELECT 'c' || o_custkey AS source, 'o' || o_orderkey AS target, 'AUTHORED' AS type FROM orders UNION ALL SELECT 'o' || o_orderkey, 'kb' || o_orderstatus, 'BELONGS_TO' FROM orders
UNION ALL SELECT DISTINCT 'o' || l_orderkey, 'p' || l_partkey, 'MENTIONS' FROM lineitem UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'CHILD_OF' FROM nation""")
def structural_edges(spark, sf_dir):
    """Edges that documents' own columns give: author, base, references, parent."""
    o, li, n = _t(spark, sf_dir, "orders", "lineitem", "nation")
    edge = lambda rows, a, x, b, y, kind: rows.select(F.concat(F.lit(a), x).alias("source"), F.concat(F.lit(b), y).alias("target"), F.lit(kind).alias("type"))
    return (
        edge(o, "c", "o_custkey", "o", "o_orderkey", "AUTHORED").unionByName(edge(o, "o", "o_orderkey", "kb", "o_orderstatus", "BELONGS_TO"))
        .unionByName(edge(li.select("l_orderkey", "l_partkey").distinct(), "o", "l_orderkey", "p", "l_partkey", "MENTIONS")).unionByName(edge(n, "n", "n_nationkey", "r", "n_regionkey", "CHILD_OF"))
    )


_CURRENT = "SELECT c_custkey AS src, 'MEMBER_OF' AS type, c_nationkey AS dst, TIMESTAMP '2023-01-01' AS created_at FROM customer"
_MOVED = "SELECT c_custkey AS src, 'MEMBER_OF' AS type, (c_nationkey + CASE WHEN c_custkey % 10 = 0 THEN 1 ELSE 0 END + c_custkey % 3) % 25 AS dst, CASE WHEN c_custkey % 10 = 0 THEN TIMESTAMP '2024-06-01' ELSE TIMESTAMP '2024-01-01' END AS at FROM customer WHERE c_custkey % 5 = 0"


@r.query(f"""WITH c AS ({_CURRENT}), n AS ({_MOVED}), k AS (SELECT c.src, CASE WHEN n.dst IS NOT NULL AND n.dst <> c.dst THEN 'WAS_MEMBER_OF' ELSE c.type END AS type, c.dst, c.created_at, CASE WHEN n.dst IS NOT NULL AND n.dst <> c.dst THEN n.at END AS archived_at FROM c LEFT JOIN n USING (src))
SELECT * FROM k UNION ALL SELECT n.src, n.type, n.dst, n.at, NULL FROM n JOIN c USING (src) WHERE n.dst <> c.dst""")
def versioned_edges(spark, sf_dir):
    """New memberships; those that they replace are archived."""
    c = table(spark, sf_dir, "customer")
    none = F.lit(None).cast("timestamp_ntz")
    now = c.select(F.col("c_custkey").alias("src"), F.lit("MEMBER_OF").alias("type"), F.col("c_nationkey").alias("dst"), F.lit("2023-01-01").cast("timestamp_ntz").alias("created_at"), none.alias("archived_at"))
    moved = lambda rows, by, at: rows.select(F.col("c_custkey").alias("src"), F.lit("MEMBER_OF").alias("type"), ((F.col("c_nationkey") + by + F.col("c_custkey") % 3) % 25).cast("int").alias("dst"), F.lit(at).cast("timestamp_ntz").alias("at"))
    new = moved(c.where("c_custkey % 5 = 0"), 0, "2024-01-01").union(moved(c.where("c_custkey % 10 = 0"), 1, "2024-06-01"))  # some move twice: the later move counts
    return m.archived(now, new, "at")


@r.query("SELECT o_custkey, o_orderkey, o_orderdate AS valid_from, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to, coalesce(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) IS NULL, true) AS current FROM orders")
def relationship_history(spark, sf_dir):
    """All versions of a customer's latest order, current and archived."""
    o = table(spark, sf_dir, "orders")
    end = F.lead("o_orderdate").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return o.select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("valid_from"), end.alias("valid_to")).withColumn("current", F.col("valid_to").isNull())


# Graph reads


_MENTIONS = "SELECT DISTINCT l_orderkey AS d, l_partkey AS p FROM lineitem"


@r.query(f"""WITH t AS (SELECT p_partkey FROM part WHERE contains(p_name, 'red')), m AS ({_MENTIONS}),
a AS (SELECT o_custkey AS person, count(DISTINCT o_orderkey) AS n FROM orders JOIN m ON d = o_orderkey WHERE p IN (SELECT p_partkey FROM t) GROUP BY 1),
b AS (SELECT o_custkey AS person, count(DISTINCT p) AS n FROM orders JOIN m ON d = o_orderkey WHERE p IN (SELECT p_partkey FROM t) GROUP BY 1), c AS (SELECT l_suppkey + 1000000000 AS person, count(DISTINCT l_partkey) AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM t) GROUP BY 1)
SELECT person, sum(n)::BIGINT AS score, count(*) AS paths FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) GROUP BY person ORDER BY score DESC, person LIMIT 20""")
def topic_experts_of_paths(spark, sf_dir):
    """Experts on a topic by three kinds of evidence, added up by person."""
    o, li, p = _t(spark, sf_dir, "orders", "lineitem", "part")
    topic = p.where(F.contains("p_name", F.lit("red"))).select(F.col("p_partkey").alias("l_partkey"))
    hits = li.join(topic, "l_partkey", "left_semi").select("l_orderkey", "l_partkey", "l_suppkey")
    by = hits.select("l_orderkey", "l_partkey").distinct().join(o.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").groupBy(F.col("o_custkey").alias("person"))
    found = by.agg(F.countDistinct("l_orderkey").alias("n"), F.countDistinct("l_partkey").alias("k"))
    direct = hits.groupBy((F.col("l_suppkey") + 1_000_000_000).alias("person")).agg(F.countDistinct("l_partkey").alias("n"))
    both = found.select("person", "n").unionByName(found.select("person", F.col("k").alias("n"))).unionByName(direct)
    return both.groupBy("person").agg(F.sum("n").alias("score"), F.count("*").alias("paths")).orderBy(F.desc("score"), "person").limit(20)


@r.query("WITH m AS (SELECT DISTINCT o_custkey AS c, l_partkey AS p FROM orders JOIN lineitem ON l_orderkey = o_orderkey) SELECT a.c AS a, b.c AS b, a.p AS part FROM m a JOIN m b ON b.p = a.p AND b.c = a.c + 1")
def common_entities(spark, sf_dir):
    """Parts that a customer and the next one both mention."""
    o, li = _t(spark, sf_dir, "orders", "lineitem")
    own = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("a"), F.col("l_partkey").alias("part")).distinct()
    return own.join(own.select((F.col("a") - 1).alias("a"), "part"), ["a", "part"]).select("a", (F.col("a") + 1).alias("b"), "part")


@r.query("WITH e AS (SELECT p_partkey AS id, p_name AS name FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(p_name), 'small')), f AS (SELECT e.id, e.name, s.l_suppkey AS other, s.l_orderkey FROM e LEFT JOIN lineitem s ON s.l_partkey = e.id AND s.l_quantity > 45) SELECT id, name, other, l_orderkey FROM f QUALIFY row_number() OVER (PARTITION BY id ORDER BY l_orderkey, other) <= 3")
def entity_facts(spark, sf_dir):
    """Entities that hold a keyword, with up to three of their facts, or none."""
    p, li = _t(spark, sf_dir, "part", "lineitem")
    e = p.where(F.contains(F.lower("p_name"), F.lit("red")) | F.contains(F.lower("p_name"), F.lit("small"))).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    f = e.join(li.where("l_quantity > 45").select(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("other"), "l_orderkey"), "id", "left")
    return f.withColumn("_k", F.row_number().over(Window.partitionBy("id").orderBy(F.asc_nulls_last("l_orderkey"), "other"))).where("_k <= 3").drop("_k")


@r.query(f"""WITH m AS ({_MENTIONS}), s AS (SELECT p_partkey AS p FROM part WHERE contains(p_name, 'red')), d1 AS (SELECT DISTINCT d FROM m JOIN s USING (p)), p2 AS (SELECT DISTINCT p FROM m WHERE d IN (SELECT d FROM d1)), d2 AS (SELECT DISTINCT d FROM m WHERE p IN (SELECT p FROM p2) AND d NOT IN (SELECT d FROM d1))
SELECT d, 1 AS hops FROM d1 UNION ALL SELECT d, 3 FROM d2""")
def related_chunks(spark, sf_dir):
    """Documents at least hops from entities that a search gives, up to three hops. Fronts are stored hop by hop."""
    p, li = _t(spark, sf_dir, "part", "lineitem")
    e = li.select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
    seeds = p.where(F.contains("p_name", F.lit("red"))).select(F.col("p_partkey").alias("node"))
    return g.reached_across(e, seeds, 3).select(F.col("node").alias("d"), F.col("distance").alias("hops"))


@r.query(f"WITH m AS ({_MENTIONS}), a AS (SELECT d, p FROM m WHERE d % 20 = 0), s AS (SELECT a.d AS doc, m.d AS other, count(*) AS shared FROM a JOIN m ON m.p = a.p AND m.d <> a.d GROUP BY 1, 2) SELECT doc, other, shared, round(shared / (SELECT count(*) FROM m x WHERE x.d = s.doc), 6) AS share FROM s QUALIFY row_number() OVER (PARTITION BY doc ORDER BY shared DESC, other) <= 5")
def document_clusters(spark, sf_dir):
    """For each stated document the five that share most topics with it."""
    e = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
    nodes = e.where("src % 20 = 0").select(F.col("src").alias("node")).distinct()
    size = e.groupBy(F.col("src").alias("a")).agg(F.countDistinct("dst").alias("n"))
    s = g.shared_neighbours(e, nodes).join(size, "a").select(F.col("a").alias("query"), F.col("b").alias("id"), F.col("shared").alias("score"), "n")
    return v.top_per_query(s, 5).select(F.col("query").alias("doc"), F.col("id").alias("other"), F.col("score").alias("shared"), F.round(F.col("score") / F.col("n"), 6).alias("share"))


@r.query(f"WITH m AS ({_MENTIONS}), c AS (SELECT o_orderkey AS d, o_custkey AS c FROM orders), s AS (SELECT d AS doc, c FROM c), x AS (SELECT DISTINCT s.doc, c.d AS n FROM s JOIN c USING (c) WHERE c.d <> s.doc), y AS (SELECT DISTINCT x.doc, m.p AS n FROM (SELECT doc, doc AS n FROM s UNION ALL SELECT * FROM x) x JOIN m ON m.d = x.n) SELECT doc, (SELECT count(*) FROM x WHERE x.doc = s.doc) AS documents, (SELECT count(*) FROM y WHERE y.doc = s.doc) AS topics FROM s")
def document_impact(spark, sf_dir):
    """How many documents of the same author, and topics of all these, a document touches."""
    o, li = _t(spark, sf_dir, "orders", "lineitem")
    author = F.struct("o_custkey", F.when(F.col("o_custkey").isNull(), F.col("o_orderkey")).alias("alone"))
    own = o.select(F.col("o_orderkey").alias("doc"), author.alias("author"))
    mentions = own.join(li.select(F.col("l_orderkey").alias("doc"), "l_partkey"), "doc")
    topics = mentions.groupBy("author").agg(F.countDistinct("l_partkey").alias("topics"))  # all documents of an author touch the same
    docs = own.groupBy("author").agg((F.count("*") - 1).alias("documents"))
    return own.join(docs.join(topics, "author", "left"), "author").select("doc", "documents", F.coalesce("topics", F.lit(0)).alias("topics"))


_STEPS = "SELECT l_orderkey AS process, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS step, l_partkey AS action FROM lineitem"


def _steps(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("process"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice")).alias("step"), F.col("l_partkey").alias("action"))


@r.query(f"WITH s AS ({_STEPS}) SELECT process, step, action FROM s WHERE step >= 2 QUALIFY row_number() OVER (PARTITION BY process ORDER BY step) <= 3")
def process_chains(spark, sf_dir):
    """Three steps of each process from the second on."""
    return _steps(spark, sf_dir).where("step between 2 and 4")


@r.query(f"WITH s AS ({_STEPS}), k AS (SELECT process, step, action, list(action) OVER (PARTITION BY process ORDER BY step ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS before, list(action) OVER (PARTITION BY process ORDER BY step ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS after FROM s) SELECT process, step, action, coalesce(array_to_string(before, ','), '') AS before, coalesce(array_to_string(after, ','), '') AS after FROM k WHERE step = 2")
def step_contexts(spark, sf_dir):
    """Two steps on either side of each process's second step."""
    w = Window.partitionBy("process").orderBy("step")
    side = lambda a, b: F.concat_ws(",", F.collect_list(F.col("action").cast("string")).over(w.rowsBetween(a, b)))
    return _steps(spark, sf_dir).withColumns({"before": side(-2, -1), "after": side(1, 2)}).where("step = 2")


@r.query("SELECT c_custkey, r_name || ' > ' || n_name AS path FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
def chunk_sections(spark, sf_dir):
    c, n, x = _t(spark, sf_dir, "customer", "nation", "region")
    return c.join(n, c.c_nationkey == n.n_nationkey).join(x, n.n_regionkey == x.r_regionkey).select("c_custkey", F.concat_ws(" > ", "r_name", "n_name").alias("path"))


@r.query("SELECT n_name, c_custkey FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE contains(lower(n_name), 'nation_1') QUALIFY row_number() OVER (PARTITION BY n_name ORDER BY c_custkey) <= 5")
def section_titles(spark, sf_dir):
    """Pages of sections whose titles hold the words, five a section."""
    n, c = _t(spark, sf_dir, "nation", "customer")
    hit = n.where(F.contains(F.lower("n_name"), F.lit("nation_1"))).join(c, n.n_nationkey == c.c_nationkey)
    return hit.withColumn("_k", F.row_number().over(Window.partitionBy("n_name").orderBy("c_custkey"))).where("_k <= 5").select("n_name", "c_custkey")


@r.query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def documents_without_base(spark, sf_dir):
    c, o = _t(spark, sf_dir, "customer", "orders")
    return c.select("c_custkey").join(o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@r.query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def mentioned_never_author(spark, sf_dir):
    c, o = _t(spark, sf_dir, "customer", "orders")
    of = lambda cond: o.where(cond).select(F.col("o_custkey").alias("c_custkey"))
    return c.select("c_custkey").join(of("o_totalprice > 100000"), "c_custkey", "left_semi").join(of("o_orderpriority = '1-URGENT'"), "c_custkey", "left_anti")


@r.query("""WITH p AS (SELECT c_custkey, '2024-0' || (1 + c_custkey % 9) AS token FROM customer), o AS (SELECT o_custkey, o_orderkey, strftime(o_orderdate, '1997-%m') AS m FROM orders), h AS (SELECT c_custkey, o_orderkey, m = replace(token, '2024', '1997') AS hit FROM p JOIN o ON o_custkey = c_custkey)
SELECT c_custkey, o_orderkey FROM h WHERE hit OR c_custkey NOT IN (SELECT c_custkey FROM h WHERE hit)""")
def person_documents(spark, sf_dir):
    """Documents that mention a person in the month asked for; where there are none, all that mention them."""
    c, o = _t(spark, sf_dir, "customer", "orders")
    month = F.concat(F.lit("1997-0"), 1 + F.col("c_custkey") % 9)
    h = c.select("c_custkey", month.alias("token")).join(o.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.concat(F.lit("1997-"), F.date_format("o_orderdate", "MM")).alias("m")), "c_custkey").withColumn("hit", F.col("m") == F.col("token"))
    some = h.where("hit").select("c_custkey").distinct()
    return h.where("hit").select("c_custkey", "o_orderkey").unionByName(h.join(some, "c_custkey", "left_anti").select("c_custkey", "o_orderkey"))


@r.query("""WITH e AS (SELECT p_partkey AS p, p_name FROM part WHERE contains(p_name, 'red')), a AS (SELECT DISTINCT l_orderkey AS d FROM (SELECT l_orderkey, l_partkey FROM lineitem JOIN e ON e.p = l_partkey QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey) <= 30)),
b AS (SELECT p + 5 AS d FROM e QUALIFY row_number() OVER (ORDER BY p) <= 5) SELECT d, max(kind) AS kind FROM (SELECT d, 'connected' AS kind FROM a UNION ALL SELECT d, 'source' FROM b) GROUP BY d""")
def entity_documents(spark, sf_dir):
    """Documents that entities of a keyword lead to: by up to 30 facts of each, and by the source documents of five of them."""
    p, li = _t(spark, sf_dir, "part", "lineitem")
    e = p.where(F.contains("p_name", F.lit("red"))).select(F.col("p_partkey").alias("l_partkey"))
    facts = li.join(e, "l_partkey", "left_semi").withColumn("_k", F.row_number().over(Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey"))).where("_k <= 30")
    source = e.orderBy("l_partkey").limit(5).select((F.col("l_partkey") + 5).alias("d"), F.lit("source").alias("kind"))
    return facts.select(F.col("l_orderkey").alias("d"), F.lit("connected").alias("kind")).distinct().unionByName(source).groupBy("d").agg(F.max("kind").alias("kind"))


@r.query("SELECT doc_id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0)")
def not_yet_ingested(spark, sf_dir):
    """Documents whose content was not ingested before; only ids and hashes meet."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return d.join(d.where("doc_id % 3 = 0").select("h"), "h", "left_anti").select("doc_id")


_GRAMS = "list_distinct(list_transform(range(1, greatest(length({0}) - 1, 2)), lambda i: {0}[i:i + 2]))"


@r.query(f"""WITH q AS (SELECT p_partkey AS query, unnest({_GRAMS.format('p_name')}) AS gram FROM part WHERE p_partkey % 20 = 0), d AS (SELECT p_partkey AS id, unnest({_GRAMS.format('p_name')}) AS gram FROM part), h AS (SELECT query, id, count(*) AS shared FROM q JOIN d USING (gram) WHERE query <> id GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT query, id, shared FROM h QUALIFY row_number() OVER (PARTITION BY query ORDER BY shared DESC, id) <= 20""")
def gram_candidates(spark, sf_dir):
    """Candidates of the stated terms by n-grams in common, two at least, the 20 with most."""
    from ..functions import text as t

    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    asked = p.where("id % 20 = 0").withColumnRenamed("id", "query")
    grams = lambda rows, c: rows.select(F.col("name").alias(c)).distinct().select(c, F.explode(t.char_ngrams(F.col(c))).alias("gram"))
    shared = grams(asked, "name").join(grams(p, "other"), "gram").groupBy("name", "other").agg(F.count("*").alias("score")).where("score >= 2")
    return v.best_by_name(asked, p, shared, 20).select("query", "id", F.col("score").alias("shared"))


# Counts


@r.query("SELECT count(*) AS n, count(*) FILTER (k IS NOT NULL) AS with_chunks, round(sum(k) / count(*) FILTER (k IS NOT NULL), 4) AS avg_chunks FROM (SELECT CASE WHEN event_type = 'view' THEN json_extract_string(props, '$.k')::INT END AS k FROM events)")
def context_averages(spark, sf_dir):
    """An average over a JSON field, by the rows that have it."""
    k = F.when(F.col("event_type") == "view", F.get_json_object("props", "$.k").cast("int"))
    return table(spark, sf_dir, "events").select(k.alias("k")).agg(F.count("*").alias("n"), F.count("k").alias("with_chunks"), F.round(F.sum("k") / F.count("k"), 4).alias("avg_chunks"))


@r.query("SELECT o_orderpriority AS kb, count(*) AS pending FROM orders WHERE o_orderstatus = 'P' GROUP BY 1")
def pending_candidates(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_orderpriority").alias("kb")).agg(F.count("*").alias("pending"))


@r.query("SELECT l_shipdate::DATE AS batch, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS returned, count(*) FILTER (l_linestatus = 'F') AS done, round(avg(l_quantity), 4) AS avg_quantity, round(avg(l_discount), 6) AS avg_discount FROM lineitem GROUP BY 1")
def batch_stats(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("batch")).agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_if(F.col("l_linestatus") == "F").alias("done"), F.round(F.avg("l_quantity"), 4).alias("avg_quantity"), F.round(F.avg("l_discount"), 6).alias("avg_discount"))


@r.query("SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11'")
def failed_documents(spark, sf_dir):
    return table(spark, sf_dir, "events").where("event_type = 'error' and ts >= timestamp_ntz'2024-01-10' and ts < timestamp_ntz'2024-01-11'").select("user_id").distinct()


@r.query("SELECT user_id, count(*) FILTER (event_type = 'click') AS up, count(*) FILTER (event_type = 'error') AS down FROM events WHERE event_type IN ('click', 'error') GROUP BY user_id")
def vote_tallies(spark, sf_dir):
    e = F.col("event_type")
    return table(spark, sf_dir, "events").where(e.isin("click", "error")).groupBy("user_id").agg(F.count_if(e == "click").alias("up"), F.count_if(e == "error").alias("down"))


@r.query("""WITH h AS (SELECT doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS k, length(text) AS n FROM documents) SELECT count(*) AS total, count(*) FILTER (k > 1) AS exact, count(*) FILTER (k = 1 AND n < 100) AS short, round(count(*) FILTER (k > 1 OR n < 100) / count(*), 6) AS filter_rate FROM h""")
def dedup_counters(spark, sf_dir):
    """How many documents each stage of a dedup filters, and the rate of all."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"), F.length("text").alias("n"))
    first = d.groupBy("h").agg(F.min("doc_id").alias("first"))
    k = d.join(first, "h").select(F.col("doc_id") != F.col("first"), "n").toDF("copy", "n")
    return k.agg(F.count("*").alias("total"), F.count_if("copy").alias("exact"), F.count_if(~F.col("copy") & (F.col("n") < 100)).alias("short"), F.round(F.count_if(F.col("copy") | (F.col("n") < 100)) / F.count("*"), 6).alias("filter_rate"))


@r.query("WITH s AS (SELECT o_custkey, o_orderkey, count(DISTINCT l_shipdate::DATE) AS k FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2) SELECT o_custkey, least(count(*) FILTER (k >= 2) * 0.05, 0.1)::DOUBLE AS bonus FROM s GROUP BY o_custkey")
def section_coverage(spark, sf_dir):
    """A bonus for documents that a result hits in two sections or more."""
    o, li = _t(spark, sf_dir, "orders", "lineitem")
    each = li.select(F.col("l_orderkey").alias("o_orderkey"), F.to_date("l_shipdate").alias("s")).distinct().groupBy("o_orderkey").agg(F.count("*").alias("k"))
    return o.join(each, "o_orderkey").groupBy("o_custkey").agg(F.least(F.count_if(F.col("k") >= 2) * 0.05, F.lit(0.1)).alias("bonus"))


@r.query("SELECT 'Person' AS label, count(*) AS n FROM customer UNION ALL SELECT 'Document', count(*) FROM orders UNION ALL SELECT 'Topic', count(*) FROM part UNION ALL SELECT 'AUTHORED', count(*) FROM orders UNION ALL SELECT 'MENTIONS', count(*) FROM lineitem")
def graph_stats(spark, sf_dir):
    names = {"Person": "customer", "Document": "orders", "Topic": "part", "AUTHORED": "orders", "MENTIONS": "lineitem"}
    one = [table(spark, sf_dir, x).select(F.lit(k).alias("label")) for k, x in names.items()]
    out = one[0]
    for x in one[1:]:
        out = out.unionByName(x)
    return out.groupBy("label").agg(F.count("*").alias("n"))


@r.query("SELECT lower(trim(split_part(p_name, ' ', 1))) AS query, count(*) AS n FROM part JOIN lineitem ON l_partkey = p_partkey WHERE length(trim(split_part(p_name, ' ', 1))) >= 2 GROUP BY 1 ORDER BY n DESC, query LIMIT 10")
def popular_queries(spark, sf_dir):
    p, li = _t(spark, sf_dir, "part", "lineitem")
    n = li.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    q = F.lower(F.trim(F.split_part("p_name", F.lit(" "), F.lit(1))))
    return p.join(n, "p_partkey").select(q.alias("query"), "n").where(F.length("query") >= 2).groupBy("query").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "query").limit(10)


@r.query("SELECT (SELECT count(*) FROM customer WHERE c_acctbal > 0) AS bases, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS pending, (SELECT count(*) FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR) AS searches, (SELECT round(sum(c_acctbal), 2) FROM customer WHERE c_acctbal > 0) AS documents")
def dashboard(spark, sf_dir):
    """One row of counters; each is one aggregate of its table."""
    c, o, e = _t(spark, sf_dir, "customer", "orders", "events")
    day = e.select("ts").join(e.agg(F.max("ts").alias("top")), F.lit(True)).where(F.col("ts") >= F.col("top") - F.expr("interval 24 hours"))  # one row
    parts = [c.where("c_acctbal > 0").agg(F.count("*").alias("bases"), F.round(F.sum("c_acctbal"), 2).alias("documents")), o.where("o_orderstatus = 'P'").agg(F.count("*").alias("pending")), day.agg(F.count("*").alias("searches"))]
    return parts[0].crossJoin(parts[1]).crossJoin(parts[2])  # one row each


@r.query("SELECT n_name, count(*) AS bases, round(sum(c_acctbal), 2) AS total, max(c_acctbal) AS most FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name")
def base_aggregates(spark, sf_dir):
    c, n = _t(spark, sf_dir, "customer", "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).groupBy("n_name").agg(F.count("*").alias("bases"), F.round(F.sum("c_acctbal"), 2).alias("total"), F.max("c_acctbal").alias("most"))


@r.query("SELECT o_orderstatus AS status, count(*) AS runs, sum(n)::BIGINT AS chunks, count(*) FILTER (n IS NULL) AS empty_runs, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1")
def ingestion_stats(spark, sf_dir):
    o, li = _t(spark, sf_dir, "orders", "lineitem")
    n = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return o.join(n, "o_orderkey", "left").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("runs"), F.sum("n").alias("chunks"), F.count_if(F.col("n").isNull()).alias("empty_runs"), F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"))


@r.query("SELECT role, count(*) AS answers, round(count(*) FILTER (contains(text, '.')) / count(*), 6) AS with_sources, round(avg(length(text)), 4) AS avg_length FROM conversations GROUP BY role")
def transparency_stats(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("answers"), F.round(F.count_if(F.contains("text", F.lit("."))) / F.count("*"), 6).alias("with_sources"), F.round(F.avg(F.length("text")), 4).alias("avg_length"))


@r.query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 20 OFFSET 5")
def verification_queue(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_orderkey", "o_orderdate").orderBy("o_orderdate", "o_orderkey").offset(5).limit(20)


@r.query("SELECT o_custkey, count(*) AS documents, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey ORDER BY documents DESC, total DESC, o_custkey LIMIT 20")
def contributors(spark, sf_dir):
    by = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("documents"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return by.orderBy(F.desc("documents"), F.desc("total"), "o_custkey").limit(20)


@r.query("SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate FROM lineitem ORDER BY l_shipdate DESC, l_orderkey, l_linenumber, l_partkey LIMIT 500")
def recent_entities(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate").orderBy(F.desc("l_shipdate"), "l_orderkey", "l_linenumber", "l_partkey").limit(500)


@r.query("SELECT doc_id FROM documents ORDER BY sha256('seed:' || doc_id), doc_id LIMIT 50")
def bootstrap_sample(spark, sf_dir):
    """A sample for a schema that is the same each time: the least by a hash of the id."""
    return table(spark, sf_dir, "documents").select("doc_id").orderBy(F.sha2(F.concat(F.lit("seed:"), "doc_id"), 256), "doc_id").limit(50)


# Sweeps by time


@r.query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'draft' WHEN 'P' THEN 'published' ELSE 'deprecated' END AS state FROM orders WHERE o_orderstatus = 'F' AND o_orderdate + INTERVAL 90 DAY <= TIMESTAMP '1998-01-01'")
def auto_archive(spark, sf_dir):
    """Deprecated documents whose grace of 90 days is over."""
    o = table(spark, sf_dir, "orders").where((F.col("o_orderstatus") == "F") & (F.col("o_orderdate") + F.expr("interval 90 days") <= F.lit("1998-01-01").cast("timestamp_ntz")))
    return o.select("o_orderkey", F.lit("deprecated").alias("state"))


@r.query("SELECT c_custkey, datediff('day', max(o_orderdate)::DATE, DATE '2000-01-01') AS days FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey HAVING datediff('day', max(o_orderdate)::DATE, DATE '2000-01-01') >= 180")
def stale_documents(spark, sf_dir):
    c, o = _t(spark, sf_dir, "customer", "orders")
    last = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last"))
    return c.join(last, "c_custkey").select("c_custkey", F.datediff(F.lit("2000-01-01").cast("date"), F.to_date("last")).alias("days")).where("days >= 180")


@r.query("SELECT user_id, count(*) AS processed, count(*) FILTER (event_type <> 'error') AS succeeded, count(*) FILTER (event_type = 'error') AS failed, arg_max(event_id, (ts, event_id)) FILTER (event_type = 'error') AS last_error FROM events GROUP BY user_id")
def progress_counters(spark, sf_dir):
    bad = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("processed"), F.count_if(~bad).alias("succeeded"), F.count_if(bad).alias("failed"), F.max(F.when(bad, F.struct("ts", "event_id")))["event_id"].alias("last_error"))


@r.query("SELECT user_id, last, CASE WHEN age > 172800 THEN 'sweep' ELSE 'stuck' END AS action FROM (SELECT user_id, max(ts) AS last, epoch(TIMESTAMP '2024-01-31 00:00:00') - floor(epoch(max(ts))) AS age FROM events WHERE event_type = 'view' GROUP BY user_id) WHERE age > 21600")
def stuck_jobs(spark, sf_dir):
    """Jobs whose last sign of life is older than a threshold, and those to be given up."""
    last = table(spark, sf_dir, "events").where("event_type = 'view'").groupBy("user_id").agg(F.max("ts").alias("last"))
    age = F.unix_seconds(F.lit("2024-01-31").cast("timestamp")) - F.unix_seconds(F.col("last").cast("timestamp"))
    return last.where(age > 21600).select("user_id", "last", F.when(age > 172800, "sweep").otherwise("stuck").alias("action"))


_COS = "list_inner_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]) / sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]) * list_inner_product(d.embedding::DOUBLE[], d.embedding::DOUBLE[]))"


@r.query(f"WITH s AS (SELECT q.vec_id AS query, d.vec_id AS entry, q.label, round({_COS}, 9) AS score FROM embeddings q JOIN embeddings d ON d.label = q.label AND d.vec_id % 20 <> 0 WHERE q.vec_id % 20 = 0) SELECT query, entry, round(score, 5) AS score FROM s WHERE score >= 0.3 QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, entry) = 1")
def cached_answers(spark, sf_dir):
    """The most alike cached entry of each stated query in the same base (label; a handful), if it is alike enough."""
    e = table(spark, sf_dir, "embeddings")
    plain = e.select("vec_id", "label", F.col("embedding").alias("vec"))
    q = plain.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), "label", "vec")
    found = None
    for label in [x["label"] for x in q.select("label").distinct().orderBy("label").collect()]:  # one for each base
        one = v.dense_top_k(q.where(F.col("label") == label).select("query", "vec"), plain.where((F.col("label") == label) & (F.col("vec_id") % 20 != 0)).select(F.col("vec_id").alias("id"), "vec"), 1)
        found = one if found is None else found.unionByName(one)
    return found.where("score >= 0.3").select("query", F.col("id").alias("entry"), F.round("score", 5).alias("score"))


@r.query("""WITH q AS (SELECT event_id, user_id % 50 AS key FROM events), l1 AS (SELECT DISTINCT o_custkey AS key FROM orders WHERE o_orderstatus = 'P'), l2 AS (SELECT c_custkey AS key FROM customer WHERE c_acctbal > 5000) SELECT event_id, CASE WHEN l1.key IS NOT NULL THEN 'l1' WHEN l2.key IS NOT NULL THEN 'l2' ELSE 'miss' END AS layer FROM q LEFT JOIN l1 USING (key) LEFT JOIN l2 USING (key)""")
def layered_lookup(spark, sf_dir):
    """The first layer that has an entry for a request."""
    e, o, c = _t(spark, sf_dir, "events", "orders", "customer")
    l1 = o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("key")).distinct().withColumn("l1", F.lit("l1"))
    l2 = c.where("c_acctbal > 5000").select(F.col("c_custkey").alias("key"), F.lit("l2").alias("l2"))
    return e.select("event_id", (F.col("user_id") % 50).alias("key")).join(l1, "key", "left").join(l2, "key", "left").select("event_id", F.coalesce("l1", "l2", F.lit("miss")).alias("layer"))


@r.query("""WITH b AS (SELECT o_custkey, o_orderkey, o_totalprice AS score, o_orderdate FROM orders), f AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, o_orderkey) AS k FROM b), p AS (SELECT o_custkey, o_orderkey, score, 'pool' AS found FROM f WHERE k <= 2),
x AS (SELECT o_custkey, o_orderkey, 0.7 AS score, 'date' AS found FROM b WHERE month(o_orderdate) = 3 AND o_orderkey NOT IN (SELECT o_orderkey FROM p) QUALIFY row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderkey) = 1) SELECT * FROM p UNION ALL SELECT * FROM x""")
def date_supplements(spark, sf_dir):
    """A pool of results, and one of each group that the date asked for adds."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("score"), "o_orderdate")
    ranked = o.withColumn("_k", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("score"), "o_orderkey")))
    pool = ranked.where("_k <= 2").select("o_custkey", "o_orderkey", "score", F.lit("pool").alias("found"))
    dated = ranked.where((F.month("o_orderdate") == 3) & (F.col("_k") > 2))
    one = dated.withColumn("_n", F.row_number().over(Window.partitionBy("o_custkey", F.year("o_orderdate")).orderBy("o_orderkey"))).where("_n = 1")
    return pool.unionByName(one.select("o_custkey", "o_orderkey", F.lit(0.7).alias("score"), F.lit("date").alias("found")))


@r.query("WITH i AS (SELECT DISTINCT 'Brand#' || (11 + c_custkey % 5) AS ident FROM customer), h AS (SELECT ident, p_size AS kb, p_partkey FROM i JOIN part ON contains(p_brand, ident)) SELECT ident, kb, p_partkey FROM h QUALIFY row_number() OVER (PARTITION BY ident, kb ORDER BY p_partkey) <= 3")
def identifier_hits(spark, sf_dir):
    """Up to three chunks of each base that hold an identifier. Identifiers of a request are few."""
    c, p = _t(spark, sf_dir, "customer", "part")
    ids = c.select(F.concat(F.lit("Brand#"), 11 + F.col("c_custkey") % 5).alias("ident")).distinct()
    hits = p.join(F.broadcast(ids), F.contains(p.p_brand, F.col("ident"))).select("ident", F.col("p_size").alias("kb"), "p_partkey")
    return hits.withColumn("_k", F.row_number().over(Window.partitionBy("ident", "kb").orderBy("p_partkey"))).where("_k <= 3").drop("_k")


@r.query("WITH f AS (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000 GROUP BY 1) SELECT f.c_custkey, o_orderkey, 'search' AS found FROM f JOIN orders ON o_custkey = f.c_custkey WHERE o_totalprice > 300000 UNION ALL SELECT f.c_custkey, o_orderkey, 'keyword' FROM f JOIN orders ON o_custkey = f.c_custkey WHERE n = 0 AND o_orderpriority = '5-LOW'")
def keyword_fallback(spark, sf_dir):
    """What a search finds; for those for which it finds nothing, what keywords find."""
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    found = o.where("o_totalprice > 300000").select("c_custkey", "o_orderkey", F.lit("search").alias("found"))
    other = o.where("o_orderpriority = '5-LOW'").join(found.select("c_custkey").distinct(), "c_custkey", "left_anti").select("c_custkey", "o_orderkey", F.lit("keyword").alias("found"))
    return found.unionByName(other)
