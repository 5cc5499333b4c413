"""Queries for chunking, near duplicates, page parts, access, query traits, sinks and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import queries as q
from ..functions import text as t
from ..operators import access, chunking, near_duplicates
from ..operators import analytics as a
from ..sources import files
from ..streaming import state
from .registry import Registry, table
from .storage import shared_dir, spread

r = Registry()


@r.query()
def document_chunks(spark, sf_dir):
    return chunking.chunks(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), 1200)


@r.query(r"""WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents)
SELECT doc_id, len(s) AS n, round(list_avg(list_transform(s, lambda x: length(x))), 4) AS avg_length, sha256(array_to_string(s, '|')) AS fingerprint FROM s""")
def document_sentences(spark, sf_dir):
    """A text without sentences has no average; a null one has none of the figures."""
    s = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("text").isNotNull(), chunking.sentences(F.col("text"))).alias("s"))
    mean = F.try_divide(F.aggregate("s", F.lit(0).cast("long"), lambda x, y: x + F.length(y)), F.array_size("s"))
    return s.select("doc_id", F.array_size("s").alias("n"), F.round(mean, 4).alias("avg_length"), F.sha2(F.array_join("s", "|"), 256).alias("fingerprint"))


@r.query()
def heading_sections(spark, sf_dir):
    return chunking.heading_sections(table(spark, sf_dir, "documents"))


@r.query()
def minhash_near_duplicates(spark, sf_dir):
    return near_duplicates.near_duplicates(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


@r.query()
def page_parts(spark, sf_dir):
    p = spread(table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", files.html_parts("html").alias("p"))
    return p.select("page_id", "p.text", F.size("p.headings").alias("n_headings"), F.size("p.links").alias("n_links"), F.size("p.tables").alias("n_tables"), F.size("p.code").alias("n_code"))


@r.query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_totalprice BETWEEN 1000 AND 50000 THEN 'allow' WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_custkey % 2 = 0 THEN 'deny' WHEN starts_with(o_orderpriority, '5') OR FALSE THEN 'allow' WHEN regexp_matches(o_orderpriority, '^(?:[34]-)') AND NOT o_orderstatus IN ('P') THEN 'review' ELSE 'deny' END AS effect FROM orders""")
def policy_effects(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("*", F.lit("order").alias("resource"), F.lit("read").alias("action"), (F.col("o_custkey") % 2 == 0).cast("string").alias("even"))
    policies = [
        {"resource": "order", "action": "*", "effect": "allow", "conditions": [("o_orderstatus", "eq", "F"), ("o_totalprice", "between", (1000, 50000))]},
        {"resource": "*", "action": "read", "effect": "deny", "conditions": [("o_orderpriority", "in", ["1-URGENT", "2-HIGH"]), ("even", "eq", "true")]},
        {"resource": "order", "action": "write", "effect": "allow"},
        {"resource": "order", "action": "read", "effect": "allow", "conditions": [("o_orderpriority", "starts_with", "5")]},
        {"resource": "order", "action": "read", "effect": "review", "conditions": [("o_orderpriority", "regex", "[34]-"), ("o_orderstatus", "not_in", ["P"])]},
        {"resource": "*", "action": "*", "effect": "allow", "active": False},
    ]
    return access.evaluated(rows, policies).select("o_orderkey", "effect")


@r.query("""WITH g(role, permission) AS (VALUES ('BUILDING', 'order:read'), ('MACHINERY', 'order:*'), ('HOUSEHOLD', '*:*')), q AS (SELECT o_orderkey AS request, o_custkey AS u, CASE WHEN o_orderkey % 3 = 0 THEN 'write' ELSE 'read' END AS action, o_orderkey % 25 AS scope FROM orders)
SELECT request, EXISTS (SELECT 1 FROM customer c JOIN g ON g.role = c.c_mktsegment WHERE c.c_custkey = q.u AND (c.c_acctbal > 5000 OR c.c_nationkey = q.scope) AND g.permission IN ('*:*', 'order:*', 'order:' || q.action)) AS allowed FROM q""")
def role_permissions(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    requests = o.select(F.col("o_orderkey").alias("request"), F.col("o_custkey").alias("user"), F.lit("order").alias("resource"), F.when(F.col("o_orderkey") % 3 == 0, "write").otherwise("read").alias("action"), (F.col("o_orderkey") % 25).alias("scope"))
    roles = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user"), F.col("c_mktsegment").alias("role"), F.when(F.col("c_acctbal") <= 5000, F.col("c_nationkey").cast("long")).alias("scope"))
    grants = spark.createDataFrame([("BUILDING", "order:read"), ("MACHINERY", "order:*"), ("HOUSEHOLD", "*:*")], "role string, permission string")
    return access.permitted(requests, roles, grants).select("request", "allowed")


@r.query("SELECT item_id, CASE WHEN trim(text) = '' THEN 'unknown' WHEN regexp_matches(trim(text), '(?i)^(?:하이|헬로|hello|hi|hey)\\b') THEN 'chitchat' WHEN regexp_matches(trim(text), '(?i).*vs\\s') THEN 'comparative' ELSE 'factual' END AS type FROM benchmark".replace("\\\\", "\\"))
def query_types(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", q.classified(F.col("text"))["type"].alias("type"))


@r.query(r"SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(trim(text)), '\s+'), lambda w: length(w) >= 2 AND w NOT IN ('the', 'of', 'de', 'der')))), ' ') AS keywords FROM benchmark")
def query_keywords(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.array_sort(q.keywords(F.col("text"), ["the", "of", "de", "der"])), " ").alias("keywords"))


@r.query("SELECT q.conv_id, q.turn, sha256('{\"messages\":[' || to_json({'role': 'user', 'content': q.text})::VARCHAR || ',' || to_json({'role': 'assistant', 'content': a.text})::VARCHAR || ']}') AS line_sha256 FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user' AND a.role = 'assistant'")
def chat_export(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    said = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    pairs = asked.join(said, ["conv_id", "turn"])
    keyed = pairs.select("conv_id", "turn", F.to_json(F.struct(F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content"))).alias("messages"))).alias("value"))
    return keyed.select("conv_id", "turn", F.sha2("value", 256).alias("line_sha256"))


@r.query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING date_trunc('hour', any_value(ts)) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)")
def streamed_counts(spark, sf_dir):
    """The table as a stream to the end: windows that the watermark has closed."""
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))
    at = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    run = state.windowed_counts(events, "ts", ["event_type"]).writeStream.outputMode("append").format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state")
    run.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("start timestamp, event_type string, n long").parquet(f"{at}/out").withColumn("start", F.col("start").cast("timestamp_ntz"))


@r.query("SELECT bucket, count(*) AS n, round(avg(quality), 4) AS quality, round(avg(toxic), 4) AS toxic FROM (SELECT ('0x' || sha256(doc_id::VARCHAR)[1:8])::BIGINT % 100 AS bucket, quality, toxic FROM labels) GROUP BY bucket")
def rollout_buckets(spark, sf_dir):
    b = table(spark, sf_dir, "labels").withColumn("bucket", t.percent_bucket(F.col("doc_id").cast("string")))
    return b.groupBy("bucket").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 4).alias("quality"), F.round(F.avg("toxic"), 4).alias("toxic"))


@r.query("SELECT source, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic, round(count(*) FILTER (quality = 1) / count(*), 4) AS rate, count(*) FILTER (quality = 1) / count(*) >= 0.8 AS gate FROM documents JOIN labels USING (doc_id) GROUP BY source")
def regression_gate(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    good = F.count_if(F.col("quality") == 1)
    return rows.groupBy("source").agg(F.count("*").alias("n"), good.alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.round(good / F.count("*"), 4).alias("rate"), (good / F.count("*") >= 0.8).alias("gate"))


@r.query("SELECT c_nationkey, n FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) WHERE n >= 3")
def facet_counts(spark, sf_dir):
    return a.counts_by(table(spark, sf_dir, "customer"), "c_nationkey").where("n >= 3")
