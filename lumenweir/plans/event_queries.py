"""Queries over events, orders and their tables: usage and fleet analytics, trust, access, time-driven state in batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as s
from ..operators import analytics as a
from ..operators import documents as d
from .registry import Registry, table

r = Registry()
AS_OF = "2024-02-01"


@r.query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(avg(value), 4) AS avg_value, count(*) FILTER (value > 50) AS high FROM events GROUP BY event_type")
def usage_by_type(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.avg("value"), 4).alias("avg_value"), F.count_if(F.col("value") > 50).alias("high"))


@r.query("SELECT json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, k LIMIT 20")
def top_properties(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "k").limit(20)


@r.query("SELECT date_trunc('day', ts)::DATE AS day, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, round(count(*) FILTER (event_type <> 'error') / count(*), 4) AS success_rate, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def daily_success(spark, sf_dir):
    failed = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.count_if(failed).alias("errors"), F.round(F.count_if(~failed) / F.count("*"), 4).alias("success_rate"), F.countDistinct("user_id").alias("users"))


@r.query("WITH l AS (SELECT user_id, max((ts, event_id)) FILTER (event_type <> 'error') AS ok FROM events GROUP BY user_id) SELECT user_id, (SELECT count(*) FROM events e WHERE e.user_id = l.user_id AND (ok IS NULL OR (e.ts, e.event_id) > ok)) AS streak FROM l")
def failure_streaks(spark, sf_dir):
    return a.failure_streak(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"], F.col("event_type") == "error")


@r.query("SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.9), 4) AS p90, round(quantile_cont(value, 0.95), 4) AS p95, min(value) AS least, max(value) AS most FROM events GROUP BY event_type")
def score_distribution(spark, sf_dir):
    return a.score_stats(table(spark, sf_dir, "events"), "value", "event_type")


@r.query("SELECT b::DOUBLE AS bound, (SELECT count(*) FROM events WHERE value <= b) AS n FROM (VALUES (1.0), (5.0), (10.0), (50.0), (100.0), (500.0)) v(b)")
def value_histogram(spark, sf_dir):
    return a.histogram(table(spark, sf_dir, "events"), "value", [1.0, 5.0, 10.0, 50.0, 100.0, 500.0])


@r.query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 3600 SECOND THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), k AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g) SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM k GROUP BY user_id, s")
def user_sessions(spark, sf_dir):
    return a.sessions(table(spark, sf_dir, "events"), "user_id", "ts", 3600)


@r.query("""WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events),
w AS (SELECT *, ts AS held, true AS ok FROM e WHERE k = 1
 UNION ALL SELECT e.*, CASE WHEN e.ts - w.held > INTERVAL 1800 SECOND THEN e.ts ELSE w.held END, e.ts - w.held > INTERVAL 1800 SECOND FROM w JOIN e ON e.user_id = w.user_id AND e.event_type = w.event_type AND e.k = w.k + 1)
SELECT event_id, user_id, event_type FROM w WHERE ok""")
def idempotent_events(spark, sf_dir):
    return a.first_in_window(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts"), ["user_id", "event_type"], "ts", "event_id", 1800).select("event_id", "user_id", "event_type")


@r.query("SELECT user_id, max(ts) AS last_beat, count(*) AS beats, CASE WHEN epoch(TIMESTAMP '2024-01-31 00:00:00')::BIGINT - floor(epoch(max(ts)))::BIGINT > 43200 THEN 'offline' ELSE 'online' END AS status FROM events GROUP BY user_id")
def heartbeat_status(spark, sf_dir):
    return a.latest_state(table(spark, sf_dir, "events"), "user_id", "ts", "2024-01-31 00:00:00", 43200)


@r.query("SELECT status, count(*) AS n FROM (SELECT CASE WHEN epoch(TIMESTAMP '2024-01-31 00:00:00')::BIGINT - floor(epoch(max(ts)))::BIGINT > 43200 THEN 'offline' ELSE 'online' END AS status FROM events GROUP BY user_id) GROUP BY status")
def fleet_status(spark, sf_dir):
    return a.counts_by(heartbeat_status(spark, sf_dir), "status")


@r.query("SELECT event_type, count(*) AS n, min(ts) AS oldest FROM events WHERE ts >= TIMESTAMP '2024-02-01' - INTERVAL 14 DAY GROUP BY event_type")
def retained_events(spark, sf_dir):
    kept = a.retained(table(spark, sf_dir, "events"), "ts", AS_OF, 14)
    return kept.groupBy("event_type").agg(F.count("*").alias("n"), F.min("ts").alias("oldest"))


@r.query("""WITH RECURSIVE e AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
w AS (SELECT *, [ts] AS held, true AS allowed FROM e WHERE k = 1
 UNION ALL SELECT event_id, user_id, ts, k, CASE WHEN len(live) < 3 THEN list_append(live, ts) ELSE live END, len(live) < 3
 FROM (SELECT e.*, list_filter(w.held, lambda x: x > e.ts - INTERVAL 86400 SECOND) AS live FROM w JOIN e ON e.user_id = w.user_id AND e.k = w.k + 1))
SELECT event_id, allowed FROM w""")
def rate_limited(spark, sf_dir):
    return a.allowed_by_rate(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 3, 86400)


_VOTES = "SELECT user_id, count(*) FILTER (event_type = 'purchase') AS up, count(*) FILTER (event_type = 'error') AS reports, count(*) FILTER (event_type = 'signup') AS reviews, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'click') AS clicks, max(ts) AS last FROM events GROUP BY user_id"
_WILSON = "CASE WHEN pos + neg = 0 THEN 0.5 ELSE (pos / (pos + neg) + 3.8416 / (2 * (pos + neg)) - 1.96 * sqrt(((pos / (pos + neg)) * (1 - pos / (pos + neg)) + 3.8416 / (4 * (pos + neg))) / (pos + neg))) / (1 + 3.8416 / (pos + neg)) END".replace("pos", "(up + 5 * reviews)").replace("neg", "(3 * reports)")
_KTS = f"WITH v AS ({_VOTES}), p AS (SELECT user_id, {_WILSON} AS wilson, greatest(0.1, pow(2.0, -greatest((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(last)) / 86400000000, 0) / 60.0)) AS freshness, least(greatest(0.2 * ln(1 + views) / ln(10001) + 0.3 * ln(1 + clicks) / ln(501) + 0.2 * ln(1 + up) / ln(1001), 0.0), 1.0) AS usage FROM v), k AS (SELECT *, round(least(greatest(100 * (0.2 * 0.8 + 0.2 * freshness + 0.25 * wilson + 0.1 * usage + 0.15 + 0.1), 0), 100), 2) AS kts FROM p)"


def _trust(spark, sf_dir):
    kind = lambda k: F.count_if(F.col("event_type") == k)
    v = table(spark, sf_dir, "events").groupBy("user_id").agg(kind("purchase").alias("up"), kind("error").alias("reports"), kind("signup").alias("reviews"), kind("view").alias("views"), kind("click").alias("clicks"), F.max("ts").alias("last"))
    v = v.withColumns({"wilson": s.validation(F.col("up"), F.lit(0), F.col("reviews"), F.col("reports")), "freshness": s.exponential_freshness(s.exact_age(F.col("last"), AS_OF), F.lit(60.0)), "usage": s.usage_score(F.col("views"), F.col("clicks"), F.lit(0.0), F.col("up"))})
    return v.withColumn("kts", s.trust_score(source=F.lit(0.8), freshness=F.col("freshness"), validation=F.col("wilson"), usage=F.col("usage"), hallucination=F.lit(1.0), consistency=F.lit(1.0)))


@r.query(_KTS + " SELECT user_id, round(wilson, 6) AS wilson, round(freshness, 6) AS freshness, round(usage, 6) AS usage, kts, CASE WHEN kts >= 85 THEN 'high' WHEN kts >= 70 THEN 'medium' WHEN kts >= 50 THEN 'low' ELSE 'uncertain' END AS tier FROM k")
def trust_scores(spark, sf_dir):
    t = _trust(spark, sf_dir)
    return t.select("user_id", *(F.round(c, 6).alias(c) for c in ("wilson", "freshness", "usage")), "kts", s.tier(F.col("kts")).alias("tier"))


@r.query(_KTS + " SELECT CASE WHEN kts >= 85 THEN 'high' WHEN kts >= 70 THEN 'medium' WHEN kts >= 50 THEN 'low' ELSE 'uncertain' END AS tier, count(*) AS n, round(avg(kts), 4) AS avg_kts FROM k GROUP BY 1")
def trust_tiers(spark, sf_dir):
    return trust_scores(spark, sf_dir).groupBy("tier").agg(F.count("*").alias("n"), F.round(F.avg("kts"), 4).alias("avg_kts"))


@r.query(_KTS + " SELECT user_id, round(0.7 * (kts / 100) + 0.3 * freshness, 6) AS trend FROM k ORDER BY trend DESC, user_id LIMIT 25")
def trending(spark, sf_dir):
    return _trust(spark, sf_dir).select("user_id", F.round(0.7 * (F.col("kts") / 100) + 0.3 * F.col("freshness"), 6).alias("trend")).orderBy(F.desc("trend"), "user_id").limit(25)


@r.query("SELECT o_orderkey, CASE WHEN a <= 90 THEN 'current' WHEN a <= 365 THEN 'stale' WHEN a <= 730 THEN 'outdated' ELSE 'archived' END AS status, round(0.5 * (1 + cos(3.141592653589793 * least(greatest(a / 2000.0, 0), 1))), 6) AS freshness, CASE WHEN a <= 30 THEN 1.0 WHEN a <= 90 THEN 0.8 WHEN a <= 180 THEN 0.5 ELSE 0.3 END::DOUBLE AS step FROM (SELECT o_orderkey, datediff('day', o_orderdate::DATE, DATE '2001-12-31') AS a FROM orders)")
def freshness_states(spark, sf_dir):
    age = s.age_days(F.col("o_orderdate"), "2001-12-31")
    return table(spark, sf_dir, "orders").select("o_orderkey", s.freshness_status(age).alias("status"), F.round(s.cosine_freshness(age, F.lit(2000.0)), 6).alias("freshness"), s.step_freshness(age).alias("step"))


@r.query("SELECT o_orderkey, o_custkey, o_totalprice, count(*) OVER () AS total FROM orders WHERE o_orderstatus = 'F' AND lower(o_orderpriority) LIKE '%urgent%' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def page_of_orders(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").where((F.col("o_orderstatus") == "F") & F.lower("o_orderpriority").contains("urgent"))
    page = rows.orderBy(F.desc("o_totalprice"), "o_orderkey").select("o_orderkey", "o_custkey", "o_totalprice").offset(40).limit(20)
    return page.crossJoin(rows.agg(F.count("*").alias("total")))  # one row


@r.query("SELECT o_orderstatus, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_orderpriority = '5-LOW') AS low, round(avg(o_totalprice), 3) AS avg_price, min(o_orderdate) AS first FROM orders GROUP BY o_orderstatus")
def evaluation_summary(spark, sf_dir):
    p = F.col("o_orderpriority")
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count_if(p == "1-URGENT").alias("urgent"), F.count_if(p == "5-LOW").alias("low"), F.round(F.avg("o_totalprice"), 3).alias("avg_price"), F.min("o_orderdate").alias("first"))


@r.query("SELECT l_returnflag, l_linestatus, grouping_id(l_returnflag, l_linestatus) AS g, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus))")
def error_statistics(spark, sf_dir):
    by = [F.col("l_returnflag"), F.col("l_linestatus")]
    rows = table(spark, sf_dir, "lineitem").groupingSets([[by[0]], [by[1]]], *by)
    return rows.agg(F.grouping_id().alias("g"), F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@r.query("SELECT c_mktsegment AS kb, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY ('0x' || sha256(c_custkey::VARCHAR)[1:8])::BIGINT, c_custkey) AS k FROM customer) WHERE k <= 100")
def balanced_sample(spark, sf_dir):
    return d.capped_per_group(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey", 100).select(F.col("c_mktsegment").alias("kb"), "c_custkey")


@r.query("SELECT c.c_custkey, c.c_name, n.n_name, r.r_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey WHERE c.c_acctbal > 5000 AND r.r_name IN ('ASIA', 'EUROPE') AND starts_with(c.c_mktsegment, 'B')")
def scoped_access(spark, sf_dir):
    c, n, g = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    ok = c.where((F.col("c_acctbal") > 5000) & F.col("c_mktsegment").startswith("B"))
    return ok.join(n, ok.c_nationkey == n.n_nationkey).join(g.where(F.col("r_name").isin("ASIA", "EUROPE")), F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "c_name", "n_name", "r_name")
