"""Usage, fleet and evaluation analytics over event tables; streaks, sessions, rate limits and time-outs in batch form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counts_by(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def failure_streak(runs: DataFrame, key: str, order: list[str], failed: Column) -> DataFrame:
    """Failures of each key since its last other run, newest first: counted after the latest success, so that a key of
    many runs is summed up, not sorted in one place."""
    at = F.struct(*order)
    last = runs.groupBy(key).agg(F.max(F.when(~failed, at)).alias("_ok"))
    later = runs.join(last, key).where(F.col("_ok").isNull() | (at > F.col("_ok")))
    return last.select(key).join(later.groupBy(key).agg(F.count("*").alias("streak")), key, "left").select(key, F.coalesce("streak", F.lit(0)).alias("streak"))


def score_stats(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Mean, least, most and exact percentiles (linear between neighbours)."""
    p = lambda q: F.round(F.percentile(value, F.lit(q)), 4)
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(value), 4).alias("mean"), p(0.5).alias("p50"), p(0.9).alias("p90"), p(0.95).alias("p95"), F.min(value).alias("least"), F.max(value).alias("most"))


def histogram(rows: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    """How many values are at or below each bound."""
    row = rows.agg(*(F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)))
    pairs = ", ".join(f"{b}D, b{i}" for i, b in enumerate(bounds))
    return row.selectExpr(f"stack({len(bounds)}, {pairs}) AS (bound, n)")


def sessions(events: DataFrame, key: str, ts: str, gap_seconds: int) -> DataFrame:
    """Runs of a key's events with no larger gap."""
    w = F.session_window(ts, f"{gap_seconds} seconds")
    out = events.groupBy(key, w.alias("w")).agg(F.count("*").alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last"))
    return out.select(key, "first", "last", "n")


def first_in_window(rows: DataFrame, key: list[str], ts: str, order: str, seconds: int) -> DataFrame:
    """Rows that an idempotency window lets through: those with no row let through of the same key in the seconds before."""
    passed = allowed_by_rate(rows.withColumn("_key", F.xxhash64(*key)), "_key", ts, order, 1, seconds, at_end=False).where("allowed")
    return rows.join(passed.select(order), order, "left_semi")


def latest_state(beats: DataFrame, key: str, ts: str, as_of: str, timeout_seconds: int) -> DataFrame:
    """Each key's last beat, and whether it is still online at a time."""
    last = beats.groupBy(key).agg(F.max(ts).alias("last_beat"), F.count("*").alias("beats"))
    age = F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds(F.col("last_beat").cast("timestamp"))
    return last.withColumn("status", F.when(age > timeout_seconds, "offline").otherwise("online"))


def retained(rows: DataFrame, ts: str, as_of: str, days: int) -> DataFrame:
    return rows.where(F.col(ts) >= F.lit(as_of).cast("timestamp_ntz") - F.make_interval(days=F.lit(days)))


def allowed_by_rate(requests: DataFrame, key: str, ts: str, order: str, limit: int, seconds: int, at_end: bool = True) -> DataFrame:
    """Which requests of a key a sliding window of `limit` accepted ones in the seconds before lets pass. Acceptance depends
    on the acceptances before, so that a key's times are walked through in order, in bounded memory (the last `limit`).
    at_end: whether an acceptance just so many seconds ago no longer counts."""
    from collections import deque

    import pyarrow as pa

    columns = [key, ts, order]

    def walk(batches):
        now, passed = object(), deque()
        for b in batches:
            ok = []
            for k, at in zip(b.column(0).to_pylist(), b.column(1).cast(pa.int64()).to_pylist(), strict=True):
                if k != now:
                    now, passed = k, deque()
                while passed and passed[0] < at - seconds * 1_000_000 + at_end:
                    passed.popleft()
                ok.append(len(passed) < limit)
                if ok[-1]:
                    passed.append(at)
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array(ok)], [order, "allowed"])

    kind = requests.schema[order].dataType.simpleString()
    dealt = requests.select(columns).repartition(key).sortWithinPartitions(key, ts, order)
    return dealt.mapInArrow(walk, f"{order} {kind}, allowed boolean")
