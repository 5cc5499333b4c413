"""Streams with keyed state, collected log files and the transactional sink: restarts, failures and replays."""

import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from lumenweir.operators import analytics, lifecycle
from lumenweir.sources import points
from lumenweir.streaming import collect, keyed

EVENTS = "id long, k string, ts timestamp, from_state string, to_state string"


@pytest.fixture(scope="module")
def events():
    rng, at, rows = random.Random(6), dt.datetime(2024, 1, 1), []
    for i in range(400):
        at += dt.timedelta(seconds=rng.choice((0, 1, 5, 20)))
        rows.append((i, rng.choice("aab") + str(rng.randrange(3)), at, *rng.choices(["draft", "published", "archived", "under_review", "deleted"], [4, 5, 3, 3, 0.2], k=2)))
    return rows


def run_in_parts(spark, rows, path, made):
    """The rows of a stream that is stopped and started again from its checkpoint, with new files each time."""
    keyed.use_state_store(spark)
    for i in range(4):
        part = spark.createDataFrame(rows[i * 100 : (i + 1) * 100], EVENTS)
        part.coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
        made(stream).writeStream.format("parquet").option("checkpointLocation", f"{path}/state").option("path", f"{path}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out")


def test_rate_limit_restarts(spark, events, tmp_path):
    got = run_in_parts(spark, events, str(tmp_path), lambda s: keyed.rate_limited(s, "k", "ts", "id", 3, 60))
    batch = analytics.allowed_by_rate(spark.createDataFrame(events, EVENTS), "k", "ts", "id", 3, 60)
    want = {r["id"]: r["allowed"] for r in batch.collect()}
    found = {r["id"]: r for r in got.collect()}
    assert {i: r["allowed"] for i, r in found.items()} == want and 0 < sum(want.values()) < len(want)
    assert all((r["retry_after"] == 0) == r["allowed"] and r["retry_after"] <= 61 for r in found.values())


def test_heartbeats(spark, events, tmp_path):
    """Each newer beat is online; a key that is silent is offline once the watermark is past its time-out, and only once."""
    beats = [e for e in events if not (e[1] == "b0" and e[0] > 150)]
    got = run_in_parts(spark, (beats + [(1000, "z", events[-1][2] + dt.timedelta(hours=1), None, None)])[-400:], str(tmp_path), lambda s: keyed.heartbeats(s, "k", "ts", 600)).collect()
    last = max(e[2] for e in beats if e[1] == "b0")
    assert [r["last_beat"] for r in got if r["k"] == "b0" and r["status"] == "offline"].count(last) == 1
    online = {}
    for r in got:
        if r["status"] == "online":
            online[r["k"]] = max(online.get(r["k"], r["last_beat"]), r["last_beat"])
    assert all(online[k] == max(e[2] for e in beats if e[1] == k) for k in online if k != "z")


def test_lifecycle_restarts(spark, events, tmp_path):
    got = run_in_parts(spark, events, str(tmp_path), lambda s: keyed.lifecycles(s, "k", "ts", "id"))
    want = lifecycle.replay(spark.createDataFrame(events, EVENTS), "k", ["ts", "id"])
    assert {tuple(r) for r in got.select("id", "accepted", "status").collect()} == {tuple(r) for r in want.select("id", "accepted", "status").collect()}
    assert 0 < want.where("accepted").count() < len(events)


def test_lifecycle_rules(spark):
    assert lifecycle.replayed("draft", [("draft", "archived"), ("draft", "published"), ("draft", "deleted"), ("published", "archived"), (None, "published"), ("archived", None), ("archived", "deleted"), ("deleted", "draft")]) == [
        (False, "draft"), (True, "published"), (False, "published"), (True, "archived"), (False, "archived"), (False, "archived"), (True, "deleted"), (False, "deleted"),
    ]
    at = dt.datetime(2024, 1, 1)
    row = lifecycle.scheduled(spark.createDataFrame([("published", at), ("deleted", at)], "status string, at timestamp"), "at").orderBy("status").collect()
    assert row[0]["delete_at"] == at + dt.timedelta(days=30) and row[0]["archive_at"] is None and row[1]["archive_at"] == at + dt.timedelta(days=90)
    assert lifecycle.replay(spark.createDataFrame([], EVENTS), "k", ["ts"]).count() == 0


# Collected logs


def write_log(path, name, entries):
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/{name}.jsonl", "w") as f:
        f.write("\n".join(e if isinstance(e, str) else json.dumps(e) for e in entries))


def test_collect_exactly_once(spark, tmp_path):
    """A run that fails after it has written its part is run again: nothing is lost or doubled; later files update earlier rows."""
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    write_log(source, "a", [{"id": "1", "store_id": "s", "query": "q", "ts": "2024-01-01T00:00:00"}, {"query": "no id"}, {"query": "no id"}, "{broken", "", "[1]"])
    write_log(source, "b", [{"id": "2", "success": False, "ts": "bad"}])
    failed = []

    def fail_once(number):
        if not failed:
            failed.append(number)
            raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        collect.collect(spark, source, target, state, "edge", 1, fail_once).awaitTermination()
    for _ in range(2):
        collect.collect(spark, source, target, state, "edge", 1, fail_once).awaitTermination()
    assert failed == [0]
    rows = {r["id"]: r for r in collect.collected(spark, target).collect()}
    assert len(rows) == 3 and rows["1"]["store_id"] == "s" and rows["1"]["success"] and not rows["2"]["success"]
    assert rows["2"]["store_id"] == "unknown" and rows["2"]["edge_timestamp"] is None and rows["2"]["query"] == ""
    write_log(source, "c", [{"id": "1", "answer": "older", "ts": "2023-01-01T00:00:00"}, {"id": "2", "answer": "new", "ts": "2024-01-01T00:00:00"}])
    collect.collect(spark, source, target, state, "edge").awaitTermination()
    rows = {r["id"]: r for r in collect.collected(spark, target).collect()}
    assert len(rows) == 3 and rows["1"]["answer"] == "" and rows["2"]["answer"] == "new"
    assert spark.read.parquet(target).where("broken").count() == 2


# The sink


def test_sink_commits_and_aborts(spark, tmp_path):
    path = str(tmp_path / "points")
    good = spark.range(200).select("id", F.when(F.col("id") % 10 > 0, F.array(F.col("id").cast("double"))).alias("vector"), F.concat(F.lit("n"), "id").alias("name"))
    points.write(good.repartition(3), path)
    got = points.read(spark, path)
    assert got.count() == 180 and got.select("id").distinct().count() == 180 and got.agg(F.max("in_request")).first()[0] <= 64
    assert got.where("payload['name'] <> concat('n', id)").count() == 0
    fails = good.select("id", F.when(F.col("id") == 150, F.raise_error(F.lit("bad row"))).otherwise(F.col("vector")).alias("vector"), "name")
    with pytest.raises(Exception, match="bad row"):
        points.write(fails.repartitionByRange(4, "id"), path)
    assert points.read(spark, path).count() == 180
    assert len([d for d in os.listdir(path) if os.path.isdir(f"{path}/{d}")]) == 1  # the failed job's folder is gone
    points.write(good.where("id < 5").coalesce(1), path)
    assert points.read(spark, path).count() == 184
    points.write(good.where("id < 100").coalesce(1), path, batch=7, mode="overwrite")
    again = points.read(spark, path)
    assert again.count() == 90 and sorted(r["in_request"] for r in again.select("request", "in_request").distinct().collect()) == [6, *[7] * 12]
    points.write(good.where("id < 0"), str(tmp_path / "none"))
    assert points.read(spark, str(tmp_path / "none")).count() == 0
