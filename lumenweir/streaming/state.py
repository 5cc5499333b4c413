"""Time-driven operators over streams, by event time with a watermark; the batch forms are in operators.analytics."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(events: DataFrame, ts: str, by: list[str], size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of a tumbling window; rows later than the watermark are left out."""
    w = F.window(ts, size)
    return events.withWatermark(ts, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def idempotent(requests: DataFrame, key: list[str], ts: str, window: str = "60 seconds") -> DataFrame:
    """The first request of a key within the window."""
    return requests.withWatermark(ts, window).dropDuplicatesWithinWatermark(key)


def distinct_content(docs: DataFrame, kb: str, content_hash: str) -> DataFrame:
    """The first document of each hash of a knowledge base, for ever: the state keeps every hash."""
    return docs.dropDuplicates([kb, content_hash])


def heartbeat_states(beats: DataFrame, key: str, ts: str, timeout: str = "10 minutes") -> DataFrame:
    """(key, last_beat, status): online with each beat, offline once the watermark is a time-out past the last one."""
    kind = beats.schema[key].dataType.simpleString()
    micros = pd.Timedelta(timeout)

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({key: [keys[0]], "last_beat": [pd.Timestamp(last, unit="us")], "status": ["offline"]})
            return
        last = max(int(f[ts].max().value // 1000) for f in frames)
        last = max(last, state.get[0]) if state.exists else last
        state.update((last,))
        state.setTimeoutTimestamp(last // 1000 + int(micros.total_seconds() * 1000))
        yield pd.DataFrame({key: [keys[0]], "last_beat": [pd.Timestamp(last, unit="us")], "status": ["online"]})

    timed = beats.withWatermark(ts, "0 seconds").groupBy(key)
    return timed.applyInPandasWithState(step, f"{key} {kind}, last_beat timestamp, status string", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def failure_alerts(least: int, sink: list | None = None):
    """For foreachBatch: keys whose newest runs failed `least` times in a row, by operators.analytics.failure_streak."""
    from ..operators.analytics import failure_streak

    def each(batch: DataFrame, epoch: int) -> None:
        found = failure_streak(batch, "kb_id", ["completed_at"], F.col("status") != "success").where(F.col("streak") >= least)
        if sink is not None:
            sink += [(epoch, r["kb_id"], r["streak"]) for r in found.collect()]  # keys with an alert
        else:
            found.write.mode("append").format("noop").save()

    return each
