"""Keyed state in streams by transformWithState: a sliding-window rate limiter, heartbeats, lifecycles.

Each is a processor over a key's rows with list or value state in the state store, and event-time timers that clear or change
state when nothing comes; results are those of the batch forms in operators.analytics and operators.lifecycle, if rows come
in order of their event time, but for what is later than the watermark, which Spark drops. Within a batch, a key's rows are
worked through in order of time and id. A key's rows are one task by nature: the order between them decides. The state
survives a restart from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Streams that are started from now on keep their state in RocksDB, which these processors need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _in_order(frames: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(by, kind="stable")


def _micros(times: pd.Series) -> list[int]:
    return times.astype("datetime64[us]").astype("int64").tolist()


class _Limiter(StatefulProcessor):
    """List state: when the accepted requests of the window were. A timer clears it when the window has passed."""

    def __init__(self, key: str, ts: str, order: str, most: int, seconds: int) -> None:
        self.key, self.ts, self.order, self.most, self.window = key, ts, order, most, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getListState("held", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [r[0] for r in self.held.get()] if self.held.exists() else []
        f, allowed, waits = _in_order(rows, [self.ts, self.order]), [], []
        for at in _micros(f[self.ts]):
            held = [x for x in held if x > at - self.window]
            allowed.append(len(held) < self.most)
            waits.append(0 if allowed[-1] else max((held[0] - at + self.window) // 1_000_000 + 1, 1))
            if allowed[-1]:
                held.append(at)
        self.held.put([(x,) for x in held])
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t if isinstance(t, int) else t[0])
        self.handle.registerTimer((held[-1] + self.window) // 1000 + 1)
        yield pd.DataFrame({self.key: [key[0]] * len(f), self.order: f[self.order], "allowed": allowed, "retry_after": waits})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def rate_limited(requests: DataFrame, key: str, ts: str, order: str, most: int = 100, seconds: int = 60, late: str = "1 minute") -> DataFrame:
    """(key, order, allowed, retry_after) of each request: at most so many are accepted in any window; a refused one is told after
    how many whole seconds the oldest of the window is out of it."""
    kinds = {f.name: f.dataType.simpleString() for f in requests.schema}
    shape = f"{key} {kinds[key]}, {order} {kinds[order]}, allowed boolean, retry_after long"
    timed = requests.withWatermark(ts, late).groupBy(key)
    return timed.transformWithStateInPandas(_Limiter(key, ts, order, most, seconds), shape, "Append", "EventTime")


class _Heartbeat(StatefulProcessor):
    """Value state: the newest beat. Its timer reports the key as offline, unless a newer beat has moved it."""

    def __init__(self, key: str, ts: str, seconds: int) -> None:
        self.key, self.ts, self.wait = key, ts, seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "at long")

    def _row(self, key, last: int, status: str) -> pd.DataFrame:
        return pd.DataFrame({self.key: [key[0]], "last_beat": [pd.Timestamp(last, unit="us")], "status": [status]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest = max(max(_micros(f[self.ts])) for f in rows)
        before = self.last.get()[0] if self.last.exists() else None
        if before is None or newest > before:
            if before is not None:
                self.handle.deleteTimer(before // 1000 + self.wait)
            self.last.update((newest,))
            self.handle.registerTimer(newest // 1000 + self.wait)
            yield self._row(key, newest, "online")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        (last,) = self.last.get()
        self.last.clear()
        yield self._row(key, last, "offline")

    def close(self) -> None:
        pass


def heartbeats(beats: DataFrame, key: str, ts: str, seconds: int = 600, late: str = "1 minute") -> DataFrame:
    """(key, last_beat, status): online with each newer beat, offline when the watermark is so many seconds past the last."""
    kind = beats.schema[key].dataType.simpleString()
    timed = beats.withWatermark(ts, late).groupBy(key)
    return timed.transformWithStateInPandas(_Heartbeat(key, ts, seconds), f"{key} {kind}, last_beat timestamp, status string", "Append", "EventTime")


class _Lifecycle(StatefulProcessor):
    """Value state: the status. A transition that isn't allowed, or starts elsewhere, leaves it as it is."""

    def __init__(self, key: str, ts: str, order: str) -> None:
        self.key, self.ts, self.order = key, ts, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.status = handle.getValueState("status", "status string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        from ..operators.lifecycle import FIRST, replayed

        f = _in_order(rows, [self.ts, self.order])
        before = self.status.get()[0] if self.status.exists() else FIRST
        steps = replayed(before, zip(f["from_state"], f["to_state"], strict=True))
        self.status.update((steps[-1][1],))
        yield pd.DataFrame({self.key: [key[0]] * len(f), self.order: f[self.order], "accepted": [s[0] for s in steps], "status": [s[1] for s in steps]})

    def close(self) -> None:
        pass


def lifecycles(events: DataFrame, key: str, ts: str, order: str) -> DataFrame:
    """(key, order, accepted, status) of each asked transition (from_state, to_state): as operators.lifecycle.replay."""
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    shape = f"{key} {kinds[key]}, {order} {kinds[order]}, accepted boolean, status string"
    return events.groupBy(key).transformWithStateInPandas(_Lifecycle(key, ts, order), shape, "Append", "None")
