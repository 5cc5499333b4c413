"""The lifecycle of documents as a state machine that is replayed from their events."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Where a document begins, and which states may follow each.
FIRST = "draft"
ALLOWED = {
    "draft": ("published", "deleted"),
    "published": ("archived", "under_review", "deleted"),
    "under_review": ("published", "archived", "deleted"),
    "archived": ("published", "deleted"),
    "deleted": (),
}
ARCHIVE_DAYS, GRACE_DAYS = 90, 30


def replayed(status: str, asked: Iterable[tuple[str | None, str | None]]) -> list[tuple[bool, str]]:
    """(accepted, status after it) of each asked transition (from, to) in order."""
    out = []
    for source, target in asked:
        accepted = source == status and target in ALLOWED.get(status, ())
        status = target if accepted else status
        out.append((accepted, status))
    return out


def replay(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The events (key, from_state, to_state) with accepted and status: each key's in order, from FIRST on. A transition is accepted
    if it starts from the present state and the table allows it; another leaves the state as it is. Events are sorted by key
    within partitions and walked through as they come, so that no key's events are held at once; nulls are no states."""
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, status = None, FIRST
        for f in frames:
            steps = []
            for k, source, target in zip(f[key], f["from_state"], f["to_state"], strict=True):
                if k != at:
                    at, status = k, FIRST
                steps += replayed(status, [(source, target)])
                status = steps[-1][1]
            yield f.assign(accepted=[s[0] for s in steps], status=[s[1] for s in steps])

    dealt = events.repartition(key).sortWithinPartitions(key, *order)
    return dealt.mapInPandas(walk, ", ".join(f"{n} {k}" for n, k in kinds.items()) + ", accepted boolean, status string")


def scheduled(states: DataFrame, at: str) -> DataFrame:
    """With archive_at and delete_at: when a published document is archived by itself, and a deleted one is removed."""
    after = lambda status, days: F.when(F.col("status") == status, F.col(at) + F.make_dt_interval(F.lit(days)))
    return states.withColumns({"archive_at": after("published", ARCHIVE_DAYS), "delete_at": after("deleted", GRACE_DAYS)})
