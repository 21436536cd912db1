"""Streams: idempotent intake, windowed logs, and timelines that grow as events arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def once(stream: DataFrame, key: str, ts: str, delay: str = "1 day") -> DataFrame:
    """Each key once within the watermark; state is dropped as the watermark passes."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def tumbling(stream: DataFrame, ts: str, by: list[str], size: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Counts and sums for each window, written once the watermark has passed it."""
    return stream.withWatermark(ts, delay).groupBy(F.window(ts, size), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def growing_timelines(stream: DataFrame, scope: str, ts: str = "ts", delay: str = "7 days") -> DataFrame:
    """stream(scope, event_id, ts) -> (scope, n_events, first_ts, last_ts) after each batch. Ids of any type; events that a scope
    has already had within the delay change nothing, and events from before it are too late. A scope's state is its
    counts and the ids of that time."""

    def update(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, first, last, ids, times = state.get if state.exists else (0, None, None, [], [])
        limit = state.getCurrentWatermarkMs()
        known = {i: t for i, t in zip(ids, times) if t >= limit}
        for pdf in batches:
            for event, at in zip(pdf["event_id"].astype(str), pdf[ts]):
                ms = int(at.timestamp() * 1000)
                if event not in known and ms >= limit:
                    known[event] = ms
                    n, first, last = n + 1, min(first or at, at), max(last or at, at)
        state.update((n, first, last, list(known), list(known.values())))
        yield pd.DataFrame([(key[0], n, first, last)], columns=[scope, "n_events", "first_ts", "last_ts"])

    kind = dict(stream.dtypes)[scope]
    kept = "n long, first_ts timestamp, last_ts timestamp, ids array<string>, times array<bigint>"
    return stream.withWatermark(ts, delay).groupBy(scope).applyInPandasWithState(update, f"{scope} {kind}, n_events long, first_ts timestamp, last_ts timestamp", kept, "update", "NoTimeout")
