"""Seeds and events of documents that arrive in any order, compared as they come.

A document's state is a map from days to how many seeds and events name them, beside three sums, so an arriving row changes one entry and
no list is kept or sorted. A document that has been quiet for some time of the watermark gives up its state; it may be told so.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..session import ship

#: The state store that this kind of operator asks for.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Reconcile(StatefulProcessor):
    """Rows (side, value, at) of one document: side a or b, the day that it names, and when it came in ms."""

    def __init__(self, by: str, quiet_ms: int) -> None:
        self.by, self.quiet_ms = by, quiet_ms

    def row(self, key: Any, a: int, b: int, differing: int, closed: bool) -> Row:
        return Row(**{self.by: key[0]}, n_a=a, n_b=b, consistent=differing == 0, closed=closed)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.days = handle.getMapState("days", "value string", "a long, b long")
        self.sums = handle.getValueState("sums", "a long, b long, differing long, latest long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        a, b, differing, latest = self.sums.get() or (0, 0, 0, 0)
        for row in rows:
            day = (row["value"],)
            had = self.days.getValue(day) or (0, 0)
            has = (had[0] + (row["side"] == "a"), had[1] + (row["side"] == "b"))
            self.days.updateValue(day, has)
            a, b, differing, latest = a + has[0] - had[0], b + has[1] - had[1], differing + (has[0] != has[1]) - (had[0] != had[1]), max(latest, row["at"])
        self.sums.update((a, b, differing, latest))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(latest + self.quiet_ms)
        yield self.row(key, a, b, differing, False)

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        a, b, differing, _ = self.sums.get() or (0, 0, 0, 0)
        self.days.clear()
        self.sums.clear()
        yield self.row(key, a, b, differing, True)

    def close(self) -> None:
        pass


def consistency_stream(seeds: DataFrame, events: DataFrame, by: str, value: str, ts: str = "ts", delay: str = "1 day", quiet_seconds: int = 7 * 86400) -> DataFrame:
    """seeds(by, value, ts) and events(by, value, ts) as streams -> (by, n_a, n_b, consistent, closed) of each group that changes, in update mode: the
    last row of a group is what timeline.consistency() says of all its rows so far. Rows behind the watermark by more than ``delay`` are left out. A group
    that the watermark has left behind by ``quiet_seconds`` gives a last row with ``closed`` and its state is dropped; rows that come
    later begin anew. Null values count as a day of their own, null groups as one group. The session needs the state store STORE."""
    ship(seeds.sparkSession)
    side = lambda df, name: df.select(F.col(by), F.lit(name).alias("side"), F.coalesce(F.col(value).cast("string"), F.lit("")).alias("value"), F.col(ts).alias("ts"), F.unix_millis(ts).alias("at"))
    both = side(seeds, "a").unionByName(side(events, "b")).withWatermark("ts", delay)
    schema = f"{by} {dict(seeds.dtypes)[by]}, n_a long, n_b long, consistent boolean, closed boolean"
    return both.groupBy(by).transformWithState(Reconcile(by, quiet_seconds * 1000), schema, "Update", "EventTime")
