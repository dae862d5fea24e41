"""What a stream took in, batch by batch: raw rows and sums, event-time bounds, rows that came too late, and state sizes.

The metrics are observed on the rows as they come, before any grouping, and reach a listener with each batch's progress.
``numRowsDroppedByWatermark`` counts partial sums; the rows that were too late are those of weeks that the watermark of their
batch had closed, so they follow from the rows of each week and the watermark.
"""

from __future__ import annotations

import threading
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..functions.columns import EPOCH_SECONDS, event_time, week_of

NAME = "clicks"
WEEK_SECONDS = 604_800


def observed(clicks: DataFrame, first_week: int, last_week: int) -> DataFrame:
    """``clicks`` with metrics: rows, sum of clicks, first and last event time, and rows of each week from first to last."""
    week, time = week_of(F.col("date")), event_time(F.col("date"))
    weeks = [F.count_if(week == k).alias(f"week_{k}") for k in range(first_week, last_week + 1)]
    return clicks.observe(NAME, F.count("*").alias("rows"), F.sum("sum_click").alias("clicks"), F.min(time).alias("first_time"), F.max(time).alias("last_time"), F.count_if((week < first_week) | (week > last_week)).alias("other_weeks"), *weeks)


@dataclass
class Taken:
    """Totals over the batches of a query; nothing grows with their number."""

    batches: int = 0
    rows: int = 0
    clicks: int = 0
    late_rows: int = 0
    dropped_sums: int = 0
    state_max: int = 0
    state_end: int = 0
    state_bytes: int = 0
    first_time: datetime | None = None
    last_time: datetime | None = None
    ended: threading.Event = field(default_factory=threading.Event)


def _closed(watermark: str | None, week: int) -> bool:
    """Had the watermark passed the end of the week's window?"""
    if not watermark:
        return False
    at = datetime.fromisoformat(watermark.replace("Z", "+00:00")).timestamp()
    return EPOCH_SECONDS + (week + 1) * WEEK_SECONDS <= at


class Watch(StreamingQueryListener):
    """Sums what :func:`observed` reports, for each query by its id."""

    def __init__(self) -> None:
        self.taken: dict[str, Taken] = {}

    def of(self, query: StreamingQuery, seconds: float = 60) -> Taken:
        """The totals of a query that has ended; its last events may still be on their way."""
        own = self.taken.setdefault(str(query.runId), Taken())
        own.ended.wait(seconds)
        return own

    def onQueryStarted(self, event) -> None:
        self.taken.setdefault(str(event.runId), Taken())

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        own = self.taken.setdefault(str(p.runId), Taken())
        own.batches += 1
        for s in p.stateOperators:
            own.dropped_sums += s.numRowsDroppedByWatermark
            own.state_max, own.state_end, own.state_bytes = max(own.state_max, s.numRowsTotal), s.numRowsTotal, s.memoryUsedBytes
        seen = p.observedMetrics.get(NAME)
        if seen is None or not seen["rows"]:
            return
        own.rows += seen["rows"]
        own.clicks += seen["clicks"] or 0
        own.first_time = min(x for x in (own.first_time, seen["first_time"]) if x is not None)
        own.last_time = max(x for x in (own.last_time, seen["last_time"]) if x is not None)
        watermark = p.eventTime.get("watermark")
        own.late_rows += sum(n for name, n in seen.asDict().items() if name.startswith("week_") and n and _closed(watermark, int(name.removeprefix("week_"))))

    def onQueryTerminated(self, event) -> None:
        self.taken.setdefault(str(event.runId), Taken()).ended.set()


@contextmanager
def watching(spark: SparkSession) -> Iterator[Watch]:
    watch = Watch()
    spark.streams.addListener(watch)
    try:
        yield watch
    finally:
        spark.streams.removeListener(watch)


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Queries that start here keep their state in RocksDB and write only its changes to the checkpoint: for a state without a
    watermark, which grows with the keys. A query keeps the store that its checkpoint began with."""
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
