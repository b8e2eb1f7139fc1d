"""Clusters by key over a stream, with state that expires after the horizon.

Each key's state is its cluster and when that was last seen. A posting within the horizon joins the cluster; a later one
starts another. A timer in event time drops the state of a key that the watermark has left behind by the horizon, so the
store holds keys of the last weeks and not of all time. ``in_batch`` is the same rule over a whole table.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.window import Window

from harrow.functions.keys import HORIZON_DAYS

OUTPUT = "external_id long, dedup_key string, micros long, cluster_id long, started boolean"
#: The state store that timers need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Horizon(StatefulProcessor):
    """dedup_key -> (cluster_id, seen in microseconds), dropped ``days`` after ``seen``."""

    def __init__(self, days: int):
        self.horizon = days * 86_400_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("cluster", "cluster_id long, seen long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802, N803
        cluster, seen = self.state.get() if self.state.exists() else (None, None)
        before = seen
        # a key's postings of one batch, which the stream's limit on files per batch bounds
        for at, posting in sorted((r["micros"], r["external_id"]) for r in rows):
            started = seen is None or at - seen > self.horizon
            if started:
                cluster = posting
            seen = at if started else max(seen, at)
            yield Row(external_id=posting, dedup_key=key[0], micros=at, cluster_id=cluster, started=started)
        if before is not None:
            self.handle.deleteTimer(self._due(before))
        self.state.update((cluster, seen))
        self.handle.registerTimer(self._due(seen))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.state.clear()
        yield from ()

    def _due(self, seen: int) -> int:
        """Milliseconds; a posting at the horizon itself still joins, so the timer is one later."""
        return (seen + self.horizon) // 1000 + 1

    def close(self) -> None:
        pass


def clustered(postings: DataFrame, late: str = "1 day", days: int = HORIZON_DAYS) -> DataFrame:
    """A stream of ``external_id``, ``dedup_key``, ``at`` -> the same with ``cluster_id`` and ``started``.

    Postings without a key are left out. What comes later than the watermark (``late`` behind the newest) is dropped by
    Spark. The session's state store must be ``STORE``.
    """
    rows = postings.select("external_id", "dedup_key", "at").filter("dedup_key is not null").withWatermark("at", late)
    rows = rows.withColumn("micros", F.unix_micros("at"))
    out = rows.groupBy("dedup_key").transformWithState(_Horizon(days), OUTPUT, "Append", "EventTime")
    return out.select("external_id", "dedup_key", F.timestamp_micros("micros").alias("at"), "cluster_id", "started")


def in_batch(postings: DataFrame, days: int = HORIZON_DAYS) -> DataFrame:
    """The same rule over a table: a posting starts a cluster where the one before it with its key is beyond the horizon.

    Keys are cut into days first, so that a window holds a key's days and not its postings.
    """
    rows = postings.select("external_id", "dedup_key", "at").filter("dedup_key is not null")
    day: Column = F.date_trunc("day", F.col("at"))
    per_day = rows.groupBy("dedup_key", day.alias("day")).agg(
        F.min(F.struct("at", "external_id")).alias("first"), F.max("at").alias("last")
    )  # within a day no gap is beyond the horizon
    order = Window.partitionBy("dedup_key").orderBy("day")
    gap = F.col("first.at") - F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.coalesce(gap > F.make_dt_interval(F.lit(days)), F.lit(True))
    started = F.when(begins, F.col("first.external_id"))
    per_day = per_day.select("dedup_key", "day", F.last(started, ignorenulls=True).over(order).alias("cluster_id"), begins.alias("begins"), "first")
    out = rows.withColumn("day", day).join(per_day, ["dedup_key", "day"])
    return out.select("external_id", "dedup_key", "at", "cluster_id", (F.col("begins") & (F.col("external_id") == F.col("first.external_id"))).alias("started"))


def state_rows(spark: SparkSession, checkpoint: str) -> int:
    """Keys that a stopped stream holds."""
    return spark.read.format("statestore").option("stateVarName", "cluster").load(checkpoint).count()
