"""The event table as a stream: windows and sessions behind a watermark, and a running average with state that idle users leave.

Event times come without a zone and are taken as UTC.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vistrel.sources.views import table


def read_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of a folder as a stream; the schema is that of the table."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count and sum of values per window and kind; a stream closes a window once the watermark has passed it."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    out = timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a user: events that are no further apart than the gap."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    out = timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "n")


#: The state store that stateful processors need.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class _Average(StatefulProcessor):
    """Points and average of a user; a timer ends the user when nothing has come for the idle time."""

    def __init__(self, keep: float, idle_ms: int):
        self.keep, self.idle_ms = keep, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.average = handle.getValueState("average", "n long, ema double, last_ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        n, ema, last = self.average.get() if self.average.exists() else (0, 0.0, 0)
        frame = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        frame = frame[frame["ts"] >= pd.Timestamp(timerValues.getCurrentWatermarkInMs(), unit="ms")]  # the engine drops late rows a batch later
        if not len(frame):
            return
        for value in frame["value"]:
            ema = value if n == 0 else self.keep * ema + (1 - self.keep) * value
            n += 1
        last = max(last, int(pd.Timestamp(frame["ts"].max()).timestamp() * 1000))
        self.average.update((n, float(ema), last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last + self.idle_ms)
        yield self.row(key, n, ema, False)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        n, ema, _ = self.average.get()
        self.average.clear()
        yield self.row(key, n, ema, True)

    def row(self, key: tuple, n: int, ema: float, ended: bool) -> pd.DataFrame:
        return pd.DataFrame({"user_id": [key[0]], "n": [n], "ema": [float(ema)], "ended": [ended]})


def running_average(events: DataFrame, keep: float = 0.99, late: str = "10 minutes", idle: timedelta = timedelta(days=1)) -> DataFrame:
    """(user_id, n, ema, ended) after each micro-batch: the exponential average over a user's events, which within a batch are in the order of time.

    Events behind the watermark are dropped. A user without events for the idle time, by the watermark, is reported once more as ended and leaves
    the state; a later event begins anew. The session needs STATE_STORE.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).select("user_id", "event_id", "ts", "value")
    processor = _Average(keep, int(idle.total_seconds() * 1000))
    return timed.groupBy("user_id").transformWithStateInPandas(processor, "user_id long, n long, ema double, ended boolean", "Update", "EventTime")
