"""Deduplication of a stream with state of its own: an entry lives for a horizon after its last sight, then a timer takes it out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstSights(StatefulProcessor):
    """Rows of a key that were not seen within `horizon_ms` before; state is the time of the last sight."""

    def __init__(self, horizon_ms: int):
        self.horizon_ms = horizon_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows)).sort_values(["event_ms", "pos"], kind="stable")
        before = self.last.get()[0] if self.last.exists() else None
        times = found["event_ms"].tolist()
        previous = [before, *times[:-1]]
        yield found[[p is None or t - p > self.horizon_ms for p, t in zip(previous, times, strict=True)]]
        newest = max([times[-1], *([before] if before is not None else [])])
        self.last.update((newest,))
        if before is not None and newest != before:
            self.handle.deleteTimer(before + self.horizon_ms + 1)
        if newest != before:
            self.handle.registerTimer(newest + self.horizon_ms + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def first_sights(posts: DataFrame, key: str, time_col: str, pos: str, horizon: str = "60 days", late: str = "1 day") -> DataFrame:
    """(key, event_ms, pos) of each sight of a key more than `horizon` after the one before; ties in time go by `pos`.

    `posts` is a stream. State lives in the RocksDB state store, which the session has to name (see `rocksdb`); keys
    not seen for the horizon leave it as the watermark passes, so it is bounded by the keys of the horizon. A task
    sorts a key's rows of one batch: the source's maxFilesPerTrigger bounds them.
    """
    spark = posts.sparkSession
    horizon_ms = int(spark.sql(f"SELECT unix_millis(timestamp_millis(0) + INTERVAL {horizon}) AS ms").first()["ms"])
    timed = posts.select(F.col(key).cast("string").alias("key"), F.col(time_col).cast("timestamp").alias("event_time"), F.col(pos).cast("long").alias("pos"))
    timed = timed.withColumn("event_ms", F.unix_millis("event_time")).withWatermark("event_time", late)
    return timed.groupBy("key").transformWithStateInPandas(FirstSights(horizon_ms), "key string, event_time timestamp, pos long, event_ms long", "Append", "EventTime")


class rocksdb:  # noqa: N801  reads like a context
    """The session's streams keep their state in RocksDB inside."""

    def __init__(self, spark):
        self.spark = spark

    def __enter__(self):
        self.before = self.spark.conf.get(_PROVIDER, None)
        self.spark.conf.set(_PROVIDER, ROCKSDB)

    def __exit__(self, *_):
        self.spark.conf.unset(_PROVIDER) if self.before is None else self.spark.conf.set(_PROVIDER, self.before)


def drain(stream: DataFrame, path: str) -> DataFrame:
    """All that the stream has now, written under `path` with its checkpoint, and read back."""
    query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")
