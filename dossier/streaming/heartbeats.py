"""Heartbeats of running work as a stream: keys that have gone silent, each told once."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from dossier.sources.scratch import prepare

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Silence(StatefulProcessor):
    """State of a key: its times that nothing has followed within stale_ms, and a timer that goes off when the first of them is that old.

    By then all that comes earlier has come, so it is told, or not if work had ended there, whatever the batches were.  A key
    whose times have all been told has no state, and is watched again when it beats again.
    """

    def __init__(self, key: str, stale_ms: int, by_event: bool, keep_ms: int | None = None):
        self.key, self.stale_ms, self.by_event, self.keep_ms = key, stale_ms, by_event, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "at array<long>, ends array<boolean>", self.keep_ms)

    def _held(self) -> list[tuple[int, bool]]:
        at, ends = self.open.get() if self.open.exists() else ((), ())
        return list(zip(at, ends, strict=True))

    def _hold(self, times: list[tuple[int, bool]]) -> None:
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if times:
            self.open.update(([t for t, _ in times], [e for _, e in times]))
            self.handle.registerTimer(times[0][0] + self.stale_ms)
        else:
            self.open.clear()

    # Names of columns that begin with an underscore do not reach pandas.
    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        times = self._held()
        for some in rows:
            if self.by_event:
                times += zip(some["beat_ms"].tolist(), some["beat_ends"].tolist(), strict=True)
            else:  # by the clock, a beat counts from when it is seen
                times = [(timerValues.getCurrentProcessingTimeInMs(), bool(some["beat_ends"].iloc[some["beat_ms"].argmax()]))]
            times.sort()
            times = [t for t, after in zip(times, [*times[1:], None], strict=True) if after is None or after[0] - t[0] >= self.stale_ms]
        self._hold(times)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() if self.by_event else timerValues.getCurrentProcessingTimeInMs()
        times = self._held()
        told = [t for t, ends in times if t + self.stale_ms <= now and not ends]
        self._hold([t for t in times if t[0] + self.stale_ms > now])
        if told:
            yield pd.DataFrame({self.key: [key[0]] * len(told), "last_ms": told})

    def close(self) -> None:
        pass


def silent_keys(beats: DataFrame, key: str, at: str, stale_seconds: int, status: str | None = None, done: tuple[str, ...] = ("done", "failed"), delay: str | None = "0 seconds", keep_ms: int | None = None) -> DataFrame:
    """(key, last_ms) of a stream of beats: each time that a key, not done, had no beat for stale_seconds after, told once.

    delay: how late beats may come; silence is then measured between the times `at` of beats, so the same beats give the same
    rows however they arrive, and after a restart too.  None: by the clock of the cluster.  keep_ms: the state of a key is dropped after
    so long (only by the clock).  Beats without a key or time are passed over.
    """
    spark = beats.sparkSession
    prepare(spark)
    spark.conf.set(_PROVIDER, _ROCKSDB)  # the only store with timers
    ended = F.coalesce(F.col(status).isin(*done), F.lit(False)) if status else F.lit(False)
    rows = beats.where(F.col(key).isNotNull() & F.col(at).isNotNull()).withColumns({"beat_ms": F.unix_millis(F.col(at).cast("timestamp")), "beat_ends": ended})
    mode = "ProcessingTime"
    if delay is not None:
        rows, mode = rows.withColumn("beat_time", F.col(at).cast("timestamp")).withWatermark("beat_time", delay).select(key, "beat_ms", "beat_ends", "beat_time"), "EventTime"
    else:
        rows = rows.select(key, "beat_ms", "beat_ends")
    out = StructType([beats.schema[key]]).add("last_ms", "long")
    return rows.groupBy(key).transformWithStateInPandas(Silence(key, 1000 * stale_seconds, delay is not None, keep_ms), out, "Append", mode)


def silences(beats: DataFrame, key: str, at: str, stale_seconds: int) -> DataFrame:
    """The same of a table of beats, as at the time of its last beat."""
    ms = F.unix_millis(F.col(at).cast("timestamp"))
    d = beats.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(key, ms.alias("last_ms"))
    following = F.lead("last_ms").over(Window.partitionBy(key).orderBy("last_ms"))
    now = F.broadcast(d.agg(F.max("last_ms").alias("now")))  # one row
    return d.withColumn("following", following).join(now, F.coalesce("following", "now") - F.col("last_ms") >= 1000 * stale_seconds).select(key, "last_ms")


def run_to_files(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """All that a stream has now, appended to a table; what an earlier run has told isn't told again."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def file_stream(spark: SparkSession, table: DataFrame, path: str, names: str = "*.parquet", per_batch: int = 1000) -> DataFrame:
    """A table's files, of these names in a folder, as a stream."""
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", per_batch).option("pathGlobFilter", names).parquet(path)
