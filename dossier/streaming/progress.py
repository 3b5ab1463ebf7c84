"""Append logs as streams: progress counters and event counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def log_stream(spark: SparkSession, path: str, schema: StructType, per_batch: int = 100) -> DataFrame:
    """A folder of JSON-lines logs as a stream of rows."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).option("pathGlobFilter", "*.json*").json(path)


def progress(units: DataFrame) -> DataFrame:
    """Units done (each once, counted exactly) and events of each job; counts of a set of units never fall."""
    done = units.where("status = 'done' AND unit IS NOT NULL").select("job", "unit").dropDuplicates(["job", "unit"]).select("job", F.lit(1).alias("done"), F.lit(0).alias("event"))
    every = done.union(units.select("job", F.lit(0).alias("done"), F.lit(1).alias("event")))
    return every.groupBy("job").agg(F.sum("done").alias("done"), F.sum("event").alias("events"))


def events_by_kind(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """All that a stream has now, as the table that a query over it ends with."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
