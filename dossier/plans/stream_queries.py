"""Queries over streams: each runs a stream over a given table to its end and returns what it has told."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.sources.scratch import new_folder
from dossier.streaming import heartbeats, progress, views

from .registry import Registry, Tables

_r = Registry()
QUERIES, ORACLE_SQL = _r.queries, _r.sql


def _events(t: Tables) -> DataFrame:
    """The events as a stream: its source is the folder that the table's own file, or files, are in."""
    table = t("events")
    folder, name = table.inputFiles()[0].rsplit("/", 1)
    return heartbeats.file_stream(table.sparkSession, table, folder, "*.parquet" if folder.endswith(".parquet") else name)


_SILENCES = """WITH b AS (SELECT user_id, epoch_us(ts) // 1000 AS beat FROM events), n AS (SELECT *, lead(beat) OVER (PARTITION BY user_id ORDER BY beat) AS following FROM b)
SELECT user_id, beat AS last_ms FROM n WHERE coalesce(following, (SELECT max(beat) FROM b)) - beat >= 6 * 3600 * 1000"""


@_r.add(_SILENCES)
def heartbeat_silences(t: Tables) -> DataFrame:
    """Times after which a user does nothing for six hours, by timers of a stream over the events."""
    base = new_folder(t("events").sparkSession, "beats")
    return heartbeats.run_to_files(heartbeats.silent_keys(_events(t), "user_id", "ts", 6 * 3600), f"{base}/out", f"{base}/checkpoint")


@_r.add(_SILENCES)
def heartbeat_table(t: Tables) -> DataFrame:
    return heartbeats.silences(t("events"), "user_id", "ts", 6 * 3600)


@_r.add("""WITH u AS (SELECT event_id, 'file' || user_id % 50 AS file, CASE WHEN event_id % 5 <> 0 THEN event_id % 9 END AS page FROM events)
SELECT file, min(event_id) AS first, string_agg(coalesce(CAST(page AS VARCHAR), '-') || ':' || event_id, ' ' ORDER BY coalesce(page, -1), event_id) AS units FROM u GROUP BY file""")
def units_by_file(t: Tables) -> DataFrame:
    """Events as units of fifty files, of which every fifth belongs to no page, followed as a stream."""
    spark = t("events").sparkSession
    base = new_folder(spark, "units")
    units = _events(t).select("event_id", F.concat(F.lit("file"), F.col("user_id") % 50).alias("file"), F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 9).alias("page"))
    views.follow(units, f"{base}/out", "event_id", f"{base}/checkpoint")
    found = views.grouped(spark.read.parquet(f"{base}/out"), "file", "page", ["event_id"])
    said = F.transform("units", lambda u: F.concat_ws(":", F.coalesce(u["page"].cast("string"), F.lit("-")), u["event_id"]))
    return found.select("file", F.col("place.order").alias("first"), F.array_join(said, " ").alias("units"))


@_r.add("SELECT user_id AS job, CAST(count(DISTINCT event_id % 20) FILTER (WHERE event_type = 'purchase') AS BIGINT) AS done, CAST(count(*) AS BIGINT) AS events FROM events GROUP BY user_id")
def progress_stream(t: Tables) -> DataFrame:
    """Purchases as done units of a user, of which some are told twice: exact counters of a stream."""
    base = new_folder(t("events").sparkSession, "progress")
    units = _events(t).select(F.col("user_id").alias("job"), (F.col("event_id") % 20).alias("unit"), F.when(F.col("event_type") == "purchase", "done").otherwise("seen").alias("status"))
    query = f"progress_{base[-32:]}"
    return progress.run_once(progress.progress(units), query, f"{base}/checkpoint")
