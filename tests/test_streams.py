"""Streams over files that arrive one by one: silent keys once, also after a restart, and views that a replayed batch leaves as they are."""

import datetime

import pytest
from pyspark.sql import functions as F

from dossier.sources.scratch import new_folder
from dossier.streaming import heartbeats, views


def beat(key, minute, status="running"):
    return (key, datetime.datetime(2026, 1, 1, minute // 60, minute % 60), status)


@pytest.fixture
def base(spark):
    return new_folder(spark, "streams")


def arrive(spark, base, rows, name):
    spark.createDataFrame(rows, "job string, at timestamp, status string").coalesce(1).write.parquet(f"{base}/in/{name}")


def dead(spark, base, out="out"):
    table = spark.createDataFrame([], "job string, at timestamp, status string")
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{base}/in")
    told = heartbeats.silent_keys(stream, "job", "at", 300, "status")
    return sorted((r["job"], r["last_ms"] // 60_000 % 1440) for r in heartbeats.run_to_files(told, f"{base}/{out}", f"{base}/{out}-checkpoint").collect())


def test_silent_keys_are_told_once(spark, base):
    arrive(spark, base, [beat("a", 0), beat("b", 0), beat("c", 1), beat(None, 0), ("d", None, "running")], 1)
    assert dead(spark, base) == []
    arrive(spark, base, [beat("a", 4), beat("c", 2, "done"), beat("e", 20)], 2)
    assert dead(spark, base) == [("a", 4), ("b", 0)]  # c is done, e is the last to have beaten
    arrive(spark, base, [beat("a", 21), beat("e", 40)], 3)  # a is back, and silent again
    assert dead(spark, base) == [("a", 4), ("a", 21), ("b", 0), ("e", 20)]
    assert dead(spark, base) == [("a", 4), ("a", 21), ("b", 0), ("e", 20)]  # nothing new, nothing told
    # Another run over the same files from the start tells the same.
    assert dead(spark, base, "again") == [("a", 4), ("a", 21), ("b", 0), ("e", 20)]


def test_silent_keys_of_a_table(spark):
    beats = spark.createDataFrame([beat("a", 0), beat("a", 3), beat("b", 8), beat(None, 0)], "job string, at timestamp, status string")
    assert [r["job"] for r in heartbeats.silences(beats, "job", "at", 300).collect()] == ["a"]


def test_views_keep_first_seen_order_and_ignore_replays(spark, base):
    schema = "no long, file string, page int, text string"
    rows = [[(0, "z", 2, "z2"), (1, "a", None, "a"), (2, "z", None, "z")], [(3, "a", 1, "a1"), (4, "m", 1, "m1"), (5, "z", 2, "z2 again")]]
    for k, some in enumerate(rows):
        spark.createDataFrame(some, schema).coalesce(1).write.parquet(f"{base}/in/{k}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{base}/in")
        views.follow(stream, f"{base}/out", "no", f"{base}/checkpoint")

    def seen():
        found = views.grouped(spark.read.parquet(f"{base}/out"), "file", "page", ["text"]).orderBy("place").collect()
        return [(r["file"], [u["text"] for u in r["units"]]) for r in found]

    expected = [("z", ["z", "z2", "z2 again"]), ("a", ["a", "a1"]), ("m", ["m1"])]
    assert seen() == expected
    views.merge_batch(f"{base}/out", "no")(spark.createDataFrame(rows[1], schema), 1)
    assert seen() == expected


def test_beats_by_the_clock(spark, base):
    arrive(spark, base, [beat("a", 0), beat("b", 0, "failed")], 1)
    stream = spark.readStream.schema("job string, at timestamp, status string").option("recursiveFileLookup", "true").parquet(f"{base}/in")
    told = heartbeats.silent_keys(stream, "job", "at", 1, "status", delay=None)
    query = told.writeStream.format("memory").queryName("clock").option("checkpointLocation", f"{base}/checkpoint").outputMode("append").trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            if spark.table("clock").count():
                break
            query.awaitTermination(1)
        assert [r["job"] for r in spark.table("clock").select(F.col("job")).collect()] == ["a"]
    finally:
        query.stop()
