"""Results by content: what has been computed for the same bytes, by the same engine for the same purpose, is read again."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.sources.scratch import exists, new_folder, removed, written

# Fixed value: characters of a key.
KEY_SIZE = 40


def cache_key(content: Column, engine: Column, purpose: Column, seal: Column) -> Column:
    """A key of the bytes, the engine's print, the purpose and the seal of a run; parts are told apart, and null is empty."""
    parts = [F.coalesce(c.cast("binary"), F.lit(b"")) for c in (content, engine, purpose, seal)]
    sized = reduce(F.concat, [F.concat(F.octet_length(p).cast("string").cast("binary"), F.lit(b"\0"), p) for p in parts[1:]], parts[0])
    return F.substring(F.sha2(sized, 256), 1, KEY_SIZE)


def cached(work: DataFrame, key: str, path: str, compute: Callable[[DataFrame], DataFrame], complete: Callable[[], Column]) -> DataFrame:
    """work with the results of compute for its keys, and `made`: whether they were computed now.

    compute gets the rows whose key has no result, one for each key (the first by all its columns), and returns the key
    and the columns of a result; it isn't called when there are none.  Only results for which complete() holds are stored, so what
    is partial is computed again.  Each call stores a folder of its own, and of several results of a key, which
    calls at the same time may make, the first folder by name is read.  Null keys are a key like any other.
    """
    spark = work.sparkSession
    store = f"{path.rstrip('/')}/runs"
    known = None
    if exists(spark, store):
        rows = spark.read.parquet(store)
        columns = [c for c in rows.columns if c not in (key, "run")]
        known = rows.groupBy(key).agg(F.min_by(F.struct(*columns), "run").alias("__result"))
    todo = work if known is None else work.join(known, work[key].eqNullSafe(known[key]), "left_anti")
    todo = todo.groupBy(key).agg(F.min(F.struct(*(c for c in work.columns if c != key))).alias("__row")).select(key, "__row.*")
    if todo.isEmpty():
        made = None
    else:
        run = uuid.uuid4().hex
        made = written(compute(todo), new_folder(spark, "results"))
        made.where(complete()).write.option("compression", "zstd").parquet(f"{store}/run={run}")
    results = []
    if known is not None:
        results.append(known.select(F.col(key).alias("__key"), "__result", F.lit(False).alias("made")))
    if made is not None:
        results.append(made.select(F.col(key).alias("__key"), F.struct(*(c for c in made.columns if c != key)).alias("__result"), F.lit(True).alias("made")))
    if not results:
        return work.withColumn("made", F.lit(False))
    every = reduce(DataFrame.unionByName, results)
    return work.join(every, work[key].eqNullSafe(every["__key"])).select(*(work[c] for c in work.columns), "__result.*", "made")


def forget(work: DataFrame, path: str) -> None:
    """Takes a cache away."""
    removed(work.sparkSession, path)
