"""Score arithmetic over items: totals where no score isn't zero, spreads, pools and block reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def totals(items: DataFrame, keys: list[str], score: str, most: str) -> DataFrame:
    """Totals of items with a known maximum; those without a score are pending, not zero."""
    known, scored = F.col(most).isNotNull(), F.col(score).isNotNull()
    return items.groupBy(*keys).agg(
        F.sum(F.when(known & scored, F.col(score))).alias("total_score"),
        F.sum(F.when(known, F.col(most))).alias("total_max"),
        F.count_if(known & ~scored).alias("pending_count"),
        F.sum(F.when(known & ~scored, F.col(most))).alias("pending_max"),
    )


def spread(runs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Largest less smallest value over repeated runs; null with fewer than two."""
    return runs.groupBy(*keys).agg(F.count(value).alias("runs"), F.when(F.count(value) >= 2, F.max(value) - F.min(value)).alias("spread"))


def block_reason(n: Column, low: Column, high: Column, ratio: float = 100.0) -> Column:
    return F.when(n < 2, "too_few").when(high / low >= ratio, "unit_mismatch")


def most_frequent(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value of each key, ties by value."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("n").desc(), value))
    return counts.withColumn("__r", rank).where("__r = 1").drop("__r")
