"""Lists as their users see them: text filters, clamped pages, newest rows, roll-ups by category and score matrices."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .records import Order, ordering


def contains_all(df: DataFrame, needles: dict[str, str]) -> DataFrame:
    """Rows whose columns (or expressions) contain every needle, whatever the case; blank needles set no filter."""
    used = [F.lower(F.expr(c)).contains(n.strip().lower()) for c, n in needles.items() if n.strip()]
    return df.where(reduce(and_, used)) if used else df


def history(df: DataFrame, done: Column, words: list[str], query: str, day: str, now: Column, days: int) -> DataFrame:
    """Finished rows that have the query in any of the words, of fewer than `days` whole days ago and none in the future."""
    text = F.lower(F.concat_ws(" ", *words))
    age = F.floor((F.unix_timestamp(now) - F.unix_timestamp(day)) / 86400)
    return df.where(done & text.contains(query.strip().lower()) & (age >= 0) & (age < days))


def faceted(df: DataFrame, anywhere: tuple[list[str], str], chosen: dict[str, list]) -> DataFrame:
    """Rows with a text in any column of a list, and in every faceted column one of the chosen values (none: any)."""
    columns, needle = anywhere
    out = df.where(F.lower(F.concat_ws("\n", *columns)).contains(needle.lower())) if needle else df
    return reduce(lambda d, kv: d.where(F.col(kv[0]).isin(kv[1])) if kv[1] else d, chosen.items(), out)


def clamped_page(df: DataFrame, order: Order, size: int, number: int) -> DataFrame:
    """The page of that number from 0, or the last one where there are fewer."""
    last = max(0, -(-df.count() // size) - 1)
    return df.orderBy(*ordering(order)).offset(min(max(number, 0), last) * size).limit(size)


def newest(df: DataFrame, order: Order, n: int) -> DataFrame:
    """The first n rows in an order: a bounded list."""
    return df.orderBy(*ordering(order)).limit(n)


def percent(text: Column) -> Column:
    """The number before a percent sign; null where there is none."""
    return F.regexp_extract(text, r"^\s*(-?[0-9]+(?:\.[0-9]+)?)\s*%\s*$", 1).try_cast("double")


def overview(df: DataFrame, sums: list[str], rates: list[str]) -> DataFrame:
    """Number of rows, sums, and means of percentages to two digits."""
    return df.agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in sums), *(F.round(F.avg(percent(F.col(c))), 2).alias(c) for c in rates))


def subtotals(items: DataFrame, keys: list[str], score: str, most: str) -> DataFrame:
    """Earned and deducted points and pending items of each category; its maximum is null if any item's is unknown."""
    known = F.col(most).isNotNull()
    return items.groupBy(*keys).agg(
        F.count("*").alias("items"),
        F.count_if(~known).alias("unknown"),
        F.count_if(F.col(score).isNull()).alias("pending"),
        F.coalesce(F.sum(score), F.lit(0)).alias("earned"),
        F.coalesce(F.sum(F.when(known & F.col(score).isNotNull(), F.greatest(F.col(most) - F.col(score), F.lit(0)))), F.lit(0)).alias("deducted"),
        F.when(F.count_if(~known) == 0, F.sum(most)).alias("max"),
    )


def first_seen(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """(group, place, n): groups in the order of their first rows."""
    first = df.groupBy(group).agg(F.min(F.struct(*order)).alias("first"), F.count("*").alias("n"))
    return first.withColumn("place", F.row_number().over(Window.orderBy("first"))).drop("first")  # as many rows as groups


def score_matrix(cells: DataFrame, item: str, bidder: str, score: str, most: str, order: list[str]) -> DataFrame:
    """A row for each item: its first bidder's maximum, and of all bidders (sorted) the score and what is missing to the maximum."""
    one = cells.groupBy(item, bidder).agg(F.min_by(F.struct(score, most), F.struct(*order)).alias("c"), F.min(F.struct(*order)).alias("at"))
    cell = F.struct(F.col(bidder).alias("bidder"), F.col(f"c.{score}").alias("score"), F.greatest(F.col(f"c.{most}") - F.col(f"c.{score}"), F.lit(0)).alias("missing"))
    return one.groupBy(item).agg(F.min_by(F.col(f"c.{most}"), "at").alias("max"), F.array_sort(F.collect_list(cell)).alias("cells"), F.min("at").alias("first"))


def ranked(df: DataFrame, keys: list[str], score: str, before: str, index: str) -> DataFrame:
    """`place` of each row by score (to six digits), then the rank before and the row's index; the rank before where a score is missing.

    keys: of the lists that are ranked, so that each is a task of its own.
    """
    own = Window.partitionBy(*keys)
    place = F.row_number().over(own.orderBy(F.round(score, 6).desc(), F.col(before).asc_nulls_last(), index))
    return df.withColumn("place", F.when(F.count_if(F.col(score).isNull()).over(own) == 0, place).otherwise(F.col(before)))
