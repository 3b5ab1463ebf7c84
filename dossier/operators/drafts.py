"""Page-anchored drafts as tables of lines: anchors, headings, carried context, runs and spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The line protocol of drafts.
ANCHOR = r"^【(转换稿)?第 ?(\d+)(?:-(\d+))? ?页】$"
FILE_HEAD = r"^### 文件: (.*?)(?: \((?:kind|route)=.*)?$"
HEADINGS = ((1, r"^第[一二三四五六七八九十百千0-9]+[章节篇部分]"), (2, r"^[一二三四五六七八九十]+、\s*."), (3, r"^（[一二三四五六七八九十0-9]+）\s*."))
CARRY_LINES = 300


def lines(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """(keys, line_no, line): lines of a text, numbered from 0."""
    return df.select(*keys, F.posexplode(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")).alias("line_no", "line"))


def anchor_page(line: Column) -> Column:
    return F.try_to_number(F.regexp_extract(F.trim(line), ANCHOR, 2), F.lit("999999999")).cast("int")


def heading_level(line: Column) -> Column:
    """1 to 3, or null for a line that is no heading; a Markdown heading counts its marks, three at most."""
    marks = F.length(F.regexp_extract(line, r"^\s*(#{1,6})\s+\S", 1))
    out = F.when(marks > 0, F.least(marks, F.lit(3)))
    for level, pattern in HEADINGS:
        out = out.when(F.trim(line).rlike(pattern), level)
    return out


def carried(df: DataFrame, keys: list[str], order: str, is_marker: Column, value: Column, within: int) -> Column:
    """The last marker's value at or above a row, if at most `within` rows away."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(is_marker, F.struct(value.alias("v"), F.col(order).alias("at"))), ignorenulls=True).over(w)
    return F.when(F.col(order) - last["at"] <= within, last["v"])


def islands(df: DataFrame, keys: list[str], order: str, value: str, least: int) -> DataFrame:
    """Runs of at least `least` neighbouring rows (by consecutive order) of one value: keys, value, first, last, n."""
    rank = F.row_number().over(Window.partitionBy(*keys, value).orderBy(order))
    runs = df.withColumn("__run", F.col(order) - rank).groupBy(*keys, value, "__run")
    return runs.agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).where(F.col("n") >= least).drop("__run")


def merged(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Union of overlapping intervals: keys, start, end."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = df.withColumn("__new", F.when(F.col(start) <= before, 0).otherwise(1))
    numbered = flagged.withColumn("__id", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "__id").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__id")


def heading_spans(headings: DataFrame, keys: list[str]) -> DataFrame:
    """Each heading's span ends before the next heading of the same or a higher level (rows: keys, line_no, level)."""
    ahead = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(1, Window.unboundedFollowing)
    nexts = [F.min(F.when(F.col("level") <= k, F.col("line_no"))).over(ahead) for k in (1, 2, 3)]
    return headings.withColumn("ends_before", F.when(F.col("level") == 1, nexts[0]).when(F.col("level") == 2, nexts[1]).otherwise(nexts[2]))
