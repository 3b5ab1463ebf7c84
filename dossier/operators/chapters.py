"""Chapters of a draft: contents pages, paths of headings, tags, entities and page references."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Key words of chapter titles, in order of precedence.
TAGS = {
    "evaluation_method": ("评标办法", "评分标准", "评分细则", "评审办法", "评审方法", "评审程序"),
    "qualification_review": ("资格审查", "资格评审", "资格要求", "初步评审", "符合性审查", "响应性审查"),
    "performance": ("业绩", "类似项目", "类似工程"),
    "bid_form": ("投标函", "投标报价", "开标一览"),
    "commercial": ("商务", "合同条款", "付款"),
    "technical": ("技术方案", "技术标", "施工组织"),
}
# Patterns of labelled entities (the value is the group), and the least headings of a contents page.
DATE = r"\d{4}\s*[-/年]\s*\d{1,2}\s*[-/月]\s*\d{1,2}"
CERTIFICATE = r"(?:证书|资质|注册)\s*编号\s*[:：]?\s*([一-龥A-Za-z0-9][一-龥A-Za-z0-9\-]{5,})"
PERSON = r"(?:项目经理|项目负责人|技术负责人|法定代表人)\s*[:：]?\s*([一-龥]{2,4})"
CONTENTS_LEAST, WIDEST_RANGE = 3, 40


def tag(title: Column) -> Column:
    """The first tag one of whose key words a title has; `general` without any, null for a blank title."""
    out = F.when(F.trim(title) == "", F.lit(None).cast("string"))
    for name, words in TAGS.items():
        out = out.when(reduce(or_, (title.contains(w) for w in words)), name)
    return out.otherwise(F.when(title.isNotNull(), "general"))


def tier(label: Column) -> Column:
    return F.when(label.contains("招标"), "tender").when(label.contains("投标"), "bid").otherwise("whole")


def without_contents(headings: DataFrame, keys: list[str], least: int = CONTENTS_LEAST) -> DataFrame:
    """Headings (keys, line_no, level, ...) that aren't in a contents page: `least` or more adjacent lines of one level.

    The last of such a run stays if the line after it is no heading: it opens the text itself.
    """
    rank = F.row_number().over(Window.partitionBy(*keys, "level").orderBy("line_no"))
    after = F.lead("line_no").over(Window.partitionBy(*keys).orderBy("line_no"))
    d = headings.withColumn("__run", F.col("line_no") - rank).withColumn("__opens", F.coalesce(after != F.col("line_no") + 1, F.lit(True)))
    run = Window.partitionBy(*keys, "level", "__run")
    d = d.withColumn("__n", F.count("*").over(run)).withColumn("__last", F.max("line_no").over(run))
    listed = (F.col("__n") >= least) & ~((F.col("line_no") == F.col("__last")) & F.col("__opens"))
    return d.where(~listed).select(*headings.columns)


def paths(headings: DataFrame, keys: list[str]) -> DataFrame:
    """Headings (keys, line_no, level 1 to 3, title) with `path`: the titles above it and its own, joined by ' > '."""
    w = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda k: F.last(F.when(F.col("level") == k, F.struct("line_no", "title")), ignorenulls=True).over(w)
    d = headings.withColumn("__one", last(1)).withColumn("__two", last(2))
    one, two = F.col("__one"), F.col("__two")
    in_one = two["line_no"] > F.coalesce(one["line_no"], F.lit(-1))
    above = F.when(F.col("level") >= 2, one["title"]), F.when((F.col("level") == 3) & in_one, two["title"])
    return d.withColumn("path", F.concat_ws(" > ", *above, "title")).drop("__one", "__two")


def split_glued(line: Column) -> Column:
    """One or two lines: a chapter heading stuck to the end of a sentence becomes a line of its own."""
    pattern = r"^(.*?[。；：）\)])\s*(第[一二三四五六七八九十百千0-9]+[章节篇部分]\s.*)$"
    head, tail = (F.trim(F.regexp_extract(line, pattern, k)) for k in (1, 2))
    return F.when(line.rlike(pattern) & (head != "") & (tail != ""), F.array(head, tail)).otherwise(F.array(line))


def iso_dates(text: Column) -> Column:
    """Dates of a text as year-month-day, in order, each as often as it is there."""
    parts = lambda d: F.transform(F.regexp_extract_all(d, F.lit(r"\d+"), F.lit(0)), lambda n: n.cast("int"))
    return F.transform(F.regexp_extract_all(text, F.lit(DATE), F.lit(0)), lambda d: F.format_string("%04d-%02d-%02d", parts(d)[0], parts(d)[1], parts(d)[2]))


def entities(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, type, value, line_no): distinct dates, certificates and people of (keys, line_no, line), where they are first."""
    found = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value")))
    line = F.col("line")
    every = F.concat(
        found("date", iso_dates(line)),
        found("cert_no", F.regexp_extract_all(line, F.lit(CERTIFICATE), F.lit(1))),
        found("person", F.regexp_extract_all(line, F.lit(PERSON), F.lit(1))),
    )
    rows = lines.select(*keys, "line_no", F.explode(every).alias("e")).select(*keys, "line_no", "e.type", "e.value")
    return rows.groupBy(*keys, "type", "value").agg(F.min("line_no").alias("line_no"))


def page_refs(text: Column) -> Column:
    """Sorted pages that a citation names (第 3 页, 第 3-5 页); a range of over 40 pages counts by its ends."""
    spans = F.regexp_extract_all(text, F.lit(r"第\s*\d+(?:\s*[-–—~至]\s*\d+)?\s*页"), F.lit(0))
    ends = F.transform(spans, lambda s: F.transform(F.regexp_extract_all(s, F.lit(r"\d+"), F.lit(0)), lambda n: n.cast("int")))
    wide = lambda e: F.abs(F.element_at(e, -1) - e[0]) >= WIDEST_RANGE
    return F.array_sort(F.array_distinct(F.flatten(F.transform(ends, lambda e: F.when(wide(e), e).otherwise(F.sequence(e[0], F.element_at(e, -1)))))))
