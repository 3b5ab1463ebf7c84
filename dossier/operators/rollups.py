"""Roll-ups of documents and verdicts: status of a folder's files, resolved evidence, findings, and cited places."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chapters import tier

# How pages are cited.
PAGE, CONVERTED = r"第\s*(\d+)\s*页", r"转换稿\s*第\s*\d+\s*页"


def cited(source: Column) -> Column:
    """struct<tier, page, kind> of a citation: whose draft, the first page that is named, and of which rendering."""
    text = F.coalesce(source, F.lit(""))
    page = F.nullif(F.regexp_extract(text, PAGE, 1), F.lit("")).cast("int")
    return F.struct(tier(text).alias("tier"), page.alias("page"), F.when(text.rlike(CONVERTED), "converted").otherwise("original").alias("kind"))


def rewritten(source: Column, page: Column) -> Column:
    """A citation with its first page put right; one without a page stays as it is."""
    found = F.regexp_extract(source, f"(?s)^(.*?)({PAGE})(.*)$", 1), F.regexp_extract(source, f"(?s)^(.*?)({PAGE})(.*)$", 4)
    return F.when(source.rlike(PAGE), F.concat(found[0], F.lit("第 "), page, F.lit(" 页"), found[1])).otherwise(source)


def document_status(results: DataFrame, keys: list[str], order: str, file: str, failed: Column, partial: Column, degraded: Column, has_text: Column) -> DataFrame:
    """(keys, status, failed_files, degraded_files, problem_files) of the files of each document.

    failed where no file has text, else partial where a file failed or broke off, degraded where one was read by the
    fallback, and ready.  Files that failed come before those that broke off; problem files are all, each once.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.when(yes(c), F.struct(F.col(order).alias("o"), F.col(file).alias("f"))))), lambda x: x["f"])
    d = results.groupBy(*keys).agg(F.concat(listed(failed), listed(partial)).alias("failed_files"), listed(degraded).alias("degraded_files"), F.bool_or(yes(has_text)).alias("__text"))
    status = F.when(~F.col("__text"), "failed").when(F.size("failed_files") > 0, "partial").when(F.size("degraded_files") > 0, "degraded").otherwise("ready")
    return d.select(*keys, status.alias("status"), "failed_files", "degraded_files", F.array_distinct(F.concat("failed_files", "degraded_files")).alias("problem_files"))


def resolution_summary(citations: DataFrame, keys: list[str], ref: str, found: str, page_status: str) -> DataFrame:
    """(keys, checked, one counter for each class and state of the page, weak_refs, unresolved_refs): what became of a verdict's citations."""
    count = lambda c, value: F.count_if(F.col(c) == value).alias(value)
    refs = lambda value: F.array_sort(F.collect_list(F.when(F.col(found) == value, F.col(ref)))).alias(f"{value.removesuffix('_match')}_refs")
    counters = [count(found, v) for v in ("resolved", "weak_match", "unresolved")] + [count(page_status, v) for v in ("page_ok", "page_corrected", "page_unverified")]
    return citations.groupBy(*keys).agg(F.count(found).alias("checked"), *counters, refs("weak_match"), refs("unresolved"))


def findings(explanation: Column, reasons: Column, chain: Column, scoring: Column, checks: Column) -> Column:
    """array<struct<origin, text, kind>> of all that a verdict says: explanation, reasons, evidence, scores and checks, in this order.

    kind: the rendering that page references of the text are read by.
    """
    said = lambda *cs: F.array_join(F.array(*(F.coalesce(c, F.lit("")) for c in cs)), " ")
    row = lambda origin, text, kind=F.lit("original"): F.struct(origin.alias("origin"), text.alias("text"), kind.alias("kind"))
    named = lambda name, i: F.concat(F.lit(f"{name}["), i, F.lit("]"))
    parts = [
        F.when(F.coalesce(explanation, F.lit("")) != "", F.array(row(F.lit("explanation"), explanation))),
        F.transform(reasons, lambda r, i: row(named("reasons", i), F.coalesce(r, F.lit("None")))),
        F.transform(chain, lambda e, i: row(named("evidence_chain", i), said(e["source"], e["finding"], e["conclusion"]), F.when(e["page_kind"] == "converted", "converted").otherwise("original"))),
        F.transform(scoring, lambda s, i: row(named("scoring", i), said(s["item"], s["basis"], s["pending_reason"]))),
        F.transform(checks, lambda c, i: row(named("eligibility_checks", i), said(c["check"], c["basis"], c["evidence"]["source"], c["evidence"]["quote"]))),
    ]
    empty = F.array().cast("array<struct<origin: string, text: string, kind: string>>")
    return reduce(F.concat, [F.coalesce(p, empty) for p in parts])
