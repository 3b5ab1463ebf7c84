"""Lookups between nested verdicts and what they name: rules, criteria, bidders, results, pages and defects."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key: of duplicates the last wins."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__r")).select(*keys, *(F.col(f"__r.{c}").alias(c) for c in rest))


def by_name(rows: DataFrame, facts: DataFrame, name: str, order: str) -> DataFrame:
    """Left join by name, where of facts with one name the last counts."""
    return rows.join(last_per_key(facts, [name], order), name, "left")


def described(df: DataFrame, key: str, refs: str, rules: DataFrame, rule: str, title: str, text: str) -> DataFrame:
    """(key, refs): each reference with its rule's title and text in the given order; an unknown one is its own title."""
    each = df.select(key, F.posexplode_outer(refs).alias("at", "__ref"))
    found = each.join(rules.select(F.col(rule).alias("__ref"), F.col(title).alias("__title"), F.col(text).alias("__text")).dropDuplicates(["__ref"]), "__ref", "left")
    one = F.struct("at", F.col("__ref").alias("id"), F.coalesce("__title", "__ref").alias("title"), F.coalesce("__text", F.lit("")).alias("text"))
    listed = F.array_sort(F.collect_list(F.when(F.col("__ref").isNotNull(), one)))
    return found.groupBy(key).agg(F.transform(listed, lambda r: r.dropFields("at")).alias(refs))


def known_only(df: DataFrame, key: str, refs: str, rules: DataFrame, rule: str) -> DataFrame:
    """(key, refs) without references to unknown rules, in the given order; with no rules at all nothing is dropped."""
    if rules.isEmpty():
        return df.select(key, refs)
    each = df.select(key, F.posexplode_outer(refs).alias("at", "__ref"))
    kept = each.join(rules.select(F.col(rule).alias("__ref"), F.lit(True).alias("__known")).distinct(), "__ref", "left")
    listed = F.array_sort(F.collect_list(F.when(F.col("__known"), F.struct("at", "__ref"))))
    return kept.groupBy(key).agg(F.transform(listed, lambda r: r["__ref"]).alias(refs))


def first_match(summaries: DataFrame, results: DataFrame, summary: str, pairs: list[tuple[str, str]], order: str) -> DataFrame:
    """Each summary with the first result that has one of its keys: a union of equality joins, since a disjunction would compare all pairs.

    pairs: columns of summaries and of results that may be equal.
    """
    found = [summaries.select(summary, F.col(a).alias("__k")).where("__k is not null and __k <> ''").join(results.withColumn("__k", F.col(b)), "__k").drop("__k") for a, b in pairs]
    rank = F.row_number().over(Window.partitionBy(summary).orderBy(order))
    best = reduce(DataFrame.unionByName, found).withColumn("__rank", rank).where("__rank = 1").drop("__rank")
    return summaries.select(summary).join(best, summary, "left")


def resolved_name(asked: DataFrame, known: DataFrame, key: str, given: str, name: str, value: str) -> DataFrame:
    """(key, id, reason): the id given; else that of the one known row with just this name; else why there is none."""
    names = known.groupBy(F.trim(name).alias("__n")).agg(F.count("*").alias("__many"), F.min(value).alias("__id"))
    plain = F.trim(F.coalesce(F.col(name), F.lit("")))
    d = asked.withColumn("__n", plain).join(names, "__n", "left")
    own, many = F.nullif(F.trim(given), F.lit("")), F.coalesce("__many", F.lit(0))
    reason = F.when(own.isNotNull(), None).when(F.col("__n") == "", "missing").when(many == 0, "unmatched").when(many > 1, "ambiguous")
    return d.select(key, F.coalesce(own, F.when((F.col("__n") != "") & (many == 1), F.col("__id"))).alias("id"), reason.alias("reason"))


def on_pages(quotes: DataFrame, pages: DataFrame, keys: list[str], quote: str, cited: str, page: str, text: str, near: int = 1) -> DataFrame:
    """Pages within `near` of a quote's cited one that contain it: an equality join on keys and page, one row of a quote for each page near it."""
    around = quotes.withColumn(page, F.explode(F.sequence(F.col(cited) - near, F.col(cited) + near)))
    return around.join(pages.select(*keys, page, text), [*keys, page]).where(F.col(text).contains(F.col(quote)))


def matched_defects(defects: DataFrame, findings: DataFrame, case: str, defect: str, words: str, musts: str, refs: str, absence: str, order: str) -> DataFrame:
    """The first finding of its case for each defect: any key word, all that must be there, and common pages unless it is an absence."""
    d, f = defects.select(case, defect, words, musts, absence, F.col(refs).alias("__refs")), findings
    text = F.col("text")
    fits = F.exists(words, lambda w: text.contains(w)) & F.forall(musts, lambda w: text.contains(w)) & (F.col(absence) | F.arrays_overlap("__refs", refs))
    first = d.join(f, case).where(fits).groupBy(case, defect).agg(F.min(order).alias("finding"))
    return d.select(case, defect).join(first, [case, defect], "left")


def with_statuses(projects: DataFrame, bids: DataFrame, key: str, status: str, fine: tuple[str, ...] = ("ready",)) -> DataFrame:
    """Projects with their own and their bids' impaired documents as one ordered array of warnings."""
    worse = lambda c: F.col(c).isNotNull() & ~F.col(c).isin(*fine)
    own = bids.where(worse(status)).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("bid", F.col(status).alias("status")))).alias("bids"))
    first = F.when(worse(status), F.array(F.struct(F.lit("").alias("bid"), F.col(status).alias("status")))).otherwise(F.array())
    return projects.join(own, key, "left").select(key, F.concat(first, F.coalesce("bids", F.array())).alias("warnings"))


def back_filled(native: DataFrame, read: DataFrame, keys: list[str], page: str, text: str) -> DataFrame:
    """Blank pages take the text that was read from their picture; a document whose page counts differ stays as it is."""
    n = read.groupBy(*keys).agg(F.count("*").alias("__there"))
    d = native.withColumn("__here", F.count("*").over(Window.partitionBy(*keys)))
    d = d.join(n, keys, "left").join(read.select(*keys, page, F.col(text).alias("__read")), [*keys, page], "left")
    filled = F.when((F.trim(text) == "") & (F.col("__here") == F.col("__there")), F.coalesce(F.nullif(F.trim("__read"), F.lit("")), F.col(text))).otherwise(F.col(text))
    return d.select(*keys, page, filled.alias(text))


def usable(checks: list[tuple[str, Column]]) -> Column:
    """The code of the first check that fails; null if none does."""
    return F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in checks))


def scope(tag: str | None, file: str | None) -> Column:
    """Rows of a tag and of a file; none of a kind given: any."""
    parts = [F.col(c) == v for c, v in (("tag", tag), ("file", file)) if v]
    return reduce(and_, parts) if parts else F.lit(True)


def any_of(*conditions: Column) -> Column:
    return reduce(or_, conditions)
