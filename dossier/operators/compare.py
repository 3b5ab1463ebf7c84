"""Comparisons of bidders, criteria and checks of verdicts: pools, guards, signatures, warnings and golden cases."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the contract: reasons why a score may be pending, and tolerances of scores and of price units.
PENDING_REASONS = ("cross_bid", "external_data", "live_event", "evidence_unresolved", "subjective", "not_responsive")
TOLERANCE, UNIT_RATIO = 0.01, 100.0


def positive_amount(c: Column) -> Column:
    """A finite number above 0; null for anything else."""
    x = c.cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")) & (x > 0), x)


def pool(results: DataFrame, project: str, bidder: str, order: str, version: str, current: str, price: str) -> DataFrame:
    """(project, bidder, amount, comparable, exclusion): the latest result of each bidder, and why one can't be compared."""
    rank = F.row_number().over(Window.partitionBy(project, bidder).orderBy(F.col(order).desc()))
    latest = results.withColumn("__rank", rank).where("__rank = 1")
    stale = ~F.coalesce(F.col(version) == F.col(current), F.lit(False))
    amount = positive_amount(F.col(price))
    reason = F.when(stale, "criteria_stale").when(amount.isNull(), "bid_price_invalid")
    return latest.select(project, bidder, amount.alias("amount"), reason.isNull().alias("comparable"), reason.alias("exclusion"))


def blocked(entries: DataFrame, project: str) -> DataFrame:
    """(project, comparable, reason): why a whole pool can't be compared; null where it can."""
    own = F.when(F.col("comparable"), F.col("amount"))
    agg = entries.groupBy(project).agg(F.count_if("comparable").alias("comparable"), F.min(own).alias("__low"), F.max(own).alias("__high"))
    reason = F.when(F.col("comparable") < 2, "insufficient_comparable_bidders").when(F.col("__high") / F.col("__low") >= UNIT_RATIO, "bid_price_unit_mismatch")
    return agg.select(project, "comparable", reason.alias("reason"))


def guarded(scores: DataFrame, entries: DataFrame, blocks: DataFrame, project: str, bidder: str, cleared: list[str]) -> DataFrame:
    """Model scores as they may be shown: bidders of a blocked pool and excluded ones lose theirs and go to manual review."""
    d = entries.join(blocks.select(project, "reason"), project).join(scores, [project, bidder], "left")
    bad = F.col("reason").isNotNull() | ~F.col("comparable")
    return d.select(project, bidder, *(F.when(~bad, F.col(c)).alias(c) for c in cleared), F.when(bad, "manual_review").otherwise("scored").alias("status"), F.coalesce("exclusion", "reason").alias("note"))


def signature(df: DataFrame, keys: list[str], ids: str, criteria: str) -> DataFrame:
    """(keys, signature): the first 16 digits of the SHA-256 of the sorted ids and the criteria's hash; null with fewer than two ids."""
    joined = F.concat(F.array_join(F.array_sort(F.collect_list(F.col(ids).cast("string"))), ","), F.lit("|"), F.coalesce(F.max(criteria), F.lit("")))
    return df.groupBy(*keys).agg(F.when(F.count(ids) >= 2, F.substring(F.sha2(joined, 256), 1, 16)).alias("signature"))


def recompute_needed(current: DataFrame, stored: DataFrame, key: str, active: DataFrame) -> DataFrame:
    """(key, needed): whether a signature differs from the stored one, where there is one and none is being computed."""
    d = current.join(stored.select(key, F.col("signature").alias("__was")), key, "left").join(active.select(key, F.lit(True).alias("__busy")).distinct(), key, "left")
    needed = F.col("signature").isNotNull() & ~F.col("signature").eqNullSafe(F.col("__was")) & F.col("__busy").isNull()
    return d.select(key, needed.alias("needed"))


def pending_errors(scoring: Column, allowed: tuple[str, ...] = PENDING_REASONS) -> Column:
    """Items without a score whose reason isn't one of the known ones."""
    return F.transform(F.filter(scoring, lambda s: s["score"].isNull() & ~F.coalesce(s["pending_reason"].isin(*allowed), F.lit(False))), lambda s: s["item"])


def mode_warning(mode: Column, score: Column, most: Column, base: Column, hits: Column) -> Column:
    """The code of what is wrong with a scored item's arithmetic; null if nothing is or can't be told (no hits, or no scores)."""
    expected = F.when(mode == "deduction", most - hits).when(mode == "additive", F.coalesce(base, F.lit(0.0)) + hits).when(mode == "banded", hits)
    off = F.abs(expected - score) > TOLERANCE
    vague = (mode == "deduction") & hits.isNull() & (score > TOLERANCE) & (score < most)
    return F.when(score.isNull() | most.isNull(), None).when(off, F.concat(mode, F.lit("_mismatch"))).when(vague, "deduction_without_hits")


def downgraded(scoring: Column, unresolved: Callable[[Column], Column], note: str) -> Column:
    """Scored items with evidence that isn't found become pending, once, with a note."""
    bad = lambda s: (s["status"] == "scored") & F.coalesce(unresolved(s), F.lit(False))

    def changed(s: Column) -> Column:
        lower = s.withField("status", F.lit("manual_review")).withField("score", F.lit(None).cast("double"))
        return lower.withField("pending_reason", F.lit("evidence_unresolved")).withField("basis", F.concat(F.coalesce(s["basis"], F.lit("")), F.lit(note)))

    return F.transform(scoring, lambda s: F.when(bad(s), changed(s)).otherwise(s))


def aliased(c: Column, aliases: dict[str, str], fallback: str) -> Column:
    """The known value that a text stands for."""
    known = F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv))
    return F.coalesce(F.try_element_at(known, F.lower(F.trim(F.coalesce(c, F.lit(""))))), F.lit(fallback))


def mismatches(expected: DataFrame, actual: DataFrame, keys: list[str], checks: dict[str, Callable[[Column, Column], Column]]) -> DataFrame:
    """(keys, missing): for each expectation the names of the checks that the actual row fails; all of them where there is no row."""
    names = list(checks)
    d = expected.select(*keys, *(F.col(n).alias(f"__e_{n}") for n in names)).join(actual.select(*keys, *names), keys, "left")
    bad = F.array(*(F.when(~F.coalesce(check(F.col(f"__e_{n}"), F.col(n)), F.lit(False)), F.lit(n)) for n, check in checks.items()))
    return d.select(*keys, F.array_compact(bad).alias("missing"))


def attribution(runs: DataFrame, item: str, kind: str, hit: str) -> DataFrame:
    """(kind, items, always, ever): items of each kind, and how many all runs or any run hit."""
    one = runs.groupBy(item, kind).agg(F.bool_and(hit).alias("all"), F.bool_or(hit).alias("any"))
    return one.groupBy(kind).agg(F.count("*").alias("items"), F.count_if("all").alias("always"), F.count_if("any").alias("ever"))


#: Steps of each schema: functions of a DataFrame, in order.
REGISTRY: dict[str, list[Callable[[DataFrame], DataFrame]]] = {}


def register(schema: str, *steps: Callable[[DataFrame], DataFrame]) -> None:
    REGISTRY[schema] = list(steps)


def apply_steps(schema: str, df: DataFrame) -> DataFrame:
    """df after all steps of its schema, as one plan."""
    for step in REGISTRY[schema]:
        df = df.transform(step)
    return df
