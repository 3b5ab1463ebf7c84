"""Verdicts as nested columns: coercion of risk scores, derived decisions, gates and checks of score items."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the verdict contract.
DECISIONS = {"approved": (True, "合规"), "rejected": (False, "不合规"), "manual_review": (False, "待人工复核")}
RISK_NAMES = ("invoice", "amount", "approval", "budget", "anomaly")
UNCONFIRMED = ("false", "no", "0", "疑似", "待确认", "待核验", "unconfirmed", "manual")


def decision(verdict: Column) -> Column:
    """struct<result, conclusion> of a verdict; null for one that isn't known."""
    out = None
    for name, (result, conclusion) in DECISIONS.items():
        value = F.struct(F.lit(result).alias("result"), F.lit(conclusion).alias("conclusion"))
        out = F.when(verdict == name, value) if out is None else out.when(verdict == name, value)
    return out


def risk_score(raw: Column) -> Column:
    """A score on the scale 0 to 10: above 10 it was given in percent; ties go to the even number; no number is 0."""
    x = F.when(raw > 10, raw / 10).otherwise(raw)
    return F.when(raw.isNull(), 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(10), F.bround(x, 0))).cast("int"))


def risk_dimensions(pairs: Column, name: str = "name", score: str = "score") -> Column:
    """array<struct<name, score>> from array<struct<name, score double>> (of map_entries: key, value); null if none has a name."""
    named = F.filter(pairs, lambda p: F.trim(p[name]) != "")
    return F.when(F.size(named) > 0, F.transform(named, lambda p: F.struct(p[name].alias("name"), risk_score(p[score]).alias("score"))))


def has_all_risks(dimensions: Column) -> Column:
    """Whether the names are the fixed ones, each once."""
    names = F.transform(dimensions, lambda d: d["name"])
    return F.coalesce(F.array_sort(names) == F.array(*(F.lit(n) for n in sorted(RISK_NAMES))), F.lit(False))


def hits_total(points: Column) -> Column:
    """The sum of all points; null if there are none or one of them is no number."""
    whole = (F.size(points) > 0) & F.forall(points, lambda p: p.isNotNull())
    return F.when(whole, F.aggregate(points, F.lit(0.0), lambda a, p: a + p))


def meaningful_hit(hit: Column) -> Column:
    """Whether a map<string, string> names something and isn't marked as unconfirmed; no mark counts as confirmed.

    Values lost their types: null, '', 'false', '0', '[]' and '{}' count as empty.
    """
    mark = F.lower(F.trim(hit["confirmed"]))
    doubtful = F.map_contains_key(hit, "confirmed") & (mark.isNull() | mark.isin(*UNCONFIRMED))
    return ~doubtful & F.exists(F.map_values(hit), lambda v: ~F.coalesce(v, F.lit("")).isin("", "false", "0", "[]", "{}"))


def hard_disqualification(hits: Column, statuses: Column) -> Column:
    """True with a meaningful hit or a failed eligibility check; nulls are no hits."""
    failed = F.exists(statuses, lambda s: F.lower(F.trim(F.coalesce(s, F.lit("")))) == "fail")
    return F.coalesce(F.exists(hits, meaningful_hit), F.lit(False)) | F.coalesce(failed, F.lit(False))


def out_of_range(items: Column) -> Column:
    """Names of items (struct with item, score, max) whose score is below 0 or above the maximum."""
    bad = F.filter(items, lambda i: F.coalesce((i["score"] < 0) | (i["score"] > i["max"]), F.lit(False)))
    return F.transform(bad, lambda i: i["item"])


def moving_first(hits: Column) -> Column:
    """Hits that move a score (points not 0) before the others, each part in its order."""
    moves = lambda h: F.coalesce(h["points"] != 0, F.lit(False))
    return F.concat(F.filter(hits, moves), F.filter(hits, lambda h: ~moves(h)))
