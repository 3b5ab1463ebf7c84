"""Model output as VARIANT columns: brought to a contract's shape, and patched, without Python."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the verdict contract.
FIELDS = ("claim_id", "verdict", "explanation", "reasons", "policy_refs", "risk_score", "extracted_data", "evidence_chain", "reviewed_by", "timestamp", "manual_review_reason", "risk_dimensions")
DERIVED = ("result", "conclusion")
REVIEWER, UNKNOWN_CLAIM, NEUTRAL_RISK, MANUAL = "AI", "UNKNOWN", 50, "manual_review"
LINK = ("source", "finding", "conclusion")
#: Field, path and type of the plain fields; what a field is when it's missing is said in `normalised`.
PLAIN = (("claim_id", "string"), ("verdict", "string"), ("explanation", "string"), ("risk_score", "double"), ("reviewed_by", "string"), ("timestamp", "string"), ("manual_review_reason", "string"))


def kind(value: Column) -> Column:
    """OBJECT, ARRAY, STRING, ... of a variant; null for a missing one."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def text_of(value: Column) -> Column:
    """A variant as text: a string as it is, anything else as JSON."""
    return F.when(kind(value) == "STRING", F.try_variant_get(value, "$", "string")).otherwise(F.to_json(value))


def _said(value: Column, field: str) -> Column:
    """A field of an object as trimmed text; null if it is missing or empty."""
    return F.nullif(F.trim(F.try_variant_get(value, f"$.{field}", "string")), F.lit(""))


def lines_of(value: Column) -> Column:
    """array<string> of a field that should be a list of texts: a string by its lines, objects by what they say."""

    def item(x: Column) -> Column:
        told = F.coalesce(*(_said(x, f) for f in ("description", "message", "reason")))
        severity = _said(x, "severity")
        marked = F.when(severity.isNotNull() & told.isNotNull(), F.concat(F.lit("["), severity, F.lit("] "), told)).otherwise(told)
        return F.when(kind(x) == "OBJECT", F.coalesce(marked, F.to_json(x))).otherwise(text_of(x))

    whole = F.try_variant_get(value, "$", "string")
    lines = F.filter(F.transform(F.split(whole, r"\r\n|\r|\n"), lambda s: F.trim(s)), lambda s: s != "")
    split = F.when(F.size(lines) > 0, lines).otherwise(F.array(F.lit("")))
    return F.when(kind(value) == "STRING", split).when(kind(value) == "ARRAY", F.transform(F.try_variant_get(value, "$", "array<variant>"), item))


def links_of(value: Column) -> Column:
    """array<struct<source, finding, conclusion>>: objects cut to these fields, a single object as a list of one, anything else left out."""
    several = F.when(kind(value) == "OBJECT", F.array(value)).when(kind(value) == "ARRAY", F.try_variant_get(value, "$", "array<variant>"))
    link = lambda x: F.struct(*(F.coalesce(F.try_variant_get(x, f"$.{f}", "string"), F.lit("")).alias(f) for f in LINK))
    return F.coalesce(F.transform(F.filter(several, lambda x: kind(x) == "OBJECT"), link), F.array().cast("array<struct<source: string, finding: string, conclusion: string>>"))


def pairs_of(value: Column) -> Column:
    """array<struct<name, score>> of risk dimensions that came as an object of scores or as a list of named ones."""
    of_map = F.transform(F.map_entries(F.try_variant_get(value, "$", "map<string, variant>")), lambda e: F.struct(e["key"].alias("name"), F.try_variant_get(e["value"], "$", "double").alias("score")))
    of_list = F.transform(F.filter(F.try_variant_get(value, "$", "array<variant>"), lambda x: kind(x) == "OBJECT"), lambda x: F.struct(F.try_variant_get(x, "$.name", "string").alias("name"), F.try_variant_get(x, "$.score", "double").alias("score")))
    return F.when(kind(value) == "OBJECT", of_map).when(kind(value) == "ARRAY", of_list)


def normalised(raw: Column, request: Column, now: Column, known_refs: Column | None = None) -> Column:
    """struct of the contract's fields, with `error` (not_json, not_object, or the derived field that was reported) and `dropped` (fields of no contract).

    What is missing: claim_id is the request's id, reviewed_by the model, timestamp now, lists are empty, extracted_data is
    an empty object and risk_score neutral; a field that is there keeps its value, null too.  A reason for manual review only
    stays with that verdict.  known_refs: an array of rules; references to others are left out.
    """

    def of(v: Column) -> Column:
        whole = F.when(kind(v) == "OBJECT", v)
        keys = F.when(whole.isNotNull(), F.map_keys(F.try_variant_get(v, "$", "map<string, variant>")))
        return _let(F.struct(whole.alias("v"), keys.alias("keys"), v.isNull().alias("none")), lambda x: _shaped(x["v"], x["keys"], x["none"], request, now, known_refs))

    return _let(F.try_parse_json(raw), of)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """What body makes of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _shaped(whole: Column, keys: Column, none: Column, request: Column, now: Column, known_refs: Column | None) -> Column:
    has = lambda f: F.array_contains(keys, f)
    field = lambda f: F.try_variant_get(whole, f"$.{f}", "variant")
    reported = F.filter(F.array(*map(F.lit, DERIVED)), lambda f: F.array_contains(keys, f))
    error = F.when(none, "not_json").when(whole.isNull(), "not_object").when(F.size(reported) > 0, F.get(reported, F.lit(0)))
    missing = {"claim_id": F.coalesce(request, F.lit(UNKNOWN_CLAIM)), "reviewed_by": F.lit(REVIEWER), "timestamp": now, "risk_score": F.lit(float(NEUTRAL_RISK))}
    out = {f: F.try_variant_get(whole, f"$.{f}", t) for f, t in PLAIN}
    out |= {f: F.when(has(f), out[f]).otherwise(value) for f, value in missing.items()}
    out["manual_review_reason"] = F.when(out["verdict"] == MANUAL, out["manual_review_reason"])
    for f in ("reasons", "policy_refs"):
        out[f] = F.when(has(f), lines_of(field(f))).otherwise(F.array().cast("array<string>"))
    if known_refs is not None:
        out["policy_refs"] = F.filter(out["policy_refs"], lambda r: F.array_contains(known_refs, r))
    out["evidence_chain"] = links_of(field("evidence_chain"))
    out["risk_dimensions"] = pairs_of(field("risk_dimensions"))
    out["extracted_data"] = F.when(has("extracted_data"), field("extracted_data")).otherwise(F.parse_json(F.lit("{}")))
    dropped = F.array_sort(F.array_except(keys, F.array(*map(F.lit, (*FIELDS, *DERIVED)))))
    fine = F.when(error.isNull(), F.struct(*(out[f].alias(f) for f in FIELDS)))
    return F.struct(fine.alias("fields"), error.alias("error"), dropped.alias("dropped"))


def patched(value: Column, path: list[str], new: Column) -> Column:
    """A variant with one field set, all others as they are; what isn't an object on the way to it becomes one."""
    fields = F.coalesce(F.try_variant_get(value, "$", "map<string, variant>"), F.create_map().cast("map<string, variant>"))
    key, *rest = path
    inner = patched(F.try_variant_get(value, f"$.{key}", "variant"), rest, new) if rest else new
    others = F.map_filter(fields, lambda k, _: k != key)
    return F.to_variant_object(F.map_concat(others, F.create_map(F.lit(key), inner)))
