"""Token and byte budgets: the closed plan of an injection, page chunks and running sums under a cap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the plan.
WINDOW_TOKENS, SCAFFOLD_TOKENS, MARGIN_PARTS, CHUNK_CHARS = 200_000, 90_000, 4, 4_000


def plan(criteria: Column, queries: Column, floor: Column, total: int = WINDOW_TOKENS, scaffold: int = SCAFFOLD_TOKENS) -> Column:
    """struct<per_item, evidence, chunks_per_item, cause>: what is left for evidence, in equal whole parts.

    cause names why there is no plan (the other fields are null then): `reserve_too_large` if it would fit without
    the scaffold's reserve, else `window_too_small`; null where there is one.
    """
    left = F.lit(total - scaffold - total // MARGIN_PARTS) - criteria
    cause = F.when(left < floor, F.when(left + scaffold >= floor, "reserve_too_large").otherwise("window_too_small"))
    each = F.when(cause.isNull(), F.floor(left / queries))
    return F.struct(each.alias("per_item"), (each * queries).alias("evidence"), F.when(each.isNotNull(), F.greatest(F.lit(1), F.floor(each / CHUNK_CHARS))).alias("chunks_per_item"), cause.alias("cause"))


def within(df: DataFrame, keys: list[str], order: str, size: str, cap: int) -> DataFrame:
    """Rows of each key, in order, for as long as the running sum of their sizes stays within the cap."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("__sum", F.sum(size).over(w)).where(F.col("__sum") <= cap).drop("__sum")


def ledger(text: Column, limit: int) -> Column:
    """struct<original_bytes, kept_bytes, limit_bytes> of a text that is cut to a number of UTF-8 bytes."""
    n = F.octet_length(text)
    return F.struct(n.alias("original_bytes"), F.octet_length(head_bytes(text, limit)).alias("kept_bytes"), F.lit(limit).alias("limit_bytes"))


def head_bytes(text: Column, limit: int) -> Column:
    """The longest prefix of at most so many UTF-8 bytes that ends at a character's end."""
    if limit <= 0:
        return F.when(text.isNotNull(), "")
    # A cut character leaves at most three bytes at the end; what validates is the text up to it.
    whole = [F.try_validate_utf8(F.substring(F.encode(text, "UTF-8"), 1, max(limit - k, 0)).cast("string")) for k in range(4)]
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.coalesce(*whole))
