"""Record stores: filters, ordered pages, latest rows, and state changes as new snapshots of a table."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Order = list[tuple[str, bool]]  # column, descending


def ordering(order: Order) -> list[Column]:
    """Nulls first ascending and last descending, as the record stores sort."""
    return [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_first() for c, down in order]


def matching(df: DataFrame, filters: dict[str, object], blank_is_any: bool = True) -> DataFrame:
    """Rows equal to every filter; None (and, if asked, the empty string) sets no filter."""
    used = {k: v for k, v in filters.items() if v is not None and not (blank_is_any and v == "")}
    return df.where(reduce(and_, (F.col(k) == F.lit(v) for k, v in used.items()))) if used else df


def page(df: DataFrame, order: Order, limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*ordering(order)).offset(offset).limit(limit)


def first_per(df: DataFrame, keys: list[Column | str], order: Order) -> DataFrame:
    """The first row of each key in the given order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*ordering(order)))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def blank_to_null(c: str) -> Column:
    return F.nullif(F.trim(F.col(c)), F.lit(""))


def first_filled(*columns: str) -> Column:
    """The first column that is neither null nor empty."""
    return F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in columns))


def last_of(rows: DataFrame, keys: list[str], order: str | None) -> DataFrame:
    """One row of each key: the last in the given order (any of them without one)."""
    return first_per(rows, keys, [(order, True)]) if order else rows.dropDuplicates(keys)


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Rows replace those with the same key; of several rows of a key the last in the given order."""
    new = last_of(rows, keys, order)
    return table.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*table.columns))


def upsert_keeping(table: DataFrame, rows: DataFrame, keys: list[str], keep: list[str], order: str | None = None) -> DataFrame:
    """Rows replace those with the same key, but for columns that keep what was first written."""
    new = last_of(rows, keys, order)
    old = table.select(*keys, *(F.col(c).alias(f"__{c}") for c in keep))
    new = new.join(old, keys, "left").select(*(F.coalesce(f"__{c}", c).alias(c) if c in keep else F.col(c) for c in table.columns))
    return table.join(new.select(*keys), keys, "left_anti").unionByName(new)


def merge_upsert(table: DataFrame, rows: DataFrame, keys: list[str], provided: list[str], order: str | None = None) -> DataFrame:
    """Only the provided columns are written, nulls too; other columns of a known row stay.  Of several rows of a key the last counts."""
    own = last_of(rows, keys, order).select(*keys, F.lit(True).alias("__new"), *(F.col(c).alias(f"__{c}") for c in provided))
    joined = table.join(own, keys, "full")
    value = lambda c: F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in provided else F.col(c)
    return joined.select(*(F.col(c) if c in keys else value(c) for c in table.columns))


def transition(table: DataFrame, who: Column, updates: dict[str, Column]) -> tuple[DataFrame, Column]:
    """Compare and set: columns change where `who` holds; also whether a row is changed."""
    hit = F.coalesce(who, F.lit(False))
    return table.select(*(F.when(hit, updates[c]).otherwise(F.col(c)).alias(c) if c in updates else F.col(c) for c in table.columns)), hit


def fill_if_empty(table: DataFrame, rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The first writer wins: only null or empty values are replaced."""
    own = rows.select(*keys, *(F.col(c).alias(f"__{c}") for c in columns))
    joined = table.join(own, keys, "left")
    return joined.select(*(F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"__{c}")).alias(c) if c in columns else F.col(c) for c in table.columns))


def get_or_create(table: DataFrame, rows: DataFrame, key: list[str], nullable: str, order: str | None = None) -> DataFrame:
    """Rows whose key is new, one of each key; those without the nullable part of the key (null or blank) are always new."""
    named = F.trim(F.coalesce(F.col(nullable).cast("string"), F.lit(""))) != ""
    known = table.select(*key).distinct()
    new = last_of(rows.where(named), key, order).join(known, key, "left_anti")
    return new.unionByName(rows.where(~named))


def cascade(parent: DataFrame, key: str, gone: DataFrame, children: list[tuple[DataFrame, str]]) -> tuple[DataFrame, list[DataFrame]]:
    """The parent and child tables without the rows of the keys in `gone`."""
    drop = lambda t, k: t.join(gone.select(F.col(key).alias(k)), k, "left_anti")
    return drop(parent, key), [drop(t, k) for t, k in children]


def cascade_counts(gone: DataFrame, tables: list[tuple[str, DataFrame, str, str | None]]) -> DataFrame:
    """(name, n): rows that each table loses with the rows of `gone`, level by level.

    tables: name, table, its column that names a row of the level above, and the column that the level below names (None: the same level goes on).
    """
    out, keys = None, gone
    for name, table, parent, own in tables:
        lost = table.join(keys.toDF(parent).distinct(), parent, "left_semi")
        n = lost.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = n if out is None else out.unionAll(n)
        keys = lost.select(own) if own else keys
    return out


def replaced_parts(table: DataFrame, rows: DataFrame, part: str) -> DataFrame:
    """All rows of the parts that are given anew give way to them; doing it twice changes nothing."""
    return table.join(rows.select(part).distinct(), part, "left_anti").unionByName(rows.select(*table.columns))


def retained(df: DataFrame, finished: Column, at: str, now: Column, days: int) -> DataFrame:
    """Rows that aren't finished or not older than so many days."""
    return df.where(~(F.coalesce(finished, F.lit(False)) & F.coalesce(F.col(at) < now - F.make_dt_interval(F.lit(days)), F.lit(False))))


def not_worse(old: DataFrame, new: DataFrame, keys: list[str], text: str, status: str, ranks: dict[str, int]) -> DataFrame:
    """The new version of each row where its text isn't blank and its status ranks no lower; the old one else, or where there is no other."""
    rank = lambda c: F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in ranks.items() for x in kv)), F.col(c)), F.lit(-1))
    rest = [c for c in old.columns if c not in keys]
    d = old.select(*keys, F.struct(*rest).alias("__old")).join(new.select(*keys, F.struct(*rest).alias("__new")), keys, "full")
    good = F.col("__old").isNull() | ((F.trim(F.coalesce(F.col(f"__new.{text}"), F.lit(""))) != "") & (rank(f"__new.{status}") >= rank(f"__old.{status}")))
    kept = d.select(*keys, F.when(F.col("__new").isNotNull() & good, F.col("__new")).otherwise(F.col("__old")).alias("r"))
    return kept.select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))


def first_authority(df: DataFrame, keys: list[str], able: Column, value: str, at: str) -> DataFrame:
    """The value of the first row of each key that may define it; null where none may."""
    return df.groupBy(*keys).agg(F.min_by(F.when(able, F.col(value)), F.when(able, F.col(at))).alias(value))


def changed_prints(before: DataFrame, now: DataFrame, key: str, parts: list[str]) -> DataFrame:
    """(key, state) of entries whose parts changed: added, removed or changed."""
    a, b = (d.select(key, F.sha2(F.concat_ws("\x1f", *parts), 256).alias(p)) for d, p in ((before, "__a"), (now, "__b")))
    state = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(F.col("__a") != F.col("__b"), "changed")
    return a.join(b, key, "full").select(key, state.alias("state")).where("state is not null")


def one_of(c: Column, allowed: tuple[str, ...]) -> Column:
    """The value, if it is allowed; an error else."""
    return F.when(c.isin(*allowed), c).otherwise(F.raise_error(F.concat(F.lit("not a known value: "), F.coalesce(c, F.lit("null")))))


def union_first_wins(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.unionByName(b.join(a.select(*keys), keys, "left_anti"))
