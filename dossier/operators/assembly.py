"""Evidence of a case: what its items ask for, how a search went, and blocks taken in order under shared budgets."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

# Fixed values of the wording.
ORIGINS = {"tender": "招标文件", "bid": "投标文件"}
RULE_PREFIX, HEAD, CHAPTER = "资格审查:", "### 文件: ", "【章节: {}】"


def item_queries(rules: Column, items: Column) -> Column:
    """array<struct<item, queries>>: rules by check and requirement, then items by name, category and basis; without a name, none."""
    said = lambda c: F.trim(F.coalesce(c, F.lit("")))
    asked = lambda *cs: F.filter(F.array(*map(said, cs)), lambda q: q != "")
    of_rules = F.transform(F.filter(rules, lambda r: said(r["check"]) != ""), lambda r: F.struct(F.concat(F.lit(RULE_PREFIX), said(r["check"])).alias("item"), asked(r["check"], r["requirement"]).alias("queries")))
    of_items = F.transform(F.filter(items, lambda i: said(i["item"]) != ""), lambda i: F.struct(said(i["item"]).alias("item"), asked(i["item"], i["category"], i["basis"]).alias("queries")))
    empty = F.array().cast("array<struct<item: string, queries: array<string>>>")
    return F.concat(F.coalesce(of_rules, empty), F.coalesce(of_items, empty))


def trails(items: dict[str, list[str]], rounds: list[DataFrame], labels: list[str]) -> DataFrame:
    """(item, found, tried): the queries that were tried for each item, with the label of their round, up to the one that finds any.

    rounds: results of a search, (query, ...), as in search.first_winning.
    """
    spark = rounds[0].sparkSession
    steps = [(i, q.strip(), n, turn, len(qs) * n + turn, q.strip() + label) for i, qs in items.items() for n, label in enumerate(labels) for turn, q in enumerate(qs)]
    asked = F.broadcast(spark.createDataFrame(steps, "item string, query string, round int, turn int, step int, said string"))  # a row for each query and round
    every = reduce(DataFrame.unionByName, (r.select("query", F.lit(n).alias("round")).distinct().withColumn("hit", F.lit(True)) for n, r in enumerate(rounds)))
    d = asked.join(every, ["query", "round"], "left").groupBy("item").agg(F.min(F.when(F.col("hit"), F.col("step"))).alias("first"), F.array_sort(F.collect_list(F.struct("step", "said"))).alias("steps"))
    some = F.filter("steps", lambda s: F.col("first").isNull() | (s["step"] <= F.col("first")))
    return d.select("item", F.col("first").isNotNull().alias("found"), F.transform(some, lambda s: s["said"]).alias("tried"))


def assembled(items: DataFrame, candidates: DataFrame, keys: list[str], item: str, order: list[str], chunk: str, size: str, per_item: int, in_all: int) -> DataFrame:
    """(keys, item, state, tokens, blocks): what each item of a case gets of its candidates.

    Items go in order, each through its candidates in the order of the columns `order`: one that an item of the case has taken
    already is in evidence and costs nothing; an item ends before the first one that would take it over per_item (its
    own first is exempt) or all items over in_all.  state: unresolved without candidates, truncated with candidates of
    which none is in evidence, else ok.  Tokens of all items are what is used of in_all.

    What an item gets depends on all that was taken before in the case, so each case is gone through in one task, row by row,
    as numbers without any text; what is held of it is the set of its chunks.  items: a row for each item, not null.  Null keys
    are a case; sizes that are null count as 0.
    """
    plain = candidates.select(*keys, item, *(F.col(c).alias(f"__o{k}") for k, c in enumerate(order)), F.col(chunk).cast("string").alias("__chunk"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("__size"))
    same = reduce(Column.__and__, (F.col(f"i.{k}").eqNullSafe(F.col(f"c.{k}")) for k in [*keys, item]))
    rows = items.select(*keys, item).alias("i").join(plain.alias("c"), same, "left").select("i.*", *(f"c.__o{k}" for k in range(len(order))), "c.__chunk", "c.__size")
    blocks = "array<struct<chunk: string, tokens: bigint>>"
    schema = items.select(*keys, item).withColumns({"state": F.lit(""), "tokens": F.lit(0).cast("long"), "blocks": F.lit(None).cast(blocks)}).schema
    n = len(keys)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        case, own, seen, used = None, None, set(), 0

        def told(done: list[dict]) -> pa.RecordBatch:
            states = ["ok" if o["held"] else "truncated" if o["asked"] else "unresolved" for o in done]
            columns = [[o["names"][k] for o in done] for k in range(n + 1)] + [states, [o["tokens"] for o in done], [o["blocks"] for o in done]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, to_arrow_schema(schema), strict=True)], names=[f.name for f in schema])

        for batch in batches:
            done = []
            for *names, one, cost in zip(*(batch.column(k).to_pylist() for k in (*range(n + 1), n + 1 + len(order), n + 2 + len(order))), strict=True):
                if own is None or own["names"] != names:
                    done += [own] if own else []
                    own = {"names": names, "tokens": 0, "blocks": [], "held": False, "asked": False, "full": False}
                    if case != names[:n]:
                        case, seen, used = names[:n], set(), 0
                if cost is None or own["full"]:
                    continue
                own["asked"] = True
                if one in seen:
                    own["held"] = True
                elif (own["tokens"] and own["tokens"] + cost > per_item) or used + cost > in_all:
                    own["full"] = True
                else:
                    seen.add(one)
                    used += cost
                    own["tokens"] += cost
                    own["held"] = True
                    own["blocks"].append({"chunk": one, "tokens": cost})
            yield told(done)
        yield told([own] if own else [])

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, item, *(f"__o{k}" for k in range(len(order))))
    return dealt.mapInArrow(fold, schema)


def block_text(scope: Column, file: Column, anchor: Column, chapter: Column, text: Column) -> Column:
    """A chunk as a piece of a draft that stands by itself: its side, file, page (where it is known), chapter and text."""
    origin = F.when(scope == "tender", ORIGINS["tender"]).otherwise(ORIGINS["bid"])
    before, after = CHAPTER.split("{}")
    lines = [F.concat(F.lit("=== "), origin, F.lit("底稿 ===")), F.concat(F.lit(HEAD), F.coalesce(file, origin)), F.when(anchor.rlike("^【.*第 [0-9]+.* 页】$"), anchor), F.concat(F.lit(before), chapter, F.lit(after)), text]
    return F.concat_ws("\n", *lines)


def gate(has_items: Column, chunks: Column, cause: Column, ledger: Column) -> Column:
    """struct<state, manual>: what becomes of a case, and whether people have to look at it.

    has_items: whether anything can be searched for; chunks: of its own side in the index; cause: why there is no plan
    (null: there is one); ledger: array of assembled's rows.
    """
    some = lambda state: F.exists(ledger, lambda r: r["state"] == state)
    nothing = ~F.coalesce(F.exists(ledger, lambda r: F.size(r["blocks"]) > 0), F.lit(False))
    state = (
        F.when(~F.coalesce(has_items, F.lit(False)), "skipped").when(F.coalesce(chunks, F.lit(0)) == 0, "unavailable").when(cause.isNotNull(), "exhausted").when(nothing, "all_unresolved")
        .when(some("unresolved") | some("truncated"), "warnings").otherwise("ok")
    )
    return F.struct(state.alias("state"), state.isin("unavailable", "exhausted", "all_unresolved").alias("manual"))
