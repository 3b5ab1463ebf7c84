"""Bills of quantities: the amounts that matter of a long priced bill, as a few ranked entries."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chunks import anchor_text
from .drafts import ANCHOR, CARRY_LINES, anchor_page

# Words of totals, shapes of amounts, and what counts for and against a candidate.
TOTAL = "投标总价"
SUBTOTALS = ("分部分项合计", "单价措施合计", "措施项目", "其他项目", "规费", "税金", "合计", "总计", "价款")
PARTIAL = ("单位工程", "税金", "分部分项", "措施", "规费")
IN_FIGURES = "小写"
EXACT = r"[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|[0-9]+\.[0-9]{1,2}"
LOOSE = EXACT + r"|[0-9]{5,}"
CAPITALS = r"[壹贰叁肆伍陆柒捌玖零拾佰仟万亿圆元角分整]{4,}"
AHEAD, BEHIND, FIRST_PAGES = 3, 2, 5
MOST = {"total": 6, "subtotal": 12, "amount": 8}


def _has(c: Column, words: tuple[str, ...]) -> Column:
    return reduce(or_, (c.contains(w) for w in words))


def _value(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit("")).cast("double")


def amounts(line: Column, pattern: str) -> Column:
    return F.regexp_extract_all(line, F.lit(pattern), F.lit(0))


def entries(lines: DataFrame, keys: list[str], order: str, line: str, most: dict[str, int] = MOST) -> DataFrame:
    """(keys, kind, place, n, page, value, amount, text, capitals, score): candidates for the total, subtotals and highest amounts of bills.

    A total's amount is the largest near its line, a subtotal's the first: on the line itself, the three lines with text
    after it, then the two before.  Candidates are ranked by score, the others by value, each amount's value once; ties go to the
    first line.  The chosen total isn't listed among the amounts.  n: all entries of a kind.  A page holds for 300 lines
    after its anchor.  All that is needed of a bill is dealt once, by its keys; a bill is sorted by one task, and lists are
    cut to `most` before they are gathered.
    """
    file = Window.partitionBy(*keys).orderBy("__at")
    so_far = file.rowsBetween(Window.unboundedPreceding, 0)
    d = lines.select(*keys, F.col(order).alias("__at"), F.coalesce(line, F.lit("")).alias("__line"))
    is_anchor = F.trim("__line").rlike(ANCHOR)
    d = d.withColumns({"__no": F.row_number().over(file), "__context": F.array_join(F.collect_list("__line").over(file.rowsBetween(-2, 2)), " ")})
    marker = F.last(F.when(is_anchor, F.struct("__no", anchor_page(F.col("__line")).alias("page"))), ignorenulls=True).over(so_far)
    d = d.withColumn("__marker", marker).withColumn("__page", F.when(F.col("__no") - F.col("__marker.__no") <= CARRY_LINES, F.col("__marker.page")))
    d = d.where(F.trim("__line") != "")
    near = [F.col("__line"), *(F.lead("__line", k).over(file) for k in range(1, AHEAD + 1)), *(F.lag("__line", k).over(file) for k in range(1, BEHIND + 1))]
    d = d.withColumn("__near", F.array(*near)).where(~is_anchor)

    said = F.trim("__line")
    loose = F.flatten(F.transform(F.array_compact("__near"), lambda x: amounts(x, LOOSE)))
    largest = F.get(F.array_sort(F.transform(loose, lambda a, i: F.struct((-_value(a)).alias("v"), i.alias("i"), a.alias("a")))), F.lit(0))["a"]
    exact = F.get(F.flatten(F.transform(F.array_compact("__near"), lambda x: amounts(x, EXACT))), F.lit(0))
    capitals = F.get(F.filter(F.transform(F.array_compact(F.slice("__near", 1, AHEAD + 1)), lambda x: F.regexp_extract(x, CAPITALS, 0)), lambda x: x != ""), F.lit(0))
    score = F.when(F.col("__page") <= FIRST_PAGES, 3).otherwise(0) + F.when(said.contains(IN_FIGURES), 3).otherwise(0) + F.when(capitals.isNotNull(), 2).otherwise(0) - F.when(_has(F.col("__context"), PARTIAL), 3).otherwise(0)
    none = F.lit(None).cast("string")
    entry = lambda kind, amount, text, part, caps=none, points=F.lit(0): F.struct(F.lit(kind).alias("kind"), part.alias("part"), amount.alias("amount"), _value(amount).alias("value"), text.alias("text"), caps.alias("capitals"), points.cast("int").alias("score"))
    zero = F.lit(0)
    listed = F.concat(
        F.array(entry("total", F.when(said.contains(TOTAL), largest), said, zero, capitals, score)),
        F.array(entry("subtotal", F.when(_has(said, SUBTOTALS), exact), F.substring(said, 1, 40), zero)),
        F.transform(amounts(said, EXACT), lambda a, i: entry("amount", a, F.substring(said, 1, 50), i)),
    )
    e = d.select(*keys, "__at", F.col("__page").alias("page"), F.explode(listed).alias("e")).select(*keys, "__at", "page", "e.*").where("amount is not null")
    # Of the amounts each value once, where it is first; the largest candidate's is left out below.
    once = F.row_number().over(Window.partitionBy(*keys, "kind", "value").orderBy("__at", "part"))
    e = e.withColumn("__once", once).where((F.col("kind") != "amount") | (F.col("__once") == 1))
    by_kind = Window.partitionBy(*keys, "kind")
    rank = F.row_number().over(by_kind.orderBy(F.when(F.col("kind") == "total", F.col("score")).otherwise(F.col("value")).desc(), "__at", "part"))
    e = e.withColumns({"place": rank, "n": F.count("*").over(by_kind)})
    chosen = F.max(F.when((F.col("kind") == "total") & (F.col("place") == 1), F.col("value"))).over(Window.partitionBy(*keys))
    e = e.withColumn("__chosen", chosen)
    same = (F.col("kind") == "amount") & F.coalesce(F.col("value") == F.col("__chosen"), F.lit(False))
    passed = F.sum(same.cast("int")).over(by_kind.orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    e = e.withColumns({"__same": same, "place": F.col("place") - passed}).where(~F.col("__same"))
    limit = reduce(lambda c, k: c.when(F.col("kind") == k, most[k]), list(most)[1:], F.when(F.col("kind") == list(most)[0], most[list(most)[0]]))
    return e.where(F.col("place") <= limit).select(*keys, "kind", "place", "n", "page", "value", "amount", "text", "capitals", "score")


def summary(found: DataFrame, keys: list[str], most_chars: int | None = None) -> DataFrame:
    """(keys, summary): entries as text, each below its page's anchor; bills without a total or subtotal have none."""
    anchor = lambda e: F.when(e["page"].isNull(), "【页未知】").otherwise(anchor_text(e["page"], F.lit(None).cast("int"), F.lit(False)))
    row = F.struct("place", "n", "page", "amount", "text", "capitals", "score")
    rows = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, row))).alias(kind)
    d = found.groupBy(*keys).agg(rows("total"), rows("subtotal"), rows("amount")).where((F.size("total") > 0) | (F.size("subtotal") > 0))
    best = F.get("total", F.lit(0))
    told = F.concat(F.lit("投标总价: "), best["amount"], F.when(best["capitals"].isNotNull(), F.concat(F.lit("  (大写: "), best["capitals"], F.lit(")"))).otherwise(""), F.lit("  [grand total · 候选打分="), best["score"], F.lit("]"))
    others = F.concat(F.lit("投标总价全部候选(供人核): "), F.array_join(F.transform("total", lambda e: F.concat(anchor(e), F.lit("="), e["amount"])), " / "))
    several = F.get("subtotal", F.lit(0))["n"]
    under = lambda c, text: F.flatten(F.transform(c, lambda e: F.array(anchor(e), text(e))))
    parts = F.concat(
        F.when(F.size("total") > 0, F.array(anchor(best), told)).otherwise(F.array().cast("array<string>")),
        F.when(best["n"] > 1, F.array(others)).otherwise(F.array().cast("array<string>")),
        F.when(F.size("subtotal") > 0, F.concat(F.array(F.concat(F.lit("各类合计(共 "), several, F.lit(" 处，列金额最大 "), F.size("subtotal"), F.lit(")："))), under("subtotal", lambda e: F.concat_ws(" ", e["text"], e["amount"])))).otherwise(F.array().cast("array<string>")),
        F.when(F.size("amount") > 0, F.concat(F.array(F.concat(F.lit("Top-"), F.size("amount"), F.lit(" 高价金额(供异常价抽查)："))), under("amount", lambda e: e["text"]))).otherwise(F.array().cast("array<string>")),
    )
    text = F.array_join(parts, "\n")
    return d.select(*keys, (text if most_chars is None else F.substring(text, 1, most_chars)).alias("summary"))
