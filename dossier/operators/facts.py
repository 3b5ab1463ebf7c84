"""Labelled facts of drafts: a project's name and code on each side, and whether both sides agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labels in order of preference, what parts them from their values, where a value ends, and shapes of values.
NAMES = ("采购项目名称", "招标项目名称", "项目名称", "工程名称", "标段名称")
CODES = ("采购项目编号", "项目编号", "招标编号", "采购编号", "工程编号", "标段编号", "项目编码")
SEPARATOR, STOP = r"(?U)^(?:[:：]\s*|[|｜\t]+\s*|\s{2,})", r"(?U)\s{2,}|[|｜\t]"
EDGES = " 　\"'“”‘’,，;；。、"
NAME_SIZE, CODE_SIZE, LEAST_INSIDE = (4, 80), (3, 60), 4


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{EDGES}]+|[{EDGES}]+$", "")


def labelled(line: Column, labels: tuple[str, ...]) -> Column:
    """The value after the first label that has one; a label without a separator after it has none."""

    def before_a_label(value: Column) -> Column:
        cut = F.array_min(F.filter(F.array(*(F.instr(value, other) for other in NAMES + CODES)), lambda x: x > 1))
        return F.when(cut.isNull(), value).otherwise(_stripped(F.substring(value, F.lit(1), cut - 1)))

    def after(label: str) -> Column:
        at = F.instr(line, label)
        rest = F.substring(line, at + len(label), F.length(line))
        plain = F.regexp_replace(F.regexp_replace(rest, SEPARATOR, ""), r"(?U)^\s+|\s+$", "")
        short = F.transform(F.array(_stripped(F.split(plain, STOP)[0])), before_a_label)[0]
        return F.when((at > 0) & rest.rlike(SEPARATOR) & (F.length(short) > 0), short)

    return F.coalesce(*map(after, labels))


def side_facts(lines: DataFrame, keys: list[str], order: str, line: str) -> DataFrame:
    """(keys, name, code): the first valid name and code of each draft, null where it has none."""
    name, code = labelled(F.col(line), NAMES), labelled(F.col(line), CODES)
    sized = lambda c, size: F.length(c).between(*size)
    d = lines.select(*keys, F.col(order).alias("__o"), name.alias("__n"), code.alias("__c"))
    good = d.select(*keys, "__o", F.when(sized("__n", NAME_SIZE), F.col("__n")).alias("__n"), F.when(sized("__c", CODE_SIZE) & F.col("__c").rlike(r"(?U)\d") & ~F.col("__c").contains(" "), F.col("__c")).alias("__c"))
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct(F.col("__o"), F.col(c))))[c]
    return good.groupBy(*keys).agg(first("__n").alias("name"), first("__c").alias("code"))


def agree(left: Column, right: Column, inside: bool) -> Column:
    """Whether two normalised values are the same, or with `inside` one is within the other; null where a side has none."""
    known = (F.length(left) > 0) & (F.length(right) > 0)
    within = (F.least(F.length(left), F.length(right)) >= LEAST_INSIDE) & (left.contains(right) | right.contains(left))
    return F.when(known, (left == right) | (within if inside else F.lit(False)))
