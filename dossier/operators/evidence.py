"""Evidence of review items: text that follows a hit, budgets dealt by tiers, corrected pages, rendered drafts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chunks import anchor_text
from .search import grams
from .spans import even

# Fixed value: a quote of fewer characters isn't looked up.
LEAST_QUOTE = 8


def continued(chunks: DataFrame, keys: list[str], order: str, size: str, hit: Column, substance: Column, family: Column, depth: Column, budget: int) -> DataFrame:
    """(keys, hit_at, order): the chunks that follow each hit in its document, up to the next hit of any item.

    A hit and what follows it are taken until their sizes reach the budget; chunks without substance are passed over.  Where
    the document ends before either, the next heading of the hit's own family that isn't deeper ends it, and nothing follows a
    hit without a heading (null family).  order has to be unique within a document.
    """
    d = chunks.select(*keys, order, F.col(size).alias("__size"), F.coalesce(hit, F.lit(False)).alias("__hit"), F.coalesce(substance, F.lit(False)).alias("__sub"), family.alias("__family"), depth.alias("__depth"))
    file = Window.partitionBy(*keys)
    d = d.withColumn("hit_at", F.last(F.when(F.col("__hit"), F.col(order)), ignorenulls=True).over(file.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("__final", F.max("hit_at").over(file) == F.col("hit_at")).where(F.col("hit_at").isNotNull())
    whole = Window.partitionBy(*keys, "hit_at")
    so_far = whole.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    counted = F.sum(F.when(F.col("__hit") | F.col("__sub"), F.col("__size")).otherwise(0))
    d = d.withColumn("__used", counted.over(so_far) - F.when(F.col("__hit") | F.col("__sub"), F.col("__size")).otherwise(0)).withColumn("__all", counted.over(whole))
    d = d.withColumn("__own", F.first(F.struct("__family", "__depth")).over(so_far))
    ends = ~F.col("__hit") & F.col("__sub") & (F.col("__family") == F.col("__own.__family")) & (F.col("__depth") <= F.col("__own.__depth"))
    d = d.withColumn("__past", F.sum(F.when(ends, 1).otherwise(0)).over(so_far))
    bounded = ~F.col("__final") | (F.col("__all") >= budget)
    by_layout = F.col("__own.__family").isNotNull() & (F.col("__past") == 0)
    return d.where(~F.col("__hit") & F.col("__sub") & (F.col("__used") < budget) & (bounded | by_layout)).select(*keys, "hit_at", order)


def allocated(df: DataFrame, keys: list[str], order: str, tier: str, size: str, budget: int) -> DataFrame:
    """(keys, order, kept): how much of each chunk a budget holds.

    Lower tiers take what they need, in order; the last one shares what they leave, each chunk an even part of what is left by
    then, as a fold over the sizes of a draft's last tier.  order has to be unique within a draft.
    """
    before = F.coalesce(F.sum(size).over(Window.partitionBy(*keys).orderBy(tier, order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = df.select(*keys, order, F.col(size).cast("long").alias("__size"), F.greatest(budget - before, F.lit(0)).cast("long").alias("__left"), (F.col(tier) == F.max(tier).over(Window.partitionBy(*keys))).alias("__last"))
    first = d.where("NOT __last").select(*keys, order, F.least("__size", "__left").alias("kept"))
    rest = d.where("__last").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("__size").alias("s")))).alias("__rows"), F.max("__left").alias("__left"))
    dealt = rest.withColumn("__kept", even(F.col("__rows.s"), F.col("__left")))
    each = dealt.select(*keys, F.explode(F.zip_with("__rows", "__kept", lambda a, b: F.struct(a["o"].alias("o"), b.alias("k")))).alias("__e"))
    return first.unionByName(each.select(*keys, F.col("__e.o").alias(order), F.col("__e.k").alias("kept")))


def corrected_pages(citations: DataFrame, pages: DataFrame, keys: list[str], file: str, page: str, quote: str, text: str) -> DataFrame:
    """citations with `page` put right and `status`: page_ok, page_corrected or page_unverified.

    A quote that its page doesn't hold goes to the only page of the named file that does; with none or several, with a page
    that is null or a quote of under eight characters it is unverified and keeps its page.  Pages are found by an equality
    join of a quote's first eight characters.  keys have to be unique.
    """
    first = lambda c: F.xxhash64(F.substring(c, 1, LEAST_QUOTE))
    asked = citations.where((F.length(quote) >= LEAST_QUOTE) & F.col(page).isNotNull()).select(*dict.fromkeys([*keys, file]), F.col(page).alias("__cited"), F.col(quote).alias("__quote"), first(quote).alias("__gram"))
    texts = pages.select(file, F.col(page).alias("__at"), F.col(text).alias("__text"))
    places = texts.select(file, "__at", F.explode(F.array_distinct(grams(F.col("__text"), LEAST_QUOTE))).alias("__gram"))  # no text beside its grams
    some = places.join(asked.select(file, "__gram").distinct(), [file, "__gram"], "left_semi").distinct()
    held = asked.join(some, [file, "__gram"]).drop("__gram").join(texts, [file, "__at"]).where(F.col("__text").contains(F.col("__quote")))
    found = held.groupBy(*keys).agg(F.min("__at").alias("__low"), F.max("__at").alias("__high"), F.bool_or(F.col("__at") == F.col("__cited")).alias("__there"))
    d = citations.join(found, keys, "left")
    status = F.when(F.col("__there"), "page_ok").when(F.col("__low") == F.col("__high"), "page_corrected").otherwise("page_unverified")
    return d.withColumn("status", status).withColumn(page, F.when(F.col("status") == "page_corrected", F.col("__low")).otherwise(F.col(page))).drop("__low", "__high", "__there")


def table_text(name: Column, rows: Column) -> Column:
    """A table as lines: its name, if it has one, then its rows with tabs between the cells."""
    lines = F.transform(rows, lambda r: F.array_join(r, "\t", ""))
    head = F.when(F.length(name) > 0, F.array(F.concat(F.lit("[表: "), name, F.lit("]")))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(head, lines), "\n")


def rendered(pages: DataFrame, tables: DataFrame, keys: list[str], page: str, text: str, order: str, name: str, rows: str) -> DataFrame:
    """(keys, body): a document's pages below their anchors, each with its own tables; tables without a page come last.

    Pages without text and tables are left out, and the others keep their numbers.
    """
    listed = lambda kept: F.array_join(F.transform(F.array_sort(F.collect_list(kept)), lambda t: t["t"]), "\n")
    told = tables.select(*keys, F.col(page), F.struct(F.col(order).alias("o"), table_text(F.col(name), F.col(rows)).alias("t")).alias("__t"))
    own = told.where(F.col(page).isNotNull()).groupBy(*keys, page).agg(listed(F.col("__t")).alias("__tables"))
    has_text = F.col(text).rlike(r"(?U)\S")
    body = F.concat_ws("\n", F.when(has_text, F.col(text)), F.col("__tables"))
    anchor = anchor_text(F.col(page), F.lit(None).cast("int"), F.lit(False))
    parts = pages.join(own, [*keys, page], "left").where(has_text | F.col("__tables").isNotNull()).select(*keys, F.struct(F.col(page).alias("o"), F.concat(anchor, F.lit("\n"), body).alias("t")).alias("__t"))
    whole = parts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list("__t")), lambda t: t["t"]).alias("__parts"))
    tail = told.where(F.col(page).isNull()).groupBy(*keys).agg(listed(F.col("__t")).alias("__tail"))
    return whole.join(tail, keys, "full").select(*keys, F.concat_ws("\n\n", "__parts", "__tail").alias("body"))
