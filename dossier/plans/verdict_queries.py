"""Verdict, budget, chapter and tree queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossier.operators import budget, chapters, trees, verdicts

from .registry import Registry, Tables

_r = Registry()
QUERIES, ORACLE_SQL = _r.queries, _r.sql


@_r.add("""SELECT o_orderkey, o_orderstatus = 'F' AS result, CASE o_orderstatus WHEN 'F' THEN '合规' WHEN 'O' THEN '不合规' ELSE '待人工复核' END AS conclusion FROM orders""")
def verdict_labels(t: Tables) -> DataFrame:
    verdict = F.when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderstatus") == "O", "rejected").otherwise("manual_review")
    return t("orders").select("o_orderkey", verdicts.decision(verdict).alias("d")).select("o_orderkey", "d.result", "d.conclusion")


@_r.add("""SELECT l_orderkey, l_linenumber, n AS name, CAST(greatest(0, least(10, round_even(CASE WHEN x > 10 THEN x / 10 ELSE x END, 0))) AS INTEGER) AS score
FROM (SELECT l_orderkey, l_linenumber, unnest(['amount', 'budget']) AS n, unnest([l_quantity / 2, l_discount * 100 - 3]) AS x FROM lineitem)""")
def risk_dimension_scores(t: Tables) -> DataFrame:
    pairs = F.array(*(F.struct(F.lit(n).alias("name"), x.alias("score")) for n, x in (("amount", F.col("l_quantity") / 2), ("budget", F.col("l_discount") * 100 - 3), (" ", F.lit(1.0)))))
    d = t("lineitem").select("l_orderkey", "l_linenumber", F.explode(verdicts.risk_dimensions(pairs)).alias("d"))
    return d.select("l_orderkey", "l_linenumber", "d.name", "d.score")


@_r.add("""SELECT l_orderkey, CASE WHEN count(*) = count(p) THEN round(sum(p), 6) END AS total FROM
(SELECT l_orderkey, CASE WHEN l_returnflag <> 'R' THEN l_tax END AS p FROM lineitem) GROUP BY l_orderkey""")
def hit_field_sum(t: Tables) -> DataFrame:
    points = F.collect_list(F.struct("l_linenumber", F.when(F.col("l_returnflag") != "R", F.col("l_tax")).alias("p")))
    d = t("lineitem").groupBy("l_orderkey").agg(points.alias("hits"))
    return d.select("l_orderkey", F.round(verdicts.hits_total(F.transform("hits", lambda h: h["p"])), 6).alias("total"))


@_r.add("""SELECT l_orderkey, bool_or((l_linestatus = 'O' AND l_quantity >= 45 AND l_returnflag <> 'N') OR (l_linestatus = 'O' AND l_quantity < 2)) AS rejected FROM lineitem GROUP BY l_orderkey""")
def disqualification_gate(t: Tables) -> DataFrame:
    """Open lines of 45 or more are hits, unconfirmed ones with flag N; open lines of less than 2 are failed checks."""
    is_open = F.col("l_linestatus") == "O"
    hit = F.when(is_open & (F.col("l_quantity") >= 45), F.create_map(F.lit("quote"), F.col("l_returnflag"), F.lit("confirmed"), F.when(F.col("l_returnflag") != "N", "true").otherwise("疑似")))
    check = F.when(is_open & (F.col("l_quantity") < 2), " FAIL").otherwise("pass")
    d = t("lineitem").groupBy("l_orderkey").agg(F.collect_list(hit).alias("hits"), F.collect_list(check).alias("checks"))
    return d.select("l_orderkey", verdicts.hard_disqualification(F.col("hits"), F.col("checks")).alias("rejected"))


@_r.add("""SELECT l_orderkey, array_to_string(list_sort(list(CAST(l_linenumber AS VARCHAR)) FILTER (WHERE l_discount * 100 > l_quantity)), ',') AS bad FROM lineitem
GROUP BY l_orderkey HAVING count(*) FILTER (WHERE l_discount * 100 > l_quantity) > 0""")
def score_range_check(t: Tables) -> DataFrame:
    item = F.struct(F.col("l_linenumber").cast("string").alias("item"), (F.col("l_discount") * 100).alias("score"), F.col("l_quantity").alias("max"))
    d = t("lineitem").groupBy("l_orderkey").agg(verdicts.out_of_range(F.collect_list(item)).alias("bad"))
    return d.where(F.size("bad") > 0).select("l_orderkey", F.array_join(F.array_sort("bad"), ",").alias("bad"))


@_r.add("""WITH b AS (SELECT p_partkey, 60000 - CAST(p_retailprice * 50 AS BIGINT) AS e, p_size + 1 AS q FROM part), c AS (SELECT *, CASE WHEN e < 8000 THEN CASE WHEN e + 90000 >= 8000 THEN 'reserve_too_large' ELSE 'window_too_small' END END AS cause FROM b)
SELECT p_partkey, CASE WHEN cause IS NULL THEN CAST(e // q AS BIGINT) END AS per_item, CASE WHEN cause IS NULL THEN CAST(e // q * q AS BIGINT) END AS evidence, CASE WHEN cause IS NULL THEN CAST(greatest(1, e // q // 4000) AS BIGINT) END AS chunks_per_item, cause FROM c""")
def injection_plan(t: Tables) -> DataFrame:
    criteria = F.round(F.col("p_retailprice") * 50).cast("long")
    d = t("part").select("p_partkey", budget.plan(criteria, F.col("p_size") + 1, F.lit(8000)).alias("b"))
    return d.select("p_partkey", "b.*")


@_r.add("""SELECT l_orderkey, l_linenumber FROM (SELECT *, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) AS s FROM lineitem) WHERE s <= 60""")
def running_budget(t: Tables) -> DataFrame:
    d = t("lineitem").withColumn("place", F.struct("l_linenumber", "l_partkey", "l_suppkey"))
    return budget.within(d, ["l_orderkey"], "place", "l_quantity", 60).select("l_orderkey", "l_linenumber")


@_r.add("""SELECT l_suppkey, amount FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY amount DESC) AS r FROM (SELECT DISTINCT l_suppkey, l_extendedprice AS amount FROM lineitem)) WHERE r <= 8""")
def top_distinct_amounts(t: Tables) -> DataFrame:
    d = t("lineitem").select("l_suppkey", F.col("l_extendedprice").alias("amount")).distinct()
    return d.withColumn("r", F.row_number().over(Window.partitionBy("l_suppkey").orderBy(F.desc("amount")))).where("r <= 8").drop("r")


@_r.add("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events), h AS (SELECT user_id, event_id, k, event_type FROM e WHERE event_type <> 'view'),
g AS (SELECT *, k - row_number() OVER (PARTITION BY user_id, event_type ORDER BY k) AS run, coalesce(lead(k) OVER (PARTITION BY user_id ORDER BY k) <> k + 1, true) AS opens FROM h),
n AS (SELECT *, count(*) OVER w AS size, max(k) OVER w AS last FROM g WINDOW w AS (PARTITION BY user_id, event_type, run))
SELECT user_id, event_id FROM n WHERE NOT (size >= 3 AND NOT (k = last AND opens))""")
def contents_lines_removed(t: Tables) -> DataFrame:
    """Events as lines of their user, kinds as levels; views are plain text."""
    d = t("events").withColumn("line_no", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    headings = d.where("event_type <> 'view'").select("user_id", "event_id", "line_no", F.col("event_type").alias("level"))
    return chapters.without_contents(headings, ["user_id"]).select("user_id", "event_id")


@_r.add("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS value FROM orders")
def date_entities(t: Tables) -> DataFrame:
    """Order dates, written without leading zeros in a sentence, found in it again."""
    told = F.concat(F.lit("于"), F.date_format("o_orderdate", "yyyy年M月d日"), F.lit("签订 12 份"))
    return t("orders").select("o_orderkey", F.explode(chapters.iso_dates(told)).alias("value"))


@_r.add("""WITH RECURSIVE up AS (SELECT p_partkey AS a, p_partkey AS d FROM part UNION ALL SELECT p.p_partkey, u.d FROM up u JOIN part p ON p.p_partkey = u.a // 2 WHERE u.a // 2 > 0)
SELECT a AS id, CAST(count(*) - 1 AS BIGINT) AS descendants FROM up GROUP BY a""")
def descendant_counts(t: Tables) -> DataFrame:
    """Parts as a tree in which part k hangs below part k div 2."""
    nodes = t("part").select("p_partkey", F.expr("nullif(p_partkey div 2, 0)").alias("parent"))
    return trees.descendant_counts(trees.closure(nodes, "p_partkey", "parent"))
