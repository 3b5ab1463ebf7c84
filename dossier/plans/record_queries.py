"""Record-store, join, aggregate, window and state-change queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossier.operators import drafts, records, scores

from .registry import Registry, Tables

_r = Registry()
QUERIES, ORACLE_SQL = _r.queries, _r.sql
_NEWEST = [("o_orderdate", True), ("o_orderkey", True)]


@_r.add("SELECT * FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC LIMIT 50 OFFSET 20")
def paged_list(t: Tables) -> DataFrame:
    return records.page(records.matching(t("orders"), {"o_orderstatus": "F", "o_orderpriority": ""}), _NEWEST, 50, 20)


@_r.add("SELECT * FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'")
def filtered_list(t: Tables) -> DataFrame:
    return records.matching(t("orders"), {"o_orderstatus": "O", "o_orderpriority": "1-URGENT", "o_custkey": None})


@_r.add("SELECT * FROM orders WHERE o_orderkey = 7")
def get_by_key(t: Tables) -> DataFrame:
    return records.matching(t("orders"), {"o_orderkey": 7})


@_r.add("""SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END AS submitted FROM orders
ORDER BY coalesce(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END, TIMESTAMP '1995-01-01') DESC, o_orderkey LIMIT 100""")
def coalesce_order_list(t: Tables) -> DataFrame:
    d = t("orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("submitted"))
    return d.orderBy(F.coalesce("submitted", F.lit("1995-01-01").cast("timestamp")).desc(), "o_orderkey").limit(100)


@_r.add("""SELECT user_id, event_id, event_type, value FROM
(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def latest_per_key(t: Tables) -> DataFrame:
    return records.first_per(t("events"), ["user_id"], [("ts", True), ("event_id", True)]).select("user_id", "event_id", "event_type", "value")


@_r.add("""WITH p AS (SELECT * FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC LIMIT 500)
SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM p) WHERE r = 1""")
def latest_after_limit(t: Tables) -> DataFrame:
    """The limit comes before the rows of a key are reduced to the latest."""
    return records.first_per(records.page(t("orders"), _NEWEST, 500), ["o_custkey"], _NEWEST).select("o_custkey", "o_orderkey", "o_totalprice")


@_r.add("""SELECT user_id AS conversation_id, CAST(count(*) AS BIGINT) AS request_count, round(sum(value), 4) AS total_value, min(ts) AS first_ts, max(ts) AS last_ts,
max_by(event_type, row(ts, event_id)) AS latest_type, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS modes FROM events GROUP BY user_id""")
def conversation_summaries(t: Tables) -> DataFrame:
    return t("events").groupBy(F.col("user_id").alias("conversation_id")).agg(
        F.count("*").alias("request_count"), F.round(F.sum("value"), 4).alias("total_value"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.max_by("event_type", F.struct("ts", "event_id")).alias("latest_type"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("modes"),
    )


@_r.add("""SELECT conv_id, CAST(count(*) AS BIGINT) AS turns, max_by(role, turn) AS last_role, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id""")
def conversation_turns(t: Tables) -> DataFrame:
    return t("conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.max_by("role", "turn").alias("last_role"), F.sum(F.length("text")).alias("chars"))


@_r.add("SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL")
def distinct_known_ids(t: Tables) -> DataFrame:
    return t("events").select("user_id").where("user_id is not null").distinct()


@_r.add("SELECT CAST(count(*) AS BIGINT) AS active FROM orders WHERE o_orderstatus NOT IN ('F')")
def count_active(t: Tables) -> DataFrame:
    return t("orders").where(~F.col("o_orderstatus").isin("F")).agg(F.count("*").alias("active"))


@_r.add("""SELECT o_orderkey, coalesce(nullif(c_name, ''), 'unknown') AS name FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def left_lookup_name(t: Tables) -> DataFrame:
    c = t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return t("orders").join(c, "o_custkey", "left").select("o_orderkey", F.coalesce(F.nullif("c_name", F.lit("")), F.lit("unknown")).alias("name"))


@_r.add("""WITH r AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R')
SELECT k AS order_key, 'result' AS origin FROM r UNION ALL SELECT o_orderkey, 'task' FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey NOT IN (SELECT k FROM r)""")
def roster_union_antijoin(t: Tables) -> DataFrame:
    results = t("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("order_key"), F.lit("result").alias("origin")).distinct()
    tasks = t("orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("order_key"), F.lit("task").alias("origin"))
    return records.union_first_wins(results, tasks, ["order_key"])


@_r.add("SELECT * FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def orphan_antijoin(t: Tables) -> DataFrame:
    return t("customer").join(t("orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select(*t("customer").columns)


@_r.add("SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def known_refs_semijoin(t: Tables) -> DataFrame:
    return t("customer").join(t("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select(*t("customer").columns)


@_r.add("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'Z' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders
UNION ALL SELECT o_orderkey + 100000000, 'Z', o_totalprice FROM orders WHERE o_orderkey % 5 = 0""")
def upsert_replace(t: Tables) -> DataFrame:
    base = t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = base.where("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.lit("Z"))
    more = base.where("o_orderkey % 5 = 0").select((F.col("o_orderkey") + 100000000).alias("o_orderkey"), F.lit("Z").alias("o_orderstatus"), "o_totalprice")
    return records.upsert(base, new.unionByName(more), ["o_orderkey"])


@_r.add("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders""")
def merge_upsert(t: Tables) -> DataFrame:
    """A provided null overwrites; a column that isn't provided stays."""
    base = t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    rows = base.where("o_orderkey % 4 = 0").select("o_orderkey", F.lit(None).cast("string").alias("o_orderstatus"))
    return records.merge_upsert(base, rows, ["o_orderkey"], ["o_orderstatus"])


@_r.add("""SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' AND o_totalprice > 100000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
coalesce(o_orderstatus <> 'F' AND o_totalprice > 100000, false) AS changed FROM orders""")
def compare_and_set(t: Tables) -> DataFrame:
    base = t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    who = (F.col("o_orderstatus") != "F") & (F.col("o_totalprice") > 100000)
    after, _ = records.transition(base.withColumn("changed", F.lit(False)), who, {"o_orderstatus": F.lit("X"), "changed": F.lit(True)})
    return after.select("o_orderkey", "o_orderstatus", "changed")


@_r.add("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1996-01-01' THEN 'failed' ELSE o_orderstatus END AS status FROM orders""")
def recover_stale(t: Tables) -> DataFrame:
    base = t("orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), "o_orderdate")
    late = (F.col("status") == "O") & (F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp"))
    return records.transition(base, late, {"status": F.lit("failed")})[0].select("o_orderkey", "status")


@_r.add("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'filled' ELSE c_mktsegment END AS c_mktsegment FROM customer""")
def fill_if_empty(t: Tables) -> DataFrame:
    base = t("customer").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, "").when(F.col("c_custkey") % 2 == 0, F.lit(None)).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    return records.fill_if_empty(base, base.select("c_custkey", F.lit("filled").alias("c_mktsegment")), ["c_custkey"], ["c_mktsegment"])


@_r.add("""SELECT 'customer' AS name, CAST(count(*) AS BIGINT) AS left_rows FROM customer WHERE c_nationkey <> 3
UNION ALL SELECT 'orders', CAST(count(*) AS BIGINT) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)
UNION ALL SELECT 'lineitem', CAST(count(*) AS BIGINT) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3)""")
def cascade_delete(t: Tables) -> DataFrame:
    gone = t("customer").where("c_nationkey = 3").select("c_custkey")
    gone_orders = t("orders").join(gone.withColumnRenamed("c_custkey", "o_custkey"), "o_custkey", "left_semi").select("o_orderkey")
    customer, (orders,) = records.cascade(t("customer"), "c_custkey", gone, [(t("orders"), "o_custkey")])
    lineitem = records.cascade(t("lineitem"), "l_orderkey", gone_orders.withColumnRenamed("o_orderkey", "l_orderkey"), [])[0]
    count = lambda d, n: d.agg(F.lit(n).alias("name"), F.count("*").alias("left_rows"))
    return count(customer, "customer").union(count(orders, "orders")).union(count(lineitem, "lineitem"))


@_r.add("""SELECT l_orderkey, round(sum(CASE WHEN l_returnflag <> 'R' THEN l_discount END), 6) AS total_score, round(sum(l_quantity), 6) AS total_max,
CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS BIGINT) AS pending_count, round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END), 6) AS pending_max FROM lineitem GROUP BY l_orderkey""")
def score_totals(t: Tables) -> DataFrame:
    """Items with flag R have no score yet."""
    items = t("lineitem").select("l_orderkey", F.when(F.col("l_returnflag") != "R", F.col("l_discount")).alias("score"), F.col("l_quantity").alias("most"))
    out = scores.totals(items, ["l_orderkey"], "score", "most")
    return out.select("l_orderkey", *(F.round(c, 6).alias(c) for c in ("total_score", "total_max")), "pending_count", F.round("pending_max", 6).alias("pending_max"))


@_r.add("""SELECT l_suppkey, CAST(count(q) AS BIGINT) AS runs, CASE WHEN count(q) >= 2 THEN round(max(q) - min(q), 6) END AS spread
FROM (SELECT l_suppkey, l_linenumber, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2) GROUP BY l_suppkey""")
def repeat_spread(t: Tables) -> DataFrame:
    runs = t("lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.sum("l_quantity").alias("q"))
    return scores.spread(runs, ["l_suppkey"], "q").withColumn("spread", F.round("spread", 6))


@_r.add("SELECT l_returnflag, median(l_extendedprice) AS mid, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem GROUP BY l_returnflag")
def median_stats(t: Tables) -> DataFrame:
    return t("lineitem").groupBy("l_returnflag").agg(F.median("l_extendedprice").alias("mid"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"))


@_r.add("""SELECT coalesce(nullif(l_linestatus, ''), 'unknown') AS reason, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE l_linestatus <> 'F') AS BIGINT) AS degrading FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1""")
def pending_histogram(t: Tables) -> DataFrame:
    d = t("lineitem").where("l_returnflag = 'R'")
    return d.groupBy(F.coalesce(F.nullif("l_linestatus", F.lit("")), F.lit("unknown")).alias("reason")).agg(F.count("*").alias("n"), F.count_if(F.col("l_linestatus") != "F").alias("degrading"))


@_r.add("""SELECT l_partkey, CAST(count(*) AS BIGINT) AS n, CASE WHEN count(*) < 2 THEN 'too_few' WHEN max(p) / min(p) >= 1.2 THEN 'unit_mismatch' END AS reason
FROM (SELECT l_partkey, l_suppkey, min(l_extendedprice / l_quantity) AS p FROM lineitem WHERE l_quantity > 0 GROUP BY 1, 2) GROUP BY l_partkey""")
def pool_price_ratio(t: Tables) -> DataFrame:
    offers = t("lineitem").where("l_quantity > 0").groupBy("l_partkey", "l_suppkey").agg(F.min(F.col("l_extendedprice") / F.col("l_quantity")).alias("p"))
    pool = offers.groupBy("l_partkey").agg(F.count("*").alias("n"), F.min("p").alias("low"), F.max("p").alias("high"))
    return pool.select("l_partkey", "n", scores.block_reason(F.col("n"), F.col("low"), F.col("high"), 1.2).alias("reason"))


@_r.add("SELECT p_brand, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY p_brand")
def facet_counts(t: Tables) -> DataFrame:
    return t("part").groupBy("p_brand").agg(F.count("*").alias("n"))


@_r.add("""SELECT c_nationkey, c_mktsegment, n FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) AS r FROM
(SELECT c_nationkey, c_mktsegment, CAST(count(*) AS BIGINT) AS n FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1, 2)) WHERE r = 1""")
def mode_with_tiebreak(t: Tables) -> DataFrame:
    return scores.most_frequent(t("customer"), ["c_nationkey"], "c_mktsegment")


@_r.add("""SELECT s_suppkey, s_acctbal, CAST(row_number() OVER (ORDER BY round(s_acctbal, 6) DESC, s_suppkey) AS INTEGER) AS place FROM supplier""")
def stable_rank(t: Tables) -> DataFrame:
    """One window over a dimension whose rows are ranked as a whole."""
    return t("supplier").select("s_suppkey", "s_acctbal", F.row_number().over(Window.orderBy(F.round("s_acctbal", 6).desc(), "s_suppkey")).alias("place"))


@_r.add("""SELECT CAST(count(*) AS BIGINT) AS all_orders, CAST(count(*) FILTER (WHERE o_orderstatus = 'O') AS BIGINT) AS doing, CAST(count(*) FILTER (WHERE o_orderstatus = 'P') AS BIGINT) AS review,
CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS done, CAST(count(*) FILTER (WHERE o_orderstatus IN ('O', 'P')) AS BIGINT) AS active FROM orders""")
def dashboard_summary(t: Tables) -> DataFrame:
    n = lambda *s: F.count_if(F.col("o_orderstatus").isin(*s))
    return t("orders").agg(F.count("*").alias("all_orders"), n("O").alias("doing"), n("P").alias("review"), n("F").alias("done"), n("O", "P").alias("active"))


@_r.add("""SELECT user_id, event_id, page FROM (SELECT user_id, event_id, CASE WHEN k - max(CASE WHEN event_type = 'purchase' THEN k END) OVER w <= 5
THEN max_by(CASE WHEN event_type = 'purchase' THEN event_id END, CASE WHEN event_type = 'purchase' THEN k END) OVER w END AS page
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY k ROWS UNBOUNDED PRECEDING))""")
def page_carry_forward(t: Tables) -> DataFrame:
    d = t("events").withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    return d.select("user_id", "event_id", drafts.carried(d, ["user_id"], "k", F.col("event_type") == "purchase", F.col("event_id"), 5).alias("page"))


@_r.add("""SELECT user_id, event_type, CAST(min(k) AS INTEGER) AS first, CAST(max(k) AS INTEGER) AS last, CAST(count(*) AS BIGINT) AS n FROM
(SELECT *, k - row_number() OVER (PARTITION BY user_id, event_type ORDER BY k) AS g FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events))
GROUP BY user_id, event_type, g HAVING count(*) >= 3""")
def adjacent_runs(t: Tables) -> DataFrame:
    d = t("events").withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    return drafts.islands(d, ["user_id"], "k", "event_type", 3)


@_r.add("""WITH s AS (SELECT l_orderkey % 100 AS bin, l_partkey AS a, l_partkey + 20 AS b FROM lineitem),
f AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY bin ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM s),
g AS (SELECT *, sum(n) OVER (PARTITION BY bin ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS i FROM f)
SELECT bin, min(a) AS a, max(b) AS b FROM g GROUP BY bin, i""")
def interval_merge(t: Tables) -> DataFrame:
    s = t("lineitem").select((F.col("l_orderkey") % 100).alias("bin"), F.col("l_partkey").alias("a"), (F.col("l_partkey") + 20).alias("b"))
    return drafts.merged(s, ["bin"], "a", "b")


@_r.add("""SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum FROM events GROUP BY event_type""")
def json_field_totals(t: Tables) -> DataFrame:
    return t("events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k_sum"))


@_r.add("""SELECT r_name, CAST(count(DISTINCT n_nationkey) AS BIGINT) AS nations, CAST(count(c_custkey) AS BIGINT) AS customers FROM region
LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name""")
def tree_counts(t: Tables) -> DataFrame:
    per = t("customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("c"))
    tree = t("region").join(t("nation").withColumnRenamed("n_regionkey", "r_regionkey"), "r_regionkey", "left").join(per, "n_nationkey", "left")
    return tree.groupBy("r_name").agg(F.count("n_nationkey").alias("nations"), F.coalesce(F.sum("c"), F.lit(0)).alias("customers"))


@_r.add("""SELECT o_orderkey, date_diff('second', TIMESTAMP '1992-01-01', o_orderdate) AS age_s, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' - INTERVAL 30 DAY""")
def date_arithmetic(t: Tables) -> DataFrame:
    start = F.lit("1992-01-01").cast("timestamp")
    d = t("orders").where(F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp") - F.expr("INTERVAL 30 DAYS"))
    return d.select("o_orderkey", (F.unix_timestamp("o_orderdate") - F.unix_timestamp(start)).alias("age_s"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("iso"))


@_r.add("""SELECT p_partkey, CAST(s AS INTEGER) AS chunk_start, CAST(least(s + 20, p_size) AS INTEGER) AS chunk_end FROM part, generate_series(0, p_size - 1, 20) AS g(s)""")
def page_chunk_plan(t: Tables) -> DataFrame:
    d = t("part").where("p_size > 0").select("p_partkey", "p_size", F.explode(F.sequence(F.lit(0), F.col("p_size") - 1, F.lit(20))).alias("chunk_start"))
    return d.select("p_partkey", F.col("chunk_start").cast("int").alias("chunk_start"), F.least(F.col("chunk_start") + 20, "p_size").cast("int").alias("chunk_end"))
