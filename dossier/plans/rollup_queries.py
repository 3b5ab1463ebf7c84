"""Roll-ups over the driver's tables, and forms of earlier queries that have rows on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.operators import assembly, drafts, rollups

from .registry import Registry, Tables

_r = Registry()
QUERIES, ORACLE_SQL = _r.queries, _r.sql


@_r.add("""WITH r AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n, 'f' || l_partkey % 7 AS file, l_returnflag = 'A' AS failed, l_quantity > 45 AS partial, l_linestatus = 'F' AND l_quantity < 20 AS degraded, l_quantity > 10 AS said FROM lineitem),
s AS (SELECT l_orderkey, bool_or(said) AS said, list_concat(coalesce(list(file ORDER BY n) FILTER (WHERE failed), []), coalesce(list(file ORDER BY n) FILTER (WHERE partial), [])) AS bad, coalesce(list(file ORDER BY n) FILTER (WHERE degraded), []) AS worse FROM r GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN NOT said THEN 'failed' WHEN len(bad) > 0 THEN 'partial' WHEN len(worse) > 0 THEN 'degraded' ELSE 'ready' END AS status, array_to_string(bad, ',') AS failed_files, array_to_string(worse, ',') AS degraded_files, len(list_distinct(list_concat(bad, worse))) AS problems FROM s""")
def document_rollup(t: Tables) -> DataFrame:
    """Lines of an order as files of a document."""
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    d = t("lineitem").select("l_orderkey", order.alias("n"), F.concat(F.lit("f"), F.col("l_partkey") % 7).alias("file"), "l_returnflag", "l_linestatus", "l_quantity")
    q = F.col("l_quantity")
    out = rollups.document_status(d, ["l_orderkey"], "n", "file", F.col("l_returnflag") == "A", q > 45, (F.col("l_linestatus") == "F") & (q < 20), q > 10)
    return out.select("l_orderkey", "status", F.array_join("failed_files", ",").alias("failed_files"), F.array_join("degraded_files", ",").alias("degraded_files"), F.size("problem_files").cast("long").alias("problems"))


@_r.add("""WITH c AS (SELECT o_custkey, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'resolved' WHEN 'O' THEN 'weak_match' ELSE 'unresolved' END AS class, CASE o_orderkey % 4 WHEN 0 THEN 'page_ok' WHEN 1 THEN 'page_corrected' WHEN 2 THEN 'page_unverified' END AS page FROM orders)
SELECT o_custkey, count(*) AS checked, count(*) FILTER (WHERE class = 'resolved') AS resolved, count(*) FILTER (WHERE class = 'weak_match') AS weak_match, count(*) FILTER (WHERE class = 'unresolved') AS unresolved, count(*) FILTER (WHERE page = 'page_ok') AS page_ok,
count(*) FILTER (WHERE page = 'page_corrected') AS page_corrected, count(*) FILTER (WHERE page = 'page_unverified') AS page_unverified, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) FILTER (WHERE class = 'weak_match'), '') AS weak_refs, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) FILTER (WHERE class = 'unresolved'), '') AS unresolved_refs FROM c GROUP BY o_custkey""")
def evidence_summary(t: Tables) -> DataFrame:
    """Orders as citations of their customer's verdict."""
    found = F.when(F.col("o_orderstatus") == "F", "resolved").when(F.col("o_orderstatus") == "O", "weak_match").otherwise("unresolved")
    k = F.col("o_orderkey") % 4
    d = t("orders").select("o_custkey", "o_orderkey", found.alias("class"), F.when(k == 0, "page_ok").when(k == 1, "page_corrected").when(k == 2, "page_unverified").alias("page"))
    out = rollups.resolution_summary(d, ["o_custkey"], "o_orderkey", "class", "page")
    return out.withColumns({c: F.array_join(c, ",") for c in ("weak_refs", "unresolved_refs")})


_SOURCE = "CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN '招标文件 第 ' || p_size || ' 页 和 第9页' WHEN 1 THEN '投标文件（转换稿第' || p_size || '页）' WHEN 2 THEN p_name ELSE '投标 第' || p_size || ' 页' END"


@_r.add(f"""WITH s AS (SELECT p_partkey, p_size, p_name, {_SOURCE} AS source FROM part)
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'tender' WHEN 2 THEN 'whole' ELSE 'bid' END AS tier, CASE WHEN p_partkey % 4 <> 2 THEN p_size END AS page, CASE WHEN p_partkey % 4 = 1 THEN 'converted' ELSE 'original' END AS kind,
CASE p_partkey % 4 WHEN 0 THEN '招标文件 第 77 页 和 第9页' WHEN 1 THEN '投标文件（转换稿第 77 页）' WHEN 2 THEN p_name ELSE '投标 第 77 页' END AS rewritten FROM s""")
def sources_parsed(t: Tables) -> DataFrame:
    d = t("part").select("p_partkey", F.expr(_SOURCE).alias("source"))
    return d.select("p_partkey", rollups.cited(F.col("source")).alias("c"), rollups.rewritten(F.col("source"), F.lit(77)).alias("rewritten")).select("p_partkey", "c.*", "rewritten")


@_r.add("""SELECT o_orderkey, origin, text, kind FROM (SELECT o_orderkey, 'explanation' AS origin, o_orderpriority AS text, 'original' AS kind FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 'reasons[' || i || ']', 'r' || i, 'original' FROM orders, range(2) AS r(i) WHERE o_orderkey % 3 > 0
UNION ALL SELECT o_orderkey, 'evidence_chain[0]', o_orderstatus || '  c', CASE WHEN o_orderstatus = 'O' THEN 'converted' ELSE 'original' END FROM orders UNION ALL SELECT o_orderkey, 'scoring[0]', 'price  late', 'original' FROM orders UNION ALL SELECT o_orderkey, 'eligibility_checks[0]', 'licence b ' || o_orderstatus || ' ', 'original' FROM orders)""")
def findings_flat(t: Tables) -> DataFrame:
    """What verdicts of orders say, in all five places."""
    none = F.lit(None).cast("string")
    status = F.col("o_orderstatus")
    chain = F.array(F.struct(status.alias("source"), none.alias("finding"), F.lit("c").alias("conclusion"), F.when(status == "O", "converted").alias("page_kind")))
    scoring = F.array(F.struct(F.lit("price").alias("item"), none.alias("basis"), F.lit("late").alias("pending_reason")))
    checks = F.array(F.struct(F.lit("licence").alias("check"), F.lit("b").alias("basis"), F.struct(status.alias("source"), none.alias("quote")).alias("evidence")))
    reasons = F.when(F.col("o_orderkey") % 3 > 0, F.array(F.lit("r0"), F.lit("r1")))
    said = rollups.findings(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")), reasons, chain, scoring, checks)
    return t("orders").select("o_orderkey", F.explode(said).alias("f")).select("o_orderkey", "f.*")


@_r.add("""SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 END AS level FROM conversations WHERE turn % 4 < 3""")
def heading_levels_of_turns(t: Tables) -> DataFrame:
    """Turns below headings of three kinds, or none."""
    k = F.col("turn") % 4
    line = F.when(k == 0, F.concat(F.lit("第"), F.col("turn") + 1, F.lit("章 "), F.col("role"))).when(k == 1, F.concat(F.lit("二、 "), F.col("role"))).when(k == 2, F.concat(F.lit("### "), F.col("role"))).otherwise(F.concat(F.lit("text 第一章 "), F.col("role")))
    return t("conversations").select("conv_id", "turn", drafts.heading_level(line).alias("level")).where("level IS NOT NULL")


@_r.add("SELECT DISTINCT l_partkey AS ref FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def unknown_refs(t: Tables) -> DataFrame:
    """Parts that lines refer to and that aren't among the known ones."""
    known = t("part").where("p_size > 10").select(F.col("p_partkey").alias("ref"))
    return t("lineitem").select(F.col("l_partkey").alias("ref")).where("ref IS NOT NULL").join(known, "ref", "left_anti").distinct()


@_r.add("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'skipped' WHEN o_custkey % 7 = 0 THEN 'unavailable' WHEN o_orderkey % 11 = 0 THEN 'exhausted' WHEN o_orderstatus = 'P' THEN 'all_unresolved' WHEN o_orderstatus = 'O' THEN 'warnings' ELSE 'ok' END AS state,
o_orderkey % 5 <> 0 AND (o_custkey % 7 = 0 OR o_orderkey % 11 = 0 OR o_orderstatus = 'P') AS manual FROM orders""")
def context_gate(t: Tables) -> DataFrame:
    """Orders as cases with a ledger of two items."""
    block = F.array(F.struct(F.lit("c").alias("chunk"), F.lit(1).cast("long").alias("tokens")))
    none = F.array().cast("array<struct<chunk: string, tokens: bigint>>")
    entry = lambda state: F.struct(F.lit(state).alias("state"), (block if state == "ok" else none).alias("blocks"))
    status = F.col("o_orderstatus")
    ledger = F.when(status == "P", F.array(entry("unresolved"), entry("truncated"))).when(status == "O", F.array(entry("ok"), entry("truncated"))).otherwise(F.array(entry("ok"), entry("ok")))
    gate = assembly.gate(F.col("o_orderkey") % 5 != 0, F.col("o_custkey") % 7, F.when(F.col("o_orderkey") % 11 == 0, "window_too_small"), ledger)
    return t("orders").select("o_orderkey", gate.alias("g")).select("o_orderkey", "g.*")
