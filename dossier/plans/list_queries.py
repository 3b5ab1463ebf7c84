"""List, roll-up, lookup and state-change queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.operators import lists, lookups, records

from .registry import Registry, Tables

_r = Registry()
QUERIES, ORACLE_SQL = _r.queries, _r.sql


@_r.add("SELECT c_custkey, c_name FROM customer WHERE lower(c_name) LIKE '%customer#%' AND lower(concat_ws(' ', c_mktsegment, c_nationkey)) LIKE '%mach%'")
def contains_filter(t: Tables) -> DataFrame:
    return lists.contains_all(t("customer"), {"c_name": "CUSTOMER#", "concat_ws(' ', c_mktsegment, c_nationkey)": " mach", "c_custkey": " "}).select("c_custkey", "c_name")


@_r.add("""SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND lower(concat_ws(' ', o_orderpriority, o_custkey)) LIKE '%high%'
AND floor((epoch(TIMESTAMP '1997-01-01 12:00:00') - epoch(o_orderdate)) / 86400) BETWEEN 0 AND 364""")
def history_filter(t: Tables) -> DataFrame:
    now = F.lit("1997-01-01 12:00:00").cast("timestamp")
    return lists.history(t("orders"), F.col("o_orderstatus") == "F", ["o_orderpriority", "o_custkey"], " High ", "o_orderdate", now, 365).select("o_orderkey")


@_r.add("""SELECT p_partkey, p_name FROM part WHERE (lower(p_name) LIKE '%widget%' OR lower(p_brand) LIKE '%widget%') AND p_type IN ('ECONOMY', 'STANDARD') ORDER BY p_partkey
LIMIT 7 OFFSET (SELECT greatest(0, (count(*) - 1) // 7) * 7 FROM part WHERE (lower(p_name) LIKE '%widget%' OR lower(p_brand) LIKE '%widget%') AND p_type IN ('ECONOMY', 'STANDARD'))""")
def faceted_page(t: Tables) -> DataFrame:
    """A page beyond the end is the last one."""
    some = lists.faceted(t("part"), (["p_name", "p_brand"], "Widget"), {"p_type": ["ECONOMY", "STANDARD"], "p_brand": []})
    return lists.clamped_page(some, [("p_partkey", False)], 7, 10**6).select("p_partkey", "p_name")


@_r.add("SELECT event_id, user_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 80")
def keep_newest(t: Tables) -> DataFrame:
    return lists.newest(t("events"), [("ts", True), ("event_id", True)], 80).select("event_id", "user_id", "ts")


@_r.add("SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(p_size) AS BIGINT) AS p_size, round(avg(CASE WHEN p_size % 3 > 0 THEN CAST(p_size AS DOUBLE) END), 2) AS rate FROM part")
def cache_overview(t: Tables) -> DataFrame:
    """Texts that are no percentage don't count in the mean."""
    d = t("part").select("p_size", F.when(F.col("p_size") % 3 > 0, F.concat(F.col("p_size").cast("string"), F.lit(" %"))).otherwise("n/a").alias("rate"))
    return lists.overview(d, ["p_size"], ["rate"])


@_r.add("SELECT s_suppkey, s_name, round(s_acctbal, 1) AS used FROM supplier ORDER BY s_acctbal DESC, s_suppkey")
def usage_rows(t: Tables) -> DataFrame:
    return t("supplier").orderBy(*records.ordering([("s_acctbal", True), ("s_suppkey", False)])).select("s_suppkey", "s_name", F.round("s_acctbal", 1).alias("used"))


@_r.add("""WITH i AS (SELECT l_suppkey, l_returnflag, CASE WHEN l_linestatus = 'F' OR l_linenumber % 2 = 0 THEN l_quantity END AS score,
CASE WHEN l_returnflag = 'R' AND l_linenumber = 7 THEN NULL ELSE 40.0 END AS most FROM lineitem)
SELECT l_suppkey, l_returnflag, CAST(count(*) AS BIGINT) AS items, CAST(count(*) FILTER (most IS NULL) AS BIGINT) AS unknown, CAST(count(*) FILTER (score IS NULL) AS BIGINT) AS pending,
coalesce(sum(score), 0) AS earned, coalesce(sum(CASE WHEN most IS NOT NULL AND score IS NOT NULL THEN greatest(most - score, 0) END), 0) AS deducted,
CASE WHEN count(*) FILTER (most IS NULL) = 0 THEN sum(CAST(most AS DOUBLE)) END AS max FROM i GROUP BY l_suppkey, l_returnflag""")
def category_subtotals(t: Tables) -> DataFrame:
    score = F.when((F.col("l_linestatus") == "F") | (F.col("l_linenumber") % 2 == 0), F.col("l_quantity"))
    most = F.when(~((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 7)), F.lit(40.0))
    return lists.subtotals(t("lineitem").select("l_suppkey", "l_returnflag", score.alias("score"), most.alias("most")), ["l_suppkey", "l_returnflag"], "score", "most")


@_r.add("SELECT p_type, CAST(row_number() OVER (ORDER BY min(p_partkey)) AS INTEGER) AS place, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY p_type")
def categories_first_seen(t: Tables) -> DataFrame:
    return lists.first_seen(t("part"), "p_type", ["p_partkey"])


@_r.add("""WITH c AS (SELECT l_linenumber AS item, l_suppkey % 4 AS bidder, arg_min(l_quantity, row(l_orderkey, l_quantity)) AS score FROM lineitem GROUP BY ALL)
SELECT item, CAST(50.0 AS DOUBLE) AS max, string_agg(bidder || ':' || CAST(score AS INTEGER) || ':' || CAST(50 - score AS INTEGER), ',' ORDER BY bidder) AS cells FROM c GROUP BY item""")
def score_pivot(t: Tables) -> DataFrame:
    own = t("lineitem").groupBy("l_linenumber", "l_suppkey", "l_orderkey").agg(F.min("l_quantity").alias("score"))
    d = own.select(F.col("l_linenumber").alias("item"), (F.col("l_suppkey") % 4).alias("bidder"), "score", F.lit(50.0).alias("most"), "l_orderkey")
    cells = F.array_join(F.transform("cells", lambda c: F.concat_ws(":", c["bidder"].cast("string"), c["score"].cast("int").cast("string"), c["missing"].cast("int").cast("string"))), ",")
    return lists.score_matrix(d, "item", "bidder", "score", "most", ["l_orderkey", "score"]).select("item", "max", cells.alias("cells"))


@_r.add("""SELECT o_custkey, o_orderkey, CAST(CASE WHEN count(*) FILTER (o_orderstatus = 'P') OVER (PARTITION BY o_custkey) = 0
THEN row_number() OVER (PARTITION BY o_custkey ORDER BY round(o_totalprice, 6) DESC, o_orderkey) ELSE 9 END AS INTEGER) AS place FROM orders""")
def rank_with_pending(t: Tables) -> DataFrame:
    d = t("orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("score"), F.lit(9).alias("was"))
    return lists.ranked(d, ["o_custkey"], "score", "was", "o_orderkey").select("o_custkey", "o_orderkey", "place")


@_r.add("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'Z' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders""")
def upsert_repeated(t: Tables) -> DataFrame:
    """Two incoming rows have one key: the later one stays, and no row comes twice."""
    base = t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = base.where("o_orderkey % 3 = 0").withColumn("v", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("o_orderstatus", F.when(F.col("v") == 2, "Z").otherwise("Y"))
    return records.upsert(base, new, ["o_orderkey"], "v")


@_r.add("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'Z' ELSE o_orderstatus END AS status, o_orderdate AS created FROM orders WHERE o_orderkey % 4 <> 2
UNION ALL SELECT o_orderkey, 'Z', TIMESTAMP '2000-01-01' FROM orders WHERE o_orderkey % 4 = 2""")
def upsert_keeps_created(t: Tables) -> DataFrame:
    every = t("orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created"))
    new = every.where("o_orderkey % 2 = 0").withColumns({"status": F.lit("Z"), "created": F.lit("2000-01-01").cast("timestamp")})
    return records.upsert_keeping(every.where("o_orderkey % 4 <> 2"), new, ["o_orderkey"], ["created"])


@_r.add("""SELECT CAST(c AS BIGINT) AS created FROM (SELECT (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_orderstatus <> 'P' AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0))
+ (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS c)""")
def create_missing(t: Tables) -> DataFrame:
    """One row for each new key, and every row without one."""
    known = t("customer").where("c_custkey % 2 = 0").select("c_custkey")
    rows = t("orders").select(F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("c_custkey"), "o_orderkey")
    return records.get_or_create(known, rows, ["c_custkey"], "c_custkey", "o_orderkey").agg(F.count("*").alias("created"))


@_r.add("""WITH g AS (SELECT c_custkey FROM customer WHERE c_custkey % 10 = 0), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM g))
SELECT 'customer' AS name, CAST(count(*) AS BIGINT) AS n FROM g UNION ALL SELECT 'orders', count(*) FROM o UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)""")
def cascade_loss(t: Tables) -> DataFrame:
    gone = t("customer").where("c_custkey % 10 = 0").select("c_custkey")
    return records.cascade_counts(gone, [("customer", t("customer"), "c_custkey", None), ("orders", t("orders"), "o_custkey", "o_orderkey"), ("lineitem", t("lineitem"), "l_orderkey", None)])


@_r.add("SELECT source, CAST(count(*) AS BIGINT) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM (SELECT source, text FROM documents WHERE source NOT IN ('src0', 'src1') UNION ALL SELECT 'src0', text FROM documents WHERE source = 'src0' AND lang = 'en') GROUP BY source")
def file_reindexed(t: Tables) -> DataFrame:
    """The rows of a file give way to its new ones; another file's stay; twice is as once."""
    base = t("documents").where("source <> 'src1'").select("source", "text")
    new = t("documents").where("source = 'src0' and lang = 'en'").select("source", "text")
    once = records.replaced_parts(base, new, "source")
    return records.replaced_parts(once, new, "source").groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@_r.add("SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1996-06-01' - INTERVAL 200 DAY)")
def retention(t: Tables) -> DataFrame:
    return records.retained(t("orders"), F.col("o_orderstatus") == "F", "o_orderdate", F.lit("1996-06-01").cast("timestamp"), 200).select("o_orderkey")


@_r.add("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority WHEN o_orderkey % 3 = 1 AND o_orderstatus <> 'F' THEN 'new' ELSE o_orderpriority END AS text FROM orders""")
def rollback_if_worse(t: Tables) -> DataFrame:
    """New versions are blank (0), ready as P (1: not worse than O or P) or missing (2)."""
    old = t("orders").select("o_orderkey", F.col("o_orderpriority").alias("text"), F.col("o_orderstatus").alias("status"))
    new = old.where("o_orderkey % 3 < 2").withColumns({"text": F.when(F.col("o_orderkey") % 3 == 0, " ").otherwise("new"), "status": F.lit("P")})
    return records.not_worse(old, new, ["o_orderkey"], "text", "status", {"O": 1, "P": 2, "F": 3}).select("o_orderkey", "text")


@_r.add("""SELECT o_custkey, arg_min(CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END, CASE WHEN o_orderstatus <> 'P' THEN o_orderkey END) AS criteria FROM orders GROUP BY o_custkey""")
def criteria_authority(t: Tables) -> DataFrame:
    d = t("orders").withColumnRenamed("o_orderpriority", "criteria")
    return records.first_authority(d, ["o_custkey"], F.col("o_orderstatus") != "P", "criteria", "o_orderkey")


@_r.add("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'added' WHEN p_partkey % 5 = 1 THEN 'removed' ELSE 'changed' END AS state FROM part WHERE p_partkey % 5 < 2 OR (p_partkey % 5 = 2 AND p_size > 10)""")
def index_fingerprints(t: Tables) -> DataFrame:
    every = t("part").select("p_partkey", "p_name", "p_size")
    now = every.where("p_partkey % 5 <> 1").withColumn("p_size", F.when((F.col("p_partkey") % 5 == 2) & (F.col("p_size") > 10), 0).otherwise(F.col("p_size")))
    return records.changed_prints(every.where("p_partkey % 5 <> 0"), now, "p_partkey", ["p_name", "p_size"])


@_r.add("""WITH f AS (SELECT l_suppkey, arg_max(l_quantity, l_orderkey * 10 + l_linenumber) AS q FROM lineitem WHERE l_suppkey % 2 = 0 GROUP BY l_suppkey)
SELECT s_suppkey AS l_suppkey, s_name, q AS l_quantity FROM supplier LEFT JOIN f ON s_suppkey = l_suppkey""")
def criteria_by_item(t: Tables) -> DataFrame:
    """Of facts with one name the last counts; an item without any stays."""
    facts = t("lineitem").where("l_suppkey % 2 = 0").select("l_suppkey", "l_quantity", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    rows = t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return lookups.by_name(rows, facts, "l_suppkey", "seq").select("l_suppkey", "s_name", "l_quantity")


_REFS = "array(cast(c_nationkey as string), 'R-99', cast(c_nationkey % 3 as string))"


@_r.add("""SELECT c_custkey, concat_ws('|', a.n_name, 'R-99', b.n_name) AS refs FROM customer JOIN nation a ON c_nationkey = a.n_nationkey JOIN nation b ON c_nationkey % 3 = b.n_nationkey""")
def refs_described(t: Tables) -> DataFrame:
    rules = t("nation").select(F.col("n_nationkey").cast("string").alias("id"), "n_name", F.lit("x").alias("text"))
    out = lookups.described(t("customer").select("c_custkey", F.expr(_REFS).alias("refs")), "c_custkey", "refs", rules, "id", "n_name", "text")
    return out.select("c_custkey", F.array_join(F.transform("refs", lambda r: r["title"]), "|").alias("refs"))


@_r.add("""SELECT c_custkey, concat_ws('|', CASE WHEN c_nationkey < 10 THEN c_nationkey END, c_nationkey % 3) AS refs FROM customer""")
def refs_known(t: Tables) -> DataFrame:
    rules = t("nation").where("n_nationkey < 10").select(F.col("n_nationkey").cast("string").alias("id"))
    out = lookups.known_only(t("customer").select("c_custkey", F.expr(_REFS).alias("refs")), "c_custkey", "refs", rules, "id")
    return out.select("c_custkey", F.array_join("refs", "|").alias("refs"))


@_r.add("""SELECT c_custkey, min(o_orderkey) AS o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey OR o_orderkey = c_custkey * 3 GROUP BY c_custkey""")
def multi_key_match(t: Tables) -> DataFrame:
    summaries = t("customer").select("c_custkey", F.col("c_custkey").cast("string").alias("claim"), (F.col("c_custkey") * 3).cast("string").alias("request"))
    results = t("orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("claim"), F.col("o_orderkey").cast("string").alias("request"))
    return lookups.first_match(summaries, results, "c_custkey", [("claim", "claim"), ("request", "request")], "o_orderkey").select("c_custkey", "o_orderkey")


@_r.add("""WITH n AS (SELECT p_name, count(*) AS many, min(p_partkey) AS id FROM part WHERE p_partkey % 7 = 0 GROUP BY p_name)
SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'given' WHEN p_partkey % 5 > 0 AND many = 1 THEN CAST(n.id AS VARCHAR) END AS id,
CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 5 = 0 THEN 'missing' WHEN many IS NULL THEN 'unmatched' WHEN many > 1 THEN 'ambiguous' END AS reason FROM part LEFT JOIN n USING (p_name)""")
def names_resolved(t: Tables) -> DataFrame:
    p = t("part")
    asked = p.select("p_partkey", F.when(F.col("p_partkey") % 11 == 0, "given").otherwise(" ").alias("given"), F.when(F.col("p_partkey") % 5 > 0, F.concat(F.lit(" "), "p_name")).alias("name"))
    known = p.where("p_partkey % 7 = 0").select(F.col("p_name").alias("name"), F.col("p_partkey").cast("string").alias("id"))
    return lookups.resolved_name(asked, known, "p_partkey", "given", "name", "id")


@_r.add("""SELECT a.conv_id, a.turn AS cited, b.turn AS page FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND abs(a.turn - b.turn) <= 1 AND contains(b.text, substr(a.text, 1, 12))""")
def quotes_on_pages(t: Tables) -> DataFrame:
    c = t("conversations")
    quotes = c.select("conv_id", F.col("turn").alias("cited"), F.substring("text", 1, 12).alias("quote"))
    pages = c.select("conv_id", F.col("turn").alias("page"), "text")
    return lookups.on_pages(quotes, pages, ["conv_id"], "quote", "cited", "page", "text").select("conv_id", "cited", "page")


@_r.add("""WITH d AS (SELECT conv_id, turn AS defect, role = 'user' AS absence FROM conversations WHERE turn < 3)
SELECT d.conv_id, d.defect, min(f.turn) AS finding FROM d LEFT JOIN conversations f ON d.conv_id = f.conv_id AND (contains(f.text, 'the') OR contains(f.text, 'and')) AND contains(f.text, 'an')
AND (absence OR f.turn IN (defect, defect + 2)) GROUP BY d.conv_id, d.defect""")
def defects_matched(t: Tables) -> DataFrame:
    c = t("conversations")
    defects = c.where("turn < 3").select("conv_id", F.col("turn").alias("defect"), F.array(F.lit("the"), F.lit("and")).alias("words"), F.array(F.lit("an")).alias("musts"), F.array("turn", F.col("turn") + 2).alias("refs"), (F.col("role") == "user").alias("absence"))
    findings = c.select("conv_id", "turn", "text", F.array("turn").alias("refs"))
    return lookups.matched_defects(defects, findings, "conv_id", "defect", "words", "musts", "refs", "absence", "turn")


@_r.add("""WITH b AS (SELECT o_custkey, string_agg(o_orderkey || ':' || o_orderstatus, ',' ORDER BY CAST(o_orderkey AS VARCHAR)) AS w FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_custkey)
SELECT c_custkey AS key, concat_ws(',', CASE WHEN c_mktsegment = 'FURNITURE' THEN ':' || c_mktsegment END, w) AS warnings FROM customer LEFT JOIN b ON o_custkey = c_custkey""")
def document_warnings(t: Tables) -> DataFrame:
    projects = t("customer").select(F.col("c_custkey").alias("key"), F.when(F.col("c_mktsegment") == "FURNITURE", F.col("c_mktsegment")).otherwise("F").alias("status"))
    bids = t("orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").cast("string").alias("bid"), F.col("o_orderstatus").alias("status"))
    out = lookups.with_statuses(projects, bids, "key", "status", ("F",))
    return out.select("key", F.array_join(F.transform("warnings", lambda w: F.concat_ws(":", w["bid"], w["status"])), ",").alias("warnings"))


@_r.add("""WITH r AS (SELECT conv_id, turn, 'read ' || turn AS got FROM conversations WHERE conv_id % 2 = 0 OR turn > 0)
SELECT c.conv_id, c.turn, CASE WHEN c.turn % 2 = 0 AND count(*) OVER (PARTITION BY c.conv_id) = (SELECT count(*) FROM r WHERE r.conv_id = c.conv_id) THEN got WHEN c.turn % 2 = 0 THEN ' ' ELSE c.text END AS text
FROM conversations c LEFT JOIN r ON r.conv_id = c.conv_id AND r.turn = c.turn""")
def pages_back_filled(t: Tables) -> DataFrame:
    """Even turns are blank pages; where pages are missing from what was read, nothing is filled in."""
    c = t("conversations")
    native = c.select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, " ").otherwise(F.col("text")).alias("text"))
    read = c.where("conv_id % 2 = 0 or turn > 0").select("conv_id", "turn", F.concat(F.lit("read "), F.col("turn").cast("string")).alias("text"))
    return lookups.back_filled(native, read, ["conv_id"], "turn", "text")


@_r.add("SELECT o_orderkey, CASE WHEN o_totalprice <= 1000 THEN 'no_price' WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_orderpriority NOT LIKE '%-%' THEN 'no_priority' END AS problem FROM orders")
def usability_codes(t: Tables) -> DataFrame:
    checks = [("no_price", F.col("o_totalprice") > 1000), ("pending", F.col("o_orderstatus") != "P"), ("no_priority", F.col("o_orderpriority").contains("-"))]
    return t("orders").select("o_orderkey", lookups.usable(checks).alias("problem"))
