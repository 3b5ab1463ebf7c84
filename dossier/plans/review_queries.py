"""Comparison, chunk and search queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.operators import chunks, compare, lookups, search

from .registry import Registry, Tables
from .text_queries import document_index

_r = Registry()
QUERIES, ORACLE_SQL = _r.queries, _r.sql
_POOL = """latest AS (SELECT *, row_number() OVER (PARTITION BY o_orderdate_year, o_custkey ORDER BY o_orderkey DESC) AS r FROM (SELECT *, year(o_orderdate) AS o_orderdate_year FROM orders)),
entries AS (SELECT o_orderdate_year AS project, o_custkey AS bidder, CASE WHEN o_totalprice > 30000 THEN o_totalprice END AS amount, o_orderkey,
CASE WHEN o_orderstatus = 'O' THEN 'criteria_stale' WHEN o_totalprice <= 30000 THEN 'bid_price_invalid' END AS exclusion FROM latest WHERE r = 1),
pools AS (SELECT project, CAST(count(*) FILTER (exclusion IS NULL) AS BIGINT) AS comparable,
CASE WHEN count(*) FILTER (exclusion IS NULL) < 2 THEN 'insufficient_comparable_bidders' WHEN max(amount) FILTER (exclusion IS NULL) / min(amount) FILTER (exclusion IS NULL) >= 100 THEN 'bid_price_unit_mismatch' END AS reason FROM entries GROUP BY project)"""


def _entries(t: Tables) -> DataFrame:
    price = F.when(F.col("o_totalprice") > 30000, F.col("o_totalprice")).when(F.col("o_orderkey") % 2 == 0, F.lit(float("inf"))).otherwise(-1.0)
    results = t("orders").select(F.year("o_orderdate").alias("project"), F.col("o_custkey").alias("bidder"), "o_orderkey", price.alias("price"), F.when(F.col("o_orderstatus") != "O", "v2").alias("version"), F.lit("v2").alias("current"))
    return compare.pool(results, "project", "bidder", "o_orderkey", "version", "current", "price")


@_r.add(f"WITH {_POOL} SELECT project, bidder, amount, exclusion IS NULL AS comparable, exclusion FROM entries")
def compare_pool(t: Tables) -> DataFrame:
    return _entries(t)


@_r.add(f"WITH {_POOL} SELECT * FROM pools")
def compare_blocks(t: Tables) -> DataFrame:
    return compare.blocked(_entries(t), "project")


@_r.add(f"""WITH {_POOL} SELECT e.project, bidder, CASE WHEN reason IS NULL AND exclusion IS NULL THEN CAST(c_acctbal AS DOUBLE) END AS total,
CASE WHEN reason IS NULL AND exclusion IS NULL THEN 'scored' ELSE 'manual_review' END AS status, coalesce(exclusion, reason) AS note
FROM entries e JOIN pools USING (project) LEFT JOIN customer ON c_custkey = bidder""")
def compare_guard(t: Tables) -> DataFrame:
    e = _entries(t)
    scores = e.select("project", "bidder").join(t("customer").select(F.col("c_custkey").alias("bidder"), F.col("c_acctbal").alias("total")), "bidder")
    return compare.guarded(scores, e, compare.blocked(e, "project"), "project", "bidder", ["total"])


_SIGNED = """SELECT o_custkey, CASE WHEN count(*) >= 2 THEN substr(sha256(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY CAST(o_orderkey AS VARCHAR)) || '|' || 'h'), 1, 16) END AS signature FROM orders {} GROUP BY o_custkey"""


@_r.add(_SIGNED.format(""))
def input_signatures(t: Tables) -> DataFrame:
    return compare.signature(t("orders").withColumn("h", F.lit("h")), ["o_custkey"], "o_orderkey", "h")


@_r.add(f"""WITH a AS ({_SIGNED.format("")}), b AS ({_SIGNED.format("WHERE o_orderstatus <> 'P'")}), busy AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey % 50 = 0)
SELECT a.o_custkey, a.signature IS NOT NULL AND a.signature IS DISTINCT FROM b.signature AND a.o_custkey NOT IN (SELECT o_custkey FROM busy) AS needed FROM a LEFT JOIN b USING (o_custkey)""")
def recompute_needed(t: Tables) -> DataFrame:
    o = t("orders").withColumn("h", F.lit("h"))
    sign = lambda d: compare.signature(d, ["o_custkey"], "o_orderkey", "h")
    return compare.recompute_needed(sign(o), sign(o.where("o_orderstatus <> 'P'")), "o_custkey", o.where("o_orderkey % 50 = 0").select("o_custkey"))


def _scoring(t: Tables) -> DataFrame:
    reason = F.when(F.col("l_linenumber") % 2 == 0, "cross_bid").when(F.col("l_linenumber") == 3, "because")
    score = F.when(F.col("l_returnflag") != "R", F.col("l_quantity"))
    item = F.struct(F.col("l_linenumber").alias("item"), score.alias("score"), F.lit(50.0).alias("max"), reason.alias("pending_reason"), F.when(score.isNotNull(), "scored").otherwise("manual_review").alias("status"), F.lit("b").alias("basis"), F.col("l_partkey").alias("part"))
    return t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("scoring"))


@_r.add("""SELECT l_orderkey, coalesce(string_agg(l_linenumber, ',' ORDER BY l_linenumber, l_partkey) FILTER (l_returnflag = 'R' AND l_linenumber % 2 = 1), '') AS errors FROM lineitem GROUP BY l_orderkey""")
def pending_reasons(t: Tables) -> DataFrame:
    return _scoring(t).select("l_orderkey", F.array_join(compare.pending_errors(F.col("scoring")), ",").alias("errors"))


@_r.add("""SELECT l_orderkey, CAST(count(*) FILTER (l_returnflag = 'R' OR l_partkey % 10 = 0) AS INTEGER) AS manual, CAST(count(*) FILTER (l_returnflag <> 'R' AND l_partkey % 10 = 0) AS INTEGER) AS noted FROM lineitem GROUP BY l_orderkey""")
def unresolved_downgraded(t: Tables) -> DataFrame:
    lower = lambda c: compare.downgraded(c, lambda s: s["part"] % 10 == 0, " (unresolved)")
    d = _scoring(t).select("l_orderkey", lower(lower(F.col("scoring"))).alias("s"))
    manual = F.filter("s", lambda s: (s["status"] == "manual_review") & s["score"].isNull())
    return d.select("l_orderkey", F.size(manual).alias("manual"), F.size(F.filter("s", lambda s: s["basis"] == "b (unresolved)")).alias("noted"))


@_r.add("""WITH i AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE l_returnflag WHEN 'R' THEN 'deduction' WHEN 'A' THEN 'additive' ELSE 'banded' END AS mode, l_quantity AS score, CASE WHEN l_tax > 0.02 THEN 50 - l_quantity END AS hits FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN mode = 'additive' AND abs(5 + hits - score) > 0.01 THEN 'additive_mismatch' WHEN mode = 'banded' AND abs(hits - score) > 0.01 THEN 'banded_mismatch'
WHEN mode = 'deduction' AND hits IS NULL AND score > 0.01 AND score < 50 THEN 'deduction_without_hits' END AS code FROM i""")
def score_mode_warnings(t: Tables) -> DataFrame:
    mode = F.when(F.col("l_returnflag") == "R", "deduction").when(F.col("l_returnflag") == "A", "additive").otherwise("banded")
    hits = F.when(F.col("l_tax") > 0.02, 50 - F.col("l_quantity"))
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", compare.mode_warning(mode, F.col("l_quantity"), F.lit(50.0), F.lit(5.0), hits).alias("code"))


@_r.add("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'hard' WHEN '5-LOW' THEN 'soft' ELSE 'other' END AS kind FROM orders")
def enum_aliases(t: Tables) -> DataFrame:
    return t("orders").select("o_orderkey", compare.aliased(F.concat(F.lit(" "), "o_orderpriority"), {"1-urgent": "hard", "5-low": "soft"}, "other").alias("kind"))


@_r.add("""SELECT c_custkey AS key, concat_ws(',', CASE WHEN n IS NULL OR n < 10 THEN 'n' END, CASE WHEN total IS NULL OR total NOT BETWEEN 500000 AND 3000000 THEN 'total' END) AS missing
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey""")
def golden_mismatches(t: Tables) -> DataFrame:
    actual = t("orders").groupBy(F.col("o_custkey").alias("key")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    expected = t("customer").select(F.col("c_custkey").alias("key"), F.lit(10).alias("n"), F.lit(3e6).alias("total"))
    out = compare.mismatches(expected, actual, ["key"], {"n": lambda e, a: a >= e, "total": lambda e, a: a.between(500000, e)})
    return out.select("key", F.array_join("missing", ",").alias("missing"))


@_r.add("""SELECT event_type AS kind, CAST(count(*) AS BIGINT) AS items, CAST(count(*) FILTER (a) AS BIGINT) AS always, CAST(count(*) FILTER (b) AS BIGINT) AS ever
FROM (SELECT user_id, event_type, bool_and(value > 20) AS a, bool_or(value > 20) AS b FROM events GROUP BY user_id, event_type) GROUP BY event_type""")
def attribution_table(t: Tables) -> DataFrame:
    return compare.attribution(t("events").select("user_id", F.col("event_type").alias("kind"), (F.col("value") > 20).alias("hit")), "user_id", "kind", "hit")


compare.register("orders", lambda d: d.withColumn("o_orderpriority", F.upper("o_orderpriority")), lambda d: d.where("o_totalprice > 0"), lambda d: d.withColumn("late", F.col("o_orderdate") > F.lit("1997-01-01").cast("timestamp")))


@_r.add("SELECT o_orderkey, upper(o_orderpriority) AS o_orderpriority, o_orderdate > TIMESTAMP '1997-01-01' AS late FROM orders WHERE o_totalprice > 0")
def schema_steps(t: Tables) -> DataFrame:
    return compare.apply_steps("orders", t("orders")).select("o_orderkey", "o_orderpriority", "late")


@_r.add("""SELECT source, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY page IS NULL, coalesce(page, 0), first) AS INTEGER) AS place FROM
(SELECT source, CASE WHEN n_chars % 3 > 0 THEN CAST(n_chars % 7 AS INTEGER) END AS page, min(doc_id) OVER (PARTITION BY source, text) AS first, doc_id,
row_number() OVER (PARTITION BY source, text ORDER BY length(lang) DESC, doc_id) AS r FROM documents) WHERE r = 1""")
def chunks_in_order(t: Tables) -> DataFrame:
    d = t("documents").withColumn("page", F.when(F.col("n_chars") % 3 > 0, (F.col("n_chars") % 7).cast("int")))
    return chunks.in_document_order(d, ["source"], "text", "lang", "page", "doc_id").select("source", "doc_id", "place")


@_r.add("SELECT doc_id, piece, text FROM (SELECT doc_id, CAST(unnest(range(len(p))) AS INTEGER) AS piece, unnest(p) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE contains(text, chr(10)) AND NOT regexp_matches(text, '[\\x0b\\x0c\\x0d\\x1c-\\x1e\\x85\\x{2028}\\x{2029}]') AND text[-1] <> chr(10)))")
def chunks_by_line(t: Tables) -> DataFrame:
    """With the smallest size, each line is a piece."""
    d = t("documents").where(F.col("text").contains("\n") & ~F.col("text").rlike("[\\x0b\\x0c\\x0d\\x1c-\\x1e\\u0085\\u2028\\u2029]") & ~F.col("text").endswith("\n"))
    return chunks.split_chunks(d.withColumn("page", F.lit(None).cast("int")), ["doc_id"], "text", "page", 0).select("doc_id", "piece", "text")


@_r.add(r"SELECT doc_id, regexp_matches(text, '\p{L}') AS substance FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '12 ' || chr(10) ELSE text END AS text FROM documents)")
def chunk_substance(t: Tables) -> DataFrame:
    d = t("documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "12 \n【第 3 页】\n").otherwise(F.col("text")).alias("text"))
    return d.select("doc_id", F.coalesce(chunks.has_substance(F.col("text")), F.lit(None)).alias("substance"))


@_r.add("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL ELSE (p_size % 9 + 1) || '.' || p_size END AS number, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_name END AS title FROM part""")
def decimal_headings(t: Tables) -> DataFrame:
    line = F.when(F.col("p_size") % 3 == 0, F.concat(F.col("p_size").cast("string"), F.lit(".5 "), "p_name")).otherwise(F.concat((F.col("p_size") % 9 + 1).cast("string"), F.lit("."), F.col("p_size").cast("string"), F.lit(". "), "p_name"))
    d = t("part").select("p_partkey", chunks.decimal_heading(line).alias("h"))
    return d.select("p_partkey", "h.number", "h.title")


@_r.add("""SELECT event_id, CAST(part AS BIGINT) AS part, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, part ORDER BY event_id) AS BIGINT) AS piece FROM
(SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS part FROM events)""")
def segment_ids(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    return chunks.segments(t("events"), ["user_id"], "event_id", kind == "error", kind == "click", kind).select("event_id", "part", "piece")


@_r.add("""WITH e AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS line, o_orderstatus FROM orders),
f AS (SELECT *, lag(o_orderstatus) OVER w AS one, lag(o_orderstatus, 2) OVER w AS two FROM e WINDOW w AS (PARTITION BY o_custkey ORDER BY line)),
g AS (SELECT *, sum(CASE WHEN one = 'O' OR (one = 'P' AND two = 'O') THEN 0 ELSE 1 END) OVER (PARTITION BY o_custkey ORDER BY line) AS k FROM f WHERE o_orderstatus = 'O')
SELECT o_custkey, CAST(min(line) AS INTEGER) AS first, CAST(max(line) AS INTEGER) AS last, CAST(count(*) AS BIGINT) AS rows FROM g GROUP BY o_custkey, k""")
def tables_across_pages(t: Tables) -> DataFrame:
    """Orders of a customer as lines: O is a table row, P a page anchor, F any other line."""
    from pyspark.sql import Window

    lines = t("orders").select("o_custkey", "o_orderstatus", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("line"))
    cells = F.when(F.col("o_orderstatus") == "O", F.array(F.lit("a"), F.lit("b")))
    return chunks.tables(lines, ["o_custkey"], "line", cells, F.col("o_orderstatus") == "P").select("o_custkey", "first", "last", "rows")


@_r.add("SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN '页码未知' ELSE '【' || CASE WHEN p_size % 2 = 0 THEN '转换稿' ELSE '' END || '第 ' || p_size || CASE WHEN p_size % 3 = 0 THEN '-' || (p_size + 2) ELSE '' END || ' 页】' END AS anchor FROM part")
def anchors_written(t: Tables) -> DataFrame:
    page = F.when(F.col("p_size") % 5 != 0, F.col("p_size"))
    return t("part").select("p_partkey", chunks.anchor_text(page, F.when(F.col("p_size") % 3 == 0, page + 2).otherwise(page), F.col("p_size") % 2 == 0).alias("anchor"))


@_r.add("""SELECT q AS query, doc_id, CAST(place AS INTEGER) AS place FROM (SELECT q, doc_id, row_number() OVER (PARTITION BY q ORDER BY doc_id) AS place
FROM documents, (SELECT unnest(['zu', 'ou']) AS q) WHERE contains(lower(text), q) AND lang <> 'fr') WHERE place <= 10""")
def dual_search_short(t: Tables) -> DataFrame:
    """Queries of two characters are scans in document order, within a scope."""
    return document_index(t).search(["zu", "OU "], "doc_id", scope=F.col("lang") != "fr").select(F.lower("query").alias("query"), "doc_id", "place")


_BM25 = """st AS (SELECT count(*) AS n, avg(greatest(length(text) - 2, 0)) AS av FROM documents), ph AS ({phrases}),
tf AS (SELECT q, p, doc_id, len(list_filter(range(1, length(text)), lambda i: substr(lower(text), i, length(p)) = p)) AS tf, greatest(length(text) - 2, 0) AS size FROM documents, ph WHERE contains(lower(text), p)),
df AS (SELECT p, count(DISTINCT doc_id) AS df FROM tf GROUP BY p),
sc AS (SELECT q, doc_id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / av))) AS score FROM tf JOIN df USING (p), st GROUP BY q, doc_id)
SELECT q AS query, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS place FROM sc JOIN documents USING (doc_id) WHERE source <> 'src1') WHERE place <= 10"""


@_r.add("WITH " + _BM25.format(phrases="SELECT unnest(['the whe', 'the whe', 'ment']) AS q, unnest(['the', 'whe', 'ment']) AS p"))
def dual_search(t: Tables) -> DataFrame:
    """Longer queries are ranked by BM25 over their words, within a scope; statistics are those of all rows."""
    found = document_index(t).search(["the whe", "ment"], "doc_id", scope=~lookups.any_of(F.col("source") == "src1"))
    return found.select("query", "doc_id", F.round("score", 6).alias("score"))


@_r.add("WITH " + _BM25.format(phrases="SELECT 'and whe the' AS q, unnest(['nthexx']) AS p UNION ALL SELECT 'elttheren' AS q, unnest(['elttheren'[i:i+5] for i in range(1, 5)]) AS p"))
def overlap_search(t: Tables) -> DataFrame:
    """Queries that no document has whole, by their own windows of six characters without white space."""
    found = document_index(t).search(["and whe the", "elttheren"], "doc_id", scope=F.col("source") != "src1", overlap=True)
    return found.select("query", "doc_id", F.round("score", 6).alias("score"))


@_r.add("""WITH l AS (SELECT 'a' AS item, 'qqqq' AS q, 0 AS turn UNION ALL SELECT 'a', 'ou', 1 UNION ALL SELECT 'b', 'zu', 0),
h AS (SELECT item, q, turn, lang = 'fr' AS second, doc_id FROM documents, l WHERE contains(lower(text), q) AND lang IN ('en', 'fr')),
w AS (SELECT *, min((CASE WHEN second THEN 10 ELSE 0 END) + turn) OVER (PARTITION BY item) AS best FROM h),
k AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY doc_id) AS place FROM w WHERE (CASE WHEN second THEN 10 ELSE 0 END) + turn = best)
SELECT item, q AS query, doc_id, CAST(CASE WHEN second THEN 1 ELSE 0 END AS INTEGER) AS round FROM k WHERE place <= 10""")
def first_winning_layer(t: Tables) -> DataFrame:
    """English documents are the first layer, French the second; the first query of the first layer that finds any wins."""
    items = {"a": ["qqqq", "ou"], "b": ["zu"]}
    every = [q for qs in items.values() for q in qs]
    rounds = [document_index(t).search(every, "doc_id", scope=F.col("lang") == lang) for lang in ("en", "fr")]
    return search.first_winning(items, rounds).select("item", "query", "doc_id", "round")


@_r.add("""WITH q AS (SELECT item_id, CASE WHEN item_id % 4 = 0 THEN substr(text, 1, 4) WHEN item_id % 4 = 1 THEN 'zq9' WHEN item_id % 4 = 2 THEN substr(text, 1, 20) ELSE substr(text, 1, 12) || 'QQQQQQQQQQQQQQQQQQQQQQQQQQ' END AS quote FROM benchmark),
g AS (SELECT item_id, count(*) AS grams, count(*) FILTER (EXISTS (SELECT 1 FROM documents WHERE contains(text, gram))) AS found FROM (SELECT DISTINCT item_id, unnest([substr(quote, i, 6) for i in range(1, greatest(length(quote) - 4, 1))]) AS gram FROM q) GROUP BY item_id),
r AS (SELECT item_id, CASE WHEN EXISTS (SELECT 1 FROM documents WHERE contains(text, quote)) THEN 1.0 WHEN length(quote) <= 6 THEN 0.0 ELSE found / grams END AS ratio FROM q LEFT JOIN g USING (item_id))
SELECT item_id, round(CAST(ratio AS DOUBLE), 6) AS ratio, CASE WHEN ratio >= 0.65 THEN 'resolved' WHEN ratio <= 0.3 THEN 'unresolved' ELSE 'weak_match' END AS class FROM r""")
def quote_classes(t: Tables) -> DataFrame:
    k = F.col("item_id") % 4
    quote = F.when(k == 0, F.substring("text", 1, 4)).when(k == 1, "zq9").when(k == 2, F.substring("text", 1, 20)).otherwise(F.concat(F.substring("text", 1, 12), F.lit("Q" * 26)))
    out = document_index(t).quote_classes(t("benchmark").select("item_id", quote.alias("quote")), "quote", ["item_id"])
    return out.select("item_id", F.round("ratio", 6).alias("ratio"), "class")


@_r.add("SELECT source, CAST(count(*) AS BIGINT) AS chunks, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(max(length(text)) AS INTEGER) AS longest FROM documents GROUP BY source")
def layer_stats(t: Tables) -> DataFrame:
    return search.layer_stats(t("documents"), "source", "text")
