"""Evidence, budget, fact and draft queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossier.operators import assembly, bills, cache, evidence, facts, layers, spans
from dossier.sources import corpus
from dossier.sources.scratch import new_folder

from .registry import Registry, Tables

_r = Registry()
QUERIES, ORACLE_SQL = _r.queries, _r.sql


_WALK = """WITH e AS (SELECT user_id, event_id // 500 AS part, event_id, event_type = 'purchase' AS hit, event_type <> 'error' AS sub, 1 + event_id % 7 AS size, CASE WHEN event_id % 3 <> 0 THEN event_id % 4 END AS depth FROM events),
h AS (SELECT *, lead(event_id) OVER (PARTITION BY user_id, part ORDER BY event_id) AS nxt FROM e WHERE hit),
s AS (SELECT h.user_id, h.part, h.event_id AS hit_at, h.nxt, h.depth AS d, e.event_id, e.depth,
h.size + coalesce(sum(e.size) OVER (PARTITION BY h.user_id, h.part, h.event_id ORDER BY e.event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
h.size + sum(e.size) OVER (PARTITION BY h.user_id, h.part, h.event_id) AS total
FROM h JOIN e ON e.user_id = h.user_id AND e.part = h.part AND e.event_id > h.event_id AND (h.nxt IS NULL OR e.event_id < h.nxt) WHERE e.sub),
b AS (SELECT *, coalesce(bool_or(depth <= d) OVER (PARTITION BY user_id, part, hit_at ORDER BY event_id ROWS UNBOUNDED PRECEDING), false) AS past FROM s)"""
_FOLLOWING = "SELECT user_id, part, hit_at, event_id FROM b WHERE used < 12 AND (nxt IS NOT NULL OR total >= 12 OR (d IS NOT NULL AND NOT past))"


@_r.add(f"{_WALK} {_FOLLOWING}")
def continuation_walk(t: Tables) -> DataFrame:
    """Events as chunks of their user and stretch: purchases are hits, errors have no substance, two of three have a heading."""
    return _continued(_chunks(t))


def _chunks(t: Tables) -> DataFrame:
    return t("events").withColumn("part", F.expr("event_id div 500")).withColumn("size", 1 + F.col("event_id") % 7)


def _continued(d: DataFrame) -> DataFrame:
    headed = F.col("event_id") % 3 != 0
    return evidence.continued(d, ["user_id", "part"], "event_id", "size", F.col("event_type") == "purchase", F.col("event_type") != "error", F.when(headed, "number"), F.when(headed, F.col("event_id") % 4), 12)


@_r.add(_WALK.replace("WITH e AS", "WITH RECURSIVE e AS") + f""", f AS ({_FOLLOWING}),
c AS (SELECT user_id, part, hit_at, event_id FROM f UNION ALL SELECT user_id, part, event_id, event_id FROM h),
k AS (SELECT user_id, part, event_id // 3 AS chunk, hit_at % 4 AS item, 1 + event_id % 7 AS size, row_number() OVER (PARTITION BY user_id, part ORDER BY hit_at % 4, hit_at, event_id) AS i FROM c),
walk AS (SELECT user_id, part, i, item, [chunk] AS seen, 0 AS used, CASE WHEN size <= 25 THEN size ELSE 0 END AS own, size > 25 AS done, size <= 25 AS held, CASE WHEN size <= 25 THEN chunk END AS took, size FROM k WHERE i = 1
UNION ALL SELECT user_id, part, i, item, CASE WHEN act = 'take' THEN list_append(seen, chunk) ELSE seen END, used, CASE WHEN act = 'take' THEN own + size ELSE own END, done OR act = 'stop', act IN ('take', 'again'), CASE WHEN act = 'take' THEN chunk END, size FROM
 (SELECT *, CASE WHEN done THEN 'none' WHEN list_contains(seen, chunk) THEN 'again' WHEN (own > 0 AND own + size > 9) OR used + own + size > 25 THEN 'stop' ELSE 'take' END AS act FROM
  (SELECT k.*, seen, CASE WHEN k.item = w.item THEN used ELSE used + own END AS used, CASE WHEN k.item = w.item THEN own ELSE 0 END AS own, k.item = w.item AND done AS done FROM walk w JOIN k ON k.user_id = w.user_id AND k.part = w.part AND k.i = w.i + 1))),
g AS (SELECT DISTINCT user_id, part, unnest(range(5)) AS item FROM e),
z AS (SELECT user_id, part, item, bool_or(held) AS held, coalesce(sum(size) FILTER (WHERE took IS NOT NULL), 0) AS tokens, string_agg(CAST(took AS VARCHAR), ',' ORDER BY i) AS blocks FROM walk GROUP BY ALL)
SELECT user_id, part, item, CASE WHEN held THEN 'ok' WHEN held IS NULL THEN 'unresolved' ELSE 'truncated' END AS state, CAST(coalesce(tokens, 0) AS BIGINT) AS tokens, coalesce(blocks, '') AS blocks FROM g LEFT JOIN z USING (user_id, part, item)""")
def evidence_assembly(t: Tables) -> DataFrame:
    """Purchases as hits of four of five items, with what follows them; three events in a row are one chunk, which only one item pays for."""
    d, keys = _chunks(t), ["user_id", "part"]
    hits = d.where("event_type = 'purchase'").select(*keys, F.col("event_id").alias("hit_at"), "event_id")
    found = _continued(d).select(*keys, "hit_at", "event_id").unionByName(hits)
    found = found.withColumns({"item": F.col("hit_at") % 4, "chunk": F.expr("event_id div 3"), "size": 1 + F.col("event_id") % 7})
    items = d.select(*keys).distinct().withColumn("item", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))))
    out = assembly.assembled(items, found, keys, "item", ["hit_at", "event_id"], "chunk", "size", 9, 25)
    return out.select(*keys, "item", "state", "tokens", F.array_join(F.transform("blocks", lambda b: b["chunk"]), ",").alias("blocks"))


@_r.add("""WITH RECURSIVE t AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n, CAST(l_quantity AS BIGINT) AS size FROM lineitem),
q AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n % 3, n) AS i, n % 3 = max(n % 3) OVER (PARTITION BY l_orderkey) AS last_tier, count(*) OVER (PARTITION BY l_orderkey) AS total FROM t),
walk AS (SELECT l_orderkey, n, i, least(size, CASE WHEN last_tier THEN 70 // total ELSE 70 END) AS kept, 70 - least(size, CASE WHEN last_tier THEN 70 // total ELSE 70 END) AS rest FROM q WHERE i = 1
UNION ALL SELECT q.l_orderkey, q.n, q.i, least(q.size, CASE WHEN last_tier THEN rest // (total - q.i + 1) ELSE rest END), rest - least(q.size, CASE WHEN last_tier THEN rest // (total - q.i + 1) ELSE rest END) FROM walk w JOIN q ON q.l_orderkey = w.l_orderkey AND q.i = w.i + 1)
SELECT l_orderkey, n, CAST(kept AS BIGINT) AS kept FROM walk""")
def tiered_budget(t: Tables) -> DataFrame:
    """Lines of an order as chunks of three tiers that share 70 units."""
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")).cast("long")
    d = t("lineitem").select("l_orderkey", n.alias("n"), F.col("l_quantity").cast("long").alias("size")).withColumn("tier", F.col("n") % 3)
    return evidence.allocated(d, ["l_orderkey"], "n", "tier", "size", 70)


@_r.add("""WITH c AS (SELECT conv_id, turn, greatest(turn - 1, 0) AS cited, substr(text, 1, 12) AS quote FROM conversations),
h AS (SELECT c.conv_id, c.turn, count(DISTINCT p.turn) AS n, min(p.turn) AS page, bool_or(p.turn = cited) AS there FROM c JOIN conversations p ON p.conv_id = c.conv_id AND length(quote) >= 8 AND contains(p.text, quote) GROUP BY ALL)
SELECT conv_id, c.turn AS asked, CASE WHEN NOT there AND n = 1 THEN page ELSE cited END AS turn, CASE WHEN there THEN 'page_ok' WHEN n = 1 THEN 'page_corrected' ELSE 'page_unverified' END AS status FROM c LEFT JOIN h USING (conv_id, turn)""")
def page_correction(t: Tables) -> DataFrame:
    """The first words of each turn, cited from the turn before it."""
    told = t("conversations").select("conv_id", "turn", "text")
    asked = told.select("conv_id", F.col("turn").alias("asked"), F.greatest(F.col("turn") - 1, F.lit(0)).alias("turn"), F.substring("text", 1, 12).alias("quote"))
    return evidence.corrected_pages(asked, told, ["conv_id", "asked"], "conv_id", "turn", "quote", "text").drop("quote")


@_r.add("""SELECT p_partkey, p_name AS name, 'ZB-' || p_partkey AS code, true AS same_name, p_partkey % 2 = 0 AS same_code FROM part""")
def project_facts(t: Tables) -> DataFrame:
    """Names and codes of parts, written as lines of two drafts: the second one adds a lot to each name, and a digit to odd codes."""
    code = F.concat(F.lit("ZB-"), F.col("p_partkey"))
    other = F.concat(code, F.when(F.col("p_partkey") % 2 == 1, "1").otherwise(""))
    drafts = {"a": [F.lit("项目名称 及编号见下"), F.concat(F.lit("|项目名称|"), F.col("p_name"), F.lit(" |项目编号: "), code, F.lit("。"))], "b": [F.concat(F.lit("采购项目名称："), F.col("p_name"), F.lit("（第二标段）")), F.lit("招标编号：详见公告"), F.concat(F.lit("项目编号\t"), other)]}
    sides = []
    for side, lines in drafts.items():
        each = t("part").select("p_partkey", F.posexplode(F.array(*lines)).alias("n", "line"))
        sides.append(facts.side_facts(each, ["p_partkey"], "n", "line").select("p_partkey", F.struct("name", "code").alias(side)))
    d = sides[0].join(sides[1], "p_partkey")
    return d.select("p_partkey", "a.name", "a.code", facts.agree(F.col("a.name"), F.col("b.name"), True).alias("same_name"), facts.agree(F.col("a.code"), F.col("b.code"), False).alias("same_code"))


@_r.add("""WITH p AS (SELECT conv_id, turn + 1 AS page, CASE WHEN turn % 3 <> 1 THEN role END AS text, CASE WHEN turn % 4 = 1 THEN '[表: ' || role || ']' || chr(10) || conv_id || chr(9) || turn || chr(10) || 'x' END AS tab FROM conversations),
b AS (SELECT conv_id, string_agg('【第 ' || page || ' 页】' || chr(10) || concat_ws(chr(10), text, tab), chr(10) || chr(10) ORDER BY page) AS body FROM p WHERE text IS NOT NULL OR tab IS NOT NULL GROUP BY conv_id)
SELECT conv_id, body || chr(10) || chr(10) || 'end' AS body FROM b""")
def rendered_drafts(t: Tables) -> DataFrame:
    """Conversations as drafts: roles are the texts, some pages are blank, some hold a table, and a table without a page ends each."""
    c = t("conversations").withColumn("page", F.col("turn") + 1)
    cells = F.array(F.array(F.col("conv_id").cast("string"), F.col("turn").cast("string")), F.array(F.lit("x")))
    own = c.where("turn % 4 = 1").select("conv_id", "page", "turn", F.col("role").alias("name"), cells.alias("cells"))
    last = c.select("conv_id").distinct().select("conv_id", F.lit(None).cast("long").alias("page"), F.lit(0).cast("long").alias("turn"), F.lit("").alias("name"), F.array(F.array(F.lit("end"))).alias("cells"))
    pages = c.select("conv_id", "page", F.when(F.col("turn") % 3 != 1, F.col("role")).otherwise("  ").alias("text"))
    return evidence.rendered(pages, own.unionByName(last), ["conv_id"], "page", "text", "turn", "name", "cells")


@_r.add("""WITH t AS (SELECT conv_id, turn, role, sum(CASE WHEN turn % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS f, length(role || ' ' || conv_id || repeat('x', 5 * turn)) AS n FROM conversations),
p AS (SELECT conv_id, f, arg_min(role, turn) AS role, string_agg((turn + 1) || ':' || n || ':' || CASE WHEN n < 20 THEN 'blank' WHEN f % 2 = 0 THEN 'image' ELSE 'text' END, '|' ORDER BY turn) AS pages FROM t WHERE f > 0 GROUP BY conv_id, f)
SELECT CAST(conv_id AS VARCHAR) AS case, CAST(f - 1 AS INTEGER) AS place, role || '/t?' AS source, 't_' || CASE WHEN f > 1 THEN '-' || CAST(f AS INTEGER) ELSE '' END || '.txt' AS corpus_file, pages FROM p""")
def corpus_manifest(t: Tables) -> DataFrame:
    """Conversations as drafts of several files of one name, written as a corpus and read by its manifest."""
    page = F.concat(F.lit("【第 "), F.col("turn") + 1, F.lit(" 页】\n"), F.col("role"), F.lit(" "), F.col("conv_id"), F.repeat(F.lit("x"), (5 * F.col("turn")).cast("int")))
    head = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("### 文件: "), F.col("role"), F.lit("/t? (kind=pdf"), F.when(F.expr("(turn div 3) % 2 = 1"), " route=ocr").otherwise(""), F.lit(")\n"))).otherwise("")
    drafts = t("conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat(head, page).alias("x")))), lambda x: x["x"]), "\n").alias("draft"))
    spark = drafts.sparkSession
    path = new_folder(spark, "corpus")
    corpus.write_corpus(corpus.case_files(drafts, ["conv_id"], "draft"), F.col("conv_id"), path)
    told = F.transform("pages", lambda p: F.concat_ws(":", p["page"], p["chars"], p["kind"]))
    return corpus.manifest(spark, path).select("case", "place", "source", "corpus_file", F.array_join(told, "|").alias("pages"))


_LINE = """CASE WHEN conv_id % 4 = 0 THEN CASE WHEN turn = 1 THEN '如有废标情形' ELSE role END WHEN turn % 3 = 0 THEN '第' || (turn + 1) || '章 ' || CASE WHEN conv_id % 3 = 0 THEN '评标办法' ELSE role END
WHEN turn % 3 = 1 THEN '一、 ' || CASE WHEN conv_id % 2 = 0 THEN '资格审查' ELSE role END ELSE role END"""


@_r.add(f"""WITH l AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n, {_LINE} AS line FROM conversations),
k AS (SELECT *, CASE WHEN line LIKE '第%' THEN 1 WHEN line LIKE '一、%' THEN 2 END AS level, regexp_matches(line, '评标办法|资格审查|废标') AS hit FROM l),
c AS (SELECT a.conv_id, a.i AS a, coalesce((SELECT min(b.i) FROM k b WHERE b.conv_id = a.conv_id AND b.i > a.i AND b.level <= a.level), a.n) AS b FROM k a WHERE level IS NOT NULL AND hit),
s AS (SELECT * FROM c UNION ALL SELECT conv_id, greatest(0, i - 40), least(n, i + 81) FROM k WHERE hit AND conv_id NOT IN (SELECT conv_id FROM c)),
m AS (SELECT *, coalesce(a > max(b) OVER (PARTITION BY conv_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS fresh FROM s),
g AS (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS part FROM m)
SELECT conv_id, CAST(min(a) AS INTEGER) AS start, CAST(max(b) AS INTEGER) AS stop FROM g GROUP BY conv_id, part""")
def review_spans(t: Tables) -> DataFrame:
    """Turns as lines: chapters and sections, some of which reviews rest on; every fourth conversation has no heading."""
    line = F.expr(_LINE)
    d = t("conversations").select("conv_id", F.struct("turn", line.alias("line")).alias("x")).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]).alias("lines"))
    return d.select("conv_id", F.explode(spans.review_spans(F.col("lines"))).alias("s")).select("conv_id", "s.start", "s.stop")


_BILL = """CASE CAST(o_orderkey % 7 AS INT) WHEN 0 THEN '【第 ' || (o_orderkey % 9 + 1) || ' 页】' WHEN 1 THEN '投标总价（小写）' WHEN 2 THEN (o_orderkey * 131) || '.25' WHEN 3 THEN '规费 ' || (o_orderkey % 50) || '.50'
WHEN 4 THEN '' WHEN 5 THEN '' || (o_orderkey * 977) ELSE '单位工程 壹佰万元整' END"""


@_r.add(f"""WITH l AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS no, {_BILL} AS line FROM orders),
p AS (SELECT *, line LIKE '【%' AS anchor, string_agg(line, ' ') OVER (PARTITION BY o_custkey ORDER BY no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS ctx FROM l),
c AS (SELECT *, last_value(CASE WHEN anchor THEN CAST(regexp_extract(line, '第 ([0-9]+)', 1) AS INTEGER) END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY no) AS page FROM p),
n AS (SELECT *, list_filter([line, lead(line) OVER w, lead(line, 2) OVER w, lead(line, 3) OVER w, lag(line) OVER w, lag(line, 2) OVER w], lambda x: x IS NOT NULL) AS near, list_filter([line, lead(line) OVER w, lead(line, 2) OVER w, lead(line, 3) OVER w], lambda x: contains(x, '壹佰万元整')) AS caps FROM c WHERE line <> '' WINDOW w AS (PARTITION BY o_custkey ORDER BY no)),
t AS (SELECT o_custkey, no, page, 'total' AS kind, list_max([CAST(a AS DOUBLE) for a in flatten([regexp_extract_all(x, '[0-9]+\\.[0-9]{{1,2}}|[0-9]{{5,}}') for x in near])]) AS value, CASE WHEN page <= 5 THEN 3 ELSE 0 END + 3 + CASE WHEN len(caps) > 0 THEN 2 ELSE 0 END - CASE WHEN regexp_matches(ctx, '单位工程|规费') THEN 3 ELSE 0 END AS score FROM n WHERE NOT anchor AND contains(line, '投标总价')),
s AS (SELECT o_custkey, no, page, 'subtotal' AS kind, CAST(flatten([regexp_extract_all(x, '[0-9]+\\.[0-9]{{1,2}}') for x in near])[1] AS DOUBLE) AS value, 0 AS score FROM n WHERE NOT anchor AND contains(line, '规费')),
a AS (SELECT o_custkey, no, page, 'amount' AS kind, CAST(regexp_extract(line, '[0-9]+\\.[0-9]{{1,2}}', 0) AS DOUBLE) AS value, 0 AS score FROM n WHERE NOT anchor AND regexp_matches(line, '[0-9]+\\.[0-9]{{1,2}}') QUALIFY row_number() OVER (PARTITION BY o_custkey, value ORDER BY no) = 1),
b AS (SELECT o_custkey, value FROM t WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, no) = 1),
u AS (SELECT * FROM t WHERE value IS NOT NULL UNION ALL SELECT * FROM s UNION ALL SELECT a.* FROM a LEFT JOIN b USING (o_custkey) WHERE a.value IS DISTINCT FROM b.value),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, kind ORDER BY CASE WHEN kind = 'total' THEN score ELSE value END DESC, no) AS place FROM u)
SELECT o_custkey, kind, CAST(place AS INTEGER) AS place, page, value, CAST(score AS INTEGER) AS score FROM r WHERE place <= CASE kind WHEN 'total' THEN 6 WHEN 'subtotal' THEN 12 ELSE 8 END""")
def bill_entries(t: Tables) -> DataFrame:
    """Orders of a customer as lines of a priced bill."""
    d = t("orders").select("o_custkey", "o_orderkey", F.expr(_BILL).alias("line"))
    return bills.entries(d, ["o_custkey"], "o_orderkey", "line").select("o_custkey", "kind", F.col("place").cast("int").alias("place"), "page", "value", "score")


@_r.add("SELECT doc_id, CAST(octet_length(encode(text)) AS INTEGER) AS size, true AS made_first, length(text) % 10 = 0 AS made_again FROM documents")
def cached_results(t: Tables) -> DataFrame:
    """Sizes of texts, asked for twice: those of whole results are read the second time."""
    path = new_folder(t("documents").sparkSession, "cache")
    docs = t("documents").select("doc_id", "text", cache.cache_key(F.col("text"), F.lit("engine 1"), F.lit("size"), F.lit("")).alias("key"))
    compute = lambda d: d.select("key", F.octet_length("text").alias("size"), (F.length("text") % 10 != 0).alias("whole"))
    first, again = (cache.cached(docs, "key", path, compute, lambda: F.col("whole")).select("doc_id", "size", F.col("made").alias(f"made_{k}")) for k in ("first", "again"))
    return first.join(again.drop("size"), "doc_id")


@_r.add(f"""WITH l AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n, {_LINE} AS line FROM conversations),
k AS (SELECT *, CASE WHEN line LIKE '第%' THEN 1 WHEN line LIKE '一、%' THEN 2 END AS level FROM l),
h AS (SELECT *, coalesce((SELECT min(b.i) FROM k b WHERE b.conv_id = a.conv_id AND b.i > a.i AND b.level <= a.level), n) AS stop, CASE WHEN level = 2 THEN (SELECT arg_max(b.line, b.i) FROM k b WHERE b.conv_id = a.conv_id AND b.i < a.i AND b.level = 1) END AS above FROM k a WHERE level IS NOT NULL),
s AS (SELECT conv_id, i, stop, concat_ws(' > ', above, line) AS path, row_number() OVER (PARTITION BY conv_id ORDER BY i) - 1 AS pos FROM h UNION ALL SELECT conv_id, 0, n, 'bid', 0 FROM k GROUP BY conv_id, n HAVING count(level) = 0),
c AS (SELECT s.conv_id, pos, path, string_agg(line, chr(10) ORDER BY k.i) AS text FROM s JOIN k ON k.conv_id = s.conv_id AND k.i >= s.i AND k.i < stop GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, text ORDER BY length(path) DESC, pos) AS best, min(pos) OVER (PARTITION BY conv_id, text) AS first FROM c)
SELECT conv_id, 'bid#' || pos AS chunk_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY first) - 1 AS INTEGER) AS seq, path, text FROM o WHERE best = 1""")
def chunks_of_layers(t: Tables) -> DataFrame:
    """Conversations as drafts of the bid's layer, with chapters, sections and, every fourth, without headings."""
    line = F.expr(_LINE)
    d = t("conversations").select("conv_id", F.struct("turn", line.alias("line")).alias("x")).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("draft"))
    found = layers.layer_chunks(d.withColumn("layer", F.lit("bid")), ["conv_id"], "draft", "layer")
    return found.select("conv_id", "chunk_id", "seq", "path", "text")
