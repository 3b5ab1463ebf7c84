"""Retrieval, line and text-statistics queries over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.operators import drafts, search
from dossier.operators.postings import Index, index_of

from .registry import Registry, Tables

_r = Registry()
QUERIES, ORACLE_SQL = _r.queries, _r.sql

#: Each query with its phrases; no phrase overlaps itself, so SQL without look-ahead counts the same.
PHRASES = {"licence": ["licensed under"], "law": ["of the", "and the"], "french": ["que le"], "spanish": ["ción de", "por la"]}


def document_index(t: Tables) -> Index:
    """The index that all search queries read."""
    return index_of(t("documents"), ["doc_id"], ["lang", "source"])


def _bm25_sql(k: int) -> str:
    one = "CASE WHEN {tf} = 0 THEN 0 ELSE greatest(ln((n - {df} + 0.5) / ({df} + 0.5)), 1e-6) * {tf} * 2.2 / ({tf} + 1.2 * (0.25 + 0.75 * size / average)) END"
    phrases = sorted({p for ps in PHRASES.values() for p in ps})
    tf = {p: f"((length(t) - length(replace(t, '{p}', ''))) / {len(p)})" for p in phrases}
    counts = ", ".join(f"count(*) FILTER (WHERE contains(t, '{p}')) AS d{i}" for i, p in enumerate(phrases))
    scored = " UNION ALL ".join(f"SELECT '{q}' AS query, doc_id, {' + '.join(one.format(tf=tf[p], df=f'd{phrases.index(p)}') for p in ps)} AS score FROM x, s" for q, ps in PHRASES.items())
    return f"""WITH x AS (SELECT doc_id, lower(text) AS t, greatest(length(text) - 2, 0) AS size FROM documents),
s AS (SELECT count(*) AS n, avg(size) AS average, {counts} FROM x), a AS ({scored}),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS place FROM a WHERE score > 0)
SELECT query, doc_id, round(score, 6) AS score FROM r WHERE place <= {k}"""


@_r.add(_bm25_sql(3))
def bm25_topk(t: Tables) -> DataFrame:
    scored = document_index(t).bm25(PHRASES)
    return search.top_k(scored, 3, ["doc_id"]).select("query", "doc_id", F.round("score", 6).alias("score"))


@_r.add("SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'licensed') ORDER BY doc_id LIMIT 10")
def substring_scan(t: Tables) -> DataFrame:
    return search.substring_scan(t("documents").select("doc_id", "lang", "text"), "text", "Licensed", "doc_id", 10).select("doc_id", "lang")


@_r.add("""WITH q AS (SELECT item_id, text FROM benchmark WHERE length(text) >= 6), g AS (SELECT DISTINCT item_id, substr(text, i, 6) AS w FROM q, generate_series(1, length(text) - 5) AS s(i)),
c AS (SELECT DISTINCT substr(text, i, 6) AS w FROM documents, generate_series(1, length(text) - 5) AS s(i))
SELECT item_id, CAST(count(g.w) AS BIGINT) AS grams, CAST(count(c.w) AS BIGINT) AS found FROM benchmark LEFT JOIN g USING (item_id) LEFT JOIN c ON g.w = c.w GROUP BY item_id""")
def kgram_existence(t: Tables) -> DataFrame:
    return document_index(t).existence(t("benchmark"), "text", ["item_id"])


@_r.add("""SELECT doc_id, CAST(count(*) AS BIGINT) AS lines, CAST(max(length(l)) AS INTEGER) AS longest, CAST(count(DISTINCT l) AS BIGINT) AS distinct_lines
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) GROUP BY doc_id""")
def line_stats(t: Tables) -> DataFrame:
    rows = t("documents").select("doc_id", F.explode(F.split("text", "\n")).alias("l"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("lines"), F.max(F.length("l")).alias("longest"), F.countDistinct("l").alias("distinct_lines"))


@_r.add("SELECT min(doc_id) AS doc_id, CAST(count(*) AS BIGINT) AS copies FROM documents GROUP BY text")
def exact_dedupe(t: Tables) -> DataFrame:
    """The first of each text in document order."""
    return t("documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")


@_r.add("SELECT lang, CAST(count(*) AS BIGINT) AS chunks, min(n_chars) AS least, median(n_chars) AS mid, max(n_chars) AS most FROM documents GROUP BY lang")
def chunk_stats(t: Tables) -> DataFrame:
    return t("documents").groupBy("lang").agg(F.count("*").alias("chunks"), F.min("n_chars").alias("least"), F.median("n_chars").alias("mid"), F.max("n_chars").alias("most"))


@_r.add("""WITH p AS (SELECT d.doc_id, quality, CASE WHEN n_chars >= 200 AND NOT contains(text, '***') THEN 1 ELSE 0 END AS said FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
SELECT CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN said = quality THEN 1.0 ELSE 0 END), 6) AS accuracy, round(count(*) FILTER (WHERE said = 1 AND quality = 1) / nullif(count(*) FILTER (WHERE quality = 1), 0), 6) AS recall FROM p""")
def recall_accuracy(t: Tables) -> DataFrame:
    said = ((F.col("n_chars") >= 200) & ~F.col("text").contains("***")).cast("int")
    p = t("documents").join(t("labels"), "doc_id").select(said.alias("said"), "quality")
    hits = F.count_if((F.col("said") == 1) & (F.col("quality") == 1))
    return p.agg(F.count("*").alias("n"), F.round(F.avg((F.col("said") == F.col("quality")).cast("double")), 6).alias("accuracy"), F.round(hits / F.nullif(F.count_if(F.col("quality") == 1), F.lit(0)), 6).alias("recall"))


@_r.add("SELECT page_id, regexp_extract(url, '^(https?)://([^/?#]+)', 2) AS host, length(html) AS chars FROM pages")
def page_hosts(t: Tables) -> DataFrame:
    return t("pages").select("page_id", F.regexp_extract("url", r"^(https?)://([^/?#]+)", 2).alias("host"), F.length("html").cast("long").alias("chars"))


@_r.add()
def heading_levels(t: Tables) -> DataFrame:
    rows = drafts.lines(t("documents"), "text", ["doc_id"])
    return rows.withColumn("level", drafts.heading_level(F.col("line"))).where("level is not null").select("doc_id", "line_no", "level")
