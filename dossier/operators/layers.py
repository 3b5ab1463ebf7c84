"""Chunks of a layer: each file of its drafts cut at headings into a forest of spans, or as a whole where there is none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import chapters, chunks, drafts


def file_lines(drafts_: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, file, source, line_no, line): lines of drafts by their files, numbered from 0; source is null before the first head line."""
    d = drafts.lines(drafts_, text, keys).withColumn("__head", F.trim("line").rlike("^### 文件: "))
    so_far = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({"file": F.sum(F.col("__head").cast("int")).over(so_far).cast("int"), "source": F.last(F.when(F.col("__head"), F.trim(F.regexp_extract(F.trim("line"), drafts.FILE_HEAD, 1))), ignorenulls=True).over(so_far)})
    number = F.row_number().over(Window.partitionBy(*keys, "file").orderBy("line_no")) - 1
    return d.where("NOT __head").withColumn("line_no", number).select(*keys, "file", "source", "line_no", "line")


def _title(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, r"^\s*#{1,6}\s+", ""))


def layer_chunks(layers: DataFrame, keys: list[str], text: str, layer: str, most: int = chunks.MOST) -> DataFrame:
    """(keys, chunk_id, seq, source, path, title, page, text): what an index takes in of each layer's draft.

    A heading's chunk is all up to the next one of the same or a higher level, so it holds those below it; headings
    of a contents page are none.  A file without headings is one chunk named after the layer.  Chunks of over `most`
    characters are cut at lines and pages, of equal texts of a file the one with the longest path stays, and all are numbered by
    file and then by page.  chunk_id: the layer, `@` and the number of the file where there are several, the place of the
    heading and, if the chunk was cut, of the piece.  Blank files have no chunks.  A file is gone through in one task, no draft is joined
    with itself.
    """
    own = [*keys, "file"]
    lines = file_lines(layers, keys, text)
    found = lines.withColumn("level", drafts.heading_level(F.col("line"))).where("level IS NOT NULL").select(*own, "line_no", "level", _title(F.col("line")).alias("title"))
    heads = chapters.paths(chapters.without_contents(drafts.heading_spans(found, own), own), own)
    spans = heads.groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("line_no", "ends_before", "path", "title"))).alias("__spans"))
    page = drafts.anchor_page(F.col("line"))
    bodies = lines.groupBy(*own).agg(F.max("source").alias("source"), F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line", page.alias("page")))), lambda x: F.struct(x["line"].alias("line"), x["page"].alias("page"))).alias("__lines"))
    d = bodies.join(spans, own, "left").where(F.exists("__lines", lambda x: x["line"].rlike(r"(?U)\S")))
    files = F.count("*").over(Window.partitionBy(*keys))
    d = d.withColumn("__several", files > 1).join(layers.select(*keys, F.col(layer).alias("__layer")), keys)
    whole = F.array(F.struct(F.lit(0).alias("line_no"), F.lit(None).cast("int").alias("ends_before"), F.col("__layer").alias("path"), F.col("__layer").alias("title")))
    each = d.select(*own, "source", "__layer", "__several", "__lines", F.posexplode(F.coalesce("__spans", whole)).alias("__at", "__s"))
    stop = F.coalesce("__s.ends_before", F.size("__lines"))
    part = F.slice("__lines", F.col("__s.line_no") + 1, stop - F.col("__s.line_no"))
    before = F.filter(F.transform(F.slice("__lines", 1, F.col("__s.line_no") + 1), lambda x: x["page"]), lambda p: p.isNotNull())
    inside = F.filter(F.transform(part, lambda x: x["page"]), lambda p: p.isNotNull())
    first = F.coalesce(F.get(before, F.size(before) - 1), F.get(inside, F.lit(0)))
    cut = each.select(*own, "source", "__layer", "__several", "__at", F.col("__s.path").alias("path"), F.col("__s.title").alias("title"), first.alias("page"), F.array_join(F.transform(part, lambda x: x["line"]), "\n").alias("text"))
    labels = [*own, "source", "__layer", "__several", "__at", "path", "title"]
    pieces = chunks.split_chunks(cut, labels, "text", "page", most)
    many = F.count("*").over(Window.partitionBy(*own, "__at")) > 1
    ident = F.concat(F.col("__layer"), F.when(F.col("__several"), F.concat(F.lit("@"), F.col("file"))).otherwise(""), F.lit("#"), F.col("__at"), F.when(many, F.concat(F.lit("/"), F.col("piece"))).otherwise(""))
    pieces = pieces.withColumns({"chunk_id": ident, "__order": F.col("__at").cast("long") * (1 << 32) + F.col("piece")})
    placed = chunks.in_document_order(pieces, own, "text", "path", "page", "__order")
    seq = F.row_number().over(Window.partitionBy(*keys).orderBy("file", "place")) - 1
    return placed.select(*keys, "chunk_id", seq.alias("seq"), "source", "path", "title", "page", "text")
