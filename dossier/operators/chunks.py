"""Chunks of drafts: split at page anchors and by size, without copies, in document order; labels, segments and tables of lines."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from .drafts import ANCHOR

# Most characters of a chunk, and section numbers such as 4.7. with their titles.
MOST = 4000
#: Characters that a cut holds before it hands them on, and what each piece counts for besides its own.
HELD, ROW = 1 << 21, 256
DECIMAL = r"^\s*(\d{1,2}(?:\.\d{1,3}){1,4})\.\s*([^\s\d][^\t。；;]{0,38})\s*$"
_LINES = "\n\r\x0b\x0c\x1c\x1d\x1e\x85  "


def _pieces(text: str, most: int, anchor) -> Iterator[tuple[int | None, str]]:
    """(page, text) of each piece."""
    if len(text) <= most:
        yield None, text
        return

    def put(held: list[str]) -> tuple[int | None, str]:
        return next((int(m[2]) for m in map(anchor, held) if m), None), "\n".join(held)

    held, size = [], 0
    for line in text.splitlines():
        if held and (size + len(line) > most or anchor(line)):
            yield put(held)
            held, size = [], 0
        held.append(line)
        size += len(line) + 1
    if held:
        yield put(held)


def split_chunks(df: DataFrame, keys: list[str], text: str, page: str, most: int = MOST) -> DataFrame:
    """(keys, piece, page, text): chunks of over `most` characters cut at lines, before each page anchor and where the next line is too much.

    A piece takes the page of its own first anchor, else the chunk's.  Pieces depend on all lines before them, so a chunk is
    cut by one Arrow-batched function of its text, which hands on pieces as it goes and never holds those of a whole batch.
    """
    import re

    plain = df.select(*keys, F.col(page).cast("int").alias("__page"), F.coalesce(text, F.lit("")).alias("__text"))
    kinds = plain.select(*keys).schema
    out = StructType([*kinds.fields, StructField("piece", IntegerType(), False), StructField("__own", IntegerType()), StructField("__page", IntegerType()), StructField(text, StringType(), False)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = re.compile(ANCHOR)

        def put(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
            at, piece, own, texts = zip(*rows, strict=True)
            whose = pa.array(at, pa.int64())
            return pa.RecordBatch.from_arrays([*(batch.column(i).take(whose) for i in range(len(keys))), pa.array(piece, pa.int32()), pa.array(own, pa.int32()), batch.column(len(keys)).take(whose), pa.array(texts, pa.string())], out.names)

        for batch in batches:
            rows, size = [], 0
            for at, whole in enumerate(batch.column(len(keys) + 1)):
                for n, (own, piece) in enumerate(_pieces(whole.as_py(), most, lambda line: found.match(line.strip()))):
                    rows.append((at, n, own, piece))
                    size += len(piece) + ROW
                    if size > HELD:
                        yield put(batch, rows)
                        rows, size = [], 0
            if rows:
                yield put(batch, rows)

    return plain.mapInArrow(cut, out).select(*keys, "piece", F.coalesce("__own", "__page").alias(page), text)


def has_substance(text: Column) -> Column:
    """Whether a text has any letter outside its page anchors."""
    return F.regexp_replace(text, "(?m)" + ANCHOR.replace("^", r"^\s*").replace("$", r"\s*$"), "").rlike(r"\p{L}")


def in_document_order(chunks: DataFrame, keys: list[str], text: str, path: str, page: str, order: str) -> DataFrame:
    """One chunk of each text, that with the longest path, with `place`: by page, those without one last, as they came."""
    best = F.row_number().over(Window.partitionBy(*keys, F.xxhash64(text), text).orderBy(F.length(path).desc(), order))
    first = F.min(order).over(Window.partitionBy(*keys, F.xxhash64(text), text))
    kept = chunks.withColumn("__first", first).withColumn("__best", best).where("__best = 1")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(page).isNull(), F.coalesce(page, F.lit(0)), "__first"))
    return kept.withColumn("place", place).drop("__first", "__best")


def decimal_heading(line: Column) -> Column:
    """struct<number, title, depth> of a line with a section number, else null."""
    number = F.regexp_extract(line, DECIMAL, 1)
    return F.when(line.rlike(DECIMAL), F.struct(number.alias("number"), F.regexp_extract(line, DECIMAL, 2).alias("title"), F.size(F.split(number, r"\.")).alias("depth")))


def segments(lines: DataFrame, keys: list[str], order: str, outer: Column, inner: Column, name: Column) -> DataFrame:
    """lines with `part` (markers of the outer kind so far), `piece` (of the inner kind since) and the last `name` within the part."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = lines.withColumn("part", F.sum(F.when(outer, 1).otherwise(0)).over(w))
    own = Window.partitionBy(*keys, "part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("piece", F.sum(F.when(inner, 1).otherwise(0)).over(own)).withColumn("name", F.last(F.when(inner, name), ignorenulls=True).over(own))


def tables(lines: DataFrame, keys: list[str], order: str, cells: Column, is_anchor: Column) -> DataFrame:
    """(keys, first, last, rows, width): runs of table rows of one width, merged across exactly one page anchor.

    cells: the cells of a line, null where it is no table row.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    d = lines.withColumn("__width", F.size(cells)).withColumn("__anchor", is_anchor).withColumn("__width", F.when(F.col("__width") > 0, F.col("__width")))
    gaps = d.where(F.col("__width").isNotNull() | F.col("__anchor"))
    prior, one = F.lag("__width").over(w), F.lag(order).over(w)
    two, two_at, anchored = F.lag("__width", 2).over(w), F.lag(order, 2).over(w), F.lag("__anchor").over(w)
    joined = ((prior == F.col("__width")) & (one == F.col(order) - 1)) | (anchored & (two == F.col("__width")) & (two_at == F.col(order) - 2))
    rows = gaps.withColumn("__new", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)).where(F.col("__width").isNotNull())
    rows = rows.withColumn("__table", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "__table").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("rows"), F.max("__width").alias("width")).drop("__table")


def anchor_text(page: Column, last: Column, converted: Column) -> Column:
    """A page anchor as it is written; without a page it says so."""
    name = F.when(converted, "转换稿").otherwise("")
    pages = F.when(last.isNotNull() & (last != page), F.concat_ws("-", page.cast("string"), last.cast("string"))).otherwise(page.cast("string"))
    return F.when(page.isNull(), "页码未知").otherwise(F.concat(F.lit("【"), name, F.lit("第 "), pages, F.lit(" 页】")))
