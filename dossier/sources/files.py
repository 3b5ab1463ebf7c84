"""Files as tables: texts, JSON-lines logs, Word, Excel and PowerPoint files, routes by suffix, and an append sink."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as X

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Suffixes of each route, name spaces of office files, and the rows of a sheet that are read.
ROUTES = {"text": "txt csv md json tsv", "images": "png jpg jpeg bmp tif tiff webp", "word_native": "docx", "word_legacy": "doc", "excel_ooxml": "xlsx xlsm", "excel_xls": "xls", "excel_xlsb": "xlsb", "presentation_native": "pptx", "office_convert": "ppt odt ods odp", "pdf": "pdf"}
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
SHEET_ROWS = 5000


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, modificationTime, length, content) of files at any depth; side files (.units.jsonl and hidden ones) are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.where(~F.col("path").rlike(r"/(\.[^/]*|[^/]*\.units\.jsonl)$"))


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def route(path: Column) -> Column:
    """The kind of reader for a file; `manual` where there is none."""
    out = None
    for name, kinds in ROUTES.items():
        hit = suffix(path).isin(*kinds.split())
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("manual")


def pdf_has_text(content: Column) -> Column:
    return F.decode(content, "ISO-8859-1").contains("/Font")


def texts(files: DataFrame) -> DataFrame:
    """(path, text) of text files as they are; bytes that are no UTF-8 are left out."""
    clean = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "�", "")
    return files.where(route(F.col("path")) == "text").select("path", clean.alias("text"))


def json_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows of JSON-lines logs; blank, torn and other lines that can't be read are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def append_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def fingerprint_matches(files: DataFrame, pointers: DataFrame) -> DataFrame:
    """Pointers (role, sha256, bytes) with `status`: found; mismatched, where only files of that length are there; or absent.

    Only files of a length that is asked for are hashed.
    """
    sized = files.join(pointers.select(F.col("bytes").alias("length")).distinct(), "length", "left_semi")
    hashed = sized.select(F.col("length").alias("bytes"), F.sha2("content", 256).alias("own")).distinct()
    joined = pointers.join(hashed, "bytes", "left").groupBy("role", "sha256", "bytes")
    status = F.when(F.bool_or(F.col("own") == F.col("sha256")), "found").when(F.count("own") > 0, "mismatched").otherwise("absent")
    return joined.agg(status.alias("status"))


def _inner(node: X.Element, tag: str) -> str:
    return "".join(t.text or "" for t in node.iter(tag))


def _word(content: bytes) -> Iterator[tuple[str, int, int, list[str]]]:
    body = X.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{_W}body")
    blocks = [t for p in body.findall(f"{_W}p") if (t := _inner(p, f"{_W}t")).strip()]
    yield from (("block", 0, k, [t]) for k, t in enumerate(blocks))
    for n, table in enumerate(body.findall(f"{_W}tbl")):
        for k, row in enumerate(table.findall(f"{_W}tr")):
            yield "table", n, k, ["\n".join(_inner(p, f"{_W}t") for p in cell.findall(f"{_W}p")) for cell in row.findall(f"{_W}tc")]


def _place(reference: str) -> int:
    letters, n = re.match(r"[A-Z]*", reference)[0], 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n - 1


def _excel(content: bytes) -> Iterator[tuple[str, int, int, list[str]]]:
    z = zipfile.ZipFile(io.BytesIO(content))
    shared = [_inner(s, f"{_S}t") for s in X.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
    targets = {r.get("Id"): r.get("Target") for r in X.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    for n, sheet in enumerate(X.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet")):
        target = targets[sheet.get(f"{_R}id")].removeprefix("/xl/")
        for k, row in enumerate(X.fromstring(z.read(f"xl/{target}")).iter(f"{_S}row")):
            if k >= SHEET_ROWS:
                yield "cut", n, k, [sheet.get("name")]
                break
            cells: list[str] = []
            for c in row.findall(f"{_S}c"):
                value = _inner(c, f"{_S}t") if c.get("t") == "inlineStr" else _inner(c, f"{_S}v")
                cells += [""] * (_place(c.get("r", "")) - len(cells))
                cells.append(shared[int(value)] if c.get("t") == "s" and value else value)
            yield sheet.get("name"), n, k, cells


def _shapes(node: X.Element) -> Iterator[X.Element]:
    """Shapes of a slide in order, those of groups in place of the group."""
    for shape in node:
        if shape.tag == f"{_P}grpSp":
            yield from _shapes(shape)
        else:
            yield shape


def _said(body: X.Element) -> str:
    """Paragraphs as lines, line breaks within one as vertical tabs."""
    text = {f"{_A}t": lambda t: t.text or "", f"{_A}br": lambda t: "\v"}
    return "\n".join("".join(text[t.tag](t) for t in p.iter() if t.tag in text) for p in body.findall(f"{_A}p"))


def _presentation(content: bytes) -> Iterator[tuple[str, int, int, list[str]]]:
    """Shapes with text, rows of tables and pictures, by slide: part_no is the slide's place, row_no that of the shape or row."""
    z = zipfile.ZipFile(io.BytesIO(content))
    targets = {r.get("Id"): r.get("Target") for r in X.fromstring(z.read("ppt/_rels/presentation.xml.rels"))}
    for n, slide in enumerate(X.fromstring(z.read("ppt/presentation.xml")).iter(f"{_P}sldId")):
        target = targets[slide.get(f"{_R}id")].removeprefix("/ppt/")
        for k, shape in enumerate(_shapes(X.fromstring(z.read(f"ppt/{target}")).find(f"{_P}cSld/{_P}spTree"))):
            if (body := shape.find(f"{_P}txBody")) is not None and (text := _said(body)).strip():
                yield "shape", n, k, [text]
            for table in shape.iter(f"{_A}tbl"):
                yield from (("table", n, i, [_said(c.find(f"{_A}txBody")) for c in row.findall(f"{_A}tc")]) for i, row in enumerate(table.findall(f"{_A}tr")))
            if shape.tag == f"{_P}pic":
                yield "picture", n, k, []


_READERS = {"word_native": _word, "excel_ooxml": _excel, "presentation_native": _presentation}


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for path, kind, content in batch.itertuples(index=False):
            try:
                out += [(path, *part, None) for part in _READERS[kind](content)]
            except (zipfile.BadZipFile, KeyError, ValueError, AttributeError, X.ParseError) as e:
                out.append((path, None, None, None, None, type(e).__name__))
        yield pd.DataFrame(out, columns=["path", "part", "part_no", "row_no", "cells", "error"])


def office_rows(files: DataFrame) -> DataFrame:
    """(path, part, part_no, row_no, cells, error): paragraphs and table rows of .docx, sheet rows of .xlsx, shapes of .pptx files.

    A file that can't be read is one row with the error's name.  Sheets end after 5,000 rows; a row `cut` says where one did.
    """
    kinds = files.select("path", route(F.col("path")).alias("kind"), "content").where(F.col("kind").isin(*_READERS))
    return kinds.mapInPandas(_parts, "path string, part string, part_no int, row_no int, cells array<string>, error string")
