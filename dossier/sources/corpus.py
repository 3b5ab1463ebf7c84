"""A case's draft as a folder: a text for each source file, and a manifest of its pages, committed as a whole.

`case_files` cuts drafts into files; `write_corpus` writes them through a data source of our own, whose tasks write into
folders of their attempt and whose commit names those folders in manifest.json, which it writes last.  What no committed
attempt wrote is deleted then, and so is what an earlier commit had named; before it, readers see the earlier corpus.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from dossier.operators.drafts import ANCHOR, FILE_HEAD, anchor_page
from dossier.operators.spans import let

from .scratch import prepare

# What is no name of a file, the marks of a route, and the characters that a page with text has at least.
UNSAFE, ROUTE, LEAST_CHARS = r'[\\/:*?"<>|\x00-\x1f]', r"route=([A-Za-z_]+)", 20
MANIFEST = "manifest.json"
_PAGE = "struct<page: int, chars: int, kind: string>"


def _pages(lines: Column, route: Column) -> Column:
    """array<struct<page, chars, kind>> of a file's lines: blank pages too, but not what is blank before the first anchor."""
    start = F.array().cast("array<struct<page: int, text: string>>")

    def step(done: Column, line: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        added = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["page"].alias("page"), F.concat_ws("\n", last["text"], line).alias("text"))))
        fresh = lambda page, text: F.array_append(done, F.struct(page.alias("page"), text.alias("text")))
        empty = F.lit(None).cast("string")
        return F.when(F.trim(line).rlike(ANCHOR), fresh(anchor_page(line), empty)).when(F.size(done) == 0, fresh(F.lit(None).cast("int"), line)).otherwise(added)

    def page(p: Column) -> Column:
        n = F.length(F.regexp_replace(F.coalesce(p["text"], F.lit("")), r"(?U)^\s+|\s+$", ""))
        kind = F.when(n < LEAST_CHARS, "blank").when(route == "ocr", "image").otherwise("text")
        return F.struct(p["page"].alias("page"), n.cast("int").alias("chars"), kind.alias("kind"))

    kept = F.filter(F.aggregate(lines, start, step), lambda p: p["page"].isNotNull() | p["text"].rlike(r"(?U)\S"))
    return F.transform(kept, page)


def _names(bases: Column) -> Column:
    """A name for each base, in order: the first that is free of base.txt, base-2.txt, ..."""

    def step(done: Column, base: Column) -> Column:
        tries = F.transform(F.sequence(F.lit(1), F.size(done) + 1), lambda k: F.concat(base, F.when(k == 1, "").otherwise(F.concat(F.lit("-"), k)), F.lit(".txt")))
        return F.array_append(done, F.get(F.filter(tries, lambda t: ~F.array_contains(done, t)), F.lit(0)))

    return F.aggregate(bases, F.array().cast("array<string>"), step)


def case_files(drafts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, place, source, corpus_file, route, pages, body): the files of drafts, below their head lines; without one, none.

    A draft is gone through as a whole in its task.  Names are unique within a draft, whatever the sources are called.
    """
    marked = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\n|\r"), lambda x: F.struct(F.trim(x).rlike("^### 文件: ").alias("head"), x.alias("line")))
    start = F.array().cast("array<array<string>>")

    def cut(done: Column, x: Column) -> Column:
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.array_append(F.get(done, F.size(done) - 1), x["line"])))
        return F.when(x["head"], F.array_append(done, F.array(x["line"]))).when(F.size(done) > 0, joined).otherwise(done)

    def file(lines: Column) -> Column:
        head = F.trim(F.get(lines, F.lit(0)))
        source = F.trim(F.regexp_extract(head, FILE_HEAD, 1))
        base = F.regexp_replace(F.regexp_replace(F.regexp_extract(source, r"([^/]*)/*$", 1), UNSAFE, "_"), r"^[. ]+|[. ]+$", "")
        route = F.regexp_extract(head, ROUTE, 1)
        body = F.slice(lines, 2, F.size(lines))
        return F.struct(source.alias("source"), F.when(base == "", "source").otherwise(base).alias("base"), route.alias("route"), _pages(body, route).alias("pages"), F.array_join(body, "\n").alias("body"), head.alias("head"))

    found = drafts.select(*keys, F.transform(F.aggregate(marked, start, cut), file).alias("__files"))
    named = found.select(*keys, let(F.col("__files"), lambda f: F.struct(f.alias("files"), _names(F.transform(f, lambda x: x["base"])).alias("names"))).alias("__f"))
    each = named.select(*keys, F.posexplode(F.arrays_zip(F.col("__f.files").alias("file"), F.col("__f.names").alias("name"))).alias("place", "__x"))
    return each.select(*keys, "place", "__x.file.source", F.col("__x.name").alias("corpus_file"), "__x.file.route", "__x.file.pages", F.concat_ws("\n", "__x.file.head", "__x.file.body").alias("body"))


@dataclass
class Part(WriterCommitMessage):
    """What an attempt has written, in a folder of its own."""

    folder: str
    files: int
    pages: int


class CorpusWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType):
        self.path, self.batch, self.names = path.rstrip("/"), uuid.uuid4().hex, schema.fieldNames()

    def _at(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        store, top = self._at()
        folder = f"{self.batch}/{uuid.uuid4().hex}"
        files = pages = 0
        entries = []
        for batch in iterator:
            for row in batch.to_pylist():
                place = f"{folder}/{row['case']}/{row['corpus_file']}"
                store.create_dir(f"{top}/{folder}/{row['case']}", recursive=True)
                with store.open_output_stream(f"{top}/{place}") as out:
                    out.write(row["body"].encode())
                entries.append(json.dumps({**{k: row[k] for k in ("case", "place", "source", "corpus_file", "route")}, "file": place, "pages": row["pages"]}, ensure_ascii=False) + "\n")
                files, pages = files + 1, pages + len(row["pages"])
        if files:
            with store.open_output_stream(f"{top}/{folder}/pages.jsonl") as out:
                out.write("".join(entries).encode())
        return Part(folder, files, pages)

    def commit(self, messages: list[Part | None]) -> None:
        """manifest.json names the folders of this commit alone; it is moved into its place, so it is there as a whole or not."""
        store, top = self._at()
        parts = [{"folder": m.folder, "files": m.files, "pages": m.pages} for m in messages if m is not None and m.files]
        store.create_dir(f"{top}/{self.batch}", recursive=True)
        with store.open_output_stream(f"{top}/{self.batch}/{MANIFEST}") as out:
            out.write(json.dumps({"batch": self.batch, "parts": parts}, indent=2).encode())
        store.move(f"{top}/{self.batch}/{MANIFEST}", f"{top}/{MANIFEST}")
        kept = {p["folder"] for p in parts}
        for info in store.get_file_info(fs.FileSelector(top)):
            if info.type == fs.FileType.Directory and info.base_name != self.batch:
                store.delete_dir(info.path)
        for info in store.get_file_info(fs.FileSelector(f"{top}/{self.batch}")):
            if f"{self.batch}/{info.base_name}" not in kept:
                store.delete_dir(info.path)

    def abort(self, messages: list[Part | None]) -> None:
        store, top = self._at()
        if store.get_file_info(f"{top}/{self.batch}").type == fs.FileType.Directory:
            store.delete_dir(f"{top}/{self.batch}")


class CorpusSource(DataSource):
    """format("dossier_corpus"): case, place, source, corpus_file, route, pages, body, written with mode overwrite."""

    @classmethod
    def name(cls) -> str:
        return "dossier_corpus"

    def writer(self, schema: StructType, overwrite: bool) -> CorpusWriter:
        if not overwrite:
            raise ValueError("a corpus is written as a whole: use mode overwrite")
        return CorpusWriter(self.options["path"], schema)


def write_corpus(files: DataFrame, case: Column, path: str) -> None:
    """The corpus of all cases in a folder that driver and executors reach by its URI; what was there is replaced."""
    spark = files.sparkSession
    prepare(spark)
    spark.dataSource.register(CorpusSource)
    rows = files.select(case.cast("string").alias("case"), F.col("place").cast("int").alias("place"), "source", "corpus_file", "route", F.col("pages").cast(f"array<{_PAGE}>").alias("pages"), "body")
    rows.write.format(CorpusSource.name()).mode("overwrite").save(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(case, place, source, corpus_file, route, file, pages) of a corpus as it was committed."""
    named = spark.read.option("multiLine", True).schema("batch string, parts array<struct<folder: string, files: long, pages: long>>").json(f"{path.rstrip('/')}/{MANIFEST}")
    folders = [p["folder"] for p in named.first()["parts"]]  # one for each task that wrote
    schema = f"case string, place int, source string, corpus_file string, route string, file string, pages array<{_PAGE}>"
    return spark.read.schema(schema).json([f"{path.rstrip('/')}/{f}/pages.jsonl" for f in folders]) if folders else spark.createDataFrame([], schema)
