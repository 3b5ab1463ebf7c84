"""Drafts cut into files, unique names, pages; a corpus is there as a whole or not at all, whatever became of tasks."""

import json
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from dossier.sources import corpus

DRAFT = """before any file
### 文件: a/b:c.pdf (kind=pdf route=ocr)
 
【第 1 页】
twenty characters or more of text
【第 2 页】

【转换稿第 3 页】
short
### 文件: b_c.pdf
no anchor here, but text enough to count
### 文件: /x/b_c.pdf
### 文件: ... (kind=word)
【第1页】"""


@pytest.fixture
def drafts(spark):
    return spark.createDataFrame([("k1", DRAFT), ("k2", "nothing"), ("k3", None), ("k4", "### 文件: b.txt\nx\n### 文件: b.txt-2\n### 文件: b.txt\n### 文件: b.txt")], "case string, draft string")


def test_files_of_drafts(drafts):
    got = {}
    for r in corpus.case_files(drafts, ["case"], "draft").orderBy("case", "place").collect():
        got.setdefault(r["case"], []).append((r["source"], r["corpus_file"], r["route"], [tuple(p) for p in r["pages"]]))
    assert got["k1"] == [
        ("a/b:c.pdf", "b_c.pdf.txt", "ocr", [(1, 33, "image"), (2, 0, "blank"), (3, 5, "blank")]), ("b_c.pdf", "b_c.pdf-2.txt", "", [(None, 40, "text")]),
        ("/x/b_c.pdf", "b_c.pdf-3.txt", "", []), ("...", "source.txt", "", [(1, 0, "blank")]),
    ]
    assert [f for _, f, *_ in got["k4"]] == ["b.txt.txt", "b.txt-2.txt", "b.txt-3.txt", "b.txt-4.txt"]
    assert set(got) == {"k1", "k4"}


def committed(path):
    return sorted(str(p.relative_to(path)) for p in Path(path).rglob("*") if p.is_file() and not p.name.startswith("."))


def test_a_corpus_is_written_as_a_whole(spark, drafts, tmp_path):
    path = f"file://{tmp_path}"
    files = corpus.case_files(drafts, ["case"], "draft").repartition(3)
    corpus.write_corpus(files, F.col("case"), path)
    rows = corpus.manifest(spark, path).collect()
    assert len(rows) == 8 and sum(len(r["pages"]) for r in rows) == sum(p["pages"] for p in json.loads((tmp_path / "manifest.json").read_text())["parts"])
    text = {(r["case"], r["corpus_file"]): (tmp_path / r["file"]).read_text() for r in rows}
    assert text["k1", "b_c.pdf-2.txt"] == "### 文件: b_c.pdf\nno anchor here, but text enough to count"
    first = committed(tmp_path)
    # A task that fails after it has written: the earlier corpus stays, and nothing else.
    broken = files.withColumn("body", F.when((F.col("case") == "k4") & (F.col("place") == 3), F.raise_error(F.lit("lost"))).otherwise(F.col("body")))
    with pytest.raises(Exception, match="lost"):
        corpus.write_corpus(broken.coalesce(1), F.col("case"), path)
    assert committed(tmp_path) == first
    # An attempt that was lost without a word leaves a folder that the next commit takes away.
    os.makedirs(tmp_path / "stray/1")
    (tmp_path / "stray/1/page.txt").write_text("x")
    corpus.write_corpus(files.where("case = 'k1'"), F.col("case"), path)
    assert {r["case"] for r in corpus.manifest(spark, path).collect()} == {"k1"} and not any("stray" in f for f in committed(tmp_path)) and len(committed(tmp_path)) < len(first)
    corpus.write_corpus(files.where("false"), F.col("case"), path)
    assert corpus.manifest(spark, path).isEmpty()


def test_parts_that_no_message_names_are_not_kept(tmp_path):
    import pyarrow as pa

    writer = corpus.CorpusWriter(f"file://{tmp_path}", corpus.StructType())
    row = {"case": "c", "place": 0, "source": "s", "corpus_file": "s.txt", "route": "", "pages": [{"page": 1, "chars": 3, "kind": "blank"}], "body": "abc"}
    lost, kept = (writer.write(iter([pa.RecordBatch.from_pylist([row])])) for _ in range(2))
    writer.commit([kept, None])
    assert [p["folder"] for p in json.loads((tmp_path / "manifest.json").read_text())["parts"]] == [kept.folder] and not (tmp_path / lost.folder).exists()
