"""Chunks of a layer: files, headings within headings, contents pages, pages, cuts and copies."""

from dossier.operators import layers

DRAFT = "\n".join([
    "### 文件: a.pdf (kind=pdf)", "【第 1 页】", "第一章 甲", "第二章 乙", "第三章 丙", "text", "【第 2 页】", "第一章 甲", "one", "一、 子", "two", "【第 3 页】", "三 three", "第二章 乙", "same",
    "### 文件: b.pdf", "no heading", "at all", "### 文件: c.pdf", "", "### 文件: d.pdf", "# M", "x" * 30, "y" * 30, "z",
])


def test_chunks(spark):
    d = spark.createDataFrame([("k", DRAFT, "bid"), ("e", " \n", "bid"), ("n", None, "bid"), ("w", "plain", "tender")], "case string, draft string, layer string")
    rows = layers.layer_chunks(d, ["case"], "draft", "layer", most=40).orderBy("case", "seq").collect()
    got = [(r["chunk_id"], r["source"], r["path"], r["page"], r["text"]) for r in rows if r["case"] == "k"]
    assert got == [
        ("bid@1#0", "a.pdf", "第三章 丙", 1, "第三章 丙\ntext\n【第 2 页】"),
        ("bid@1#1", "a.pdf", "第一章 甲", 2, "第一章 甲\none\n一、 子\ntwo\n【第 3 页】\n三 three"),
        ("bid@1#2", "a.pdf", "第一章 甲 > 一、 子", 2, "一、 子\ntwo\n【第 3 页】\n三 three"),
        ("bid@1#3", "a.pdf", "第二章 乙", 3, "第二章 乙\nsame"),
        ("bid@2#0", "b.pdf", "bid", None, "no heading\nat all"),
        ("bid@4#0/0", "d.pdf", "M", None, "# M\n" + "x" * 30), ("bid@4#0/1", "d.pdf", "M", None, "y" * 30 + "\nz"),
    ]
    assert [r["seq"] for r in rows if r["case"] == "k"] == list(range(7))
    assert [(r["case"], r["chunk_id"], r["path"], r["text"]) for r in rows if r["case"] != "k"] == [("w", "tender#0", "tender", "plain")]
