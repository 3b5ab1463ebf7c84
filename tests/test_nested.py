import hashlib
import io
import zipfile

from pyspark.sql import functions as F

from dossier.functions import text
from dossier.operators import budget, chapters, trees, verdicts
from dossier.sources import files


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def one(spark, column, **values):
    d = spark.range(1)
    for k, v in values.items():
        d = d.withColumn(k, v if isinstance(v, type(F.lit(1))) else F.lit(v))
    return d.select(column).first()[0]


def test_risk_scores_round_half_to_even_and_stay_in_range(spark):
    got = rows(spark.createDataFrame([(2.5,), (85.0,), (None,), (-3.0,), (990.0,)], "x double").select("x", verdicts.risk_score(F.col("x"))))
    assert dict(got) == {2.5: 2, 85.0: 8, None: 0, -3.0: 0, 990.0: 10}


def test_unconfirmed_and_empty_hits_do_not_reject(spark):
    cases = [([{"quote": "x"}], True), ([{"quote": "x", "confirmed": " 疑似 "}], False), ([{"quote": "x", "confirmed": None}], False), ([{}], False), ([{"quote": ""}], False), ([], False), (None, False), ([{"quote": "x", "confirmed": "yes"}], True)]
    d = spark.createDataFrame([(k, h) for k, (h, _) in enumerate(cases)], "k int, hits array<map<string,string>>")
    got = d.select("k", verdicts.hard_disqualification(F.col("hits"), F.array(F.lit("pass"), F.lit(None).cast("string")))).collect()
    assert [bool(r[1]) for r in sorted(got)] == [c[1] for c in cases]


def test_contents_pages_leave_the_chapter_that_opens_the_text(spark):
    h = spark.createDataFrame([(1, k, 1) for k in (0, 1, 2, 3)] + [(1, 9, 1), (1, 10, 2)], "k int, line_no int, level int")
    assert sorted(r[1] for r in rows(chapters.without_contents(h, ["k"]))) == [3, 9, 10]


def test_paths_of_headings(spark):
    h = spark.createDataFrame([(1, 0, 1, "A"), (1, 1, 2, "B"), (1, 2, 3, "C"), (1, 3, 1, "D"), (1, 4, 3, "E")], "k int, line_no int, level int, title string")
    assert [r.path for r in chapters.paths(h, ["k"]).orderBy("line_no").collect()] == ["A", "A > B", "A > B > C", "D", "D > E"]


def test_tags_refs_and_glued_headings(spark):
    assert one(spark, chapters.tag(F.lit("第四章 评审方法和程序"))) == "evaluation_method"
    assert one(spark, chapters.tag(F.lit("其他"))) == "general" and one(spark, chapters.tag(F.lit(" "))) is None
    assert one(spark, chapters.page_refs(F.lit("见第 3 页、第5-7页，第 10-90 页"))) == [3, 5, 6, 7, 10, 90]
    assert one(spark, chapters.split_glued(F.lit("计算。 第四章 评审方法"))) == ["计算。", "第四章 评审方法"]
    assert one(spark, chapters.split_glued(F.lit("见招标文件第四章 规定"))) == ["见招标文件第四章 规定"]


def test_entities_are_kept_once_where_they_are_first(spark):
    lines = spark.createDataFrame([(1, 0, "2024年3月5日 项目经理：王小明"), (1, 4, "2024-03-05，证书编号: AB-12345")], "k int, line_no int, line string")
    assert {(r.type, r.value, r.line_no) for r in chapters.entities(lines, ["k"]).collect()} == {("date", "2024-03-05", 0), ("person", "王小明", 0), ("cert_no", "AB-12345", 4)}


def test_byte_prefix_ends_at_a_character(spark):
    for n in range(1, 12):
        assert one(spark, budget.head_bytes(F.lit("aé漢😀b"), n)) == "aé漢😀b".encode()[:n].decode(errors="ignore")


def test_text_functions(spark):
    assert one(spark, text.normalized(F.lit("ＡＢ，c 【1】\n"))) == "abc1"
    a, b = (one(spark, text.canonical_hash(F.lit(s))) for s in ('{"a":1,"b":[2]}', '{"b": [2], "a": 1}'))
    assert a == b and len(a) == 16 and one(spark, text.canonical_hash(F.lit("{"))) is None
    assert one(spark, text.last_json_object(F.lit('<think>{"x":1}</think> {"a":{"b":"}"}} then {"c":2} {'))) == '{"c": 2}'


def test_trees(spark):
    nodes = spark.createDataFrame([(1, None), (2, 1), (3, 1), (4, 2), (5, 99)], "id int, up int")
    pairs = trees.closure(nodes, "id", "up")
    assert rows(trees.descendant_counts(pairs)) == [(1, 3), (2, 1), (3, 0), (4, 0), (5, 0)]
    assert rows(trees.matching_branches(pairs, nodes.where("id = 4"), "id")) == [(1,), (2,), (4,)]


def test_closures_have_no_limit_of_levels_and_end_at_circles(spark):
    chain = spark.createDataFrame([(k, k - 1 or None) for k in range(1, 101)], "id int, up int")
    pairs = trees.closure(chain, "id", "up").cache()
    assert rows(trees.descendant_counts(pairs)) == sorted(((k, 100 - k) for k in range(1, 101)), key=repr)
    assert rows(trees.matching_branches(pairs, chain.where("id = 100"), "id")) == sorted(((k,) for k in range(1, 101)), key=repr)
    assert pairs.where("distance != descendant - ancestor").isEmpty()
    circle = spark.createDataFrame([(1, 3), (2, 1), (3, 2), (4, 3), (5, 5)], "id int, up int")
    assert rows(trees.closure(circle, "id", "up")) == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (1, 4, 3), (2, 1, 2), (2, 2, 0), (2, 3, 1), (2, 4, 2), (3, 1, 1), (3, 2, 2), (3, 3, 0), (3, 4, 1), (4, 4, 0), (5, 5, 0)]


def test_closures_have_no_limit_of_rows(spark):
    nodes = spark.range(1, 80_001).select("id", F.expr("nullif(id div 2, 0)").alias("up"))
    got = trees.descendant_counts(trees.closure(nodes, "id", "up")).agg(F.count("*"), F.sum("descendants")).first()
    assert tuple(got) == (80_000, sum(k.bit_length() - 1 for k in range(1, 80_001)))


def archive(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def test_files(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    s = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.docx").write_bytes(archive({"word/document.xml": f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>one</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'}))
    (tmp_path / "sub" / "b.xlsx").write_bytes(archive({
        "xl/workbook.xml": f'<workbook xmlns="{s}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f'<sst xmlns="{s}"><si><t>hi</t></si></sst>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{s}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>7</v></c></row></sheetData></worksheet>',
    }))
    (tmp_path / "bad.docx").write_bytes(b"no archive")
    (tmp_path / "t.txt").write_bytes(b"ok\xff\n")
    (tmp_path / "t.units.jsonl").write_text("{}")
    found = files.listing(spark, f"file://{tmp_path}")
    got = {(r.path.rsplit("/", 1)[1], r.part, r.row_no, tuple(r.cells or ()), r.error) for r in files.office_rows(found).collect()}
    assert got == {("a.docx", "block", 0, ("one",), None), ("a.docx", "table", 0, ("x",), None), ("b.xlsx", "S", 0, ("hi", "", "7"), None), ("bad.docx", None, None, (), "BadZipFile")}
    assert [r.text for r in files.texts(found).collect()] == ["ok\n"]
    digest = hashlib.sha256(b"ok\xff\n").hexdigest()
    pointers = spark.createDataFrame([("a", digest, 4), ("b", "0", 4), ("c", "0", 999)], "role string, sha256 string, bytes long")
    assert {r.role: r.status for r in files.fingerprint_matches(found, pointers).collect()} == {"a": "found", "b": "mismatched", "c": "absent"}


def test_torn_log_lines_are_skipped(spark, tmp_path):
    (tmp_path / "u.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n{"a": ')
    schema = spark.createDataFrame([], "a int").schema
    assert rows(files.json_lines(spark, f"file://{tmp_path}", schema)) == [(1,), (2,)]
