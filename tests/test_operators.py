from pyspark.sql import Row
from pyspark.sql import functions as F

from dossier.operators import drafts, records, search
from dossier.streaming import progress


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_blank_filter_is_no_filter_but_blank_can_be_asked_for(spark):
    df = spark.createDataFrame([(1, ""), (2, "a"), (3, None)], "k int, v string")
    assert len(rows(records.matching(df, {"v": ""}))) == 3
    assert rows(records.matching(df, {"v": ""}, blank_is_any=False)) == [(1, "")]


def test_merge_upsert_writes_nulls_it_is_given_and_adds_rows(spark):
    table = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, w string")
    new = spark.createDataFrame([(2, None), (3, "c")], "k int, v string")
    assert rows(records.merge_upsert(table, new, ["k"], ["v"])) == [(1, "a", "x"), (2, None, "y"), (3, "c", None)]


def test_get_or_create_always_inserts_rows_without_a_number(spark):
    table = spark.createDataFrame([("t", "1")], "tenant string, no string")
    new = spark.createDataFrame([("t", "1"), ("t", "2"), ("t", None)], "tenant string, no string")
    assert rows(records.get_or_create(table, new, ["tenant", "no"], "no")) == [("t", "2"), ("t", None)]


def test_anchors_and_headings(spark):
    text = "【第 3 页】\n第一章 总则\r\n一、范围\n（一）要求\n## Part\nplain\n【转换稿第 7-9 页】"
    d = drafts.lines(spark.createDataFrame([Row(k=1, t=text)]), "t", ["k"])
    got = {r.line_no: (r.page, r.level) for r in d.select("line_no", drafts.anchor_page(F.col("line")).alias("page"), drafts.heading_level(F.col("line")).alias("level")).collect()}
    assert got == {0: (3, None), 1: (None, 1), 2: (None, 2), 3: (None, 3), 4: (None, 2), 5: (None, None), 6: (7, None)}


def test_heading_spans_end_at_the_same_or_a_higher_level(spark):
    h = spark.createDataFrame([(1, 0, 1), (1, 2, 2), (1, 5, 3), (1, 8, 2), (1, 9, 1)], "k int, line_no int, level int")
    got = {r.line_no: r.ends_before for r in drafts.heading_spans(h, ["k"]).collect()}
    assert got == {0: 9, 2: 8, 5: 8, 8: 9, 9: None}


def test_overlapping_occurrences_and_windows(spark):
    d = spark.createDataFrame([("aaaa",)], "t string")
    assert d.select(search.occurrences(F.col("t"), "aaa")).first()[0] == 2
    assert search.windows("ab cdefg") == ["abcdef", "bcdefg"]


def test_progress_stream_equals_the_batch(spark, tmp_path):
    log = spark.createDataFrame([("j", "1", "done"), ("j", "2", "running"), ("j", "2", "done"), ("i", "1", "failed")], "job string, unit string, status string")
    log.write.json(str(tmp_path / "log"))
    stream = progress.progress(progress.log_stream(spark, str(tmp_path / "log"), log.schema))
    assert rows(progress.run_once(stream, "units_seen", str(tmp_path / "cp"))) == [("i", 0, 1), ("j", 2, 3)]


def test_done_units_are_counted_exactly(spark, tmp_path):
    log = spark.range(60_000).selectExpr("if(id % 30000 < 20011, 'j', 'i') AS job", "cast(id % 30000 AS string) AS unit", "if(id % 3 = 0, 'running', 'done') AS status")
    seen = rows(log.where("status = 'done'").groupBy("job").agg(F.countDistinct("unit")))
    log.repartition(3).write.json(str(tmp_path / "log"))
    stream = progress.progress(progress.log_stream(spark, str(tmp_path / "log"), log.schema, 1))
    got = rows(progress.run_once(stream, "units_exact", str(tmp_path / "cp")))
    assert [r[:2] for r in got] == seen and [r[2] for r in got] == [19_978, 40_022]
    assert rows(progress.progress(log)) == got


def test_overlaps_count_windows_of_each_document(spark):
    docs = spark.createDataFrame([(1, "4.1 项目需求及总体 设计方案 等"), (2, "总体设计方案"), (3, "别的"), (4, None), (5, "总体设计方案，总体设计方案")], "k int, text string")
    got = rows(search.overlaps(docs, ["需求及总体设计方案优化", "短"], "text", ["k"]))
    assert got == [("需求及总体设计方案优化", 1, 4), ("需求及总体设计方案优化", 2, 1), ("需求及总体设计方案优化", 5, 1)]
    assert search.overlaps(docs, ["短"], "text", ["k"]).isEmpty()


def test_entry_imports_and_names_agree():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
