"""Continuations, budgets, pages, facts and drafts on small tables of odd rows."""

from pyspark.sql import functions as F

from dossier.operators import evidence, facts


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=repr)


def test_text_after_a_hit_ends_at_the_next_hit_the_budget_or_a_heading(spark):
    data = [
        ("a", 1, 5, True, True, None, None), ("a", 2, 5, False, False, None, None), ("a", 3, 5, False, True, None, None),  # up to the next hit
        ("a", 4, 5, True, True, "n", 2), ("a", 5, 5, False, True, "n", 3), ("a", 6, 5, False, True, "n", 2), ("a", 7, 5, False, True, None, None),  # up to its own level
        ("b", 1, 9, True, True, None, None), ("b", 2, 9, False, True, None, None),  # no heading, no end: nothing
        ("c", 1, 9, True, True, None, None), ("c", 2, 90, False, True, None, None), ("c", 3, 9, False, True, None, None),  # up to the budget
        ("d", 1, 200, True, True, "n", 1), ("d", 2, 1, False, True, None, None), (None, 1, 1, True, True, "n", 1), (None, 2, 1, None, True, "m", 0),
    ]
    d = spark.createDataFrame(data, "f string, n int, size int, hit boolean, sub boolean, fam string, lv int")
    got = evidence.continued(d, ["f"], "n", "size", F.col("hit"), F.col("sub"), F.col("fam"), F.col("lv"), 50)
    assert rows(got, "f", "hit_at", "n") == sorted([("a", 1, 3), ("a", 4, 5), ("c", 1, 2), (None, 1, 2)], key=repr)
    assert evidence.continued(d.limit(0), ["f"], "n", "size", F.col("hit"), F.col("sub"), F.col("fam"), F.col("lv"), 50).count() == 0


def test_tiers_take_in_order_and_the_last_one_shares(spark):
    d = spark.createDataFrame([("x", 1, 2, 10), ("x", 2, 0, 30), ("x", 3, 2, 1), ("x", 4, 1, 50), ("x", 5, 2, 40), ("y", 1, 3, 7), ("z", 1, 0, 500), ("z", 2, 1, 4)], "k string, n int, tier int, size int")
    got = rows(evidence.allocated(d, ["k"], "n", "tier", "size", 100), "k", "n", "kept")
    assert got == [("x", 1, 6), ("x", 2, 30), ("x", 3, 1), ("x", 4, 50), ("x", 5, 13), ("y", 1, 7), ("z", 1, 100), ("z", 2, 0)]


def test_pages_are_corrected_only_within_the_named_file(spark):
    pages = spark.createDataFrame([("f", 1, "the quick brown fox"), ("f", 2, "jumps over lazy dogs"), ("f", 3, "jumps over lazy cats"), ("g", 9, "another long text"), ("g", 10, None)], "file string, page int, text string")
    asked = [(1, "f", 1, "quick brown"), (2, "f", 3, "quick brown"), (3, "f", 1, "jumps over lazy"), (4, "f", 1, "another long"), (5, "f", 2, "quick"), (6, "f", None, "quick brown"), (7, None, 1, "quick brown"), (8, "f", 1, None)]
    got = evidence.corrected_pages(spark.createDataFrame(asked, "id int, file string, page int, quote string"), pages, ["id"], "file", "page", "quote", "text")
    assert [(r["id"], r["page"], r["status"][5:]) for r in got.orderBy("id").collect()] == [
        (1, 1, "ok"), (2, 1, "corrected"), (3, 1, "unverified"), (4, 1, "unverified"), (5, 2, "unverified"), (6, None, "unverified"), (7, 1, "unverified"), (8, 1, "unverified")]


def test_first_valid_facts_win(spark):
    lines = [("a", 1, "项目名称 见下表"), ("a", 2, "项目名称：“桥梁工程”，项目编号：无"), ("a", 3, "项目名称：另一个工程"), ("a", 4, "项目编号  ZB-1 | 备注"), ("b", 1, "工程名称：短"), ("b", 2, None)]
    got = facts.side_facts(spark.createDataFrame(lines, "k string, n int, line string"), ["k"], "n", "line")
    assert rows(got, "k", "name", "code") == [("a", "桥梁工程", "ZB-1"), ("b", None, None)]
    pairs = spark.createDataFrame([("abcd", "abcde"), ("abc", "abcd"), ("abc", "abc"), ("", "abc"), (None, "abc")], "x string, y string")
    assert [tuple(r) for r in pairs.select(facts.agree(F.col("x"), F.col("y"), True), facts.agree(F.col("x"), F.col("y"), False)).collect()] == [(True, False), (False, False), (True, True), (None, None), (None, None)]


def test_drafts_keep_page_numbers_and_tables_stay_with_their_pages(spark):
    pages = spark.createDataFrame([("a", 1, "one"), ("a", 2, " "), ("a", 3, None), ("b", 1, None)], "f string, page int, text string")
    tables = spark.createDataFrame([("a", 3, 1, "t", [["x", None], ["y"]]), ("a", None, 2, None, [["end"]]), ("a", 1, 3, "", [["c"]])], "f string, page int, n int, name string, cells array<array<string>>")
    got = evidence.rendered(pages, tables, ["f"], "page", "text", "n", "name", "cells")
    assert rows(got, "f", "body") == [("a", "【第 1 页】\none\nc\n\n【第 3 页】\n[表: t]\nx\t\ny\n\nend")]
