"""State changes, chunks and searches on small tables of odd rows."""

from pyspark.sql import functions as F

from dossier.operators import chunks, compare, lists, lookups, records, search


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=repr)


def test_repeated_incoming_rows_never_multiply(spark):
    table = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, w string")
    new = spark.createDataFrame([(2, "c", "z", 1), (2, "d", "z", 2), (3, "e", None, 1), (3, "f", None, 2)], "k int, v string, w string, at int")
    assert rows(records.upsert(table, new, ["k"], "at")) == [(1, "a", "x"), (2, "d", "z"), (3, "f", None)]
    assert records.upsert(table, new, ["k"]).count() == 3
    assert rows(records.merge_upsert(table, new, ["k"], ["v"], "at")) == [(1, "a", "x"), (2, "d", "y"), (3, "f", None)]
    assert rows(records.upsert_keeping(table, new, ["k"], ["w"], "at")) == [(1, "a", "x"), (2, "d", "y"), (3, "f", None)]
    more = spark.createDataFrame([("p", 1), ("p", 2), ("q", 3), (None, 4), (None, 5), (" ", 6)], "name string, at int")
    created = records.get_or_create(spark.createDataFrame([("q",)], "name string"), more, ["name"], "name", "at")
    assert rows(created, "name", "at") == [(" ", 6), ("p", 2), (None, 4), (None, 5)]


def test_unknown_status_is_an_error(spark):
    d = spark.createDataFrame([("done",)], "s string")
    assert d.select(records.one_of(F.col("s"), ("done", "open"))).first()[0] == "done"
    try:
        d.select(records.one_of(F.col("s"), ("open",))).collect()
    except Exception as e:
        assert "not a known value: done" in str(e)
    else:
        raise AssertionError


def test_chunks_are_cut_at_anchors_and_by_size(spark):
    text = "start\n【第 7 页】\n" + "x" * 30 + "\n" + "y" * 30 + "\n【第 8 页】\nend"
    d = spark.createDataFrame([(1, text, 3), (2, "short", 4), (3, None, None)], "id int, text string, page int")
    got = rows(chunks.split_chunks(d, ["id"], "text", "page", 50), "id", "piece", "page", "text")
    assert got == [(1, 0, 3, "start"), (1, 1, 7, "【第 7 页】\n" + "x" * 30), (1, 2, 3, "y" * 30), (1, 3, 8, "【第 8 页】\nend"), (2, 0, 4, "short"), (3, 0, None, "")]
    assert [r[0] for r in d.select(chunks.has_substance(F.lit("【第 7 页】\n 12"))).collect()] == [False] * 3


def test_amounts_have_to_be_finite_and_positive(spark):
    d = spark.createDataFrame([(x,) for x in (1.5, 0.0, -1.0, float("inf"), float("nan"), None)], "x double")
    assert [r[0] for r in d.select(compare.positive_amount(F.col("x"))).collect()] == [1.5, None, None, None, None, None]


def test_no_rules_drop_no_references(spark):
    d = spark.createDataFrame([(1, ["a", "b"]), (2, [])], "k int, refs array<string>")
    none = spark.createDataFrame([], "id string")
    assert rows(lookups.known_only(d, "k", "refs", none, "id")) == [(1, ["a", "b"]), (2, [])]
    assert rows(lookups.known_only(d, "k", "refs", spark.createDataFrame([("b",)], "id string"), "id")) == [(1, ["b"]), (2, [])]


def test_searches_without_hits_and_short_queries(spark):
    d = spark.createDataFrame([(1, "AB cd", "x"), (2, "ab", "y"), (3, None, "x")], "id int, text string, tag string")
    assert rows(search.dual_search(d, "text", ["ab", "", "nothing"], ["id"], "id"), "query", "id", "place") == [("ab", 1, 1), ("ab", 2, 2)]
    assert rows(search.dual_search(d, "text", ["ab"], ["id"], "id", scope=lookups.scope("x", None)), "id") == [(1,)]
    assert search.dual_search(d, "text", [""], ["id"], "id").count() == 0
    assert search.overlap_phrases("abcdef gh") == ["abcdef"] and search.overlap_phrases("abc") == []


def test_quotes_of_all_lengths_have_a_class(spark):
    corpus = spark.createDataFrame([("the quick brown fox",), (None,)], "text string")
    quotes = spark.createDataFrame([(1, "qu"), (2, "zz"), (3, "quick brown"), (4, "quick brXXXX"), (5, ""), (6, None), (7, "XXXXXXXXXX")], "id int, quote string")
    got = {r["id"]: (round(r["ratio"], 3), r["class"]) for r in search.quote_classes(quotes, corpus, "quote", "text", ["id"]).collect()}
    assert got == {1: (1.0, "resolved"), 2: (0.0, "unresolved"), 3: (1.0, "resolved"), 4: (0.429, "weak_match"), 5: (0.0, "unresolved"), 6: (0.0, "unresolved"), 7: (0.0, "unresolved")}


def test_percentages(spark):
    d = spark.createDataFrame([("50 %",), ("7.5%",), ("n/a",), (None,)], "t string")
    assert [r[0] for r in d.select(lists.percent(F.col("t"))).collect()] == [50.0, 7.5, None, None]


def test_pieces_of_a_batch_are_handed_on_as_they_come(spark, monkeypatch):
    d = spark.createDataFrame([(i, "\n".join(f"{i} {k}" for k in range(i % 7)), None) for i in range(300)], "id int, text string, page int").coalesce(1)
    monkeypatch.setattr(chunks, "HELD", 600)
    got = rows(chunks.split_chunks(d, ["id"], "text", "page", 0), "id", "piece", "page", "text")
    assert sorted(got, key=repr) == sorted(((i, k, None, f"{i} {k}" if i % 7 else "") for i in range(300) for k in range(max(1, i % 7))), key=repr)
    plan = chunks.split_chunks(d, ["id"], "text", "page", 0)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan
