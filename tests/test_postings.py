"""The inverted index against plain scans: odd texts, segments that replace files, and what its plans read."""

import random
import re

import pytest
from pyspark.sql import functions as F

from dossier.operators import postings, search
from dossier.sources.scratch import new_folder

SCHEMA = "id long, file string, text string, lang string"


def texts(seed, n):
    rnd = random.Random(seed)
    words = ["ab", "Ab", "aab", "the", "THE", "ÉÀ", "日本語", "x", "\n", "\x00", "😀y", "co-op"]
    return [None, "", "a", "ab", "abc", "bcdefg", "tab"] + [" ".join(rnd.choice(words) for _ in range(rnd.choice([2, 9, 60]))) for _ in range(n)]


@pytest.fixture(scope="module")
def first(spark):
    return spark.createDataFrame([(i, f"f{i % 20}", t, "en" if i % 3 else "fr") for i, t in enumerate(texts(1, 50))], SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def index(spark, first):
    return postings.Index(spark, new_folder(spark, "test"), ["id"], ["lang"], "file").add(first)


def count(text, phrase):
    return len(re.findall(f"(?={re.escape(phrase.lower())})", (text or "").lower()))


PHRASES = ["a", "ab", "abc", "aa", "the ab", "éà 日本", "日本語 the", "\x00", "😀y x", "y", "co-op", "never there", "aab aab", "efg"]


def test_places_are_all_occurrences(index, first):
    rows = {r["id"]: r["text"] for r in first.collect()}
    got = index.places(PHRASES).join(index.docs().select("__segment", "__id", "__text"), ["__segment", "__id"]).collect()
    assert sorted((r["phrase"], r["__text"], r["n"]) for r in got) == sorted((p, t or "", count(t, p)) for p in PHRASES for t in rows.values() if count(t, p))


def test_chunks_of_a_long_text(spark, index, first, monkeypatch):
    batches = [b for b in index.docs().select("__id", "__text", F.lower("__text").alias("low")).orderBy("__id").toArrow().to_batches()]

    def listed():
        return sorted((r["kind"], r["gram"], r["slice"], a) for b in postings._posted(iter(batches)) for r in b.to_pylist() for a in r["at"])

    whole = listed()
    monkeypatch.setattr(postings, "CHUNK", 7)
    assert sorted(set(listed())) == whole


def test_search_equals_the_scan(index, first):
    queries = ["the ab", "aab", "日本語", "nothing at all", "", "é"]
    order = lambda df: sorted((r["query"], r["id"], round(r["score"], 9), r["place"]) for r in df.collect())
    plain = first.withColumn("low", F.lower("text"))
    for scope in (None, F.col("lang") == "fr"):
        assert order(index.search(queries[:5], "id", scope=scope)) == order(search.dual_search(first, "text", queries[:5], ["id"], "id", scope=scope))
    assert order(index.search(["the abb", "aab ab", "short"], "id", overlap=True)) == order(search.dual_search(first, "text", ["the abb", "aab ab", "short"], ["id"], "id", overlap=True))
    # Unlike the scan, both channels take letters beyond ASCII in either case.
    assert {r["id"] for r in index.search(["é"], "id", limit=99).collect()} == {r["id"] for r in plain.where(F.col("low").contains("é")).collect()}


def test_quotes(spark, index, first):
    held = [r["text"] for r in first.where("length(text) > 30").orderBy("id").limit(3).collect()]
    quotes = spark.createDataFrame([(1, held[0][5:25]), (2, held[1][:9] + "zzzzzz"), (3, "abc"), (4, "zzz"), (5, ""), (6, None), (7, held[2]), (8, "bcdefg"), (9, "THE ab")], "q long, quote string")
    same = lambda df: sorted((r[0], *(round(x, 9) if isinstance(x, float) else x for x in r[1:])) for r in df.collect())
    assert same(index.existence(quotes, "quote", ["q"])) == same(search.existence(quotes, first, "quote", "text", ["q"]))
    got = same(index.quote_classes(quotes, "quote", ["q"]))
    assert got == same(search.quote_classes(quotes, first, "quote", "text", ["q"]))
    assert {q: c for q, _, c in got} == {1: "resolved", 2: "weak_match", 3: "resolved", 4: "unresolved", 5: "unresolved", 6: "unresolved", 7: "resolved", 8: "resolved"} | {9: dict((q, c) for q, _, c in got)[9]}


def test_segments_replace_and_remove_files(spark, first):
    index = postings.Index(spark, new_folder(spark, "test"), ["id"], ["lang"], "file").add(first)
    new = spark.createDataFrame([(100 + i, f"f{i % 5}", t, "en") for i, t in enumerate(texts(2, 20))], SCHEMA)
    gone = spark.createDataFrame([("f19",), ("f18",)], "file string")
    index.add(new).add(new.where("false"), gone=gone).add(new.where("file = 'f1'").withColumn("text", F.concat("text", F.lit(" again"))))
    today = first.where("file NOT IN ('f0', 'f1', 'f2', 'f3', 'f4', 'f18', 'f19')").unionByName(new.where("file <> 'f1'")).unionByName(new.where("file = 'f1'").withColumn("text", F.concat("text", F.lit(" again"))))
    order = lambda df: sorted((r["query"], r["id"], round(r["score"], 9)) for r in df.collect())
    queries = ["the ab", "again", "aab"]
    assert order(index.search(queries, "id", limit=50)) == order(search.dual_search(today, "text", queries, ["id"], "id", limit=50))
    quotes = spark.createDataFrame([(1, "ab again"), (2, "日本語 the")], "q long, quote string")
    same = lambda df: sorted(tuple(r) for r in df.collect())
    assert same(index.quote_classes(quotes, "quote", ["q"])) == same(search.quote_classes(quotes, today, "quote", "text", ["q"]))


def test_an_unfinished_segment_is_not_read_and_written_anew(spark, first):
    path = new_folder(spark, "test")
    index = postings.Index(spark, path, ["id"], ["lang"], "file").add(first)
    first.write.parquet(f"{path}/1/docs")  # a job that was lost before its end
    assert index.docs().count() == first.count()
    index.add(first.limit(1))
    assert index._segments() == [0, 1]


def test_searches_read_no_text_and_only_the_buckets_of_their_grams(index, spark):
    plan = index.search(["co-op"], "id")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    scans = re.findall(r"ReadSchema: (\S+)", plan)
    assert scans and not any("__text" in s for s in scans)
    buckets = re.search(r"PartitionFilters: \[[^\n]*bucket#\d+ IN \(([^)]*)\)|PartitionFilters: \[[^\n]*\(bucket#\d+ = (\d+)\)", plan)
    assert buckets and len((buckets[1] or buckets[2]).split(",")) <= 3 and "PushedFilters: [In(gram" in plan


def test_an_empty_corpus(spark, first):
    index = postings.Index(spark, new_folder(spark, "test"), ["id"], ["lang"], "file").add(first.where("false"))
    assert index.search(["the ab", "a"], "id").isEmpty() and index.places([]).isEmpty()
    assert [tuple(r) for r in index.existence(spark.createDataFrame([(1, "abcdefgh")], "q long, quote string"), "quote", ["q"]).collect()] == [(1, 3, 0)]


def shuffled_records(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30000)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_a_build_shuffles_texts_and_no_postings(spark, first):
    before = shuffled_records(spark)
    index = postings.Index(spark, new_folder(spark, "test"), ["id"], ["lang"], "file").add(first)
    assert shuffled_records(spark) - before < 4 * first.count() < index._all("postings").count()


def test_short_quotes(spark, index, first):
    quotes = spark.createDataFrame(list(enumerate(["a", "Ab", "aB", "THE", "\n", "😀y", "本語 t", "ab\nab", "É", "é", "efg", "cdefg", "zz", "abcdefg", "", None])), "q long, quote string")
    same = lambda df: sorted(r[0] for r in df.collect())
    assert same(index.held_short(quotes, "quote", ["q"])) == same(search.held_whole(quotes.where("length(quote) < 6"), first, "quote", "text", ["q"]))


def test_strings_of_texts_of_any_characters():
    texts = ["a😀b日a😀b日", "", "ab", "日本\x00語é", "b日a"]
    for n in range(1, 6):
        for some in (texts, ["abcabcab", "bca"]):
            assert sorted(postings.strings([postings.codes(t) for t in some], n)) == sorted({t[i : i + n] for t in some for i in range(len(t) - n + 1)})
