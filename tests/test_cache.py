"""Results are computed once for each content, never stored when they are partial, and again for another engine."""

from pyspark.sql import functions as F

from dossier.operators import cache
from dossier.sources.scratch import new_folder


def test_read_through(spark):
    path, asked = new_folder(spark, "cache"), []
    docs = spark.createDataFrame([(1, "abc"), (2, "abc"), (3, "de"), (4, ""), (5, None), (6, "partial")], "id long, text string")

    def compute(todo):
        asked.append(sorted(r["text"] or "" for r in todo.collect()))
        return todo.select("key", F.length("text").alias("size"), (~F.coalesce(F.col("text") == "partial", F.lit(False))).alias("whole"))

    def run(engine, rows=docs):
        keyed = rows.withColumn("key", cache.cache_key(F.col("text"), F.lit(engine), F.lit("p"), F.lit("s")))
        out = cache.cached(keyed, "key", path, compute, lambda: F.col("whole"))
        return {r["id"]: (r["size"], r["made"]) for r in out.collect()}

    first = run("e1")  # null and the empty text have the same bytes
    assert {k: first[k] for k in (1, 2, 3, 6)} == {1: (3, True), 2: (3, True), 3: (2, True), 6: (7, True)} and first[4] == first[5]
    assert asked == [["", "abc", "de", "partial"]]
    asked.clear()
    again = run("e1")
    assert asked == [["partial"]] and {k: m for k, (_, m) in again.items()} == {1: False, 2: False, 3: False, 4: False, 5: False, 6: True}
    asked.clear()
    assert run("e1", docs.where("id < 6")) and asked == []  # nothing to do: not even called
    assert all(m for _, m in run("e2").values()) and len(asked) == 1
    assert run("e1", docs.where("false")) == {}


def test_keys(spark):
    key = lambda *parts: cache.cache_key(*(F.lit(p) for p in parts))
    r = spark.range(1).select(*(key(*p).alias(str(i)) for i, p in enumerate([("a", "b", "c", "d"), ("a", "bc", "", "d"), ("ab", "", "c", "d"), ("a", "b", "c", ""), ("a", "b", "c", "d")]))).first()
    assert len(set(r)) == 4 and r["0"] == r["4"] and all(len(k) == 40 for k in r)
