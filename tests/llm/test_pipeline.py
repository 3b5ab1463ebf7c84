"""The pipeline on odd rows: each stage keeps what its operator's report says, and the columns of documents."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from dossier.llm import leaks, minhash, pieces, quality, secrets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, ids string, key_a string, __q string"


def documents():
    rnd = random.Random(9)
    words = "the of and to in a is that it for on was river stone garden water light table over small green house".split()
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    long = prose(200)
    key = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(40))
    texts = [None, "", " \n", "too short", long, long, long + " end", prose(150), prose(150) + f" password = {key[:20]} and {key} ", prose(300), "w " * 60, "é " + prose(120)]
    texts += [prose(20) + " " + BENCH + " " + prose(100)]
    rows = [(i, t, "en" if i % 3 else None, "s", 0, "x", "y", "z", "q") for i, t in enumerate(texts)]
    return [*rows, (4, long, "en", "s", 0, "x", "y", "z", "q"), (None, long, "en", "s", 0, "x", "y", "z", "q"), (None, None, None, None, None, None, None, None, None)]


BENCH = "one two three four five six seven eight nine ten eleven twelve"


def test_stages_keep_what_reports_say(spark, tmp_path):
    spark.createDataFrame([(1, BENCH), (2, None), (3, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame(documents(), SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs, bench = spark.read.parquet(str(tmp_path / "documents.parquet")), spark.read.parquet(str(tmp_path / "benchmark.parquet"))
    ids = lambda d: sorted((r["doc_id"] for r in d.select("doc_id").collect()), key=str)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name == "quality rules":
            assert ids(out) == ids(quality.quality_report(docs).where("kept")) and 0 < out.count() < docs.count()
        elif name == "MinHash near-dedup":
            report = minhash.near_duplicates(docs)
            assert out.count() == report.where("n_shingles > 0").select("component_id").distinct().count() + report.where("n_shingles = 0").count()
            assert set(ids(out)) <= set(ids(report.where("kept")))
        elif name == "benchmark decontamination":
            assert ids(out) == ids(leaks.decontamination_report(docs, bench).where("not contaminated")) and out.count() == docs.count() - 1
        elif name == "secret scans":
            assert ids(out) == ids(docs)
            found = {r["doc_id"]: len(r["base"]) + len(r["added"]) for r in secrets.secret_spans(docs).collect()}
            masks = {r["doc_id"]: r["n"] for r in out.select("doc_id", F.regexp_count("text", F.lit(r"\[secret\]")).alias("n")).collect()}
            assert masks == found and sum(found.values()) >= 2
            assert out.where("n_chars <> char_length(text)").isEmpty()
        else:
            assert ids(out) == ids(docs) and out.where("not round_trip").isEmpty()
            given = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
            v = pieces.Vocabulary.load()
            assert all(pieces.decode(v, r["ids"]) == given[r["doc_id"]] for r in out.collect())
            assert all(r["nbest_ids"][0] == r["ids"] and all(pieces.decode(v, x) == given[r["doc_id"]] for x in r["nbest_ids"]) for r in out.collect())
            assert len(set(out.columns)) == len(out.columns) and dict(out.dtypes)["score"] == "double"
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            path = str(tmp_path / name.replace(" ", "-"))
            out.write.parquet(path)
            docs = spark.read.parquet(path)
    assert ids(corpus_pipeline.run(spark, str(tmp_path))) == ids(docs)


def test_empty_tables_and_empty_benchmark(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_columns_keep_their_values(spark):
    names = ["__q", "__Q_", "__words", "__hits", "__items", "__spans", "__text", "column0"]
    docs = spark.createDataFrame([(*r[:5], *(f"{r[0]} {n}" for n in names)) for r in documents()], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    bench = spark.createDataFrame([(1, BENCH)], "item_id long, text string")
    for out in (quality.keep_good(docs), leaks.decontaminate(docs, bench), leaks.decontaminate(docs, bench, action="cut"), minhash.drop_near_duplicates(docs), secrets.mask_secrets(docs)):
        assert out.columns == docs.columns and out.schema == docs.schema
        rows = out.collect()
        assert rows and all(r[n] == f"{r['doc_id']} {n}" for r in rows for n in names)
    cut = {r["doc_id"]: r["text"] for r in leaks.decontaminate(docs, bench, action="cut").collect()}
    assert BENCH not in cut[12] and len(cut[12]) > 100
