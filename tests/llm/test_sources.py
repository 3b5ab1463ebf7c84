"""Source divergence, vector codes and mixing against brute force, on small tables of odd rows."""

import collections
import hashlib
import math
import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.llm import codes, divergence, mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, size long, rank long, shard long, key string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(7)
    words = [a + b for a in ("th", "on", "er", "é", "Re", "日") for b in ("in", "at", "ß", "le", "X", "o-o", "1x")]
    long, out = "z" * 70 + "é", []
    for i in range(60):
        n = rnd.choice([0, 1, 3, 40, 200])
        text = "\t ".join(rnd.choice(words) for _ in range(n)) + rnd.choice(["", f" {long}", f" {long}q\x00"])
        out.append((i, text, rnd.choice(["en", "fr", None, ""]), rnd.choice(["a", "b", "c", "é", None]), 9, 9, 9, "k"))
    out += [(60, None, "en", "empty", 9, 9, 9, "k"), (61, "", "xx", "one", 9, 9, 9, "k"), (62, None, "xx", "two", 9, 9, 9, "k"), (None, "thin onat", None, None, 9, 9, 9, "k")]
    out += [(63, "thin " * 3000, "fr", "a", 9, 9, 9, None)] * 2
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def divergences(rows):
    """The contract, term by term and pair by pair."""
    docs = [(lang or "", source or "", TERM.findall(lower(text or ""))) for _, text, lang, source, *_ in rows]
    df = collections.Counter((lang, t) for lang, _, ts in docs for t in set(ts))
    kept = collections.defaultdict(list)
    for (lang, t), n in df.items():
        if n >= 3:
            kept[lang].append(t)
    count = collections.defaultdict(collections.Counter)
    for lang, source, ts in docs:
        for key in ((lang, source), (lang, None)):
            count[key].update(t for t in ts if t in set(kept[lang]))
    p = {key: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept[key[0]])) for t in kept[key[0]]} for key, c in count.items()}
    out = []
    for lang, source in p:
        if source is None:
            continue
        own = p[lang, source]
        pairs = [(b, sum((own[t] - p[a, b][t]) ** 2 // p[a, b][t] for t in own)) for a, b in p if a == lang and b not in (None, source)]
        terms = [(t, (own[t] - q) ** 2 // q) for t, q in p[lang, None].items() if count[lang, source][t] and own[t] > q]
        for part, found in (("pair", pairs), ("term", terms)):
            for rank, (item, value) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode())), 1):
                if part == "pair" or rank <= 200:
                    out.append((lang, source, part, item, value, rank))
    return sorted(out)


@pytest.mark.parametrize("head_terms, bucket_chars", [(200_000, 1 << 21), (5, 40), (0, 1 << 21)])
def test_divergence(docs, rows, head_terms, bucket_chars):
    expected = divergences(rows)
    assert {x[2] for x in expected} == {"pair", "term"} and any(len(x[3]) > 64 for x in expected)
    got = divergence.audit(docs, head_terms=head_terms, bucket_chars=bucket_chars)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == expected


def test_divergence_needs_its_automata(docs, monkeypatch):
    """With empty automata nothing occurs, so no term stands out."""
    monkeypatch.setattr(divergence, "occurrences", lambda docs, *a: docs.select("lang", "source", F.lit("thin").alias("key"), F.lit(0).cast("long").alias("n")).where("false"))
    assert divergence.audit(docs).where("part = 'term'").isEmpty()


def test_divergence_of_few_groups_at_once(docs, rows, monkeypatch):
    monkeypatch.setattr(divergence, "MOST_GROUPS", 0)
    assert sorted(map(tuple, divergence.audit(docs).collect())) == divergences(rows)


def test_padded_terms_are_whole_words():
    terms = divergence.Terms(["a", "ab", "b a"])
    text = divergence.plain_text(b"A ab,AB;abc a")
    ends, found = terms.occurrences(text)
    assert collections.Counter(found.tolist()) == {0: 2, 1: 2} and list(divergence.others(text, ends)) == ["abc"]
    assert list(divergence.others(*(lambda t: (t, divergence.Terms([]).occurrences(t)[0]))(divergence.plain_text(b"x y")))) == ["x", "y"]


def codebooks(kept):
    """The contract, entry by entry."""
    width = len(kept[0][1])
    cuts = [i * width // 4 for i in range(5)]
    parts = [[x[a:b] for _, x, _ in kept] for a, b in zip(cuts, cuts[1:])]
    books = [list(p[:256]) for p in parts]
    near = lambda x, book: min((sum((u - v) ** 2 for u, v in zip(x, y)), i) for i, y in enumerate(book))
    for _ in range(4):
        for k, p in enumerate(parts):
            own = collections.defaultdict(list)
            for x in p:
                own[near(x, books[k])[1]].append(x)
            books[k] = [[sum(c) // len(own[i]) for c in zip(*own[i])] if i in own else y for i, y in enumerate(books[k])]
    digest = hashlib.sha256(",".join(str(v) for b in books for y in b for v in y).encode()).hexdigest()
    out, errors = [], collections.Counter()
    for n, (i, _, label) in enumerate(kept):
        found = [near(parts[k][n], books[k]) for k in range(4)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label))
        errors[label] += out[-1][2]
    return sorted(((i, c, e, errors[label], digest) for i, c, e, label in out), key=repr)


@pytest.fixture(scope="module")
def vectors():
    rnd = random.Random(3)
    out = [(i * 3 % 331, [float(np.float32(rnd.gauss(0, 1))) for _ in range(9)], rnd.choice([1, 2, None]), "k", 1) for i in range(331)]
    out += [(400 + i, out[5][1], 7, "k", 1) for i in range(40)] + [(500, None, 1, "k", 1), (501, [1.0, None] + [0.0] * 7, 1, "k", 1), (502, [float("nan")] * 9, 1, "k", 1), (503, [float("-inf")] * 9, 2, "k", 1)]
    return [*out, (504, [1.0], 2, "k", 1), (505, [], None, "k", 1), (None, [0.0] * 9, None, None, 1), (7, [1e3] * 9, 2, "k", 1), (400, out[5][1], 7, "k", 1)]


VECTORS = "vec_id long, embedding array<float>, label int, code string, error int"


def test_codes(spark, vectors):
    kept = [(i, x, label) for i, x, label, *_ in vectors if x and len(x) == 9 and all(v is not None and math.isfinite(v) for v in x)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    expected = codebooks([(i, [math.floor(1024 * v) for v in x], label) for i, x, label in kept])
    table = spark.createDataFrame(vectors, VECTORS).repartition(4)
    got = codes.code_report(table)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == expected
    few = spark.createDataFrame([(1, [0.5], None, "", 0), (2, [0.25], None, "", 0)], VECTORS)  # parts without any component
    assert [(r[0], r[1], r[2]) for r in codes.code_report(few).orderBy("vec_id").collect()] == [(1, "00000000", 0), (2, "00000001", 0)]
    assert codes.code_report(table.where("false")).collect() == [] == codes.code_report(table.where("embedding is null")).collect()


def test_bounds_hold_the_distances_and_leave_few_entries():
    rnd = np.random.default_rng(1)
    entries, queries = rnd.integers(-500, 500, (256, 16)), rnd.integers(-500, 500, (300, 16))
    entries[9] = entries[3]
    file = codes.VAFile(entries)
    exact = ((queries[:, None] - entries) ** 2).sum(axis=2)
    lower, upper = file.bounds(queries)
    assert (lower <= exact).all() and (exact <= upper).all()
    assert (lower <= upper.min(axis=1, keepdims=True)).mean() < 0.2
    place, distance = file.nearest(queries)
    assert (place == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all() and 9 not in place


def test_decoded_vectors_are_near(spark, vectors):
    table, width = codes.kept(spark.createDataFrame(vectors, VECTORS).where("vec_id between 0 and 330"))
    books = codes.fit_codebooks(table, width)
    back = codes.decode(codes.encode(table, books, width), books).withColumnRenamed("embedding", "back")
    far = F.aggregate(F.zip_with("embedding", "back", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, b: a + b)
    whole = F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x), F.lit(0.0), lambda a, b: a + b)
    error, size = table.where("vec_id <> 7").join(back, "vec_id").agg(F.avg(far), F.avg(whole)).first()
    assert error < 0.2 * size


def test_targets():
    assert mixing.targets({"a": 100, "b": 100, None: 100}) == {"a": 200, "b": Fraction(250, 3), None: Fraction(500, 3)}
    assert mixing.targets({"a": 1, "b": 1000}) == {"a": 2, "b": 1499.5}
    assert mixing.targets({}) == {} and mixing.targets({None: 0}) == {None: 0}


def test_permutations_are_exact(spark):
    for n in (1, 2, 7, 100):
        keys = F.array(*(F.lit(mixing._key(f"{n}/{r}", n)).cast("long") for r in range(mixing.ROUNDS)))
        got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), keys, F.lit("x"))).collect()]
        assert sorted(got) == list(range(n)) and (n < 100 or got != sorted(got))


@pytest.mark.parametrize("block, shard", [(64, 1 << 16), (8, 100)])
def test_mix(spark, docs, rows, block, shard):
    sizes = [len(WORD.findall(t or "")) for _, t, *_ in rows]
    own = collections.Counter()
    for (_, _, _, source, *_), n in zip(rows, sizes):
        own[source] += n
    goal = {s: float(t) for s, t in mixing.targets(dict(own)).items()}
    report = mixing.mix_report(docs, block, shard)
    got = [tuple(r) for r in report.collect()]
    assert report.columns == ["doc_id", "size", "source_size", "target", "taken"]
    assert sorted(((d, n, own[s], goal[s]) for (d, _, _, s, *_), n in zip(rows, sizes)), key=repr) == sorted(((r[0], r[1], r[2], r[3]) for r in got), key=repr)
    assert all(0 <= r[4] <= 2 * r[1] for r in got)
    assert sorted(map(tuple, mixing.mix_report(docs.repartition(5, "text"), block, shard).collect()), key=repr) == sorted(got, key=repr)
    # The mix itself: whole words of its documents, as the report says, with every slot filled once.
    mixed = mixing.mix(docs, block, shard).collect()
    assert len({(r["shard"], r["slot"]) for r in mixed}) == len(mixed) and all(0 <= r["slot"] < shard for r in mixed)
    taken, by_source, passes = collections.Counter(), collections.Counter(), collections.Counter()
    texts = {(d, s): WORD.findall(t or "") for d, t, _, s, *_ in rows}
    for r in mixed:
        assert [w for x in r["docs"] for w in texts[x["doc_id"], r["source"]][x["first"] : x["first"] + x["n"]]] == r["text"].split()
        passes[r["source"], r["block"], r["pass"]] += 1
        by_source[r["source"]] += sum(x["n"] for x in r["docs"])
        for x in r["docs"]:
            taken[x["doc_id"]] += x["n"]
    expected = collections.Counter()
    for d, *_, n in got:
        expected[d] += n
    assert +taken == +expected and set(passes.values()) == {1}
    assert all(abs(by_source[s] - t) < 1.5 * block for s, t in goal.items())
    drawn = collections.Counter((r["shard"], r["source"]) for r in mixed)
    assert block > 8 or len({n for (k, s), n in drawn.items() if s == "a"}) > 2  # shards differ, as draws do


def test_mix_of_nothing(docs):
    assert mixing.mix_report(docs.where("false")).collect() == [] == mixing.mix(docs.where("false")).collect()
    none = mixing.mix_report(docs.where("text is null")).collect()
    assert len(none) == 2 and all(r["taken"] == r["size"] == r["target"] == 0 for r in none)
