"""Source divergence audit: how far sources of a language stand apart in their words, by a two-pass vocabulary automaton.

First pass: exact document frequencies of all terms; each language keeps those in at least `least` of its documents.
Second pass: the kept terms, with a delimiter on either side, are compiled into pyahocorasick automata, and documents are
streamed through them to count occurrences.  The `head_terms` terms of most documents are one automaton, which every
task has; documents are streamed through it once.  Words that it doesn't match are few; they are dealt out by a hash into
buckets of at most about `bucket_chars` characters of the other kept terms, and each bucket's words are streamed through the
bucket's own automaton.  So each document is read once, and an automaton has a bound, whatever the size of the vocabulary.

Occurrences are sparse postings (language, term, sources that have it).  A pair's divergence is summed from them: terms of
one side alone are taken together by equal shares, terms of neither by their number, and only terms of both are
compared one by one, within the term's row.

Shares of a billion, in integers: p = 1 + floor(10**9 * (count + 1) / (N + V)), divergence of a term floor((p - q)**2 / q).
Terms are runs of letters and of characters beyond ASCII, with A to Z in lower case; one of more than 64 characters is
counted under its SHA-256, so that no automaton grows with a text.

Defined results: null text, lang and source are empty strings; a group without terms, or a language without kept terms,
is compared all the same (value 0 where nothing is kept).  Repeated rows and null doc_ids are documents of their own.  Ties
are ranked by the bytes of item.  An empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import rolling as R
from .shared import prepare, written

LEAST, RANKS, LONG = 3, 200, 64
#: Terms of the automaton that every task has, characters of a bucket's, and how many groups of documents are broadcast.
HEAD_TERMS, BUCKET_CHARS, MOST_GROUPS = 200_000, 1 << 21, 1 << 16
#: Terms, occurrences and characters that a task holds before it hands them on.
HELD_TERMS, HELD_COUNTS, HELD_CHARS = 1 << 20, 1 << 22, 1 << 24
BILLION = 1_000_000_000
#: All ASCII but letters becomes a space, A to Z lower case.
_PLAIN = bytes(b if b >= 128 or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))
_OVERLONG = re.compile(f"[^ ]{{{LONG + 1},}}")
_SCANNED = "lang string, source string, key string, n long, bucket long, words string"


def plain_text(data: bytes, longs: dict[str, str] | None = None) -> str:
    """Terms of a text between single or more spaces, with a space at both ends; overlong terms as their keys, noted in longs."""
    text = f" {data.translate(_PLAIN).decode()} "

    def key(m: re.Match) -> str:
        k = "0" + hashlib.sha256(m[0].encode()).hexdigest()
        if longs is not None:
            longs[k] = m[0]
        return k

    return _OVERLONG.sub(key, text)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, key, long, df): in how many documents of a task a term is."""

    def out() -> pa.RecordBatch:
        sizes = [len(c) for c in held.values()]
        keys = list(chain.from_iterable(held.values()))
        lang = pa.array(list(held), pa.string()).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
        df = pa.array(np.fromiter(chain.from_iterable(c.values() for c in held.values()), np.int64, len(keys)))
        return pa.RecordBatch.from_arrays([lang, pa.array(keys, pa.string()), pa.array([longs.get(k) for k in keys] if longs else [None] * len(keys), pa.string()), df], ["lang", "key", "long", "df"])

    held: dict[str, Counter[str]] = {}
    longs: dict[str, str] = {}
    for batch in batches:
        for part, texts in R.slices(batch):
            for lang, text in zip(part.column(0).to_pylist(), texts.to_pylist(), strict=True):
                terms = set(plain_text(text.encode(), longs).split(" "))
                terms.discard("")
                held.setdefault(lang, Counter()).update(terms)
            if sum(map(len, held.values())) > HELD_TERMS or sum(map(len, longs.values())) > HELD_CHARS:
                yield out()
                held, longs = {}, {}
    yield out()


def document_frequencies(docs: DataFrame) -> DataFrame:
    """lang, key, long, df: of each term in how many documents of its language it is; long is the term itself where the key is its hash."""
    found = docs.select("lang", "text").mapInArrow(_frequencies, "lang string, key string, long string, df long")
    return found.groupBy("lang", "key", "long").agg(F.sum("df").alias("df"))


class Terms:
    """An automaton of padded terms; values are their numbers."""

    def __init__(self, keys: list[str]):
        self.keys = keys
        self.automaton = ahocorasick.Automaton()
        for i, key in enumerate(keys):
            self.automaton.add_word(f" {key} ", i)
        if keys:
            self.automaton.make_automaton()

    def occurrences(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """For each occurrence in a plain text, where it ends (the place of the space after it) and the term's number."""
        if not self.keys:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        found = np.fromiter(chain.from_iterable(self.automaton.iter(text)), np.int64)
        return found[::2], found[1::2]


def others(text: str, ends: np.ndarray) -> Iterator[str]:
    """Words of a plain text that end at none of the places."""
    space = np.frombuffer(text.encode("utf-32-le"), np.uint32) == 32
    starts, stops = np.flatnonzero(space[:-1] & ~space[1:]) + 1, np.flatnonzero(~space[:-1] & space[1:]) + 1
    left = np.ones(len(stops), bool)
    left[np.searchsorted(stops, ends)] = False
    for a, b in zip(starts[left].tolist(), stops[left].tolist(), strict=True):
        yield text[a:b]


_NAMES = ["lang", "source", "key", "n", "bucket", "words"]


class Counts:
    """Occurrences of an automaton's terms by group, until they are handed on as counts."""

    def __init__(self) -> None:
        self.held: dict[tuple[str, str], list[np.ndarray]] = {}
        self.size = 0

    def add(self, group: tuple[str, str], found: np.ndarray) -> None:
        self.held.setdefault(group, []).append(found.astype(np.int32))
        self.size += len(found)

    def taken(self, terms: Terms) -> pa.RecordBatch:
        counts = [np.unique(np.concatenate(own), return_counts=True) for own in self.held.values()]
        which = pa.array(np.repeat(np.arange(len(counts)), [len(x) for x, _ in counts]))
        lang, source = (pa.array([g[k] for g in self.held], pa.string()).take(which) for k in (0, 1))
        key = pa.array(terms.keys, pa.string()).take(pa.array(np.concatenate([np.zeros(0, np.int32), *(x for x, _ in counts)])))
        n = pa.array(np.concatenate([np.zeros(0, np.int64), *(n for _, n in counts)]))
        self.held, self.size = {}, 0
        return pa.RecordBatch.from_arrays([lang, source, key, n, pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.string())], _NAMES)


def _dealt(words: dict[tuple[int, tuple[str, str]], list[str]]) -> pa.RecordBatch:
    rows = [(*group, None, None, bucket, " ".join(own)) for (bucket, group), own in words.items()]
    kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
    columns = list(zip(*rows, strict=True)) if rows else [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _NAMES)


_LOADED: dict[str, Terms] = {}


def loaded(name: str, shared) -> Terms:
    """The automaton of the head; a worker builds it once."""
    if name not in _LOADED:
        _LOADED.clear()
        _LOADED[name] = Terms(shared.value)
    return _LOADED[name]


def _scan(name: str, shared, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of the head's terms, and the words to be looked up in buckets (none if there are no buckets)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, dealt, chars = Counts(), {}, 0
        for batch in batches:
            terms = loaded(name, shared)
            for part, texts in R.slices(batch):
                groups: dict[tuple[str, str], list[bytes]] = {}
                for lang, source, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts.to_pylist(), strict=True):
                    groups.setdefault((lang, source), []).append(text.encode())
                for group, some in groups.items():
                    text = plain_text(b" ".join(some))
                    ends, found = terms.occurrences(text)
                    counts.add(group, found)
                    for word in others(text, ends) if buckets else ():
                        dealt.setdefault((zlib.crc32(word.encode()) % buckets, group), []).append(word)
                        chars += len(word) + 1
                if counts.size > HELD_COUNTS:
                    yield counts.taken(terms)
                if chars > HELD_CHARS:
                    yield _dealt(dealt)
                    dealt, chars = {}, 0
        if counts.size:
            yield counts.taken(terms)
        yield _dealt(dealt)

    return scan


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by bucket, its terms first and then the words to look up: counts of the terms."""
    bucket, keys, terms, counts = None, [], None, Counts()
    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] != bucket:
                if counts.size:
                    yield counts.taken(terms)
                bucket, keys, terms = row["bucket"], [], None
            if row["key"] is not None:
                keys.append(row["key"])
                continue
            terms = terms or Terms(keys)
            counts.add((row["lang"], row["source"]), terms.occurrences(f" {row['words']} ")[1])
            if counts.size > HELD_COUNTS:
                yield counts.taken(terms)
    if counts.size:
        yield counts.taken(terms)


def occurrences(docs: DataFrame, vocabulary: DataFrame, head_terms: int = HEAD_TERMS, bucket_chars: int = BUCKET_CHARS) -> DataFrame:
    """lang, source, key, n: how often the terms of any language occur in the documents of each group."""
    spark = docs.sparkSession
    keys = vocabulary.groupBy("key").agg(F.sum("df").alias("df"))
    head = written(keys.orderBy(F.col("df").desc(), "key").limit(head_terms).select("key"), "head")
    known = head.toArrow().column("key").to_pylist()  # at most head_terms keys of at most 65 characters
    rest = keys.join(F.broadcast(head), "key", "left_anti")
    size = rest.agg(F.coalesce(F.sum(F.length("key") + 2), F.lit(0))).first()[0]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(size) // bucket_chars)) if size else 0
    scanned = docs.select("lang", "source", "text").mapInArrow(_scan(uuid.uuid4().hex, spark.sparkContext.broadcast(known), buckets), _SCANNED)
    if not buckets:
        return scanned.select("lang", "source", "key", "n")
    scanned = written(scanned, "scanned")
    bucket = F.pmod(F.crc32(F.col("key").cast("binary")), F.lit(buckets))
    terms = rest.select(F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), "key", F.lit(None).cast("long").alias("n"), bucket.alias("bucket"), F.lit(None).cast("string").alias("words"))
    dealt = terms.unionByName(scanned.where("bucket is not null")).repartition("bucket").sortWithinPartitions("bucket", F.col("key").asc_nulls_last())
    found = dealt.mapInArrow(_stream, _SCANNED)
    return scanned.where("key is not null").unionByName(found).select("lang", "source", "key", "n")


def share(count: Column, total: Column) -> Column:
    """Parts of a billion, smoothed by one; total: occurrences and terms."""
    long = lambda c, digits: c.cast(f"decimal({digits},0)")
    return F.call_function("div", long(count + 1, 20) * long(F.lit(BILLION), 10), long(total, 20)) + 1


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What terms of both sources add to a pair: (lang, a, b, value), summed within a task."""

    def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) ** 2 // q

    def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(keys[:, 0] * span + keys[:, 1], kind="stable")
        keys, values = keys[order], values[order]
        first = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]) if len(keys) else np.zeros(0, np.int64)
        return keys[first], np.add.reduceat(values, first) if len(first) else values

    def out(held: dict[str, list]) -> pa.RecordBatch:
        rows = [(lang, *summed(np.concatenate([k for k, _ in own]), np.concatenate([v for _, v in own]))) for lang, own in held.items()]
        keys = np.concatenate([k for _, k, _ in rows]) if rows else np.zeros((0, 2), np.int64)
        values = np.concatenate([v for *_, v in rows]) if rows else np.zeros(0, np.int64)
        langs = [lang for lang, k, _ in rows for _ in range(len(k))]
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(values)], ["lang", "a", "b", "value"])

    held: dict[str, list] = {}
    size, span, most = 0, 1 << 31, 1 << 20
    for batch in batches:
        langs, lists = batch.column(0), batch.column(1)
        lengths = lists.value_lengths().to_numpy()
        numbers, p, p0 = (f.to_numpy(zero_copy_only=False) for f in lists.flatten().flatten())
        starts = np.cumsum(lengths) - lengths
        of = langs.dictionary_encode()
        which, names = of.indices.to_numpy(), of.dictionary.to_pylist()
        for n in np.unique(lengths).tolist():
            for k, name in enumerate(names):
                rows = np.flatnonzero((lengths == n) & (which == k))
                for i in range(0, n if len(rows) and n > 1 else 0):
                    for at in range(0, len(rows), max(1, most // n)):
                        places = starts[rows[at : at + max(1, most // n)]][:, None] + np.arange(n)
                        a = places[:, [i]]
                        # The term is in both: out with what each side adds for a term that it has alone.
                        value = gap(p[a], p[places]) - gap(p[a], p0[places]) - gap(p0[a], p[places]) + gap(p0[a], p0[places])
                        keys = np.stack([np.broadcast_to(numbers[a], places.shape), numbers[places]], axis=-1).reshape(-1, 2)
                        held.setdefault(name, []).append(summed(keys, value.ravel()))
                        size += len(held[name][-1][1])
                        if size > most:
                            yield out(held)
                            held, size = {}, 0
    yield out(held)


def audit(docs: DataFrame, least: int = LEAST, ranks: int = RANKS, head_terms: int = HEAD_TERMS, bucket_chars: int = BUCKET_CHARS) -> DataFrame:
    """lang, source, part, item, value, rank: of each group the other sources by divergence, and the terms that stand out."""
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    vocabulary = written(document_frequencies(docs).where(F.col("df") >= least), "vocabulary")
    found = occurrences(docs, vocabulary, head_terms, bucket_chars)
    # A key is dealt to one task with what all sources say of it, so both sums and the lists below need no further exchange.
    found = found.repartition("lang", "key").groupBy("lang", "key", "source").agg(F.sum("n").alias("n"))
    counts = written(found.join(vocabulary.select("lang", "key", "long"), ["lang", "key"]), "counts")
    kept = vocabulary.groupBy("lang").agg(F.count("*").alias("v"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count("*").alias("terms"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = docs.select("lang", "source").distinct().join(kept, "lang", "left").join(totals, ["lang", "source"], "left").fillna(0, ["v", "n", "terms"])
    lang_n = F.sum("n").over(Window.partitionBy("lang"))
    groups = groups.select("lang", "source", number.cast("long").alias("number"), "v", "terms", (F.col("n") + F.col("v")).alias("total"), (lang_n + F.col("v")).alias("lang_total"))
    zero = F.when(F.col("v") > 0, share(F.lit(0).cast("long"), F.greatest("total", F.lit(1))))
    groups = written(groups.withColumn("p0", zero), "groups")
    few = F.broadcast(groups) if groups.count() <= MOST_GROUPS else groups  # a row for each group
    posting = F.struct("number", share(F.col("n"), F.col("total")).alias("p"), "p0", "source", "n")
    lists = counts.join(few, ["lang", "source"]).groupBy("lang", "key", "long").agg(F.collect_list(posting).alias("found"), F.sum("n").alias("n"), F.first("lang_total").alias("lang_total"))
    lists = written(lists.select("lang", F.coalesce("long", "key").alias("term"), share(F.col("n"), F.col("lang_total")).alias("q"), "found"), "postings")

    both = lists.select("lang", F.transform("found", lambda x: F.struct(x["number"].alias("number"), x["p"].alias("p"), x["p0"].alias("p0"))).alias("found"))
    both = both.mapInArrow(_pairs, "lang string, a long, b long, value long")
    alike = lists.select("lang", F.explode("found").alias("x")).groupBy("lang", F.col("x.number").alias("number"), F.col("x.p").alias("p")).agg(F.count("*").alias("n"))
    other = few.select("lang", F.col("number").alias("to"), F.col("p0").alias("to_p0"))
    alone = alike.join(other, "lang").where("number <> to")
    forth = alone.select("lang", F.col("number").alias("a"), F.col("to").alias("b"), (F.col("n") * divergence(F.col("p"), F.col("to_p0"))).alias("value"))
    back = alone.select("lang", F.col("to").alias("a"), F.col("number").alias("b"), (F.col("n") * divergence(F.col("to_p0"), F.col("p"))).alias("value"))
    named = lambda end: few.select("lang", *(F.col(c).alias(f"{c}_{end}") for c in ("source", "number", "v", "terms", "p0")))
    ends = named("a").join(named("b").drop("v_b"), "lang").where("number_a <> number_b")  # the pairs that are to be told
    sums = both.unionByName(forth).unionByName(back).groupBy("lang", F.col("a").alias("number_a"), F.col("b").alias("number_b")).agg(F.sum("value").alias("sum"))
    neither = F.when(F.col("v_a") > 0, (F.col("v_a") - F.col("terms_a") - F.col("terms_b")) * divergence(F.col("p0_a"), F.col("p0_b"))).otherwise(0)
    pairs = ends.join(sums, ["lang", "number_a", "number_b"], "left")
    pairs = pairs.select("lang", F.col("source_a").alias("source"), F.lit("pair").alias("part"), F.col("source_b").alias("item"), (F.coalesce("sum", F.lit(0)) + neither).cast("long").alias("value"))

    terms = lists.select("lang", "term", "q", F.explode("found").alias("x")).where("x.p > q")
    terms = terms.select("lang", F.col("x.source").alias("source"), F.lit("term").alias("part"), F.col("term").alias("item"), divergence(F.col("x.p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    return pairs.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).where(F.col("rank") <= ranks))
