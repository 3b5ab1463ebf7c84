"""Substring dedup by repeated-phrase automata: remove words of passages that an earlier document has.

Texts become sequences of word hashes, in slices ordered by document.  One bucket pass (buckets.py) over all windows
of `length` words confirms what recurs in several documents, and where it comes first: the longest runs of such
windows, each in its first document only, are the recurring passages.  They are dealt to shards of bounded size.  Of
each passage, phrases of `phrase` words are compiled into the shard's Aho-Corasick automaton, so near to each other
that every window holds one (the rarest that are near enough, so that common lines aren't among them).  All documents
are streamed through each automaton, one shard at a time; where a phrase occurs, the text and the passage are followed
to both sides, word by word, and a stretch of at least `length` words is an occurrence of the passage.  What a later
document has of a passage is removed.

An automaton's letters are bytes, two of each word's hash; stretches of a text in which no phrase begins with its first
words (by a bitmap of hashes, which has no misses) are passed over.  Every occurrence is verified by the words' 64-bit hashes, at
least `length` of them.  A pass over all documents is made for each shard, and shards grow with what recurs, so a
larger `shard_words` (about 60 bytes of a worker's memory each) means fewer passes.

Defined results: null texts have no words; texts shorter than a window keep all words; rows with the same doc_id
are one document; a null doc_id comes after all others, and rows without one don't make each other lose words.
Extra columns are ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from itertools import pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import buckets as B
from . import rolling as R
from .shared import prepare, removed, shared_dir, written

LENGTH, PHRASE, SHARD_WORDS, SLICE_WORDS = 50, 10, 4 << 20, 1 << 20
#: First words of a phrase, by which texts are looked through for it.
HEAD = 4
#: A passage of more words is cut into several, which overlap by a window less a word.
PASSAGE_WORDS = 1 << 16
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SLICE = "slice long, low long, words binary, docs binary, sizes binary, key_a binary, key_b binary, windows long"
_PASSAGE = "doc long, n int, words binary"
_SPANS = "key_a long, key_b long, spans array<struct<s: int, e: int>>"


def _word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts, and where each text's begin."""
    buf, offsets = R.flat(texts)
    starts, ends, first = R.words(buf, offsets, R.SPACE)
    return R.byte_ranges(buf).of(starts, ends, 1), first


def _slices(length: int, slice_words: int):
    """Slices of whole documents in order; one document may have several of its own, but none shares a part of it."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        done: list[tuple] = []  # whole documents
        last: list[tuple] = []  # rows of the document that is being read
        began = True  # it is the first of the partition, so the one before may have rows of it too

        def put(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            nonlocal number
            if rows:
                docs, a, b, words = zip(*rows, strict=True)
                sizes = np.array([len(w) for w in words])
                every = [B.zipped(np.concatenate(words)), *(B.zipped(np.array(x, np.int64)) for x in (docs, sizes, a, b))]
                columns = [number, docs[0], *every, int((sizes - length + 1).sum())]
                kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 5, pa.int64()]
                names = ["slice", "low", "words", "docs", "sizes", "key_a", "key_b", "windows"]
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(columns, kinds, strict=True)], names)
                number += 1

        def many(rows: list[tuple]) -> bool:
            return sum(len(r[3]) for r in rows) >= slice_words

        for batch in batches:
            for part, texts in R.slices(batch):
                hashes, first = _word_hashes(texts)
                docs, a, b = (part.column(i).to_pylist() for i in range(3))
                for i in np.flatnonzero(np.diff(first) >= length).tolist():
                    if last and last[0][0] != docs[i]:
                        if began or many(last):
                            yield from put(done)
                            yield from put(last)
                            done = []
                        else:
                            done += last
                        last, began = [], False
                        if many(done):
                            yield from put(done)
                            done = []
                    elif many(last):
                        yield from put(done)
                        yield from put(last)
                        last, done, began = [], [], True
                    last.append((docs[i], a[i], b[i], hashes[first[i] : first[i + 1]]))
        yield from put(done)
        yield from put(last)  # the next partition may have rows of it too

    return pack


class Words:
    """A slice's words, and its windows with their documents."""

    def __init__(self, row: dict, length: int):
        self.words, self.docs, sizes = B.unzipped(row["words"], np.uint64), B.unzipped(row["docs"]), B.unzipped(row["sizes"])
        self.first = np.r_[0, np.cumsum(sizes)]
        counts = sizes - length + 1
        self.at = np.repeat(self.first[:-1], counts) + R.runs(counts)
        self.doc = np.repeat(self.docs, counts)
        self.entries = B.Entries(R.Ranges(self.words).of(self.at, self.at + length, 2), 64)


def _sent(length: int, range_bits: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                own = Words(row, length)
                docs = own.doc[own.entries.order]
                ends = own.entries.first + own.entries.counts - 1
                yield from B.sent([(own.entries.values, docs[own.entries.first] != docs[ends])], 64, row["slice"], row["low"], range_bits)

    return send


def _passages(length: int):
    """Runs of windows that recur, in their first document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                own = Words(row, length)
                firsts = own.doc[own.entries.order][own.entries.first]
                first = own.entries.of_places(B.read_bits(row["bits"])[0]) & (own.doc == own.entries.of_places(firsts))
                at = np.flatnonzero(first)
                text = np.searchsorted(own.first, own.at[at], "right")
                new = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (np.diff(text) != 0)]) if len(at) else at
                out = []
                for a, b in pairwise(np.r_[new, len(at)].tolist()):
                    start, end = int(own.at[at[a]]), int(own.at[at[b - 1]]) + length
                    for s in range(start, max(start + 1, end - length + 1), PASSAGE_WORDS - length + 1):
                        e = min(end, s + PASSAGE_WORDS)
                        out.append((int(own.doc[at[a]]), e - s, B.zipped(own.words[s:e])))
                columns = list(zip(*out, strict=True)) if out else [()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.binary()), strict=True)], ["doc", "n", "words"])

    return cut


def _letters(words: np.ndarray) -> str:
    """Two letters for each word."""
    return (words >> R.U64(48)).astype("<u2").tobytes().decode("latin-1")


class Shard:
    """An automaton of phrases, and the passages that they come from."""

    def __init__(self, docs: np.ndarray, sizes: np.ndarray, words: np.ndarray, length: int, phrase: int):
        self.docs, self.words, self.length, self.phrase = docs, words, length, phrase
        self.first = np.r_[0, np.cumsum(sizes)]
        places: dict[str, list[tuple[int, int]]] = {}  # of each phrase: passage, and place in all words
        letters = _letters(words)
        for p, at in self.chosen():
            places.setdefault(letters[2 * at : 2 * (at + phrase)], []).append((p, at))
        self.automaton = ahocorasick.Automaton()
        for key, own in places.items():
            self.automaton.add_word(key, own)
        if len(self.automaton):
            self.automaton.make_automaton()
        self.bits = len(places).bit_length() + 6
        self.begins = np.zeros(1 << self.bits, bool)
        at = np.array([place for own in places.values() for _, place in own], np.int64)
        if len(at):
            self.begins[self.head(words, at)] = True

    def head(self, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Places in the bitmap of the first words of phrases at places."""
        return (R.Ranges(words).of(at, at + min(HEAD, self.phrase), 4) >> R.U64(64 - self.bits)).astype(np.int64)

    def chosen(self) -> Iterator[tuple[int, int]]:
        """Places of phrases, one in every window: of those near enough to the one before the rarest, and then the farthest."""
        if not len(self.words):
            return
        grams = R.Ranges(self.words).of(np.arange(len(self.words) - self.phrase + 1), np.arange(self.phrase, len(self.words) + 1), 6)
        _, which, counts = np.unique(grams, return_inverse=True, return_counts=True)
        common = counts[which]
        gap = self.length - self.phrase + 1
        for p, (a, b) in enumerate(zip(self.first[:-1].tolist(), self.first[1:].tolist(), strict=True)):
            at = a - 1
            while at < b - self.length:
                near = common[at + 1 : min(at + gap, b - self.phrase) + 1]
                at += len(near) - int(np.argmin(near[::-1]))
                yield p, at

    def occurrences(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, passage, from, to) of each stretch of at least `length` words that a text shares with a passage.

        words: of several texts, one after another, which begin at `first` (and end at its last).
        """
        if not len(self.automaton):
            return
        counts = np.maximum(np.diff(first) - self.phrase + 1, 0)
        at = np.repeat(first[:-1], counts) + R.runs(counts)
        at = at[self.begins[self.head(words, at)]]
        letters = _letters(words)
        seen: dict[tuple[int, int], int] = {}  # of each passage and shift, how far the text has been followed
        for s, e in zip(*(x.tolist() for x in R.covered(at, at + self.phrase)), strict=True):
            for end, places in self.automaton.iter(letters[2 * s : 2 * e]):
                if not end & 1:  # letters that aren't those of whole words
                    continue
                at = s + (end + 1) // 2 - self.phrase
                text = int(np.searchsorted(first, at, "right")) - 1
                low, high = int(first[text]), int(first[text + 1])
                if at + self.phrase > high:
                    continue
                for p, place in places:
                    if seen.get((p, place - at), -1) > at:
                        continue
                    start, stop = self.follow(words[low:high], at - low, place, int(self.first[p]), int(self.first[p + 1]))
                    seen[p, place - at] = low + stop
                    if stop - start >= self.length:
                        yield text, p, start, stop

    def follow(self, words: np.ndarray, at: int, place: int, low: int, high: int) -> tuple[int, int]:
        """The stretch around a place of a text that equals the passage around its own place."""
        step, start, stop = 64, at, at
        while True:
            n = min(step, len(words) - stop, high - (place + stop - at))
            off = np.flatnonzero(words[stop : stop + n] != self.words[place + stop - at : place + stop - at + n])
            stop += int(off[0]) if len(off) else n
            if len(off) or n < step:
                break
            step *= 2
        step = 64
        while True:
            n = min(step, start, place + start - at - low)
            off = np.flatnonzero(words[start - n : start] != self.words[place + start - at - n : place + start - at])
            start -= n - 1 - int(off[-1]) if len(off) else n
            if len(off) or n < step:
                return start, stop
            step *= 2


_LOADED: dict[str, Shard] = {}


def loaded(name: str, shared, length: int, phrase: int) -> Shard:
    """The shard of that name; a worker builds it once and holds one at a time.  (Tasks refer to this function by its place, and so to one cache.)"""
    if name not in _LOADED:
        _LOADED.clear()
        docs, sizes, words = shared.value
        _LOADED[name] = Shard(docs, sizes, words, length, phrase)
    return _LOADED[name]


def _streamed(name: str, shared, length: int, phrase: int):
    """Spans that documents have of passages of earlier ones, of one shard."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = loaded(name, shared, length, phrase)
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                words, docs, a, b = B.unzipped(row["words"], np.uint64), *(B.unzipped(row[c]).tolist() for c in ("docs", "key_a", "key_b"))
                spans: dict[int, set[tuple[int, int]]] = {}
                for text, p, s, e in shard.occurrences(words, np.r_[0, np.cumsum(B.unzipped(row["sizes"]))]):
                    if shard.docs[p] < docs[text]:
                        spans.setdefault(text, set()).add((s, e))
                out = [(a[j], b[j], [{"s": s, "e": e} for s, e in sorted(own)]) for j, own in spans.items()]
                columns = list(zip(*out, strict=True)) if out else [()] * 3
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key_a", "key_b", "spans"])

    return stream


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for doc, text, spans in zip(batch.column(0).to_pylist(), R.as_texts(batch.column(1)), batch.column(2), strict=True):
            words = WORD.findall(text.as_py())
            n, ranges = len(words), []
            if spans.is_valid:
                pairs = spans.values
                s, e = R.covered(pairs.field(0).to_numpy().astype(np.int64), pairs.field(1).to_numpy().astype(np.int64))
                ranges = list(zip(s.tolist(), e.tolist(), strict=True))
                for a, b in reversed(ranges):
                    del words[a:b]
            out.append((doc, n, n - len(words), hashlib.sha256(" ".join(words).encode()).hexdigest(), [a for a, _ in ranges], [b for _, b in ranges]))
        columns = list(zip(*out, strict=True)) if out else [()] * 6
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256", "removed_from", "removed_to"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def confirmed(slices: DataFrame, length: int, range_keys: int = B.RANGE_KEYS) -> DataFrame:
    """Recurring passages, each from its first document: doc, n and words (their hashes)."""
    total = slices.agg(F.coalesce(F.sum("windows"), F.lit(0))).first()[0]
    sent = slices.mapInArrow(_sent(length, B.range_bits(total, range_keys)), B.SENT)
    return slices.join(B.decided(sent, B.first_of_several), "slice").mapInArrow(_passages(length), _PASSAGE)


def repeated_passages(docs: DataFrame, length: int = LENGTH, phrase: int = PHRASE, shard_words: int = SHARD_WORDS, slice_words: int = SLICE_WORDS) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256, and the removed word ranges as two lists."""
    spark = docs.sparkSession
    prepare(spark)
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("doc")
    keys = (F.xxhash64("doc_id", "text").alias("key_a"), F.xxhash64(F.lit("b"), "text", "doc_id").alias("key_b"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select(order, *keys, "text", "doc_id")
    ranged = texts.select("doc", "key_a", "key_b", "text").repartitionByRange("doc", "key_a").sortWithinPartitions("doc")
    slices = written(ranged.mapInArrow(_slices(length, slice_words), _SLICE), "word-slices", by="slice")
    passages = written(confirmed(slices, length), "passages")
    total = passages.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = -(-total // shard_words)
    dealt = passages.withColumn("shard", F.pmod(F.xxhash64("doc", "words"), F.lit(max(1, shards))))
    path = f"{shared_dir(spark)}/dossier-spans-{uuid.uuid4().hex}"
    spark.createDataFrame([], _SPANS).write.parquet(path)
    for k in range(shards):
        rows = dealt.where(F.col("shard") == k).select("doc", "n", "words").toArrow()  # about shard_words words
        words = [B.unzipped(x.as_py(), np.uint64) for x in rows.column("words")]
        shared = spark.sparkContext.broadcast((rows.column("doc").to_numpy(), rows.column("n").to_numpy().astype(np.int64), np.concatenate(words) if words else np.zeros(0, np.uint64)))
        slices.mapInArrow(_streamed(f"{path}/{k}", shared, length, phrase), _SPANS).write.mode("append").parquet(path)
        shared.destroy()
    spans = spark.read.schema(_SPANS).parquet(path)
    spans.shared_path = path
    own = spans.groupBy("key_a", "key_b").agg(F.flatten(F.collect_set("spans")).alias("spans"))
    out = texts.join(own, ["key_a", "key_b"], "left").select("doc_id", "text", "spans")
    out = written(out.mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, removed_from array<long>, removed_to array<long>"), "repeated-passages")
    for table in (slices, passages, spans):
        removed(table)
    return out
