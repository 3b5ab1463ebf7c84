"""An inverted index of a corpus: postings of character grams, written once and updated by file.

Folders of an index, for each segment (one call of `add`):
  docs      __id, __file, __text, __size, and the keys and attributes that were asked for
  files     the files that the segment replaces or, with no documents, takes away
  postings  kind, gram, slice, at: kind 3 are trigrams of the text in lower case, with every place they begin at;
            kind 6 are hashes of six characters of the text as it is, with the documents that hold them

A posting is a row for each gram and slice (1,024 documents), so a frequent gram has as many rows as there are slices
and none grows with the corpus.  Postings lie in folders by bucket (kind 3: by the first two characters, so that what is
shorter than a gram is found as well), sorted by gram; a search reads the buckets of its grams and no text.  A phrase is
found by intersecting the places of its trigrams within a slice; trigrams are stored whole, so nothing has to be verified.
The last document of a file wins: a file that a later segment names is read from there alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossier.sources.scratch import exists, new_folder, prepare

from .search import B, K1, LEAST_IDF, SHORTEST, classified, overlap_phrases, phrases_of, with_none

BUCKETS, SLICE_BITS, PLACE_BITS, QUOTE = 16, 10, 32, 6
#: Characters that one task takes, about; their postings are sorted in its memory (some 30 bytes for each).
TASK_CHARS = 8 << 20
#: Bytes of a row group of texts, the least that a task can read.
ROW_GROUP = 2 << 20
#: Places of a slice that are sorted at once, which bounds a Python worker's memory (about 60 bytes for each).
CHUNK = 1 << 22
#: Stands after the end of a text, so that its last characters begin a trigram too.
_END = 0x110000
_POSTINGS = "kind int, bucket int, gram long, slice long, at array<long>"


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def trigrams(x: np.ndarray) -> np.ndarray:
    """Of each place the three characters that begin there, 21 bits each."""
    return (x[:-2] << 42) | (x[1:-1] << 21) | x[2:]


def quote_grams(x: np.ndarray) -> np.ndarray:
    """Hashes of six characters."""
    three = trigrams(x).astype(np.uint64)
    h = three[:-3] * np.uint64(0x9E3779B97F4A7C15) ^ (three[3:] + np.uint64(0x632BE59BD9B4E019))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (h ^ (h >> np.uint64(31))).view(np.int64)


def strings(texts: list[np.ndarray], n: int) -> list[str]:
    """The distinct strings of n characters, five at most, in texts of codes."""
    x, owner = np.concatenate(texts), np.repeat(np.arange(len(texts)), list(map(len, texts)))
    if len(x) < n:
        return []
    begin = np.flatnonzero(owner[: len(x) - n + 1] == owner[n - 1 :])
    bits = int(x.max()).bit_length()
    own = np.zeros(len(begin), np.int64)
    for i in range(n):
        if i == 3 and n * bits > 64:  # more than one key has room for: the first three characters by their number
            own, bits = pd.factorize(own)[0].astype(np.int64), 21
        own = own << bits | x[begin + i]
    first = ~pd.Series(own).duplicated().to_numpy()
    found = np.stack([x[begin[first] + i] for i in range(n)], axis=1).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return [found[i : i + n] for i in range(0, len(found), n)]


def bucket_of(kind: int, gram: np.ndarray) -> np.ndarray:
    return ((gram >> 21) * 0x9E3779B1 >> 16) % BUCKETS if kind == 3 else gram % BUCKETS


def _batch(kind: int, slice_: int, grams: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Rows of equal grams with their distinct places, in order of buckets and grams; places come in order."""
    own, some = pd.factorize(grams)
    buckets = bucket_of(kind, some)
    order = np.lexsort((some, buckets))
    some, buckets, own = some[order], buckets[order], np.argsort(order)[own]
    key = np.sort((own.astype(np.int64) << 32) | np.arange(len(at)))  # numbers of grams and of places: one key, sorted as integers
    own, at = key >> 32, at[key & 0xFFFFFFFF]
    if kind == 6:
        fresh = np.r_[True, (own[1:] != own[:-1]) | (at[1:] != at[:-1])] if len(at) else np.zeros(0, bool)
        own, at = own[fresh], at[fresh]
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(at)].astype(np.int32)), pa.array(at))
    n = len(some)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(buckets.astype(np.int32)), pa.array(some), pa.array(np.full(n, slice_, np.int64)), lists], ["kind", "bucket", "gram", "slice", "at"])


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of (id, text, low): texts in the order of ids, so that a slice is met at one go but where parts of a file begin."""

    def out(slice_: int, low: list[np.ndarray], at: list[np.ndarray], held: list[np.ndarray], whose: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if low:
            yield _batch(3, slice_, np.concatenate(low), np.concatenate(at))
        if held:
            yield _batch(6, slice_, np.concatenate(held), np.concatenate(whose))

    slice_, size, parts = None, 0, ([], [], [], [])
    for batch in batches:
        for doc, text, small in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if doc >> SLICE_BITS != slice_ or size > CHUNK:
                yield from out(slice_, *parts)
                slice_, size, parts = doc >> SLICE_BITS, 0, ([], [], [], [])
            no = doc & ((1 << SLICE_BITS) - 1)
            x, y = codes(small), codes(text)
            for a in range(0, max(len(x), len(y)), CHUNK):
                grams = trigrams(np.r_[x[a : a + CHUNK + 2], _END, _END])[: min(CHUNK, max(0, len(x) - a))]
                parts[0].append(grams)
                parts[1].append((np.int64(no) << PLACE_BITS) | np.arange(a, a + len(grams)))
                if len(y) - a >= QUOTE:
                    parts[2].append(quote_grams(y[a : a + CHUNK + QUOTE - 1]))
                    parts[3].append(np.full(len(parts[2][-1]), no, np.int64))
                size += len(grams)
                if size > CHUNK:
                    yield from out(slice_, *parts)
                    size, parts = 0, ([], [], [], [])
    yield from out(slice_, *parts)


class Index:
    """An index in a folder.  keys: columns that name a document; attributes: further columns to filter and order by."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], attributes: list[str] = [], file: str | None = None):
        self.spark, self.path, self.keys, self.file = spark, path.rstrip("/"), keys, file or keys[0]
        self.attributes = [a for a in attributes if a not in keys]

    def _segments(self) -> list[int]:
        """Segments that were written to their end."""
        n = 0
        while exists(self.spark, f"{self.path}/{n}/_DONE"):
            n += 1
        return list(range(n))

    def add(self, docs: DataFrame, text: str = "text", gone: DataFrame | None = None) -> Index:
        """A new segment: docs take the place of all earlier documents of their files; so do the files of `gone`, with nothing."""
        prepare(self.spark)
        base = f"{self.path}/{len(self._segments())}"
        plain = F.coalesce(text, F.lit(""))
        named = docs.select(F.monotonically_increasing_id().alias("__id"), F.col(self.file).cast("string").alias("__file"), plain.alias("__text"), F.greatest(F.length(plain) - 2, F.lit(0)).alias("__size"), *self.keys, *self.attributes)
        named.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(f"{base}/docs")
        kept = self.spark.read.schema(named.schema).parquet(f"{base}/docs")
        files = kept.select("__file").union(gone.select(F.col(self.file).cast("string"))) if gone is not None else kept.select("__file")
        files.distinct().write.mode("overwrite").parquet(f"{base}/files")
        # Each task sorts and writes the postings of its own part of the texts, so nothing is shuffled.  How small parts are is
        # set in a session of its own, as it holds for all reads of one.
        chars = kept.agg(F.sum(F.length("__text"))).first()[0] or 0
        reading = self.spark.newSession()
        reading.conf.set("spark.sql.files.minPartitionNum", str(chars // TASK_CHARS + 1))
        reading.conf.set("spark.sql.files.openCostInBytes", "65536")
        texts = reading.read.schema("__id long, __text string").parquet(f"{base}/docs")
        posted = texts.select("__id", "__text", F.lower("__text").alias("low")).mapInArrow(_posted, _POSTINGS)
        posted.sortWithinPartitions("kind", "bucket", "gram").write.mode("overwrite").option("compression", "zstd").partitionBy("kind", "bucket").parquet(f"{base}/postings")
        self.spark.range(0).write.parquet(f"{base}/_DONE")
        return self

    def _read(self, segment: int, table: str) -> DataFrame:
        d = self.spark.read.parquet(f"{self.path}/{segment}/{table}") if table != "postings" else self.spark.read.schema("gram long, slice long, at array<long>, kind int, bucket int").parquet(f"{self.path}/{segment}/postings")
        return d.withColumn("__segment", F.lit(segment))

    def _all(self, table: str) -> DataFrame:
        return reduce(DataFrame.unionByName, (self._read(n, table) for n in self._segments()))

    def docs(self) -> DataFrame:
        """Documents of the latest segment that names their file; with one segment, all of them."""
        d = self._all("docs")
        if len(self._segments()) == 1:
            return d
        latest = self._all("files").groupBy("__file").agg(F.max("__segment").alias("__segment"))
        return d.join(latest, d["__file"].eqNullSafe(latest["__file"]) & (d["__segment"] == latest["__segment"]), "left_semi")

    def _postings(self, kind: int, buckets: list[int]) -> DataFrame:
        return self._all("postings").where((F.col("kind") == kind) & F.col("bucket").isin(buckets))

    def places(self, phrases: list[str]) -> DataFrame:
        """(phrase, __segment, __id, n): how often documents hold phrases, overlapping occurrences too; upper and lower case are the same.

        Documents of files that were replaced are among them.
        """
        wanted, short = [], []
        for phrase in dict.fromkeys(phrases):
            x = codes(phrase.lower())
            if len(x) >= SHORTEST:
                offsets = sorted({*range(0, len(x) - 2, 3), len(x) - 3})
                wanted += [(phrase, o, len(offsets), int(g), int(b)) for o in offsets for gram in [trigrams(x[o : o + 3])] for g, b in [(gram[0], bucket_of(3, gram)[0])]]
            elif len(x):
                low = [int(x[0]), int(x[1]) if len(x) > 1 else 0]
                high = [low[0], low[1] if len(x) > 1 else _END]
                short.append((phrase, low[0] << 42 | low[1] << 21, high[0] << 42 | high[1] << 21 | (1 << 21) - 1, len(x)))
        out = []
        if wanted:
            asked = F.broadcast(self.spark.createDataFrame(wanted, "phrase string, offset int, parts int, gram long, bucket int"))  # a row for three characters of a query
            rows = self._postings(3, sorted({w[-1] for w in wanted})).where(F.col("gram").isin(sorted({w[3] for w in wanted})))
            own = rows.drop("bucket", "kind").join(asked.drop("bucket"), "gram").select("__segment", "slice", "phrase", "parts", "offset", F.transform("at", lambda a: a - F.col("offset")).alias("at"))
            own = own.repartition("slice", "phrase")  # once, for both groupings
            each = own.groupBy("__segment", "slice", "phrase", "parts", "offset").agg(F.flatten(F.collect_list("at")).alias("at"))
            lists = each.groupBy("__segment", "slice", "phrase", "parts").agg(F.collect_list("at").alias("lists")).where(F.size("lists") == F.col("parts"))
            both = F.aggregate(F.slice("lists", 2, F.greatest(F.size("lists") - 1, F.lit(0))), F.get("lists", F.lit(0)), F.array_intersect)
            out.append(lists.select("__segment", "slice", "phrase", F.explode(both).alias("at")))
        for phrase, low, high, n in short:
            buckets = [int(bucket_of(3, np.array([low]))[0])] if n == 2 else list(range(BUCKETS))
            out.append(self._postings(3, buckets).where(F.col("gram").between(low, high)).select("__segment", "slice", F.lit(phrase).alias("phrase"), F.explode("at").alias("at")))
        if not out:
            return self.spark.createDataFrame([], "phrase string, __segment int, __id long, n long")
        hits = reduce(DataFrame.unionByName, out)
        doc = F.shiftleft("slice", SLICE_BITS) + F.shiftright("at", PLACE_BITS)
        return hits.groupBy("phrase", "__segment", doc.alias("__id")).agg(F.count("*").alias("n"))

    def bm25(self, queries: dict[str, list[str]]) -> DataFrame:
        """(query, keys, attributes, score) of documents that hold a phrase of the query; statistics are those of all documents.

        A phrase shorter than a trigram counts like any other.
        """
        docs = self.docs().drop("__text")
        stats = docs.agg(F.count("*").alias("n"), F.avg("__size").alias("average")).first()
        some = self.places([p for ps in queries.values() for p in ps]).join(docs, ["__segment", "__id"])
        frequency = some.groupBy("phrase").agg(F.count("*").alias("df"))
        asked = F.broadcast(self.spark.createDataFrame([(q, p) for q, ps in queries.items() for p in ps], "query string, phrase string"))  # as given
        idf = F.greatest(F.log((stats["n"] - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
        part = idf * F.col("n") * (K1 + 1) / (F.col("n") + K1 * (1 - B + B * F.col("__size") / float(stats["average"] or 1.0)))
        scored = some.join(F.broadcast(frequency), "phrase").join(asked, "phrase")  # a row for each phrase
        return scored.groupBy("query", "__segment", "__id", *self.keys, *self.attributes).agg(F.sum(part).alias("score")).drop("__segment", "__id")

    def search(self, queries: list[str], order: str, limit: int = 10, scope: Column | None = None, overlap: bool = False) -> DataFrame:
        """(query, keys, score, place): as search.dual_search, from the index alone; scope: a condition on keys and attributes."""
        queries = list(dict.fromkeys(q.strip() for q in queries))
        long = {q: overlap_phrases(q) if overlap else phrases_of(q) for q in queries if len(q) >= (QUOTE if overlap else SHORTEST)}
        short = {q: [q] for q in queries if 0 < len(q) < SHORTEST and not overlap}
        found = self.bm25({**long, **short}).withColumn("score", F.when(F.col("query").isin(list(short)), 0.0).otherwise(F.col("score")))
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), order, *self.keys))
        inside = found if scope is None else found.where(scope)
        return inside.withColumn("place", rank).where(F.col("place") <= limit).select("query", *self.keys, "score", "place")

    def quoted(self, quotes: DataFrame, quote: str, keys: list[str]) -> DataFrame:
        """(keys, first, gram): the distinct grams of six characters of each quote; first: whether the quote begins with it."""
        kinds = [quotes.schema[k] for k in keys]

        def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = [quote_grams(codes(t)) if len(t) >= QUOTE else np.zeros(0, np.int64) for t in batch.column(len(kinds)).to_pylist()]
                seen = [np.unique(g) for g in own]
                row = np.repeat(np.arange(len(own)), [len(g) for g in seen])
                first = np.concatenate([g == o[0] for g, o in zip(seen, own, strict=True) if len(o)] or [np.zeros(0, bool)])
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(row)) for i in range(len(kinds))), pa.array(first), pa.array(np.concatenate([*seen, np.zeros(0, np.int64)]))], [*keys, "first", "gram"])

        plain = quotes.select(*keys, F.coalesce(quote, F.lit("")).alias("__quote"))
        return plain.mapInArrow(grams, plain.drop("__quote").withColumns({"first": F.lit(True), "gram": F.lit(0).cast("long")}).schema)

    def _holders(self, wanted: DataFrame) -> DataFrame:
        """(gram, __segment, slice, at) of the wanted hashes."""
        return self._postings(6, list(range(BUCKETS))).drop("kind", "bucket").join(wanted.select("gram").distinct(), "gram")

    def _live(self, found: DataFrame) -> DataFrame:
        """Rows of (__segment, slice, at) that a document of today is behind, with its __id."""
        each = found.withColumn("at", F.explode("at")).withColumn("__id", F.shiftleft("slice", SLICE_BITS) + F.col("at")).drop("slice", "at")
        return each if len(self._segments()) == 1 else each.join(self.docs().select("__segment", "__id"), ["__segment", "__id"], "left_semi")

    def existence(self, quotes: DataFrame, quote: str, keys: list[str]) -> DataFrame:
        """(keys, grams, found): how many distinct grams of six characters a quote has, and how many of them a document holds."""
        own = self.quoted(quotes, quote, keys).drop("first")
        there = self._holders(own)
        if len(self._segments()) > 1:
            there = self._live(there)
        counts = own.join(there.select("gram").distinct().withColumn("there", F.lit(1)), "gram", "left").groupBy(*keys).agg(F.count("*").alias("grams"), F.count("there").alias("found"))
        return with_none(quotes, counts, keys)

    def containing(self, quotes: DataFrame, quote: str, keys: list[str]) -> DataFrame:
        """(keys, __segment, __id): the documents that hold a quote as it is; quotes of at least six characters.

        Candidates hold the quote's first gram; only their texts are read, each once, and compared.
        """
        own = self.quoted(quotes, quote, keys).where("first").drop("first")
        held = self._live(self._holders(own)).join(own, "gram").drop("gram")
        asked = held.join(quotes.select(*keys, F.col(quote).alias("__quote")), keys)
        texts = self.docs().select("__segment", "__id", "__text").join(held.select("__segment", "__id").distinct(), ["__segment", "__id"], "left_semi")
        return asked.join(texts, ["__segment", "__id"]).where(F.col("__text").contains(F.col("__quote"))).select(*keys, "__segment", "__id")

    def held_short(self, quotes: DataFrame, quote: str, keys: list[str]) -> DataFrame:
        """(keys) of the quotes of one to five characters that some text contains.

        Texts are read once, in batches: of each batch the distinct strings of the quotes' lengths are joined with the quotes.
        """
        given = quotes.select(*keys, F.col(quote).alias("piece")).where(F.length("piece").between(1, QUOTE - 1))
        sizes = sorted(r[0] for r in given.select(F.length("piece")).distinct().collect())  # five at most

        def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = [codes(t) for t in batch.column(0).to_pylist()]
                ends = np.cumsum([0, *map(len, texts)])
                start = 0
                while start < len(texts):  # whole texts up to a chunk, so that a worker's memory is bounded
                    stop = max(start + 1, int(np.searchsorted(ends, ends[start] + CHUNK)) - 1)
                    yield pa.RecordBatch.from_arrays([pa.array([p for n in sizes for p in strings(texts[start:stop], n)], pa.string())], ["piece"])
                    start = stop

        there = self.docs().select("__text").mapInArrow(pieces, "piece string").join(given.select("piece").distinct(), "piece", "left_semi").distinct()
        return given.join(there, "piece", "left_semi").select(*keys)

    def quote_classes(self, quotes: DataFrame, quote: str, keys: list[str], resolved: float = 0.65, absent: float = 0.3) -> DataFrame:
        """(keys, ratio, class): as search.quote_classes; texts are only read for quotes shorter than six characters."""
        whole = self.containing(quotes.where(F.length(quote) >= QUOTE), quote, keys).select(*keys).distinct()
        short = quotes.where(F.length(quote) < QUOTE)
        if not short.isEmpty():
            whole = whole.union(self.held_short(short, quote, keys).distinct())
        return classified(quotes, quote, keys, whole, self.existence(quotes, quote, keys), QUOTE, resolved, absent)


_BUILT: dict[tuple, Index] = {}


def index_of(docs: DataFrame, keys: list[str], attributes: list[str]) -> Index:
    """The index of a table that is read from files: built at the first call of a session, in the shared folder, and kept there."""
    spark = docs.sparkSession
    name = (spark.sparkContext.applicationId, tuple(sorted(docs.inputFiles())), *keys, *attributes)
    if name not in _BUILT or not exists(spark, _BUILT[name].path):
        _BUILT[name] = Index(spark, new_folder(spark, "index"), keys, attributes).add(docs)
    return _BUILT[name]
