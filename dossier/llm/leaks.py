"""Benchmark decontamination with a broadcast hash set of normalised test n-grams.

The benchmark's windows of `length` words (an item with fewer is one window) go to every task as sorted hashes;
each document's token windows are looked up, hits are verified word by word, and documents or spans are removed.
The benchmark is measured first: it is broadcast in blocks of at most `block_bytes` of text, one pass over the
documents for each block, so what is broadcast has a bound that doesn't depend on the data.

Defined results: null texts have no words; items without words match nothing; items with the same item_id are
one item; a null item_id marks words as hit and is listed as an empty name.  Repeated rows and null doc_ids are
documents of their own.  An empty benchmark hits nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rolling as R
from .shared import prepare

LENGTH, BLOCK_BYTES = 10, 8 << 20


class NGrams:
    """Windows of items by length: sorted hashes, the words behind each hash, and the items that have them."""

    def __init__(self, items: list[tuple[str, str]], length: int):
        texts = R.as_texts(pa.array([t for _, t in items], pa.string()))
        buf, offsets = R.flat(texts)
        buf = R.lower_ascii(buf)
        starts, ends, first = R.words(buf, offsets, R.NOT_ALNUM)
        hashes = R.Ranges(R.byte_ranges(buf).of(starts, ends, 1))
        data = buf.tobytes()
        self.items = [name for name, _ in items]
        self.behind: dict[tuple[int, int], dict[bytes, set[int]]] = {}
        counts = np.diff(first)
        for size in np.unique(np.minimum(counts[counts > 0], length)).tolist():
            own = np.flatnonzero(np.minimum(counts, length) == size)
            windows = counts[own] - size + 1
            at = np.repeat(first[own], windows) + R.runs(windows)
            for key, p, item in zip(hashes.of(at, at + size, 2).tolist(), at.tolist(), np.repeat(own, windows).tolist(), strict=True):
                words = b" ".join(data[starts[i] : ends[i]] for i in range(p, p + size))
                self.behind.setdefault((size, key), {}).setdefault(words, set()).add(item)
        self.sizes = sorted({size for size, _ in self.behind})
        self.sorted = {size: np.sort(np.array([k for s, k in self.behind if s == size], np.uint64)) for size in self.sizes}

    def hits(self, texts: pa.Array) -> Iterator[tuple[int, list[tuple[int, int]], set[int], np.ndarray, np.ndarray]]:
        """For each text: number of words, verified windows as word ranges, items, and where its words start and end in bytes."""
        buf, offsets = R.flat(texts)
        buf = R.lower_ascii(buf)
        starts, ends, first = R.words(buf, offsets, R.NOT_ALNUM)
        hashes = R.Ranges(R.byte_ranges(buf).of(starts, ends, 1))
        found: list[tuple[list, set]] = [([], set()) for _ in range(len(texts))]
        data = None
        for size in self.sizes:
            counts = np.maximum(np.diff(first) - size + 1, 0)
            at = np.repeat(first[:-1], counts) + R.runs(counts)
            keys, known = hashes.of(at, at + size, 2), self.sorted[size]
            place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            for i in np.flatnonzero(known[place] == keys).tolist():
                data = data or buf.tobytes()
                p = int(at[i])
                words = b" ".join(data[starts[j] : ends[j]] for j in range(p, p + size))
                if items := self.behind[(size, int(keys[i]))].get(words):
                    text = int(np.searchsorted(first, p, "right")) - 1
                    found[text][0].append((p - int(first[text]), p - int(first[text]) + size))
                    found[text][1].update(items)
        for i, (ranges, items) in enumerate(found):
            a, b = first[i], first[i + 1]
            yield int(b - a), ranges, items, starts[a:b] - offsets[i], ends[a:b] - offsets[i]


_LOADED: dict[str, NGrams] = {}


def loaded(name: str, shared, length: int) -> NGrams:
    """The set of a block; a worker builds it once and holds one at a time."""
    if name not in _LOADED:
        _LOADED.clear()
        _LOADED[name] = NGrams(shared.value, length)
    return _LOADED[name]


def _scan(name: str, shared, length: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = loaded(name, shared, length)
            for part, texts in R.slices(batch, "__text"):
                index = part.schema.get_field_index
                had = [part.column(index(c)).to_pylist() for c in ("__hits", "__items")]
                words, hits, items, spans = [], [], [], []
                for i, (n, ranges, who, starts, ends) in enumerate(grams.hits(texts)):
                    ranges = [*ranges, *((r["from"], r["to"]) for r in had[0][i] or [])]
                    s, e = R.covered(*np.array(ranges, np.int64).reshape(-1, 2).T)
                    words.append(n)
                    hits.append([{"from": int(a), "to": int(b)} for a, b in zip(s, e, strict=True)])
                    items.append(sorted({*(had[1][i] or []), *(grams.items[w] for w in who)}))
                    spans.append([{"from": int(starts[a]), "to": int(ends[b - 1])} for a, b in zip(s, e, strict=True)])
                pair = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
                new = {"__words": pa.array(words, pa.int64()), "__hits": pa.array(hits, pair), "__items": pa.array(items, pa.list_(pa.string())), "__spans": pa.array(spans, pair)}
                yield pa.RecordBatch.from_arrays([new.get(f.name, part.column(i)) for i, f in enumerate(part.schema)], names=part.schema.names)

    return scan


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, length: int = LENGTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs as they are, with __words (their number), __hits (word ranges), __spans (the same in bytes) and __items (names)."""
    spark = docs.sparkSession
    prepare(spark)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    total = items.select(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0))).first()[0]
    blocks = 1 if total <= block_bytes else 2 * int(total // block_bytes) + 2
    items = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))  # half full each, so that chance leaves them within the bound
    pair = "array<struct<from: bigint, to: bigint>>"
    out = docs.withColumns({"__text": F.coalesce("text", F.lit("")), "__words": F.lit(0).cast("long"), "__hits": F.lit(None).cast(pair), "__spans": F.lit(None).cast(pair), "__items": F.lit(None).cast("array<string>")})
    for k in range(blocks):
        own = [tuple(r) for r in items.where(F.col("block") == k).select("item", "text").collect()]
        out = out.mapInArrow(_scan(uuid.uuid4().hex, spark.sparkContext.broadcast(own), length), out.schema)
    return out.drop("__text")


def hit_words() -> Column:
    return F.aggregate("__hits", F.lit(0).cast("long"), lambda n, r: n + r["to"] - r["from"])


def decontamination_report(docs: DataFrame, benchmark: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the hit byte spans."""
    found = benchmark_hits(docs.select("doc_id", "text"), benchmark, length)
    names = F.array_join(F.array_sort("__items"), ",")
    return found.select("doc_id", F.col("__words").alias("n_words"), hit_words().alias("n_hit"), F.size("__items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.size("__hits") > 0).alias("contaminated"), F.col("__spans").alias("spans"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, length: int = LENGTH, action: str = "drop") -> DataFrame:
    """docs without contaminated documents (`drop`), or with the hit spans taken out of their texts (`cut`)."""
    # All other columns have names of our own meanwhile, so that none is taken for one that the scan adds.
    named = {c: "text" if c == "text" else f"column{i}" for i, c in enumerate(docs.columns)}
    back = [F.col(new).alias(c) for c, new in named.items()]
    found = benchmark_hits(docs.toDF(*named.values()), benchmark, length)
    if action == "drop":
        return found.where(F.size("__hits") == 0).select(*back)
    raw = F.col("text").cast("binary")
    ends = F.transform("__spans", lambda s: s["to"])
    begins = F.concat(F.transform("__spans", lambda s: s["from"]), F.array(F.octet_length("text").cast("long")))
    kept = F.zip_with(F.concat(F.array(F.lit(0).cast("long")), ends), begins, lambda a, b: F.substring(raw, a.cast("int") + 1, (b - a).cast("int")).cast("string"))
    return found.withColumn("text", F.when(F.size("__hits") > 0, F.concat_ws("", kept)).otherwise(F.col("text"))).select(*back)
