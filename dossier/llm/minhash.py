"""MinHash near-dedup: fast similarity sketches, banding, exact verification and components.

`near_duplicates(docs)` keeps one document of each group of near copies.  Two documents are linked when
the Jaccard similarity of their word-shingle sets reaches the threshold; a group is a connected component.

Sketch (Dahlgaard, Knudsen and Thorup 2017): in round i each element is thrown into one hashed bin with a
value in [i, i+1); a bin keeps its minimum; the last t rounds aim at one bin each, so every coordinate of
any non-empty set is filled, with Chernoff-type concentration.  Bands of coordinates are bucket keys.

Work is done between distinct shingle sets, so exact copies cost one row each.  In each bucket every set is
first compared with one centre (a star, not all pairs).  Sets of a bucket that are in different components
after that are then compared with each other, so no link is lost to the star; only sets that differ enough
to be in other components, yet share two bands, get there.

Defined results: null, empty or blank texts have n_shingles 0, are linked with nothing and are kept.  Sets are linked, not
ids: rows of one doc_id with different texts are linked each by its own text.  Rows without a doc_id take part; their
component_id is the smallest id of the component like any other's, and null where none has one, and they are kept
only there.  The filter keeps one row of each component, the first by doc_id (null last) and then by hash of the row.
Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rolling as R
from .shared import likely, prepare, removed, written

SHINGLE, BANDS, ROWS = 5, 40, 4


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingles of each text, one after another, and the size of each set."""
    buf, offsets = R.flat(texts)
    buf = R.lower_ascii(buf)
    starts, ends, first = R.words(buf, offsets, R.SPACE)
    hashes = R.Ranges(R.byte_ranges(buf).of(starts, ends, 1))
    counts = np.diff(first)
    windows = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    at = np.repeat(first[:-1], windows) + R.runs(windows)
    every = hashes.of(at, at + np.repeat(np.minimum(counts, k), windows), 2)
    bounds = np.r_[0, np.cumsum(windows)]
    sets = [np.unique(every[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return (np.concatenate(sets) if sets else every), np.array([len(s) for s in sets], np.int64)


def sketches(elements: np.ndarray, sizes: np.ndarray, t: int) -> np.ndarray:
    """Fast similarity sketches of sets (empty sets stay unfilled): uint64 of shape (sets, t)."""
    out = np.full(len(sizes) * t, ~R.U64(0))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    for i in range(2 * t):
        if not len(owner):
            break
        h = R.mix(elements, i + 11)
        bins = (h >> R.U64(40)) % R.U64(t) if i < t else np.full(len(h), i - t, np.uint64)
        np.minimum.at(out, owner * t + bins.astype(np.int64), (h & R.U64((1 << 40) - 1)) | R.U64(i << 48))
        full = (out.reshape(-1, t) != ~R.U64(0)).all(axis=1)
        if full[owner].any():
            still = ~full[owner]
            elements, owner = elements[still], owner[still]
    return out.reshape(-1, t)


def band_keys(sketch: np.ndarray, bands: int) -> np.ndarray:
    keys = np.zeros((len(sketch), bands), np.uint64)
    for j in range(sketch.shape[1] // bands):
        keys = R.mix(keys * R.U64(3) + sketch.reshape(len(sketch), bands, -1)[:, :, j], j)
    return R.mix(keys ^ np.arange(bands, dtype=np.uint64)[None, :], 77)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in R.slices(batch):
            elements, sizes = shingle_sets(texts)
            bounds = np.r_[0, np.cumsum(sizes)]
            sums = [np.r_[R.U64(0), np.cumsum(R.mix(elements, s))] for s in (3, 4)]
            prints = [(x[bounds[1:]] - x[bounds[:-1]]).view(np.int64) for x in sums]
            keys = band_keys(sketches(elements, sizes, BANDS * ROWS), BANDS)
            some = np.flatnonzero(sizes)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum((sizes > 0) * BANDS)], pa.int32()), pa.array(keys[some].reshape(-1).view(np.int64)))
            names = ["doc_id", "key_a", "key_b", "n_shingles", "print_a", "print_b", "bands"]
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3)), pa.array(sizes), pa.array(prints[0]), pa.array(prints[1]), lists], names)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in R.slices(batch):
            elements, sizes = shingle_sets(texts)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(elements.view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0), lists], ["id", "shingles"])


def _linked_across(percent: int):
    """Links between sets of a block (or of two blocks) of a bucket that are in different components; rows come sorted by block."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def compare() -> pa.RecordBatch | None:
            rows = pa.Table.from_batches(held).combine_chunks()
            ids, comps, side = (rows.column(c).to_numpy().copy() for c in ("id", "comp", "side"))
            shingles = rows.column("shingles").combine_chunks()
            if isinstance(shingles, pa.ChunkedArray):
                shingles = shingles.chunk(0)
            flat = shingles.flatten().to_numpy(zero_copy_only=False).view(np.uint64)  # as they were sorted
            bounds = np.r_[0, np.cumsum(shingles.value_lengths().to_numpy(zero_copy_only=False))]
            sizes, two = np.diff(bounds), len(np.unique(side)) > 1
            found: list[tuple[np.ndarray, np.ndarray]] = []
            largest = np.unique(comps, return_counts=True)
            small_first = np.argsort(largest[1][np.searchsorted(largest[0], comps)], kind="stable")
            todo = np.ones(len(ids), bool)
            for i in small_first:  # the members of the largest component never start a comparison of their own
                todo[i] = False
                other = todo & (comps != comps[i]) & (100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i]))
                if two:
                    other &= side != side[i]
                j = np.flatnonzero(other)
                if not len(j):
                    continue
                own = flat[bounds[i] : bounds[i + 1]]
                at = np.repeat(bounds[j], sizes[j]) + R.runs(sizes[j])
                values = flat[at]
                place = np.minimum(np.searchsorted(own, values), len(own) - 1)
                hits = np.r_[0, np.cumsum(own[place] == values)]
                ends = np.cumsum(sizes[j])
                both = hits[ends] - hits[ends - sizes[j]]
                good = j[100 * both >= percent * (sizes[i] + sizes[j] - both)]
                if len(good):  # one link to each other component, which is this one from now on
                    joined, one = np.unique(comps[good], return_index=True)
                    found.append((np.full(len(one), ids[i]), ids[good[one]]))
                    comps[np.isin(comps, joined)] = comps[i]
            if not found:
                return None
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        block = None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in ("key", "low", "high")])
            cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            for at, to in zip(np.r_[0, cuts], np.r_[cuts, batch.num_rows], strict=True):
                if to == at:
                    continue
                this = tuple(key[:, at])
                if held and this != block and (out := compare()):
                    yield out
                if this != block:
                    held, block = [], this
                held.append(batch.slice(at, to - at))
        if held and (out := compare()):
            yield out

    return links


def components(links: DataFrame) -> DataFrame:
    """(id, comp): the smallest id reachable over links (a, b), for each id that has one.

    Minimum labels with pointer jumping: each round takes the smallest label of the neighbours and then the
    label's own label, so long chains end in a logarithmic number of rounds.  Labels are written each round.
    """
    links = links.where("a <> b")
    both = written(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("comp")), "labels")
    table = labels
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "comp"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("m"))
        step = labels.join(near, "id").select("id", F.col("comp").alias("was"), F.least("comp", "m").alias("mid"))
        jump = labels.select(F.col("id").alias("mid"), F.col("comp").alias("far"))
        step = written(step.join(jump, "mid", "left").select("id", "was", F.least("mid", F.coalesce("far", "mid")).alias("comp")), "labels")
        removed(table)
        labels, table = step.select("id", "comp"), step
        if step.where("comp <> was").isEmpty():
            removed(both)
            return labels


def near_duplicates(docs: DataFrame, percent: int = 75, block: int = 1000) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id reachable over links) and kept.

    percent: least Jaccard similarity of a link, in hundredths.  block: members of a bucket compared at a time;
    larger buckets are dealt out as pairs of blocks, so no task holds more than two of them.
    """
    return _components(docs, percent, block).select("doc_id", "n_shingles", "component_id", "kept")


def _row_keys() -> list[Column]:
    return [F.xxhash64("doc_id", "text").alias("key_a"), F.xxhash64(F.lit("b"), "text", "doc_id").alias("key_b")]


def _components(docs: DataFrame, percent: int, block: int) -> DataFrame:
    """Per row: doc_id, two hashes of it (key_a, key_b), n_shingles, comp (of its set), component_id and kept."""
    spark = docs.sparkSession
    prepare(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select("doc_id", *_row_keys(), "text")
    seen = written(texts.mapInArrow(_features, "doc_id long, key_a long, key_b long, n_shingles long, print_a long, print_b long, bands array<long>"), "sketches")
    known = seen.where("n_shingles > 0")
    # Exact copies: one set, with a number of its own, stands for all rows that have the same shingles.
    firsts = known.groupBy("print_a", "print_b").agg(F.min("doc_id").alias("doc"), F.min(F.struct("key_a", "key_b")).alias("row"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    firsts = written(firsts.withColumn("id", F.monotonically_increasing_id()), "classes")
    classes = firsts.select("print_a", "print_b", "id", "doc")
    entries = written(firsts.select(F.explode("bands").alias("key"), "id", "n"), "bands")
    buckets = entries.groupBy("key").agg(F.count("*").alias("members"), F.min(F.struct("id", "n")).alias("first")).where("members > 1")
    member = written(entries.join(buckets, "key").select("key", "id", "n", "members", F.col("first.id").alias("centre"), F.col("first.n").alias("centre_n")), "buckets")
    removed(entries)
    near_size = lambda a, b: F.least(a, b) * 100 >= F.greatest(a, b) * percent
    star = member.where("id <> centre").where(near_size(F.col("n"), F.col("centre_n"))).groupBy("centre", "id").agg(F.count("*").alias("shared"))
    star = star_table = written(star.select("centre", "id"), "star")
    # Sets again, of those that are compared at all: in a star, or in a bucket with two members besides the centre.
    wanted = star.select("id").union(star.select("centre")).union(member.where("members > 2 and id <> centre").select("id")).distinct()
    wanted = written(wanted.join(firsts.select("id", "row.key_a", "row.key_b"), "id"), "wanted")
    chosen = likely(texts.select("key_a", "key_b", "text"), wanted, "key_a").where("likely").join(wanted, ["key_a", "key_b"]).select("id", "text")
    set_table = written(chosen.mapInArrow(_sets, "id long, shingles array<long>"), "sets")
    removed(wanted)
    sets = set_table.dropDuplicates(["id"])
    pairs = star.join(sets.select(F.col("id").alias("centre"), F.col("shingles").alias("s")), "centre").join(sets, "id")
    pairs = pairs.select(F.col("centre").alias("a"), F.col("id").alias("b"), F.size(F.array_intersect("s", "shingles")).alias("both"), (F.size("s") + F.size("shingles")).alias("total"))
    links = written(pairs.where(F.col("both") * 100 >= (F.col("total") - F.col("both")) * percent).select("a", "b"), "links")
    labels = components(links)
    # Members besides the centre that are in different components still.
    rest = member.where("members > 2 and id <> centre").join(labels, "id", "left").select("key", "id", "members", F.coalesce("comp", "id").alias("comp"))
    rest = rest_table = written(rest, "rest")
    mixed = rest.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("left")).where("low <> high")
    rest = rest.join(mixed.select("key", "left"), "key").select("key", "id", "comp", F.ceil(F.col("left") / block).cast("int").alias("blocks"))
    rest = rest.withColumn("side", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rest = rest.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = rest.select("key", F.least("side", "with").alias("low"), F.greatest("side", "with").alias("high"), "side", "id", "comp")
    dealt = rest.join(sets, "id").repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    more_table = written(dealt.mapInArrow(_linked_across(percent), "a long, b long"), "more")
    more = more_table.distinct()
    if not more.isEmpty():
        labels = components(links.union(more))
    groups = classes.join(labels, "id", "left").select("print_a", "print_b", "doc", F.coalesce("comp", "id").alias("comp"))
    smallest = groups.groupBy("comp").agg(F.min("doc").alias("component_id"))
    groups = groups.join(smallest, "comp").select("print_a", "print_b", "comp", "component_id")
    out = seen.select("doc_id", "key_a", "key_b", "n_shingles", "print_a", "print_b").join(groups, ["print_a", "print_b"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.select("doc_id", "key_a", "key_b", "n_shingles", "comp", component.alias("component_id"))
    out = written(out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), "components")
    for table in (seen, firsts, member, star_table, set_table, links, rest_table, more_table):
        removed(table)
    return out


def drop_near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """docs with one row of each component; all columns stay as they are."""
    found = _components(docs, percent, 1000)
    known = found.where("comp is not null")
    first = known.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key_a", "key_b")).alias("f"), F.count("*").alias("n"))
    first = written(first.select("n", "f.key_a", "f.key_b"), "firsts")
    gone = known.select("key_a", "key_b").distinct().join(first, ["key_a", "key_b"], "left_anti")
    # Rows that are repeated as a whole have one key: one of them is chosen.
    twice = known.groupBy("key_a", "key_b").agg(F.count("*").alias("rows")).where("rows > 1").join(first, ["key_a", "key_b"], "left_semi")
    asked = written(gone.withColumn("one", F.lit(False)).union(twice.select("key_a", "key_b", F.lit(True))), "asked")
    keyed = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), "text").select("doc", *_row_keys())
    keyed = likely(keyed, asked, "key_a")
    kept = keyed.where("not likely").select("doc")
    rest = keyed.where("likely").join(asked, ["key_a", "key_b"], "left")
    kept = kept.union(rest.where("one is null").select("doc"))
    if not asked.where("one").isEmpty():
        kept = kept.union(rest.where("one").dropDuplicates(["key_a", "key_b"]).select("doc"))
    return kept.select("doc.*")
