"""Mixing sources to target weights, with DataFrame operations only.

Each source's words are one stream, its documents in the order of a hash, cut into blocks of `block_words` words (the last
one may be shorter).  The mix is a row of slots in output shards of `shard_slots`; each slot draws its source with the
chances of the targets, so a shard's counts are a multinomial draw.  Where the draws of a source end above or below its
planned number of slots, the slots too many go to the sources that fell short.  The slots of a source are numbered
through all shards, a pseudorandom permutation of its block numbers (swap-or-not, exact on any number of blocks) maps each
number to a block, another one for each pass over the source, and slots and blocks are joined by source and block.

Targets: sources in the order of code points, null last, have weights in turn and share `share` times all words;
none is above `most` times its source's own words, and what is above is shared out among the others by weight.

Defined results: a null text has no words, and a document without words takes part with nothing taken; null sources are
a source of their own; null doc_ids and repeated rows are documents of their own (rows repeated in id and text follow one
another in their stream).  A source's taken words differ from its target by less than 1.5 blocks.  Empty tables give empty
results.  Other columns are ignored.  The driver sees one row for each source.  Nothing depends on how rows are dealt
to tasks, so reruns agree.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass, field
from fractions import Fraction
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import written

WEIGHTS, SHARE, MOST = (3, 1, 2), Fraction(3, 2), 2
BLOCK_WORDS, SHARD_SLOTS, BUCKET_ROWS, ROUNDS, SEED = 64, 1 << 16, 1 << 12, 16, "mix"
WORD = r"[^\x20\x09-\x0D]+"


def hashed(text: Column) -> Column:
    """60 bits of a string."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, most: int = MOST) -> dict[str | None, Fraction]:
    """Words that each source is to give."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    rest, out = share * sum(sizes.values()), {}
    left = list(order)
    while left:
        level = rest / sum(weight[s] for s in left)
        above = [s for s in left if weight[s] * level > most * sizes[s]]
        for s in above or left:
            out[s] = Fraction(most * sizes[s]) if above else weight[s] * level
        rest -= sum(out[s] for s in above)
        left = [s for s in left if s not in out]
    return {s: out[s] for s in order}


@dataclass
class Plan:
    """Of each source, by its number: name, words, target, blocks and slots."""

    names: list[str | None]
    sizes: list[int]
    targets: list[float]
    block_words: int
    most: int = MOST
    blocks: list[int] = field(init=False)
    slots: list[int] = field(init=False)

    def __post_init__(self) -> None:
        self.blocks = [-(-n // self.block_words) for n in self.sizes]
        # Whole passes take all of a source's words, whatever its last block holds.
        whole = [math.floor(t / max(1, n)) for t, n in zip(self.targets, self.sizes, strict=True)]
        self.slots = [w * b + min(b, math.floor((t - w * n) / self.block_words + 0.5)) for w, b, t, n in zip(whole, self.blocks, self.targets, self.sizes, strict=True)]


def _search(x: Column, cuts: list[int], values: list[int], low: int, high: int) -> Column:
    """values[number of cuts that aren't above x], as a tree of comparisons; one leaf for each source."""
    if low == high:
        return F.lit(values[low]).cast("long")
    mid = (low + high) // 2
    return F.when(x < cuts[mid], _search(x, cuts, values, low, mid)).otherwise(_search(x, cuts, values, mid + 1, high))


def _chosen(x: Column, sizes: list[int], scale: int | None = None) -> Column:
    """The number of the interval that x lies in, of intervals of these sizes one after another; scale: stretched to so much in all."""
    some = [i for i, n in enumerate(sizes) if n]
    total = sum(sizes)
    ends = list(accumulate(sizes[i] for i in some))[:-1]
    return _search(x, [e * scale // total if scale else e for e in ends], some, 0, len(some) - 1)


def permuted(x: Column, n: Column, keys: Column, name: Column) -> Column:
    """A pseudorandom permutation of 0 to n - 1: each round swaps x with keys[round] - x (modulo n), or not, by a bit that both share."""

    def step(at: Column, r: Column) -> Column:
        other = F.pmod(F.get(keys, r) - at, n)
        bit = F.ascii(F.md5(F.concat_ws("/", name, r, F.greatest(at, other)))) % 2
        return F.when(bit == 1, other).otherwise(at)

    return F.aggregate(F.sequence(F.lit(0), F.size(keys) - 1), x, step)


def _key(name: str, n: int) -> int:
    return int(hashlib.md5(name.encode()).hexdigest()[:15], 16) % max(1, n)


def sizes_of(docs: DataFrame, texts: bool = False) -> DataFrame:
    """source, doc_id, size, h (the place in its stream), and the text if it is wanted."""
    text = F.coalesce("text", F.lit(""))
    h = hashed(F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text))
    return docs.select("source", "doc_id", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), h.alias("h"), *([text.alias("text")] if texts else []))


def planned(sizes: DataFrame, block_words: int = BLOCK_WORDS) -> Plan:
    own = {r["source"]: int(r["size"]) for r in sizes.groupBy("source").agg(F.sum("size").alias("size")).collect()}  # a row for each source
    goals = targets(own)
    return Plan(list(goals), [own[s] for s in goals], [float(t) for t in goals.values()], block_words)


def _sources(spark: SparkSession, plan: Plan) -> DataFrame:
    rows = [(k, *x) for k, x in enumerate(zip(plan.names, plan.sizes, plan.targets, strict=True))]
    return F.broadcast(spark.createDataFrame(rows, "src int, source string, source_size long, target double"))  # a row for each source


def blocks_of(sizes: DataFrame, plan: Plan, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """src, block, docs: the pieces of documents that a block holds, in order.

    Where a document starts is the sum of two: that of the buckets of its stream before its own, and that of its bucket's
    documents before it; a bucket is an interval of hashes with about bucket_rows rows of all sources.
    """
    spark, texts = sizes.sparkSession, "text" in sizes.columns
    bits = max(0, (sizes.count() // bucket_rows).bit_length())
    named = _sources(spark, plan)
    d = sizes.where("size > 0").join(named, sizes["source"].eqNullSafe(named["source"])).drop(named["source"])
    d = d.withColumn("bucket", F.shiftright("h", 60 - bits))
    before = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = d.groupBy("src", "bucket").agg(F.sum("size").alias("words")).withColumn("base", F.coalesce(F.sum("words").over(before), F.lit(0))).drop("words")
    inside = Window.partitionBy("src", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("below", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(base, ["src", "bucket"])
    start, width = F.col("base") + F.col("below"), plan.block_words
    d = d.withColumn("start", start).withColumn("stop", F.col("start") + F.col("size"))
    first, last = F.expr(f"start div {width}"), F.expr(f"(stop - 1) div {width}")
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "") if texts else None
    if texts:
        d = d.withColumn("words", words)

    def piece(block: Column) -> Column:
        a, b = F.greatest(F.col("start"), block * width), F.least(F.col("stop"), (block + 1) * width)
        own = [F.array_join(F.slice("words", (a - F.col("start") + 1).cast("int"), (b - a).cast("int")), " ").alias("text")] if texts else []
        return F.struct(block.alias("block"), F.struct(F.col("start"), F.col("doc_id"), F.col("size"), (a - F.col("start")).alias("first"), (b - a).alias("n"), *own).alias("piece"))

    pieces = d.select("src", F.explode(F.transform(F.sequence(first, last), piece)).alias("p")).select("src", "p.block", "p.piece")
    return pieces.groupBy("src", "block").agg(F.array_sort(F.collect_list("piece")).alias("docs"))


def slots_of(spark: SparkSession, plan: Plan, shard_slots: int = SHARD_SLOTS, seed: str = SEED) -> DataFrame:
    """shard, slot, src, pass, block: which block each slot of the mix takes."""
    total = sum(plan.slots)
    if not total:
        return spark.createDataFrame([], "shard long, slot long, src int, pass int, block long")
    drawn = spark.range(total).withColumnRenamed("id", "at")
    drawn = drawn.select("at", F.expr(f"at div {shard_slots}").alias("shard"), _chosen(hashed(F.concat_ws("/", F.lit(f"{seed}/slot"), "at")), plan.slots, 1 << 60).cast("int").alias("src"))
    counts = written(drawn.groupBy("shard", "src").agg(F.count("*").alias("n")), "draws")
    got = dict.fromkeys(range(len(plan.slots)), 0) | {r["src"]: r["n"] for r in counts.groupBy("src").agg(F.sum("n").alias("n")).collect()}  # a row for each source
    # Numbers of slots too many, and the sources that fell short, one after another.
    over, short = ([max(0, sign * (got[k] - m)) for k, m in enumerate(plan.slots)] for sign in (1, -1))
    over_from, short_from = [0, *accumulate(over)], [0, *accumulate(short)]
    before = Window.partitionBy("src").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    rank = F.row_number().over(Window.partitionBy("shard", "src").orderBy("at")) - 1
    d = drawn.withColumn("rank", rank).join(base, ["shard", "src"]).withColumn("number", F.col("base") + F.col("rank"))
    moves = F.broadcast(spark.createDataFrame([(k, m, over_from[k]) for k, m in enumerate(plan.slots)], "src int, slots long, over_from long"))  # a row for each source
    spare = F.col("number") - F.col("slots") + F.col("over_from")
    if sum(short):
        to = _chosen(spare, short).cast("int")
        d = d.join(moves, "src").withColumn("spare", F.when(F.col("number") >= F.col("slots"), spare))
        d = d.withColumn("to", F.when(F.col("spare").isNull(), F.col("src")).otherwise(to))
        ends = F.broadcast(spark.createDataFrame([(k, got[k] - short_from[k]) for k in range(len(plan.slots))], "to int, shift long"))  # a row for each source
        d = d.join(ends, "to").withColumn("number", F.when(F.col("spare").isNull(), F.col("number")).otherwise(F.col("spare") + F.col("shift"))).drop("src").withColumnRenamed("to", "src")
    keys = [(k, n, p, [_key(f"{seed}/key/{k}/{p}/{r}", n) for r in range(ROUNDS)]) for k, n in enumerate(plan.blocks) for p in range(plan.most)]
    keyed = F.broadcast(spark.createDataFrame(keys, "src int, blocks long, pass int, keys array<long>"))  # two rows for each source
    blocks = F.broadcast(spark.createDataFrame([(k, n) for k, n in enumerate(plan.blocks)], "src int, held long"))  # a row for each source
    d = d.join(blocks, "src").withColumn("pass", F.expr("number div held").cast("int")).join(keyed, ["src", "pass"])
    block = permuted(F.pmod("number", "blocks"), F.col("blocks"), F.col("keys"), F.concat_ws("/", F.lit(f"{seed}/bit"), "src", "pass"))
    return d.select("shard", F.pmod("at", F.lit(shard_slots)).alias("slot"), "src", "pass", block.alias("block"))


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: str = SEED) -> DataFrame:
    """shard, slot, source, pass, block, text, docs: the mix itself, a row for each slot."""
    sizes = sizes_of(docs, texts=True)
    plan = planned(sizes.drop("text"), block_words)
    found = slots_of(docs.sparkSession, plan, shard_slots, seed).join(blocks_of(sizes, plan), ["src", "block"])
    text = F.array_join(F.transform("docs", lambda x: x["text"]), " ")
    parts = F.transform("docs", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["first"].alias("first"), x["n"].alias("n")))
    return found.join(_sources(docs.sparkSession, plan), "src").select("shard", "slot", "source", "pass", "block", text.alias("text"), parts.alias("docs"))


def mix_report(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: str = SEED) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words of its blocks in all slots that take them)."""
    spark = docs.sparkSession
    sizes = written(sizes_of(docs), "sizes")
    plan = planned(sizes, block_words)
    times = F.when(F.col("shard").isNotNull(), F.col("d.n")).otherwise(0)
    placed = blocks_of(sizes, plan).join(slots_of(spark, plan, shard_slots, seed), ["src", "block"], "left").select("src", "shard", F.explode("docs").alias("d"))
    taken = placed.groupBy("src", "d.start", "d.doc_id", "d.size").agg(F.sum(times).alias("taken"))
    sources = _sources(spark, plan)
    columns = ("doc_id", "size", "source_size", "target", "taken")
    none = sizes.where("size = 0").join(sources, sizes["source"].eqNullSafe(sources["source"])).withColumn("taken", F.lit(0).cast("long"))
    return taken.join(sources, "src").select(*columns).unionByName(none.select(*columns))
