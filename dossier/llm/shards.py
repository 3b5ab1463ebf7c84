"""Sharding by histogram sort, with DataFrame operations only.

Documents are ordered by a hash of their text and then doc_id, so equal texts lie side by side and a hot group
is split where a boundary falls into it.  Splitters are found by counting: each round every partition counts the
exact bytes and rows of 64 key intervals within each interval that still holds a splitter, the driver reads those
few counts, and the probes move into the interval that holds the splitter, until it is met within the tolerance.
Rows are exchanged once, by intervals of keys with near equal numbers of rows, found by the same counting, so no task
gathers a shard or a hot text; exact counts give each interval its first slot.

Law `bytes`: a document's shard is floor(shards * (bytes of all smaller keys + half its own) / all bytes).

Defined results: a null text counts as empty; a null doc_id sorts first; ids further apart than 2**62 are ordered by their
quarters; rows with equal keys share a shard and
have slots in any order; empty tables give empty results.  Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import groupby
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

SHARDS, FETCH = 16, 64
#: Bits of the hash of a text, and of a digit: 64 probes for a splitter in each round.
HASH_BITS, DIGIT = 60, 6
Key = tuple[int, int]


def _levels(id_bits: int) -> list[tuple[int, int]]:
    """Shifts of (h, e) that leave the leading digits of a key: one more digit at each level."""
    return [(s, -1) for s in range(HASH_BITS - DIGIT, -1, -DIGIT)] + [(0, s) for s in range(max(0, -(-id_bits // DIGIT) - 1) * DIGIT, -1, -DIGIT)]


def _leading(level: tuple[int, int]) -> list[Column]:
    h, e = level
    return [F.shiftright("h", h), F.lit(0).cast("long") if e < 0 else F.shiftright("e", e)]


def _within(level: tuple[int, int], prefixes: set[Key]) -> Column:
    h, e = _leading(level)
    by_id = [(h == a) & e.isin([y for _, y in own]) for a, own in groupby(sorted(prefixes), key=lambda p: p[0])] if level[1] >= 0 else []
    return reduce(or_, by_id) if by_id else h.isin([a for a, _ in prefixes])


def _start(level: tuple[int, int], prefix: Key) -> Key:
    return prefix[0] << level[0], prefix[1] << max(level[1], 0)


def histogram_splitters(keys: DataFrame, shards: int = SHARDS, tolerance: int = 0, fetch: int = FETCH) -> list[Key]:
    """First keys (h, e) of shards 1 and up: where the bytes below come nearest to k/shards of all, or within the tolerance.

    An interval of at most `fetch` rows is read, key by key, instead of being counted further.
    """
    total, top = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("e"), F.lit(0))).first()
    levels, out = _levels(int(top).bit_length()), {}
    todo: dict[int, tuple[Key, int]] = {k: ((0, 0), 0) for k in range(1, shards)}  # of each splitter: interval, bytes below it
    read: dict[int, tuple[tuple[int, int], Key, int]] = {}
    for at, level in enumerate(levels):
        if not todo:
            break
        inside = keys.where(_within(levels[at - 1], {p for p, _ in todo.values()})) if at else keys
        h, e = _leading(level)
        counts = sorted(tuple(r) for r in inside.groupBy(h.alias("h"), e.alias("e")).agg(F.sum("size"), F.count("*")).collect())  # 64 rows for each splitter at most
        for k, (prefix, below) in list(todo.items()):
            goal = k * total / shards
            own = [c for c in counts if not at or _is_under(levels[at - 1], level, prefix, (c[0], c[1]))]
            for i, (a, b, size, rows) in enumerate(own):
                if below + size >= goal or i == len(own) - 1:
                    if goal - below <= tolerance:
                        out[k] = _start(level, (a, b))
                    elif rows <= fetch or at == len(levels) - 1:
                        read[k] = (level, (a, b), below)
                    if k in out or k in read:
                        del todo[k]
                    else:
                        todo[k] = ((a, b), below)
                    break
                below += size
            else:
                del todo[k]  # no rows at all
    if read:
        inside = reduce(or_, (_within(level, {p}) for level, p, _ in read.values()))
        rows = sorted(tuple(r) for r in keys.where(inside).groupBy("h", "e").agg(F.sum("size")).collect())
        for k, (level, prefix, below) in read.items():
            goal = k * total / shards
            own = [r for r in rows if (r[0] >> level[0], 0 if level[1] < 0 else r[1] >> level[1]) == prefix]
            for h, e, size in own:
                if 2 * below + size >= 2 * goal:  # nearer to the goal than the boundary after this key
                    out[k] = (h, e)
                    break
                below += size
            else:
                out[k] = (own[-1][0], own[-1][1] + 1)
    return [out[k] for k in sorted(out)]


def _is_under(above: tuple[int, int], level: tuple[int, int], prefix: Key, found: Key) -> bool:
    if found[0] >> (above[0] - level[0]) != prefix[0]:
        return False
    return above[1] < 0 or found[1] >> (above[1] - level[1]) == prefix[1]


def _shard(splitters: list[Key], low: int, high: int) -> Column:
    """How many splitters aren't above a row's key, as a search tree of comparisons."""
    if low == high:
        return F.lit(low)
    mid = (low + high) // 2
    h, e = splitters[mid]
    less = (F.col("h") < h) | ((F.col("h") == h) & (F.col("e") < e))
    return F.when(less, _shard(splitters, low, mid)).otherwise(_shard(splitters, mid + 1, high))


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, tolerance: int = 0, part_rows: int = 1 << 22) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of docs.

    The one exchange deals rows to intervals of part_rows rows at most, as many as there are shuffle partitions at least.
    """
    spark = docs.sparkSession
    text, ids = F.coalesce("text", F.lit("")), F.col("doc_id").cast("long")
    keys = docs.select(
        ids.alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long").alias("h"),
    )
    keys = written(keys, "keys")
    least, top, total = keys.agg(F.coalesce(F.min("doc_id"), F.lit(0)), F.coalesce(F.max("doc_id"), F.lit(0)), F.count("*")).first()
    half = 2 * int(top - least >= 1 << 62)
    keys = keys.withColumn("e", F.coalesce(F.shiftright("doc_id", half) - F.lit(least >> half) + 1, F.lit(0).cast("long")))
    splitters = histogram_splitters(keys, shards, tolerance)
    placed = keys.withColumn("shard", _shard(splitters, 0, len(splitters)))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // part_rows))
    cuts = histogram_splitters(keys.withColumn("size", F.lit(1)), parts, total // (4 * parts), 0)
    # Both terms never fall along the order of keys, so each interval of keys within a shard has a number of its own.
    placed = placed.withColumn("part", _shard(cuts, 0, len(cuts)) + F.col("shard"))
    counts = sorted(tuple(r) for r in placed.groupBy("part", "shard").agg(F.count("*")).collect())  # a row for each interval
    first, slots = {}, dict.fromkeys(range(shards + 1), 0)
    for part, shard, n in counts:
        first[part] = slots[shard]
        slots[shard] += n
    begins = spark.createDataFrame(list(first.items()), "part int, base long")
    at = F.row_number().over(Window.partitionBy("part").orderBy("h", "e", "doc_id"))
    placed = placed.join(F.broadcast(begins), "part")  # a row for each interval
    return placed.withColumn("at", at).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("at") - 1 + F.col("base")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
