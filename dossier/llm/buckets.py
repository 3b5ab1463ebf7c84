"""Buckets of hashed keys over a whole corpus, in passes that ship nothing but the bucket numbers.

Texts are packed into slices of bounded size, written once, so a slice is the same whenever it is read again.  In a
pass each slice sorts its keys; equal keys of a slice are one entry with a flag (the map-side combine, so a hot key
is one entry for each slice and no more).  Entries are dealt out by their leading bits, many in one row, as
compressed gaps; each range of buckets is merged by itself, and one bit for each entry goes back to its slice.
A range and a slice have a bound that the parameters set; a range has at most about `RANGE_KEYS` keys (or what its
operator says), whatever the input, and is ordered in parts of `PART_KEYS`.  A slice sends a row to each range, so both
are as large as memory allows: a slice may consist of pieces whose keys are sorted one at a time and sent together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rolling as R

RANGE_KEYS, PART_KEYS = 1 << 20, 1 << 20
#: n: entries of each piece of the slice.  more: keys of the slice beyond its entries, in one of its rows.
SENT = "range long, slice long, rank long, n array<int>, entries binary, flags binary, more long"
BITS = "slice long, range long, n array<int>, bits binary, left long"
_FAST, _SMALL, _BACK = zstandard.ZstdCompressor(level=1), zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def zipped(x: np.ndarray) -> bytes:
    return _SMALL.compress(np.ascontiguousarray(x).tobytes())


def unzipped(data: bytes, kind: type = np.int64) -> np.ndarray:
    return np.frombuffer(_BACK.decompress(data), kind)


def packed(values: np.ndarray, sizes: np.ndarray) -> bytes:
    """Runs of sorted integers as compressed gaps, byte planes apart; sizes: of the runs."""
    gaps = np.diff(values, prepend=R.U64(0))
    first = (np.cumsum(sizes) - sizes)[sizes > 0]
    gaps[first] = values[first]
    planes = [(gaps >> R.U64(8 * i)).astype(np.uint8).tobytes() for i in range(-(-int(gaps.max(initial=0)).bit_length() // 8))]
    return _FAST.compress(b"".join(planes))


def unpacked(data: bytes, sizes: np.ndarray) -> np.ndarray:
    n = int(sizes.sum())
    gaps = np.zeros(n + 1, np.uint64)
    for i, plane in enumerate(np.frombuffer(_BACK.decompress(data), np.uint8).reshape(-1, n)):
        gaps[1:] |= plane.astype(np.uint64) << R.U64(8 * i)
    sums = np.cumsum(gaps, dtype=np.uint64)
    return sums[1:] - np.repeat(sums[np.cumsum(sizes) - sizes], sizes)


def in_order(keys: np.ndarray, bits: int) -> np.ndarray:
    """Stable order of keys of so many bits: as many of them as there is room for are sorted together with their places."""
    places = max(1, len(keys) - 1).bit_length()
    lost = max(0, bits + places - 64)
    one = np.sort(((keys >> R.U64(lost)) << R.U64(places)) | np.arange(len(keys), dtype=np.uint64))
    order = (one & R.U64((1 << places) - 1)).astype(np.int64)
    if lost:
        found = keys[order]
        if (found[1:] < found[:-1]).any():
            order = order[np.argsort(found, kind="stable")]
    return order


#: Rows that are made or read at a time.
_ROWS = 256


class Entries:
    """Distinct keys of a slice in order: where each starts in the order of its places, and its flag."""

    def __init__(self, keys: np.ndarray, bits: int):
        self.keys, self.bits = keys >> R.U64(64 - bits), bits
        self.order = in_order(self.keys, bits)
        ordered = self.keys[self.order]
        new = np.r_[True, ordered[1:] != ordered[:-1]] if len(ordered) else np.zeros(0, bool)
        self.first = np.flatnonzero(new)
        self.counts = np.diff(np.r_[self.first, len(ordered)])
        self.values = ordered[self.first]

    def of_places(self, of_entries: np.ndarray) -> np.ndarray:
        """A value for each place, from a value for each entry."""
        out = np.zeros(len(self.order), of_entries.dtype)
        out[self.order] = np.repeat(of_entries, self.counts)
        return out


def sent(pieces: list[tuple[np.ndarray, np.ndarray]], bits: int, slice_: int, rank: int, range_bits: int, more: int = 0) -> Iterator[pa.RecordBatch]:
    """Rows of a pass: the entries of each range, piece after piece.  pieces: the distinct keys of each in order, with their flags."""
    cuts = np.zeros((len(pieces), (1 << range_bits) + 1), np.int64)
    for own, (values, _) in zip(cuts, pieces, strict=True):
        own[:-1] = np.searchsorted(values >> R.U64(bits - range_bits), np.arange(1 << range_bits, dtype=np.uint64)) if range_bits else 0
        own[-1] = len(values)
    sizes, rest = np.diff(cuts), R.U64((1 << (bits - range_bits)) - 1)
    names = np.flatnonzero(sizes.sum(axis=0))
    for at in range(0, len(names), _ROWS):
        rows = []
        for r in names[at : at + _ROWS].tolist():
            keys, flags = (np.concatenate([p[i][a:b] for p, a, b in zip(pieces, cuts[:, r], cuts[:, r + 1], strict=True)]) for i in (0, 1))
            rows.append((r, slice_, rank, sizes[:, r], packed(keys & rest, sizes[:, r]), zipped(np.packbits(flags)), more))
            more = 0
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["range", "slice", "rank", "n", "entries", "flags", "more"])


def range_bits(keys: int, most: int = RANGE_KEYS) -> int:
    """Leading bits that tell ranges of `most` keys, or up to half as many, apart."""
    return max(0, int(keys // most).bit_length())


def decided(sent: DataFrame, decide: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], part_keys: int = PART_KEYS) -> DataFrame:
    """(slice, bits, left): for each slice the decision on each of its entries, in their order, and how many keys those may have that are true.

    decide: takes the keys of all entries of a range, ordered by key, with the ranks of their slices and their flags.
    """

    def merge(rows: list[dict]) -> pa.RecordBatch:
        sizes = np.array([sum(r["n"]) for r in rows])
        places = np.r_[0, np.cumsum(sizes)].tolist()
        every, flags, out = np.empty(places[-1], np.uint64), np.empty(places[-1], bool), np.zeros(places[-1], bool)
        for r, a, b in zip(rows, places[:-1], places[1:], strict=True):
            every[a:b] = unpacked(r["entries"], np.array(r["n"]))
            flags[a:b] = np.unpackbits(unzipped(r["flags"], np.uint8), count=b - a)
        ranks, of = np.array([r["rank"] for r in rows]), np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
        width, parts = int(every.max(initial=1)).bit_length(), int(len(every) // part_keys).bit_length()
        low = max(0, width - parts)  # bits within a part
        for part in range(1 << min(parts, width)):
            at = np.flatnonzero(every >> R.U64(low) == part) if parts else np.arange(len(every))
            keys = every[at] & R.U64((1 << low) - 1)
            order = in_order(keys, low)
            keys, at = keys[order], at[order]
            out[at] = decide(keys, ranks[of[at]], flags[at])
        bits = [np.packbits(out[a:b]).tobytes() for a, b in zip(places[:-1], places[1:], strict=True)]
        left = [int(out[a:b].sum()) + r["more"] for r, a, b in zip(rows, places[:-1], places[1:], strict=True)]
        columns = ([r["slice"] for r in rows], [r["range"] for r in rows], [r["n"] for r in rows], bits, left)
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.binary(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["slice", "range", "n", "bits", "left"])

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in (row for i in range(0, batch.num_rows, _ROWS) for row in batch.slice(i, _ROWS).to_pylist()):
                if held and held[0]["range"] != row["range"]:
                    yield merge(held)
                    held = []
                held.append(row)
        if held:
            yield merge(held)

    dealt = sent.repartition("range").sortWithinPartitions("range")
    found = dealt.mapInArrow(ranges, BITS)
    return found.groupBy("slice").agg(F.sort_array(F.collect_list(F.struct("range", "n", "bits"))).alias("bits"), F.sum("left").alias("left"))


def read_bits(bits: list[dict] | None, pieces: int = 1) -> list[np.ndarray]:
    """The decisions on the entries of each piece of a slice."""
    if not bits:
        return [np.zeros(0, bool)] * pieces
    sizes = np.array([b["n"] for b in bits])
    every = np.concatenate([np.unpackbits(np.frombuffer(b["bits"], np.uint8), count=n) for b, n in zip(bits, sizes.sum(axis=1).tolist(), strict=True)]).astype(bool)
    first = (np.cumsum(sizes) - sizes.ravel()).reshape(sizes.shape)
    return [every[np.repeat(first[:, j], sizes[:, j]) + R.runs(sizes[:, j])] for j in range(pieces)]


def groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where groups of equal sorted keys start, and how large they are."""
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return first, np.diff(np.r_[first, len(keys)])


def repeated(keys: np.ndarray, ranks: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Entries whose key another slice has too, or that are flagged."""
    first, sizes = groups(keys)
    return np.repeat((sizes > 1) | np.logical_or.reduceat(flags, first), sizes) if len(keys) else flags


def first_of_several(keys: np.ndarray, ranks: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Entries of the lowest rank that has their key, where several ranks have it or one of them is flagged."""
    if not len(keys):
        return flags
    first, sizes = groups(keys)
    low, high = np.minimum.reduceat(ranks, first), np.maximum.reduceat(ranks, first)
    several = (low < high) | np.logical_or.reduceat(flags, first)
    return np.repeat(several, sizes) & (ranks == np.repeat(low, sizes))
