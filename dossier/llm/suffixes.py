"""Suffix-array dedup by depth-limited radix sort: remove every byte of a window that occurs more than once.

All suffixes of all texts that are at least `length` bytes long are ordered through their first `length` bytes only,
most significant digit first.  The first pass buckets every suffix by its first digit (bytes 0 to the first depth),
and suffixes alone in their bucket leave; the next digit goes on from there with those that are left, and so on to
the last depth.  Equal groups of the last pass are exactly the repeated windows.  A digit is hashed, so buckets are in
the order of hashes; what is wanted of the order are its equal groups alone.  Passes before the last have as few
bits as suffice to let most single suffixes leave, and the last one has 64.

Buckets are those of buckets.py: nothing but bucket numbers is shuffled, a piece of a slice sends each of its buckets
once, and a bucket that holds a third of all suffixes is one entry for each piece.  Each pass has as many ranges as the
suffixes that are left to it need.

Defined results: null texts are empty; texts shorter than a window keep all bytes; rows with the same doc_id are
documents of their own, so equal rows remove each other; a null doc_id is a document like any other.  Extra
columns are ignored, and an empty table gives an empty result.  Two different windows are taken for one with a
chance of 2**-64 a pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import buckets as B
from . import rolling as R
from .shared import prepare, removed, written

LENGTH, DEPTHS = 200, (64, 200)
#: Bytes of text that are shuffled as one slice, and those whose suffixes are sorted at a time.
SLICE_BYTES, PIECE_BYTES = 8 << 20, 2 << 20
#: Suffixes of a range at most.
RANGE_KEYS = 4 << 20
#: Bits of a bucket number in passes before the last, beyond those that number all suffixes: one in 2**SPARE stays by chance.
SPARE = 4
_SLICE = "slice long, ids array<long>, sizes array<long>, data binary, suffixes long"
_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed_from array<long>, removed_to array<long>"


def _slices(length: int, slice_bytes: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part, texts in R.slices(batch, most=slice_bytes):
                buf, offsets = R.flat(texts)
                sizes = np.diff(offsets)
                kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.int64()]
                row = [n, part.column(0).to_pylist(), sizes, B.zipped(buf), int(np.maximum(sizes - length + 1, 0).sum())]
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], ["slice", "ids", "sizes", "data", "suffixes"])
                n += 1

    return pack


def _pieces(row: dict, piece_bytes: int) -> list[tuple[list, np.ndarray, np.ndarray]]:
    """Ids, bytes and offsets of the texts of each piece of a slice; a longer text is a piece of its own."""
    data, offsets = B.unzipped(row["data"], np.uint8), np.r_[0, np.cumsum(np.array(row["sizes"], np.int64))]
    out, at = [], 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + piece_bytes, "right")) - 1)
        out.append((row["ids"][at:to], data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]))
        at = to
    return out


class Suffixes:
    """A piece's suffixes of `length` bytes or more, and the passes that they go through."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, depths: tuple[int, ...], bits: tuple[int, ...]):
        self.data, self.offsets = data, offsets
        self.hashes = R.byte_ranges(self.data)
        self.depths, self.bits = depths, bits
        counts = np.maximum(np.diff(self.offsets) - length + 1, 0)
        self.at = np.repeat(self.offsets[:-1], counts) + R.runs(counts)

    def entries(self, k: int) -> B.Entries:
        """Buckets of pass k over the suffixes that are left."""
        return B.Entries(self.hashes.of(self.at, self.at + self.depths[k], 3 + k), self.bits[k])

    def keep(self, k: int, bits: np.ndarray) -> None:
        """Only suffixes that pass k didn't find alone."""
        self.at = self.at[self.entries(k).of_places(bits)] if len(bits) else self.at[:0]


def _sent(k: int, length: int, depths: tuple[int, ...], bits: tuple[int, ...], range_bits: int, piece_bytes: int):
    """The buckets of pass k, of the suffixes that passes before it left."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                pieces = _pieces(row, piece_bytes)
                kept = [B.read_bits(row[f"bits{before}"], len(pieces)) for before in range(k)]
                entries, more = [], 0
                for j, (_, data, offsets) in enumerate(pieces):
                    own = Suffixes(data, offsets, length, depths, bits)
                    for before in range(k):
                        own.keep(before, kept[before][j])
                    found = own.entries(k)
                    entries.append((found.values, found.counts > 1))
                    more += len(own.at) - len(found.values)
                yield from B.sent(entries, bits[k], row["slice"], row["slice"], range_bits, more)

    return send


def _cut(length: int, depths: tuple[int, ...], bits: tuple[int, ...], piece_bytes: int):
    def removed_of(ids: list, own: Suffixes) -> pa.RecordBatch:
        text = np.searchsorted(own.offsets, own.at, "right") - 1
        s, e = R.covered(own.at + text, own.at + text + length)  # a place between texts keeps their ranges apart
        text = np.searchsorted(own.offsets + np.arange(len(own.offsets)), s, "right") - 1
        s, e, cuts = s - text, e - text, np.searchsorted(text, np.arange(len(own.offsets)))
        out: list[tuple] = []
        for doc, low, high, a, b in zip(ids, own.offsets[:-1].tolist(), own.offsets[1:].tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            digest, at = hashlib.sha256(), low
            for x, y in zip(s[a:b].tolist(), e[a:b].tolist(), strict=True):
                digest.update(own.data[at:x])
                at = y
            digest.update(own.data[at:high])
            out.append((doc, high - low, int((e[a:b] - s[a:b]).sum()), b - a, digest.hexdigest(), s[a:b] - low, e[a:b] - low))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed_from", "removed_to"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                pieces = _pieces(row, piece_bytes)
                kept = [B.read_bits(row[f"bits{k}"], len(pieces)) for k in range(len(depths))]
                for j, (ids, data, offsets) in enumerate(pieces):
                    own = Suffixes(data, offsets, length, depths, bits)
                    for k in range(len(depths)):
                        own.keep(k, kept[k][j])
                    yield removed_of(ids, own)

    return cut


def repeated_bytes(docs: DataFrame, length: int = LENGTH, depths: tuple[int, ...] = DEPTHS, slice_bytes: int = SLICE_BYTES, range_keys: int = RANGE_KEYS, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the removed byte ranges as two lists.

    depths: bytes through which suffixes are ordered after each pass; the last one is `length`.
    """
    if depths[-1] != length or list(depths) != sorted(set(depths)):
        raise ValueError("depths have to rise to the length of a window")
    prepare(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    slices = written(texts.mapInArrow(_slices(length, slice_bytes), _SLICE), "slices", by="slice")
    left = slices.agg(F.coalesce(F.sum("suffixes"), F.lit(0))).first()[0]
    few = min(64, int(left).bit_length() + SPARE)
    bits = (*[few] * (len(depths) - 1), 64)
    known = slices.drop("suffixes")
    done = []
    for k in range(len(depths)):
        sent = known.mapInArrow(_sent(k, length, depths, bits, min(few, B.range_bits(left, range_keys)), piece_bytes), B.SENT)
        done.append(written(B.decided(sent, B.repeated), f"bits-{k}"))
        left = done[-1].agg(F.coalesce(F.sum("left"), F.lit(0))).first()[0]
        known = known.join(done[-1].select("slice", F.col("bits").alias(f"bits{k}")), "slice", "left")
    out = written(known.mapInArrow(_cut(length, depths, bits, piece_bytes), _RESULT), "repeated-bytes")
    for table in (slices, *done):
        removed(table)
    return out
