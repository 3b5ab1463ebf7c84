"""Word and window hashes of many texts at once, as numpy helpers for use inside Arrow tasks.

A batch of texts is one flat byte array with offsets.  Polynomial prefix sums modulo 2**64 give the hash
of any byte or word range in constant time; results are mixed before use.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text hashed at a time: bounds a task's memory by about 80 bytes for each of them.
SLICE_BYTES = 1 << 20

_WORD_BASE = 0x9E3779B97F4A7C15
_BYTE_TABLE = np.random.default_rng(20_240_607).integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ U64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = U64(_WORD_BASE)
    inverse = U64(pow(_WORD_BASE, -1, 1 << 64))
    up, down = np.full(n, base), np.full(n, inverse)
    up[0] = down[0] = U64(1)
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


class Ranges:
    """Hashes of ranges [start, end) of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        size = 1 << max(12, int(n).bit_length())
        up, self.down = _powers(size)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * up[:n], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64), seed)


def byte_ranges(buf: np.ndarray) -> Ranges:
    return Ranges(_BYTE_TABLE[buf])


def as_texts(column: pa.Array) -> pa.Array:
    """Strings without nulls: null becomes the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).fill_null("")


def flat(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of texts, without a copy."""
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """A batch in parts of about `most` bytes of text; a longer text is a part of its own."""
    texts = as_texts(batch.column(batch.schema.get_field_index(text)))
    _, offsets = flat(texts)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, to - at), texts.slice(at, to - at)
        at = to


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return np.where((buf >= 65) & (buf <= 90), buf + 32, buf)


#: Bytes that part words: white space, or all ASCII but letters and digits.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True


def words(buf: np.ndarray, offsets: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in bytes, and for each text the index of its first word (with the total at the end)."""
    inside = np.zeros(len(buf) + 2, bool)
    inside[1:-1] = ~apart[buf]
    starts, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(buf))]
    starts[edges] = inside[1:-1][edges]
    ends[edges - 1] = inside[1:-1][edges - 1]
    at = np.flatnonzero(starts)
    return at, np.flatnonzero(ends) + 1, np.searchsorted(at, offsets)


def runs(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each n of lengths, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values, by doubling."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def covered(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of ranges as sorted disjoint ranges; ranges that touch are one."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    first = np.r_[True, s[1:] > e[:-1]]
    return s[first], e[np.r_[np.flatnonzero(first)[1:] - 1, len(s) - 1]]
