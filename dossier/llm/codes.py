"""Vector codes: each part of a vector as the number of the nearest entry of a codebook, found through a VA-file.

Components are integers, floor(1024 * x); vectors fall into four consecutive parts, as near equal as can be.  A part
position has a codebook of at most 256 entries, at first the parts of the smallest ids, then four rounds of means (rounded
down).  All arithmetic is on integers, so codes are the same whatever the order of rows.

VA-file (Weber, Schek and Blott 1998) over a codebook: each coordinate of the entries is cut into 16 cells of near equal
numbers of entries, so an entry is four bits a coordinate.  For a query, a table for each coordinate has the least and the
greatest squared difference to each cell; sums of looked-up values are bounds of its distance to each entry.  Entries
whose lower bound isn't above the smallest upper bound are compared exactly, and the nearest, ties by number, is found.

`fit_codebooks` sends the codebooks to every task, at most 256 whole vectors, and gets back a count and sums for each entry.
Defined results: rows are dropped whose vector is null, has a null or non-finite component, or another length than that of the
smallest kept id.  Repeated ids and equal vectors are rows of their own (of equal ids, the smaller vector comes first; a
null id last).  With fewer than 256 rows a codebook has as many entries.  An empty table gives an empty result.
Vectors so large that a squared distance has no room in 64 bits are refused.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import prepare, written

PARTS, ENTRIES, ROUNDS, SCALE, CELL_BITS = 4, 256, 4, 1024, 4
#: Queries that are compared at once, and labels whose sums are broadcast.
BLOCK, MOST_LABELS = 512, 1 << 16


class VAFile:
    """Entries of a codebook with the cells of their coordinates."""

    def __init__(self, entries: np.ndarray, bits: int = CELL_BITS):
        self.entries = entries
        n, width = entries.shape
        cells = min(1 << bits, n)
        order = np.argsort(entries, axis=0, kind="stable")
        self.cells = np.empty((n, width), np.int64)
        np.put_along_axis(self.cells, order, np.broadcast_to((np.arange(n) * cells // n)[:, None], (n, width)), axis=0)
        ordered = np.take_along_axis(entries, order, axis=0)
        ends = np.searchsorted(np.arange(n) * cells // n, np.arange(cells + 1))
        self.low, self.high = ordered[ends[:-1]], ordered[ends[1:] - 1]  # of each cell and coordinate

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the squared distances of queries to entries."""
        lower = np.zeros((len(queries), len(self.entries)), np.int64)
        upper = np.zeros_like(lower)
        for j in range(queries.shape[1]):
            below, above = self.low[:, j] - queries[:, j, None], queries[:, j, None] - self.high[:, j]
            least = np.maximum(np.maximum(below, above), 0) ** 2
            most = np.maximum(np.abs(below), np.abs(above)) ** 2
            lower += np.take(least, self.cells[:, j], axis=1)
            upper += np.take(most, self.cells[:, j], axis=1)
        return lower, upper

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each query the nearest entry and its squared distance."""
        places, distances = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(queries), BLOCK):
            some = queries[at : at + BLOCK]
            lower, upper = self.bounds(some)
            row, entry = np.nonzero(lower <= upper.min(axis=1, keepdims=True))  # at least one a row
            exact = ((some[row] - self.entries[entry]) ** 2).sum(axis=1)
            first = np.searchsorted(row, np.arange(len(some)))
            least = np.minimum.reduceat(exact, first)
            best = np.flatnonzero(exact == least[row])
            places.append(entry[best[np.searchsorted(row[best], np.arange(len(some)))]])
            distances.append(least)
        return np.concatenate(places), np.concatenate(distances)


class Codebooks:
    """Entries by part, entry and position."""

    def __init__(self, parts: list[np.ndarray]):
        self.parts = parts
        self.files = [VAFile(p) for p in parts]
        self.cuts = np.cumsum([0, *(p.shape[1] for p in parts)])

    @classmethod
    def of_vectors(cls, vectors: np.ndarray, parts: int = PARTS) -> Codebooks:
        cuts = [i * vectors.shape[1] // parts for i in range(parts + 1)]
        return cls([vectors[:, a:b].copy() for a, b in zip(cuts[:-1], cuts[1:], strict=True)])

    def assigned(self, vectors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        return [f.nearest(vectors[:, a:b]) for f, a, b in zip(self.files, self.cuts[:-1], self.cuts[1:], strict=True)]

    def decoded(self, codes: list[str]) -> np.ndarray:
        """The middles of the integers' intervals, as components."""
        at = np.array([list(bytes.fromhex(c)) for c in codes], np.int64).reshape(-1, len(self.parts))
        return (np.concatenate([p[at[:, k]] for k, p in enumerate(self.parts)], axis=1) + 0.5) / SCALE

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for p in self.parts for x in p.ravel().tolist()).encode()).hexdigest()


def integers(column: pa.Array, width: int) -> np.ndarray:
    """Vectors of a column without nulls, each of so many components."""
    values = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    if len(values) and width * (2 * np.abs(values).max() + 2) ** 2 >= 2**63:
        raise ArithmeticError("a vector's components are too large for 64-bit distances")
    return values.astype(np.int64).reshape(len(column), width)


def _finite(vectors: DataFrame) -> DataFrame:
    fine = F.forall("embedding", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))  # NaN is above all
    return vectors.where(F.col("embedding").isNotNull() & fine)


def kept(vectors: DataFrame) -> tuple[DataFrame, int]:
    """vec_id, label and embedding of the rows that take part, and the length of their vectors (-1: there are none)."""
    fine = _finite(vectors.select("vec_id", "label", "embedding"))
    first = fine.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select(F.size("embedding")).first()
    width = first[0] if first else -1
    return fine.where(F.size("embedding") == width), width


def _sums(books: Codebooks, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(p), np.int64) for p in books.parts]
        totals = [np.zeros_like(p) for p in books.parts]
        for batch in batches:
            vectors = integers(batch.column(0), width)
            for k, (place, _) in enumerate(books.assigned(vectors)):
                counts[k] += np.bincount(place, minlength=len(counts[k]))
                np.add.at(totals[k], place, vectors[:, books.cuts[k] : books.cuts[k + 1]])
        some = [(k, i) for k, n in enumerate(counts) for i in np.flatnonzero(n).tolist()]
        values = [[int(counts[k][i]), *totals[k][i].tolist()] for k, i in some]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in some], pa.int32()), pa.array([i for _, i in some], pa.int32()), pa.array(values, pa.list_(pa.int64()))], ["part", "entry", "sums"])

    return sums


def fit_codebooks(vectors: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of kept vectors; what a round brings back is a number for each entry and position."""
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").toArrow()
    books = Codebooks.of_vectors(integers(first.column(0).combine_chunks(), width), parts)
    for _ in range(rounds):
        sums = vectors.select("embedding").mapInArrow(_sums(books, width), "part int, entry int, sums array<long>")
        each = sums.select("part", "entry", F.posexplode("sums").alias("at", "x")).groupBy("part", "entry", "at")
        found = {(r["part"], r["entry"], r["at"]): int(r["x"]) for r in each.agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()}  # of codebooks' size
        new = [p.copy() for p in books.parts]
        for (k, i, at), total in found.items():
            if at:
                new[k][i, at - 1] = total // found[(k, i, 0)]
        books = Codebooks(new)
    return books


def encode(vectors: DataFrame, books: Codebooks, width: int) -> DataFrame:
    """vec_id, label, code, error of kept vectors."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = books.assigned(integers(batch.column(2), width))
            data = np.stack([place for place, _ in found], axis=1).astype(np.uint8).tobytes().hex()
            step = 2 * len(found)
            codes = [data[i : i + step] for i in range(0, len(data), step)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(sum(d for _, d in found), pa.int64())], ["vec_id", "label", "code", "error"])

    plain = vectors.select("vec_id", "label", "embedding")
    return plain.mapInArrow(encoded, plain.drop("embedding").withColumns({"code": F.lit(""), "error": F.lit(0).cast("long")}).schema)


def decode(codes: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id and the vector that a code stands for."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(books.decoded(batch.column(1).to_pylist())), pa.list_(pa.float64()))], ["vec_id", "embedding"])

    plain = codes.select("vec_id", "code")
    return plain.mapInArrow(decoded, plain.select("vec_id", F.array(F.lit(0.0)).alias("embedding")).schema)


def code_report(vectors: DataFrame) -> DataFrame:
    """Per kept row: vec_id, code, error, label_error (all errors of its label) and codebooks_sha256."""
    prepare(vectors.sparkSession)
    some, width = kept(vectors)
    if width < 0:
        return some.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    books = fit_codebooks(some, width)
    coded = written(encode(some, books, width), "codes")
    sums = written(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "labels")
    few = F.broadcast(sums) if sums.count() <= MOST_LABELS else sums  # a row for each label
    joined = coded.join(few, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
