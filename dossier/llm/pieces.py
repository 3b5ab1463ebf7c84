"""SentencePiece encoding and decoding with N-best segmentation over the piece lattice.

The vocabulary and the order of its pieces come from a model file and are never trained.  A byte-pair model scores a piece
by its place in the order of merges, not by how likely it is: sums of such scores favour few merges.  So a piece's score
is the logarithm of its chance by the law of Zipf and Mandelbrot: minus the logarithm of its place plus `SHIFT`.  A segmentation's score is the sum of
its pieces' scores; a character without a piece is spelled in byte pieces, at ten below the least score.  Spaces
become the word mark and a text gets one in front; a mark that a text holds itself is spelled in bytes, so
decoding gives back every text exactly.

N-best: forward Viterbi scores of a lattice are the exact cost to its start, so a backward A* search guided by
them meets complete segmentations in order of score.  No piece has a mark after another character, so a lattice
falls apart at words: Viterbi runs over all distinct words of a batch at once, with the gap to each word's second
best; a text's N best differ from the best in the N-1 words with the smallest gaps alone, whose lattices A* visits.

Defined results: a null or empty text has no pieces, and its one segmentation is empty with score 0; repeated rows
and null doc_ids are encoded like any other; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rolling as R
from .shared import prepare

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK, OWN_MARK = 0x2581, 0x110000  # the word mark, and a mark that the text holds itself
SHIFT = 300
LONGEST = 32  # characters of words that are segmented together; longer ones are segmented one by one


@dataclass
class Vocabulary:
    """Pieces with scores, and the ids of byte pieces."""

    pieces: list[str]
    scores: list[float]
    special: list[bool]
    byte_ids: list[int]

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        odd = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in ids]
        given = [sp.get_score(i) for i in ids]
        ranks = {i: r for r, i in enumerate(sorted((i for i in ids if not odd[i]), key=lambda i: -given[i]), 1)}
        # Binary fractions, so that sums are exact and ties are ties.
        scores = [-round(1024 * math.log(ranks[i] + SHIFT)) / 1024 if i in ranks else 0.0 for i in ids]
        return cls([sp.id_to_piece(i) for i in ids], scores, odd, [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])

    @cached_property
    def ids(self) -> dict[tuple[int, ...], int]:
        return {tuple(map(ord, p)): i for i, p in enumerate(self.pieces) if not self.special[i]}

    @cached_property
    def unknown(self) -> float:
        return min(s for s, odd in zip(self.scores, self.special, strict=True) if not odd) - 10

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.ids))

    @cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hashes and scores of pieces, with two tables from hash bits to a piece (or to none)."""
        keys = list(self.ids)
        flat = np.array([c for k in keys for c in k], np.uint64)
        ends = np.cumsum([len(k) for k in keys])
        hashes = np.zeros(len(self.pieces) + 1, np.uint64)
        ids = np.array([self.ids[k] for k in keys])
        hashes[ids] = R.Ranges(R.mix(flat, 7)).of(np.r_[0, ends[:-1]], ends, 8)
        first, second = np.full(1 << 20, len(self.pieces), np.int32), np.full(1 << 20, len(self.pieces), np.int32)
        first[(hashes[ids] >> R.U64(44)).astype(np.int64)] = ids
        lost = ids[first[(hashes[ids] >> R.U64(44)).astype(np.int64)] != ids]
        second[(hashes[lost] & R.U64((1 << 20) - 1)).astype(np.int64)] = lost
        if (second[(hashes[lost] & R.U64((1 << 20) - 1)).astype(np.int64)] != lost).any():
            raise ValueError("pieces collide in both tables")
        return hashes, np.r_[np.array(self.scores, float), -np.inf], first, second

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece ids of hashes; the number of pieces where there is none."""
        hashes, _, first, second = self.table
        a = first[(h >> R.U64(44)).astype(np.int64)]
        miss = hashes[a] != h
        if miss.any():
            b = second[(h[miss] & R.U64((1 << 20) - 1)).astype(np.int64)]
            a = a.copy()
            a[miss] = np.where(hashes[b] == h[miss], b, len(self.pieces))
        return a


def symbols(text: str) -> np.ndarray:
    """Code points of the normalised text."""
    if not text:
        return np.zeros(0, np.uint32)
    x = np.frombuffer((" " + text).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    x[x == MARK] = OWN_MARK
    x[x == 0x20] = MARK
    return x


def spelled(vocabulary: Vocabulary, symbol: int) -> list[int]:
    return [vocabulary.byte_ids[b] for b in (chr(MARK) if symbol == OWN_MARK else chr(symbol)).encode("utf-8", "surrogatepass")]


def arcs(vocabulary: Vocabulary, x: tuple[int, ...]) -> list[list[tuple[int, float, int]]]:
    """Of each end, the arcs (start, score, piece id) of a word's lattice; id -1 is a character without a piece."""
    out: list[list[tuple[int, float, int]]] = [[] for _ in range(len(x) + 1)]
    for j in range(1, len(x) + 1):
        for i in range(max(0, j - vocabulary.longest), j):
            if (k := vocabulary.ids.get(x[i:j])) is not None:
                out[j].append((i, vocabulary.scores[k], k))
        if not any(i == j - 1 for i, _, _ in out[j]):
            out[j].append((j - 1, vocabulary.unknown, -1))
    return out


def n_best(vocabulary: Vocabulary, x: tuple[int, ...], n: int) -> list[tuple[float, list[int]]]:
    """The n best segmentations of a word: forward Viterbi, then backward A* with its scores as the heuristic."""
    lattice = arcs(vocabulary, x)
    ahead = [0.0] + [-np.inf] * len(x)
    for j in range(1, len(x) + 1):
        ahead[j] = max(ahead[i] + s for i, s, _ in lattice[j])
    # What a path loses to the best is summed arc by arc, and the best arc of each end loses exactly 0: with the place
    # nearest the start first among equals, a path that is begun is completed before others as good are looked at.
    heap: list[tuple[float, int, int, float, tuple | None]] = [(0.0, len(x), 0, 0.0, None)]
    out, order = [], 0
    while heap and len(out) < n:
        lost, at, _, behind, path = heapq.heappop(heap)
        if at == 0:
            ids: list[int] = []
            while path:
                (i, k), path = path
                ids += [k] if k >= 0 else spelled(vocabulary, x[i])
            out.append((behind, ids))
            continue
        for i, s, k in lattice[at]:
            order += 1
            heapq.heappush(heap, (lost + (ahead[at] - (ahead[i] + s)), i, order, s + behind, ((i, k), path)))
    return out


def decode(vocabulary: Vocabulary, ids: list[int]) -> str:
    """The text of piece ids."""
    out: list[bytes] = []
    byte_of = {k: b for b, k in enumerate(vocabulary.byte_ids)}
    for k in ids:
        b = byte_of.get(k)
        out.append(vocabulary.pieces[k].replace("▁", " ").encode() if b is None else bytes([b]))
    text = b"".join(out).decode("utf-8", "surrogatepass")
    return text[1:] if text.startswith(" ") else text


@dataclass
class Solved:
    """Words by hash, in order: best score, gap to the second best, number of pieces, and where their ids start in the pool."""

    hashes: np.ndarray
    best: np.ndarray
    gap: np.ndarray
    counts: np.ndarray
    base: np.ndarray
    pool: np.ndarray

    @classmethod
    def empty(cls) -> Solved:
        return cls(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))

    def with_words(self, hashes: np.ndarray, best: np.ndarray, gap: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> Solved:
        base = len(self.pool) + np.cumsum(counts) - counts
        every = [np.concatenate(x) for x in ((self.hashes, hashes), (self.best, best), (self.gap, gap), (self.counts, counts), (self.base, base))]
        order = np.argsort(every[0], kind="stable")
        return Solved(*(x[order] for x in every), np.concatenate([self.pool, ids.astype(np.int32)]))


class Encoder:
    """Segments batches of texts; solved words are kept, a bounded number of them."""

    def __init__(self, vocabulary: Vocabulary, n: int, kept: int = 20_000, most: int = 400_000):
        self.v, self.n, self.kept, self.most = vocabulary, n, kept, most
        self.solved = Solved.empty()
        self.seen: dict[tuple[int, ...], list[tuple[float, list[int]]]] = {}

    def words(self, x: tuple[int, ...]) -> list[tuple[float, list[int]]]:
        if x not in self.seen:
            if len(self.seen) >= self.kept:
                self.seen.clear()
            self.seen[x] = n_best(self.v, x, max(self.n, 2))
        return self.seen[x]

    def together(self, ranges: R.Ranges, flat: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Best score, gap to the second best, and ids (flat, with counts) of words of one size; ids below -1 are characters to spell."""
        v, n = self.v, len(starts)
        _, scores, _, _ = v.table
        ascii_ids = np.array(v.byte_ids[:128])
        ahead, back = np.full((size + 1, n), -np.inf), np.zeros((size + 1, n), np.int64)
        ahead[0] = 0
        found: dict[tuple[int, int], np.ndarray] = {}
        piece = np.zeros((size + 1, n), np.int64)
        for j in range(1, size + 1):
            for i in range(max(0, j - v.longest), j):
                k = v.find(ranges.of(starts + i, starts + j, 8))
                s = scores[k]
                if i == j - 1:
                    none = k == len(v.pieces)
                    s = np.where(none, v.unknown, s)
                    symbol = flat[starts + i].astype(np.int64)
                    k = np.where(none, np.where(symbol < 128, ascii_ids[np.minimum(symbol, 127)], -2 - symbol), k)
                if not np.isfinite(s).any():
                    continue
                found[i, j] = s
                better = ahead[i] + s > ahead[j]
                ahead[j][better] = (ahead[i] + s)[better]
                back[j][better], piece[j][better] = i, k[better]
        behind = np.full((size + 1, n), -np.inf)
        behind[size] = 0
        for j in range(size, 0, -1):
            for i in range(max(0, j - v.longest), j):
                if (i, j) in found:
                    np.maximum(behind[i], found[i, j] + behind[j], out=behind[i])
        on = np.zeros((size + 1, n), bool)
        at, rows = np.full(n, size), np.arange(n)
        ids = np.full((n, size), -1, np.int64)
        for step in range(size - 1, -1, -1):
            live = at > 0
            if not live.any():
                break
            on[at[live], rows[live]] = True
            ids[live, step] = piece[at[live], rows[live]]
            at[live] = back[at[live], rows[live]]
        second = np.full(n, -np.inf)
        for (i, j), s in found.items():
            total = ahead[i] + s + behind[j]
            total[on[j] & (back[j] == i)] = -np.inf
            np.maximum(second, total, out=second)
        best = ahead[size]
        have = ids != -1
        return best, best - second, ids[have], have.sum(axis=1)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, list[tuple[float, list[tuple[int, list[int]]]]], np.ndarray]]:
        """Of each text: ids of the best segmentation, the N best as (score, changed words with their ids), and where words' ids end."""
        parts = [symbols(t) for t in texts]
        flat = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        offsets = np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int64)
        mark = flat == MARK
        begins = mark & ~np.r_[False, mark[:-1]]
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(begins)
        ends = np.r_[starts[1:], len(flat)].astype(np.int64)
        first = np.searchsorted(starts, offsets)
        ranges = R.Ranges(R.mix(flat.astype(np.uint64), 7))
        hashes, where, which = np.unique(ranges.of(starts, ends, 8), return_index=True, return_inverse=True)
        table = self.solved
        new = where[~np.isin(hashes, table.hashes, assume_unique=True)]
        table = table.with_words(ranges.of(starts[new], ends[new], 8), *self.solve(ranges, flat, starts[new], ends[new]))
        which = np.searchsorted(table.hashes, hashes)[which]
        self.solved = table if len(table.hashes) <= self.most else Solved.empty()
        best, gap, counts, base, pool = table.best, table.gap, table.counts, table.base, table.pool
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            words = which[a:b]
            n = counts[words]
            ids = pool[np.repeat(base[words], n) + R.runs(n)]
            out.append((ids, self.alternatives(words, float(best[words].sum()), gap, flat, starts, ends, a), np.cumsum(n)))
        return out

    def solve(self, ranges: R.Ranges, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Best score, gap, number of pieces, and all ids in order, of words."""
        sizes, m = ends - starts, len(starts)
        best, gap, counts = np.zeros(m), np.full(m, np.inf), np.zeros(m, np.int64)
        pieces: list[np.ndarray] = [np.zeros(0, np.int64)]
        owner: list[np.ndarray] = [np.zeros(0, np.int64)]
        for size in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == size)
            if size <= LONGEST:
                best[own], gap[own], ids, n = self.together(ranges, flat, starts[own], size)
                if (ids < -1).any():
                    ids, n = self.spell(ids, n)
                counts[own] = n
                pieces.append(ids)
                owner.append(np.repeat(own, n))
                continue
            for w in own.tolist():
                two = self.words(tuple(flat[starts[w] : ends[w]].tolist()))
                best[w], gap[w] = two[0][0], two[0][0] - two[1][0] if len(two) > 1 else np.inf
                counts[w] = len(two[0][1])
                pieces.append(np.array(two[0][1], np.int64))
                owner.append(np.full(counts[w], w))
        return best, gap, counts, np.concatenate(pieces)[np.argsort(np.concatenate(owner), kind="stable")]

    def spell(self, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lists = [spelled(self.v, -2 - k) if k < -1 else [k] for k in ids.tolist()]
        owner = np.repeat(np.arange(len(n)), n)
        return np.array([k for x in lists for k in x], np.int64), np.bincount(owner, [len(x) for x in lists], len(n)).astype(np.int64)

    def alternatives(self, words: np.ndarray, score: float, gap: np.ndarray, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: int) -> list[tuple[float, list[tuple[int, list[int]]]]]:
        """The N best of a text, from the N-1 words with the smallest gaps (the earlier first)."""
        gaps = gap[words]
        few = min(self.n - 1, len(gaps))
        if few <= 0:
            return [(score, [])]
        near = np.flatnonzero(gaps <= np.partition(gaps, few - 1)[few - 1])
        near = near[np.lexsort((near, gaps[near]))][:few]
        lists = [(int(i), self.words(tuple(flat[starts[at + i] : ends[at + i]].tolist()))) for i in near if np.isfinite(gaps[i])]
        heap, seen, out = [(0.0, (0,) * len(lists))], {(0,) * len(lists)}, []
        while heap and len(out) < self.n:
            lost, choice = heapq.heappop(heap)
            out.append((score - lost, [(i, words_[c][1]) for c, (i, words_) in zip(choice, lists, strict=True) if c]))
            for d, (_, words_) in enumerate(lists):
                if choice[d] + 1 < len(words_):
                    further = (*choice[:d], choice[d] + 1, *choice[d + 1 :])
                    if further not in seen:
                        seen.add(further)
                        heapq.heappush(heap, (lost + words_[choice[d]][0] - words_[choice[d] + 1][0], further))
        return out


def whole(ids: np.ndarray, changed: list[tuple[int, list[int]]], ends: np.ndarray) -> np.ndarray:
    """All ids of a segmentation that differs from the best one in some words."""
    out, at = [], 0
    for word, own in sorted(changed):
        out += [ids[at : int(ends[word - 1]) if word else 0], np.array(own, ids.dtype)]
        at = int(ends[word])
    return np.concatenate([*out, ids[at:]])


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in arrays])], pa.int32()), pa.array(flat, pa.int32()))


def _encode(shared, n: int, column: int, digest: bool):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary: Vocabulary = shared.value
        encoder = Encoder(vocabulary, n)
        plain = [p.replace("▁", " ") for p in vocabulary.pieces]
        bytes_from, bytes_to = min(vocabulary.byte_ids), max(vocabulary.byte_ids)
        for batch in batches:
            name = batch.schema.names[column]
            for part, texts in R.slices(batch, name):
                texts = texts.to_pylist()
                done = encoder.encode(texts)
                ids = [x for x, _, _ in done]
                kinds = [pa.float64(), pa.list_(pa.float64())]
                score = [b[0][0] for _, b, _ in done]
                best = [[s for s, _ in b] for _, b, _ in done]
                back = []
                for x, text in zip(ids, texts, strict=True):
                    some = len(x) and ((x >= bytes_from) & (x <= bytes_to) & (x != bytes_from + 10)).any()
                    own = decode(vocabulary, x.tolist()) if some else "".join([plain[k] for k in x.tolist()]).replace(plain[bytes_from + 10], "\n")[1:]
                    back.append(own == text)
                count = pa.array([len(x) for x in ids], pa.int64())
                if digest:
                    last = [pa.array([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in ids], pa.string())]
                else:
                    every = [whole(x, changed, ends) for x, b, ends in done for _, changed in b]
                    ends = pa.array(np.r_[0, np.cumsum([len(b) for _, b, _ in done])], pa.int32())
                    last = [_lists(ids), pa.ListArray.from_arrays(ends, _lists(every))]
                keep = [part.column(i) for i in range(part.num_columns) if i != column]
                arrays = [*keep, count, pa.array(score, kinds[0]), pa.array(best, kinds[1]), pa.array(back, pa.bool_()), *last]
                names = [c for i, c in enumerate(batch.schema.names) if i != column]
                yield pa.RecordBatch.from_arrays(arrays, names=[*names, "n_pieces", "score", "nbest_scores", "round_trip", *(["ids_sha256"] if digest else ["ids", "nbest_ids"])])

    return encode


def encode_documents(docs: DataFrame, n: int = 3, model: str = MODEL, text: str = "text", digest: bool = False) -> DataFrame:
    """docs without their texts, with n_pieces, score, nbest_scores (of the n best), round_trip, ids and nbest_ids (or the ids' SHA-256, as little-endian int32).

    Columns of docs with one of these names give way to the new ones.
    """
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(Vocabulary.load(model))  # a vocabulary has a size of its own, whatever the data
    new = {"n_pieces": "long", "score": "double", "nbest_scores": "array<double>", "round_trip": "boolean"} | ({"ids_sha256": "string"} if digest else {"ids": "array<int>", "nbest_ids": "array<array<int>>"})
    docs = docs.select(*(c for c in docs.columns if c not in new))
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text]
    return docs.mapInArrow(_encode(shared, n, docs.schema.fieldNames().index(text), digest), ", ".join([*schema, *(f"{k} {v}" for k, v in new.items())]))


def decode_documents(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """encoded with its ids replaced by their text."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(model))
    where = encoded.schema.fieldNames().index("ids")
    schema = ", ".join(f"`{f.name}` {'string' if f.name == 'ids' else f.dataType.simpleString()}" for f in encoded.schema)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            columns[where] = pa.array([decode(shared.value, x or []) for x in columns[where].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return encoded.mapInArrow(texts, schema).withColumnRenamed("ids", "text")


def encode_report(docs: DataFrame, n: int = 3, model: str = MODEL) -> DataFrame:
    """Per document: doc_id, n_pieces, score, nbest_scores, round_trip and ids_sha256."""
    return encode_documents(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), n, model, digest=True)
