"""Secret scans: fixed patterns, and a battery of randomness tests with false-discovery control.

Tokens (runs of letters, digits, +, /, _, = and -) of at least `MIN_TOKEN` characters, the fixed patterns' own least,
are tested.  The null hypothesis is that a token is written language: a chain of characters, with the transitions of
letters in European languages and of kinds of characters in names and numbers, all fixed.  The alternative is a
uniform choice from an encoding's alphabet: digits, letters, hex, base32, base36, base62 or base64.  Under the null
the likelihood ratio of the two exceeds 1/p with a chance of p at most (Markov), whatever the token's length, so a
token's p-value depends on nothing but itself: short tokens and digits alone bear little evidence, long ones much.

Tokens that aren't language must also look random in the inferred alphabet: chi-squared of the characters against
uniformity, the number of runs above and below the alphabet's middle, and the serial correlation of neighbours each
give a p-value under randomness; where the least of them, times three, is under `UNIFORM`, the token counts as p = 1.

The Benjamini-Hochberg rule at level `fdr` over the tokens of a stratum of length sets the least evidence that is
reported.  What is gathered for that is a histogram of strata and steps of evidence, whose size doesn't depend on
the data.

Defined results: a null or empty text has no secrets; repeated rows and null doc_ids are scanned like any other;
an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rolling as R
from .shared import prepare, written

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
MIN_TOKEN = 6
_KEYS = ("password", "passwd", "secret", "token", "api_key", "apikey")

# Alphabets of encodings, in the order in which they are tried.
ALPHABETS = (
    ("digits", "0123456789"),
    ("letters", "abcdefghijklmnopqrstuvwxyz"),
    ("letters", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("hex", "0123456789abcdef"),
    ("hex", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("letters", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "+/0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "-0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz"),
    ("base64", "+-/0123456789=ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz"),
)
_SETS = [(name, frozenset(letters), {c: i for i, c in enumerate(letters)}) for name, letters in ALPHABETS]
#: Steps of the evidence, a quarter of a decade of p each, and the least score that counts as random.
STEPS = 200
UNIFORM = 0.001
#: Of each letter (a to z, a word each), -3 ln of the chances of the next letter, as a letter: means over eleven languages.
_NEXT = (
    "mlkjtplpkplhjfrlsgiglmosmo gpsvgrttglwgqthtzhmogysxju hwmrguvfiojlutfqxlqikyxzrm gtsnduqtfstosogqzmnqkrrwpp "
    "mojjlnmqlpmikfrnqfgjonqmop irtnhjquetvktsfpzhnjjzvwnw hqtpeumigxsloiinzhlnhwsytu fwtodwxrgqpnpphvzmrijvszqz "
    "klikilktqomjkfinrjhhrltrrn fptmdrrsitnqrngnvsmsgqsvtq fppsesnmgwnlrkhoymhjispypu frslfqppesphpoiqwulkjrvrlw "
    "ejrreusugzuokohizukqjtvxrv hskghnhphtnoplhsvshglnvzlq qmljojmpmrmjifnjvfijjmltsq fropgrqoizqirrgjygmkitvyks "
    "kqrtpuuuluuqsqpsqprnbtjuru gpmkfqmogqlnknhquljjlopzmn isjsfqrlgtlnqqiktsifjrszlp gursfrugfxpnqqhqzilkktoylq "
    "kjkljomtjpmjigolxghgopprqp ftrtcuuygzxssrhtznptntxwsz etrogupjfwrnrlgqzmmunyptmu imhpgnsngwppmtmgxqpeournko "
    "gpkpkropkpnmikehzjihlspwoq eoooesonfqrnnojpqqqpjsnsmn "
).split()
#: Chances of the kind of the next character (lower, upper, digit, other), by that of the one before or of none.
_KIND = {"": (0.5, 0.2, 0.2, 0.1), "lower": (0.9, 0.02, 0.02, 0.06), "upper": (0.3, 0.6, 0.04, 0.06), "digit": (0.04, 0.03, 0.85, 0.08), "other": (0.35, 0.2, 0.25, 0.2)}
_LOWER, _UPPER, _DIGIT, _OTHER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "+/_=-"


def _chain() -> tuple[np.ndarray, np.ndarray]:
    """Log chances of a token's first byte, and of each byte after another."""
    kinds = (_LOWER, _UPPER, _DIGIT, _OTHER)
    letters = np.exp(-(np.array([[ord(c) - 97 for c in r] for r in _NEXT]) / 3))
    letters = 0.73 * letters / letters.sum(axis=1, keepdims=True) + 0.25 / 26 + 0.02 * np.eye(26)
    first, after = np.full(256, -np.inf), np.zeros((256, 256))
    for to, chance in zip(kinds, _KIND[""], strict=True):
        first[[ord(c) for c in to]] = math.log(chance / len(to))
    for own, name in zip(kinds, ("lower", "upper", "digit", "other"), strict=True):
        for to, chance in zip(kinds, _KIND[name], strict=True):
            inner = letters if len(own) == len(to) == 26 and (own == to or own is _UPPER) else np.full((len(own), len(to)), 1 / len(to))
            inner = 0.25 * inner + 0.75 * np.eye(len(to)) if own is to is _OTHER else inner
            after[np.ix_([ord(c) for c in own], [ord(c) for c in to])] = np.log(chance * inner)
    return first, after.ravel()


_FIRST, _AFTER = _chain()
_INSIDE = np.isfinite(_FIRST)
#: Bits of characters that alphabets tell apart, and of each set of bits the log of the smallest alphabet's size.
_PARTS = ("0189", "234567", "abcdef", _LOWER[6:], "ABCDEF", _UPPER[6:], "+/", "-_")
_BITS = np.zeros(256, np.uint8)
for _i, _part in enumerate(_PARTS):
    _BITS[[ord(_c) for _c in _part]] = 1 << _i
_SIZE = np.log([min(len(a) for _, a in ALPHABETS if all(set(p) <= set(a) for i, p in enumerate(_PARTS) if bits >> i & 1)) for bits in range(256)])


def _normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def randomness(token: str, letters_apart: bool = False) -> tuple[str, float]:
    """Inferred encoding and score (a p-value under randomness) of a token; letters alone are base36 unless they are set apart."""
    token = token.strip("=") or token  # padding
    letters = set(token)
    name, _, place = next((s for s in _SETS if letters <= s[1] and (letters_apart or s[0] != "letters")), _SETS[-1])
    x, m, n = np.array([place[c] for c in token]), len(place), len(token)
    counts = np.bincount(x, minlength=m)
    chi = float(((counts - n / m) ** 2).sum() * m / n)
    k = m - 1  # Wilson and Hilferty: the cube root of chi-squared over its degrees is near normal
    z = ((chi / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    uniform = 0.5 * math.erfc(z / math.sqrt(2))
    above = x * 2 >= m
    p = (m - -(-m // 2)) / m
    runs = 1 + int((above[1:] != above[:-1]).sum())
    q = 2 * p * (1 - p)
    ran = _normal_tail((runs - 1 - (n - 1) * q) / math.sqrt(max((n - 1) * q * (1 - q), 1e-9)))
    spread = float(((x - x.mean()) ** 2).sum())
    serial = float(((x[1:] - x.mean()) * (x[:-1] - x.mean())).sum()) / spread if spread else 1.0
    correlated = _normal_tail((serial + 1 / n) * math.sqrt(n))
    return name, min(1.0, 3 * min(uniform, ran, correlated))


def evidence(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, strata and steps of evidence against language of all tokens in texts' bytes."""
    inside = _INSIDE[buf]
    before, behind = np.r_[False, inside[:-1]], np.r_[inside[1:], False]
    edges = offsets[(offsets > 0) & (offsets < len(buf))]
    before[edges] = behind[edges - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~behind) + 1
    long = ends - starts >= MIN_TOKEN
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return starts, ends, starts, starts
    sums = np.r_[0.0, np.cumsum(_AFTER[buf[:-1].astype(np.int64) * 256 + buf[1:]])]
    language = _FIRST[buf[starts]] + sums[ends - 1] - sums[starts]
    bits = np.bitwise_or.reduceat(np.r_[_BITS[buf], np.uint8(0)], np.stack([starts, ends], axis=1).ravel())[::2]
    n = ends - starts
    log_p = language + n * _SIZE[bits] + math.log(len(ALPHABETS))
    steps = np.clip(np.floor(-4 / math.log(10) * log_p), 0, STEPS).astype(np.int64)
    return starts, ends, np.minimum(40, (2 * np.log2(n)).astype(np.int64)), steps


def _tokens(texts: pa.Array) -> tuple[list[list[dict]], list[dict[int, int]]]:
    """Of each text, the tokens with some evidence, and how many tokens were tested of each stratum."""
    buf, offsets = R.flat(texts)
    starts, ends, strata, steps = evidence(buf, offsets)
    owner = np.searchsorted(offsets, starts, "right") - 1
    keys, counts = np.unique(owner * 64 + strata, return_counts=True)
    found: list[list[dict]] = [[] for _ in range(len(texts))]
    tested: list[dict[int, int]] = [{} for _ in range(len(texts))]
    for k, c in zip(keys.tolist(), counts.tolist(), strict=True):
        tested[k // 64][k % 64] = c
    at, place = -1, np.zeros(0, np.int64)
    for t in np.flatnonzero(steps).tolist():
        d, a, b = int(owner[t]), int(starts[t]), int(ends[t])
        name, score = randomness(buf[a:b].tobytes().decode(), True)
        if score < UNIFORM:
            continue
        if d != at:
            at, place = d, np.cumsum((buf[offsets[d] : offsets[d + 1]] & 0xC0) != 0x80) - 1  # characters before each byte
        a = int(place[a - offsets[d]])
        found[d].append({"from": a, "to": a + int(ends[t] - starts[t]), "kind": name, "stratum": int(strata[t]), "step": int(steps[t])})
    return found, tested


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind as a number, end) of the fixed patterns."""
    out: list[tuple[int, int, int]] = []
    low = text.lower()
    if any(k in low for k in _KEYS) or not text.isascii():
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end() - m.start(1) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


_FOUND = "array<struct<from: int, to: int, kind: string, stratum: int, step: int>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32()), ("kind", pa.string()), ("stratum", pa.int32()), ("step", pa.int32())]))
    for batch in batches:
        for part, texts in R.slices(batch):
            base = [[{"from": s, "to": e, "kind": KINDS[k]} for s, k, e in base_spans(text)] for text in texts.to_pylist()]
            tokens, tested = _tokens(texts)
            span = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32()), ("kind", pa.string())]))
            tests = pa.list_(pa.struct([("stratum", pa.int32()), ("n", pa.int64())]))
            numbers = [[{"stratum": s, "n": n} for s, n in own.items()] for own in tested]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(base, span), pa.array(tokens, found), pa.array(numbers, tests)], ["doc_id", "base", "tokens", "tested"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of tokens of a task by stratum and step; step -1 has all that were tested."""
    total: Counter = Counter()
    for batch in batches:
        for _, texts in R.slices(batch):
            tokens, tested = _tokens(texts)
            for own in tested:
                for s, n in own.items():
                    total[s, -1] += n
            total.update((t["stratum"], t["step"]) for own in tokens for t in own)
    rows = [(s, k, n) for (s, k), n in total.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64())], ["stratum", "step", "n"])


def least_steps(counts: list[tuple[int, int, int]], fdr: float) -> dict[int, int]:
    """Of each stratum, the least step that is reported, by Benjamini and Hochberg over counts of (stratum, step, n); step -1 counts all tests."""
    tests: dict[int, int] = {}
    own: dict[int, np.ndarray] = {}
    for s, step, n in counts:
        if step < 0:
            tests[s] = n
        else:
            own.setdefault(s, np.zeros(STEPS + 1))[step] += n
    out = {}
    p = 10.0 ** (-np.arange(STEPS + 1) / 4)
    for s, found in own.items():
        rejected = np.cumsum(found[::-1])[::-1]
        good = np.flatnonzero((found > 0) & (p * tests[s] <= fdr * rejected))
        if len(good):
            out[s] = int(good[0])
    return out


def secret_spans(docs: DataFrame, fdr: float = 0.05) -> DataFrame:
    """Per document: doc_id, base spans and spans added by the tests, both as arrays of (from, to, kind)."""
    spark = docs.sparkSession
    prepare(spark)
    kinds = "array<struct<from: int, to: int, kind: string>>"
    scanned = written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scan, f"doc_id long, base {kinds}, tokens {_FOUND}, tested array<struct<stratum: int, n: bigint>>"), "secrets")
    tested = scanned.select(F.explode("tested").alias("t")).select("t.stratum", F.lit(-1).alias("step"), "t.n")
    each = tested.union(scanned.select(F.explode("tokens").alias("t")).select("t.stratum", "t.step", F.lit(1).cast("long").alias("n")))
    counts = each.groupBy("stratum", "step").agg(F.sum("n")).collect()  # 41 strata of 202 steps at most
    least = least_steps([tuple(r) for r in counts], fdr)
    limit = F.create_map(*(F.lit(x) for kv in least.items() for x in kv)) if least else F.create_map().cast("map<int,int>")
    apart = lambda t: ~F.exists("base", lambda b: (b["from"] < t["to"]) & (t["from"] < b["to"]))
    added = F.filter("tokens", lambda t: F.coalesce(t["step"] >= F.try_element_at(limit, t["stratum"]), F.lit(False)) & apart(t))
    return scanned.select("doc_id", "base", F.transform(added, lambda t: F.struct(t["from"].alias("from"), t["to"].alias("to"), t["kind"].alias("kind"))).alias("added"))


def joined(spans, order: tuple[str, ...]):
    """kind:start:end of spans by start, then kind as listed, comma-joined."""
    rank = F.create_map(*(F.lit(x) for i, k in enumerate(order) for x in (k, i)))
    keyed = F.transform(spans, lambda s: F.struct(s["from"].alias("f"), F.coalesce(F.try_element_at(rank, s["kind"]), F.lit(99)).alias("r"), s["kind"].alias("k"), s["to"].alias("t")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["k"], s["f"].cast("string"), s["t"].cast("string"))), ",")


def secret_report(docs: DataFrame, fdr: float = 0.05) -> DataFrame:
    """Per document: doc_id, counts and digest of the fixed patterns, and all spans as text."""
    found = secret_spans(docs, fdr)
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    random = F.transform("added", lambda s: s.withField("kind", F.concat(F.lit("random_"), s["kind"])))
    return found.select("doc_id", *map(n, KINDS), F.sha2(joined(F.col("base"), KINDS), 256).alias("base_sha256"), joined(F.concat("base", random), KINDS).alias("spans"))


MASK = "[secret]"


def _mask(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for text, own in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
        last = None
        for s in sorted(own or [], key=lambda s: -s["to"]):
            a, b = s["from"], s["to"] if last is None else min(s["to"], last)
            if a < b:
                text, last = text[:a] + MASK + text[b:], a
        out.append(text)
    return pa.array(out, texts.type)


def mask_secrets(docs: DataFrame, fdr: float = 0.05) -> DataFrame:
    """docs with every secret replaced by a mask; all rows and columns stay.

    Texts are scanned again where they are, so nothing but the histogram is shuffled; the mask is set for the
    spans that secret_spans finds.
    """
    spark = docs.sparkSession
    prepare(spark)
    counts = docs.select("text").mapInArrow(_count, "stratum int, step int, n long").groupBy("stratum", "step").agg(F.sum("n")).collect()
    least = least_steps([tuple(r) for r in counts], fdr)
    where = docs.schema.fieldNames().index("text")

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in R.slices(batch):
                spans = [[{"from": s, "to": e} for s, _, e in base_spans(text)] for text in texts.to_pylist()]
                for own, tokens in zip(spans, _tokens(texts)[0], strict=True):
                    own += [{"from": t["from"], "to": t["to"]} for t in tokens if t["step"] >= least.get(t["stratum"], STEPS + 1)]
                columns = list(part.columns)
                if any(spans):
                    columns[where] = _mask(columns[where], pa.array(spans, pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))))
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(mask, docs.schema)
