"""Quality rules by distribution divergence, with DataFrame operations only.

A document's histograms of character classes and of its language's common words are compared with references,
the histograms of all documents of that language, by Jensen-Shannon distance (base 2, 0 to 1).  Documents that
are too short for a histogram to say anything aren't judged by it.  Base rules: at least ten words, and at most
a fifth of the words in five-word windows that the text repeats.

One pass counts the references (a few rows, however large the input), one more judges each document by itself;
nothing but those counts is shuffled.

Defined results: a null text has no words and fails the base rules; a null or unknown language is compared with
the character classes of all documents, and not by words; repeated rows and null doc_ids are judged like any
other; extra columns are ignored by the report and kept by the filter; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh

# Common words of each language.
COMMON = {
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "des", "auf", "ist"],
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "on", "was"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por"],
    "fr": ["de", "la", "le", "les", "et", "des", "un", "en", "que", "est", "une", "pour"],
}
WINDOW = 5
_SPACES = r"[\x20\x09-\x0D]+"
#: Character classes in the order in which they are taken out of a text; what is left are symbols.
_CLASSES = [("lower", "[a-z]+"), ("space", _SPACES), ("upper", "[A-Z]+"), ("digit", "[0-9]+"), ("other", r"[^\x00-\x7F]+"), ("stop", r"[.,;:!?'\"()-]+")]

#: Least characters and words for a histogram to count, and the largest distances of a document that is kept.
MIN_CHARS, MIN_WORDS, MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 200, 120, 0.32, 0.30


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, _SPACES), "")


def _common(words: Column, lang: Column) -> Column:
    """Counts of the language's common words, and of all other words."""
    lists = F.create_map(*(x for k, v in COMMON.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    own = F.coalesce(F.try_element_at(lists, F.coalesce(lang, F.lit(""))), F.array().cast("array<string>"))
    padded = F.lower(F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" ")))
    each = let(padded, lambda t: F.transform(own, lambda w: (F.octet_length(t) - F.octet_length(F.replace(t, F.concat(F.lit(" "), w, F.lit(" ")), F.lit("")))) / (F.octet_length(w) + 2)))
    return let(each, lambda xs: F.concat(xs, F.array(F.size(words) - F.aggregate(xs, F.lit(0.0), lambda a, b: a + b))))


def _classes(text: Column, body: Callable[[Column, Column], Column], at: int = 0, counts: tuple[Column, ...] = ()) -> Column:
    """body of the counts of character classes and of what is left of a text: each class is taken out of the text in turn, once."""
    if at == len(_CLASSES):
        return body(F.array(*counts, F.length(text)), text)
    less = F.regexp_replace(text, _CLASSES[at][1], "")
    return let(less, lambda t: _classes(t, body, at + 1, (*counts, F.length(text) - F.length(t))))


def histograms(text: Column, lang: Column, more: Callable[[Column, Column, Column], list[Column]] = lambda text, words, left: []) -> Column:
    """Struct of chars (by class) and common (words), and of what `more` makes of text, words and what is left of the text.

    One nested expression, so that a filter on it can be pushed below projections without being computed twice.
    """

    def of(t: Column) -> Column:
        return let(_words(t), lambda w: _classes(t, lambda chars, left: F.struct(chars.alias("chars"), _common(w, lang).alias("common"), *more(t, w, left))))

    return let(F.coalesce(text, F.lit("")), of)


def references(docs: DataFrame) -> tuple[dict[str, list[float]], dict[str, list[float]], list[float]]:
    """Shares of character classes and of common words for each listed language, and of character classes in all."""
    some = docs.select("lang", histograms(F.col("text"), F.col("lang")).alias("q")).select("lang", "q.chars", "q.common")
    known = F.when(F.col("lang").isin(*COMMON), F.col("lang")).otherwise("")
    n, m = len(_CLASSES) + 1, len(next(iter(COMMON.values()))) + 1
    sums = [F.sum(F.get("chars", F.lit(i))).alias(f"c{i}") for i in range(n)] + [F.sum(F.get("common", F.lit(i))).alias(f"w{i}") for i in range(m)]
    rows = some.groupBy(known.alias("lang")).agg(*sums).collect()  # five rows at most
    share = lambda xs: [x / (sum(xs) or 1) for x in xs]
    chars = {r["lang"]: [float(r[f"c{i}"] or 0) for i in range(n)] for r in rows}
    words = {r["lang"]: share([float(r[f"w{i}"] or 0) for i in range(m)]) for r in rows if r["lang"]}
    every = share([sum(x[i] for x in chars.values()) for i in range(n)])
    return {k: share(v) for k, v in chars.items() if k}, words, every


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence of two histograms with sum 1, base 2."""
    half = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(F.zip_with(p, q, lambda a, b: (half(a, b) + half(b, a)) / 2), F.lit(0.0), lambda x, y: x + y)))


def repeated_words(words: Column, k: int = WINDOW) -> Column:
    """Words within windows of k words that occur twice or more in the list."""

    def places(h: Column) -> Column:
        pairs = F.array_sort(F.zip_with(h, F.sequence(F.lit(0), F.size(h) - 1), lambda a, i: F.struct(a.alias("h"), i.alias("i"))))

        def twice(z: Column) -> Column:
            same = lambda i, j: F.coalesce(F.get(z, i)["h"] == F.get(z, j)["h"], F.lit(False))
            return F.transform(F.filter(F.sequence(F.lit(0), F.size(z) - 1), lambda i: same(i, i - 1) | same(i, i + 1)), lambda i: F.get(z, i)["i"])

        return F.sort_array(let(pairs, twice))

    def union(at: Column) -> Column:
        start = F.struct(F.lit(-k).alias("last"), F.lit(0).alias("n"))
        step = lambda acc, x: F.struct(x.alias("last"), (acc["n"] + F.least(F.lit(k), x - acc["last"])).alias("n"))
        return F.aggregate(at, start, step, lambda acc: acc["n"])

    hashes = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.xxhash64(F.slice(w, i, k)))
    count = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(union(places(h)))
    return let(words, lambda w: F.when(F.size(w) < k, F.lit(0)).otherwise(let(hashes(w), count)))


def _judged(docs: DataFrame, name: str = "__q") -> DataFrame:
    chars, words, every = references(docs)
    array = lambda xs: F.array(*(F.lit(float(x)) for x in xs))
    table = lambda d: F.create_map(*(x for k, v in d.items() for x in (F.lit(k), array(v)))) if d else F.create_map().cast("map<string,array<double>>")
    lang = F.coalesce("lang", F.lit(""))
    share = lambda xs: F.transform(xs, lambda x: x / F.greatest(F.aggregate(xs, F.lit(0.0), lambda a, b: a + b), F.lit(1.0)))

    def counted(text: Column, words: Column, left: Column) -> list[Column]:
        lines = let(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.size(x) - F.size(F.array_distinct(x)))
        symbols = F.length(left) - F.length(F.regexp_replace(left, r"[#*$%&|<>]+", ""))
        return [F.length(text).alias("length"), F.size(words).alias("n"), symbols.alias("symbols"), lines.alias("lines"), repeated_words(words).alias("repeats")]

    def judge(q: Column) -> Column:
        char = js_distance(share(q["chars"]), F.coalesce(F.try_element_at(table(chars), lang), array(every)))
        word = js_distance(share(q["common"]), F.try_element_at(table(words), lang))
        failed = (q["n"] < 10) | (100 * q["repeats"] > 20 * q["n"])

        def verdict(d: Column) -> Column:
            odd = ((q["length"] >= MIN_CHARS) & (d["char"] > MAX_CHAR_DISTANCE)) | ((q["n"] >= MIN_WORDS) & F.coalesce(d["word"] > MAX_WORD_DISTANCE, F.lit(False)))
            letters = q["length"] - F.get(q["chars"], F.lit(1))
            return F.struct(q["n"].alias("n"), letters.alias("letters"), q["symbols"].alias("symbols"), q["lines"].alias("lines"), q["repeats"].alias("repeats"), failed.alias("failed"), (~failed & ~odd).alias("kept"), d["char"].alias("char"), d["word"].alias("word"))

        return let(F.struct(char.alias("char"), word.alias("word")), verdict)

    return docs.withColumn(name, let(histograms(F.col("text"), F.col("lang"), counted), judge))


def quality_report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, the base counts, base_failed, kept, and both distances (rounded)."""
    count = lambda name, to: F.col(f"__q.{name}").cast("long").alias(to)
    return _judged(docs.select("doc_id", "text", "lang")).select(
        "doc_id", count("n", "n_words"), count("letters", "word_chars"), count("symbols", "n_symbols"), count("lines", "n_dup_lines"), count("repeats", "n_repeat_words"),
        F.col("__q.failed").alias("base_failed"), F.col("__q.kept").alias("kept"), F.round("__q.char", 6).alias("char_distance"), F.round("__q.word", 6).alias("word_distance"),
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """docs without those that the rules reject; all columns stay as they are."""
    name = fresh(docs, "__q")
    return _judged(docs, name).where(F.col(name)["kept"]).select(*docs.columns)
