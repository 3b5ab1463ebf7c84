"""Lexical retrieval: substring scans, BM25 over phrases, and overlap windows as a fallback."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the ranking formula.
K1, B, LEAST_IDF, SHORTEST = 1.2, 0.75, 1e-6, 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def folded(c: Column) -> Column:
    """ASCII letters in lower case, all others as they are."""
    return F.translate(c, _UPPER, _LOWER)


def contains_folded(c: Column, needle: str) -> Column:
    return folded(c).contains(needle.translate(str.maketrans(_UPPER, _LOWER)))


def substring_scan(df: DataFrame, text: str, needle: str, order: str, limit: int) -> DataFrame:
    """The first rows in document order whose text has the needle."""
    return df.where(contains_folded(F.col(text), needle)).orderBy(order).limit(limit)


def occurrences(c: Column, phrase: str) -> Column:
    """Occurrences of a phrase, overlapping ones too."""
    return F.regexp_count(F.lower(c), F.lit(f"(?={re.escape(phrase.lower())})"))


def bm25(df: DataFrame, text: str, queries: dict[str, list[str]], keys: list[str]) -> DataFrame:
    """(query, keys, score) of rows that have a phrase of the query; statistics are those of all rows.

    One pass counts the rows, their lengths and, for each phrase, the rows that have it (one row to the driver); a second
    one scores those that have one.  Length is in trigrams.  Phrases shorter than one aren't in such an index: they find nothing.
    """
    phrases = sorted({p for ps in queries.values() for p in ps if len(p) >= SHORTEST})
    low = df.select(*keys, F.lower(text).alias("__low"), F.greatest(F.length(text) - 2, F.lit(0)).alias("__size"))
    has = lambda p: F.col("__low").contains(p.lower())
    stats = low.agg(F.count("*").alias("n"), F.avg("__size").alias("avg"), *(F.count_if(has(p)).alias(f"p{i}") for i, p in enumerate(phrases))).first()
    average, parts = float(stats["avg"] or 1.0), {}
    for i, p in enumerate(phrases):
        n, own = stats["n"], stats[f"p{i}"]
        idf = F.greatest(F.log(F.lit((n - own + 0.5) / (own + 0.5))), F.lit(LEAST_IDF))
        tf = F.when(has(p), F.regexp_count("__low", F.lit(f"(?={re.escape(p.lower())})"))).otherwise(0).cast("double")
        parts[p] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("__size") / average))
    some = low.where(reduce(or_, map(has, phrases), F.lit(False)))
    scored = some.select(*keys, F.explode(F.array(*(F.struct(F.lit(q).alias("query"), sum((parts[p] for p in ps if p in parts), F.lit(0.0)).alias("score")) for q, ps in queries.items()))).alias("s"))
    return scored.select("s.query", *keys, "s.score").where("score > 0")


def top_k(scored: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """The k best rows of each query, ties by key."""
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), *keys))
    return scored.withColumn("place", rank).where(F.col("place") <= k)


def windows(query: str, width: int = 6) -> list[str]:
    """Distinct windows of a query without white space, for the overlap fallback."""
    plain = re.sub(r"\s+", "", query)
    return list(dict.fromkeys(plain[i : i + width] for i in range(len(plain) - width + 1)))


def overlaps(df: DataFrame, queries: list[str], text: str, keys: list[str], width: int = 6) -> DataFrame:
    """(query, keys, score): how many distinct windows of a query a document has, white space aside; documents with none are left out.

    For queries that no document holds whole.  Windows of documents are joined with those of the queries by equality.
    """
    wanted = df.sparkSession.createDataFrame([(q, w) for q in dict.fromkeys(queries) for w in windows(q, width)], "query string, window string")
    plain = F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", "")
    own = df.select(*keys, F.explode(F.array_distinct(F.regexp_extract_all(plain, F.lit(f"(?s)(?=(.{{{width}}}))"), F.lit(1)))).alias("window"))
    return own.join(F.broadcast(wanted), "window").groupBy("query", *keys).agg(F.count("*").alias("score"))


def overlap_phrases(query: str, width: int = 6) -> list[str]:
    """A query's own windows that hold no white space."""
    return sorted({w for i in range(len(query) - width + 1) if not any(map(str.isspace, w := query[i : i + width]))})


def phrases_of(query: str) -> list[str]:
    """A query's words that an index of trigrams knows; the whole query where there is none."""
    return [w for w in query.split() if len(w) >= SHORTEST] or [query]


def dual_search(df: DataFrame, text: str, queries: list[str], keys: list[str], order: str, limit: int = 10, scope: Column | None = None, overlap: bool = False) -> DataFrame:
    """(query, keys, score, place): for each query the first rows that have it, by one of two channels.

    A query of fewer than three characters is a substring scan in document order, with score 0; a longer one is ranked by
    BM25 over its words, or with `overlap` over its own windows of six characters.  scope: rows that may be found;
    statistics are those of all rows.
    """
    queries = list(dict.fromkeys(q.strip() for q in queries))
    inside = F.lit(True) if scope is None else scope
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "__order", *keys))
    some = df.withColumn("__order", F.col(order)).withColumn("__in", inside)
    long = [q for q in queries if len(q) >= (6 if overlap else SHORTEST)]
    found = bm25(some, text, {q: overlap_phrases(q) if overlap else phrases_of(q) for q in long}, [*keys, "__order", "__in"]) if long else None
    short = [] if overlap else [q for q in queries if q and len(q) < SHORTEST]
    if short:
        each = F.explode(F.filter(F.array(*map(F.lit, short)), lambda q: folded(F.col(text)).contains(folded(q))))
        scans = some.select(each.alias("query"), *keys, "__order", "__in", F.lit(0.0).alias("score"))
        found = scans if found is None else found.unionByName(scans)
    if found is None:
        found = some.select(F.lit("").alias("query"), *keys, "__order", "__in", F.lit(0.0).alias("score")).where(F.lit(False))
    return found.where("__in").withColumn("place", rank).where(F.col("place") <= limit).select("query", *keys, "score", "place")


def first_winning(items: dict[str, list[str]], rounds: list[DataFrame]) -> DataFrame:
    """Rows of the first query, of the first round that finds any, for each item.  items: queries in order; rounds: results of dual_search, by layer and channel."""
    spark = rounds[0].sparkSession
    asked = spark.createDataFrame([(i, q.strip(), n) for i, qs in items.items() for n, q in enumerate(qs)], "item string, query string, turn int")
    every = reduce(DataFrame.unionByName, (r.withColumn("round", F.lit(n)) for n, r in enumerate(rounds)))
    hits = every.join(F.broadcast(asked), "query")  # as many rows as there are queries
    first = F.min(F.struct("round", "turn")).over(Window.partitionBy("item"))
    return hits.withColumn("__first", first).where((F.col("round") == F.col("__first.round")) & (F.col("turn") == F.col("__first.turn"))).drop("__first", "turn")


def grams(c: Column, gram: int) -> Column:
    """Hashes of all strings of so many characters in a text."""
    # A look-ahead steps through a text once, by whole characters; cutting out each gram by its place would start over each time.
    return F.transform(F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{gram}}}))."), F.lit(1)), lambda g: F.xxhash64(g))


def existence(quotes: DataFrame, corpus: DataFrame, quote: str, text: str, keys: list[str], gram: int = 6) -> DataFrame:
    """(keys, grams, found): how many distinct grams a quote has and how many of them the corpus has, by an equality join of hashed grams.

    A quote shorter than a gram has none.  keys have to be unique.
    """
    own = quotes.where(F.length(quote) >= gram).select(*keys, F.explode(F.array_distinct(grams(F.col(quote), gram))).alias("gram"))
    wanted = own.select("gram").distinct()
    there = corpus.where(F.length(text) >= gram).select(F.explode(grams(F.col(text), gram)).alias("gram")).join(wanted, "gram", "left_semi").distinct()
    found = own.join(there.withColumn("there", F.lit(1)), "gram", "left")
    return with_none(quotes, found.groupBy(*keys).agg(F.count("*").alias("grams"), F.count("there").alias("found")), keys)


def with_none(quotes: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of all quotes: 0 for those that have no gram."""
    return quotes.select(*keys).join(counts, keys, "left").fillna(0, ["grams", "found"])


def classified(quotes: DataFrame, quote: str, keys: list[str], whole: DataFrame, shares: DataFrame, gram: int, resolved: float, absent: float) -> DataFrame:
    """(keys, ratio, class) by the quotes that some text has as a whole, and the counts of grams of the others."""
    d = quotes.select(*keys, F.coalesce(F.col(quote), F.lit("")).alias("__q")).join(whole.withColumn("__whole", F.lit(True)), keys, "left").join(shares.select(*keys, (F.col("found") / F.nullif("grams", F.lit(0))).alias("__share")), keys, "left")
    ratio = F.when(F.col("__whole"), 1.0).when(F.length("__q") <= gram, 0.0).otherwise(F.coalesce("__share", F.lit(0.0)))
    label = F.when(F.col("ratio") >= resolved, "resolved").when(F.col("ratio") <= absent, "unresolved").otherwise("weak_match")
    return d.select(*keys, ratio.alias("ratio")).withColumn("class", label)


def held_whole(quotes: DataFrame, corpus: DataFrame, quote: str, text: str, keys: list[str], gram: int = 6) -> DataFrame:
    """(keys) of the quotes that some text contains.

    Texts that may contain a quote are found by its first gram (or by the whole of a shorter one), so there is a join of
    equal hashes for each length up to a gram, and none of all pairs.  Grams go with a hash of their text alone; a text is
    read again, once, where it has a gram that is looked for.
    """
    given = quotes.select(*keys, F.coalesce(F.col(quote), F.lit("")).alias("__q")).withColumn("__n", F.least(F.length("__q"), F.lit(gram)))
    texts = corpus.select(F.col(text).alias("__t"), F.xxhash64(text).alias("__of"))
    sizes = sorted(r[0] for r in given.select("__n").distinct().collect() if r[0])  # as many as a gram has characters
    held = []
    for n in sizes:
        first = given.where(F.col("__n") == n).withColumn("gram", F.xxhash64(F.substring("__q", 1, n)))
        places = texts.select("__of", F.explode(F.array_distinct(grams(F.col("__t"), n))).alias("gram"))
        some = places.join(first.select("gram").distinct(), "gram", "left_semi").distinct()
        asked = first.select(*keys, "__q", "gram").join(some, "gram").drop("gram")
        held.append(asked.join(texts, "__of").where(F.col("__t").contains(F.col("__q"))).select(*keys).distinct())
    return reduce(DataFrame.union, held) if held else given.select(*keys).where(F.lit(False))


def quote_classes(quotes: DataFrame, corpus: DataFrame, quote: str, text: str, keys: list[str], gram: int = 6, resolved: float = 0.65, absent: float = 0.3) -> DataFrame:
    """(keys, ratio, class) of every quote: 1 where a text contains it, else the share of its grams that texts have, 0 for one no longer than a gram."""
    whole = held_whole(quotes, corpus, quote, text, keys, gram)
    return classified(quotes, quote, keys, whole, existence(quotes, corpus, quote, text, keys, gram), gram, resolved, absent)


def layer_stats(chunks: DataFrame, layer: str, text: str) -> DataFrame:
    """Chunks, characters and the longest chunk of each layer."""
    return chunks.groupBy(layer).agg(F.count("*").alias("chunks"), F.sum(F.length(text)).alias("chars"), F.max(F.length(text)).alias("longest"))
