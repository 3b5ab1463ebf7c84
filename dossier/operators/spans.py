"""Parts of a draft that reviews need: chapters by key words, even shares of a budget, cuts at page anchors."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .drafts import ANCHOR, FILE_HEAD, heading_level

# Words of the chapters that reviews rest on, and the lines around one where there are no headings.
KEY_WORDS = ("评标办法", "评分标准", "评分细则", "评审办法", "评审方法", "评审程序", "资格审查", "资格评审", "资格要求", "初步评审", "符合性审查", "响应性审查", "废标", "否决")
BEFORE, AFTER, PREFACE = 40, 81, 120
CUT = "\n...[章节中间内容省略，章节首尾保留]...\n"
CUT_UNANCHORED = "\n...[章节中间内容省略，章节首尾保留；本文件无页锚，按字符切]...\n"
_SPANS = "array<struct<start: int, stop: int>>"


def let(value: Column, body) -> Column:
    """What body makes of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def is_key(line: Column) -> Column:
    return reduce(or_, (line.contains(w) for w in KEY_WORDS))


def _span(start: Column, stop: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), stop.cast("int").alias("stop"))


def headings(lines: Column) -> Column:
    """array<struct<at, level, key>> of the lines that are headings; a file's head line is none."""
    each = F.transform(lines, lambda x, i: F.struct(i.alias("at"), F.when(~F.trim(x).rlike(FILE_HEAD), heading_level(x)).alias("level"), is_key(x).alias("key")))
    return F.filter(each, lambda h: h["level"].isNotNull())


def united(spans: Column) -> Column:
    """Spans in order, those that touch or overlap as one."""

    def step(done: Column, s: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(_span(last["start"], F.greatest(last["stop"], s["stop"]))))
        return F.when((F.size(done) > 0) & (s["start"] <= last["stop"]), joined).otherwise(F.array_append(done, _span(s["start"], s["stop"])))

    return F.aggregate(F.array_sort(spans), F.array().cast(_SPANS), step)


def chapters(lines: Column) -> Column:
    """Spans of the headings with a key word, each up to the next heading of the same or a higher level.

    Headings are gone through from the last to the first; for each level it is remembered where the next one begins.
    """
    n = F.size(lines)
    start = F.struct(n.alias("n1"), n.alias("n2"), n.alias("n3"), F.array().cast(_SPANS).alias("out"))

    def step(acc: Column, h: Column) -> Column:
        stop = F.least(*(F.when(F.lit(k) <= h["level"], acc[f"n{k}"]).otherwise(n) for k in (1, 2, 3)))
        nexts = [F.when(h["level"] == k, h["at"]).otherwise(acc[f"n{k}"]).alias(f"n{k}") for k in (1, 2, 3)]
        return F.struct(*nexts, F.when(h["key"], F.array_append(acc["out"], _span(h["at"], stop))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(F.reverse(headings(lines)), start, step, lambda acc: acc["out"])


def review_spans(lines: Column) -> Column:
    """array<struct<start, stop>>: lines [start, stop) of the chapters by key words; where there is none, the lines around key words."""

    def of(own: Column) -> Column:
        hits = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("at"), is_key(x).alias("key"))), lambda h: h["key"])
        windows = F.transform(hits, lambda h: _span(F.greatest(h["at"] - BEFORE, F.lit(0)), F.least(h["at"] + AFTER, F.size(lines))))
        return united(F.when(F.size(own) > 0, own).otherwise(windows))

    return let(chapters(lines), of)


def even(sizes: Column, left: Column) -> Column:
    """array<long>: each size in turn gets at most an even part, rounded down, of what is left for it and those after it."""
    start = F.struct(left.cast("long").alias("left"), F.size(sizes).cast("long").alias("n"), F.array().cast("array<bigint>").alias("out"))

    def step(acc: Column, size: Column) -> Column:
        got = F.least(size.cast("long"), F.call_function("div", acc["left"], acc["n"]))
        return F.struct((acc["left"] - got).alias("left"), (acc["n"] - 1).alias("n"), F.array_append(acc["out"], got).alias("out"))

    return F.aggregate(sizes, start, step, lambda acc: acc["out"])


def anchors(text: Column) -> Column:
    """array<struct<pos, line>>: where lines begin that are page anchors."""
    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<pos: int, line: string>>").alias("out"))

    def step(acc: Column, line: Column) -> Column:
        here = F.struct(acc["pos"].alias("pos"), line.alias("line"))
        return F.struct((acc["pos"] + F.length(line) + 1).alias("pos"), F.when(F.trim(line).rlike(ANCHOR), F.array_append(acc["out"], here)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(F.split(text, "\n"), start, step, lambda acc: acc["out"])


def head_tail(text: Column, head: Column, tail: Column) -> Column:
    """struct<head, tail, replay>: the first `head` and the last `tail` characters, cut where a page begins, or else where a line does.

    replay: the anchor of the tail's page where the tail doesn't begin with one; it counts towards the tail.
    """
    size = F.length(text)

    def back(limit: Column, marks: Column) -> Column:
        before = F.substring(text, F.lit(1), limit.cast("int"))
        newline = F.instr(F.reverse(before), "\n")
        return F.coalesce(F.array_max(F.transform(F.filter(marks, lambda m: m["pos"] <= limit), lambda m: m["pos"])), F.when(newline > 0, limit - newline + 1).otherwise(limit))

    def located(cut: Column, marks: Column, budget: Column) -> Column:
        start = F.greatest(size - budget, F.lit(0))
        newline = F.locate("\n", F.substring(text, start + 1, size))
        forward = F.coalesce(F.array_min(F.transform(F.filter(marks, lambda m: m["pos"] >= start), lambda m: m["pos"])), F.when(newline > 0, start + newline).otherwise(start))

        def of(at: Column) -> Column:
            before = F.filter(marks, lambda m: m["pos"] < at)
            replay = F.when(~F.exists(marks, lambda m: m["pos"] == at), F.get(before, F.size(before) - 1)["line"])
            return F.struct(at.alias("at"), replay.alias("replay"))

        return let(F.greatest(cut, forward), of)

    def of(marks: Column) -> Column:
        def cut_at(cut: Column) -> Column:
            def last(first: Column, second: Column) -> Column:
                over = size - second["at"] + F.coalesce(F.length(second["replay"]) + 1, F.lit(0)) > tail
                none = (tail <= 0) | (first["replay"].isNotNull() & (tail - F.length(first["replay"]) - 1 <= 0))
                rest = F.when(none, "").otherwise(F.substring(text, second["at"] + 1, size))
                return F.struct(F.substring(text, F.lit(1), cut).alias("head"), rest.alias("tail"), F.when(~none & ~over, second["replay"]).alias("replay"))

            def again(first: Column) -> Column:
                less = tail - F.coalesce(F.length(first["replay"]) + 1, F.lit(0))
                return let(located(cut, marks, less), lambda second: last(first, second))

            return let(located(cut, marks, tail), again)

        return let(F.when(head > 0, back(head, marks)).otherwise(F.lit(0)).cast("int"), cut_at)

    return let(anchors(text), of)


def trimmed(text: Column, limit: Column) -> Column:
    """A part that is cut to so many characters: two thirds from its head, a third from its tail, and a mark between that says so."""

    def cut(mark: Column) -> Column:
        body = limit - F.length(mark)
        first = F.floor(body * 2 / 3).cast("int")
        return F.when(body <= 0, F.substring(text, F.lit(1), limit.cast("int"))).otherwise(
            let(head_tail(text, first, (body - first).cast("int")), lambda x: F.concat(x["head"], mark, F.when(x["replay"].isNotNull(), F.concat(x["replay"], F.lit("\n"))).otherwise(""), x["tail"]))
        )

    whole = F.when(F.size(anchors(text)) > 0, CUT).otherwise(CUT_UNANCHORED)
    return F.when(F.length(text) <= limit, text).when(limit <= 0, "").otherwise(let(whole, cut))


def first_pass(text: Column, budget: int) -> Column:
    """The preface and the review's chapters of a draft, within so many characters; null where the draft itself is.

    The preface gets a fifth at most, and no more than its even part; chapters share the rest evenly, each trimmed by itself.
    """
    joined = lambda parts: F.array_join(F.filter(parts, lambda p: p != ""), "\n\n")

    def of(lines: Column, spans: Column) -> Column:
        part = lambda a, b: F.array_join(F.slice(lines, a + 1, F.greatest(b - a, F.lit(0))), "\n")
        anchored = lambda s: F.when((s["start"] > 0) & F.trim(F.get(lines, s["start"] - 1)).rlike(ANCHOR), s["start"] - 1).otherwise(s["start"])
        first = F.get(headings(lines), F.lit(0))["at"]
        preface = F.coalesce(first, F.least(anchored(F.get(spans, F.lit(0))), F.lit(PREFACE)))
        parts = F.struct(part(F.lit(0), preface).alias("preface"), F.transform(spans, lambda s: part(anchored(s), s["stop"])).alias("sections"))
        return F.when(F.size(spans) == 0, trimmed(text, F.lit(budget))).otherwise(let(parts, fitted))

    def fitted(x: Column) -> Column:
        full = joined(F.concat(F.array(x["preface"]), x["sections"]))
        n = F.size(x["sections"]) + 1
        room = F.greatest(budget - 2 * (n - 1), F.lit(0))
        own = F.least(F.length(x["preface"]), F.floor(room / F.greatest(n, F.lit(5))).cast("int"))
        shares = even(F.transform(x["sections"], lambda s: F.length(s)), room - own)
        some = F.concat(F.array(trimmed(x["preface"], own)), F.zip_with(x["sections"], shares, lambda s, k: trimmed(s, k)))
        return F.when(F.length(full) <= budget, full).otherwise(joined(some))

    chosen = let(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\u0085  ]"), lambda lines: let(review_spans(lines), lambda spans: of(lines, spans)))
    return F.when(F.length(text) > budget, chosen)
