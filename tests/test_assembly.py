"""What items ask for, how searches went, who gets which chunk, blocks as text, and the gate."""

from pyspark.sql import functions as F

from dossier.operators import assembly

RULES = "array<struct<check: string, requirement: string>>"
ITEMS = "array<struct<item: string, category: string, basis: string>>"


def test_queries_of_items(spark):
    d = spark.createDataFrame([([(" licence ", "valid "), ("", "x"), (None, None)], [("price", None, "chapter 4"), (" ", "a", "b")]), (None, None)], f"rules {RULES}, items {ITEMS}")
    got = [[(q["item"], q["queries"]) for q in r[0]] for r in d.select(assembly.item_queries(F.col("rules"), F.col("items"))).collect()]
    assert got == [[("资格审查:licence", ["licence", "valid"]), ("price", ["price", "chapter 4"])], []]


def test_trails_stop_at_the_first_hit(spark):
    rounds = [spark.createDataFrame([(q, 1) for q in qs], "query string, doc long") for qs in (["b"], [], ["a", "c"])]
    got = {r["item"]: (r["found"], r["tried"]) for r in assembly.trails({"x": ["a", "b"], "y": ["c"], "z": ["none "]}, rounds, ["", "+", "++"]).collect()}
    assert got == {"x": (True, ["a", "b"]), "y": (True, ["c", "c+", "c++"]), "z": (False, ["none", "none+", "none++"])}


def assemble(items, candidates, per_item, in_all):
    seen, out = set(), {}
    for case, item in items:
        own = {"tokens": 0, "blocks": [], "held": False}
        some = sorted(c[2:] for c in candidates if c[:2] == (case, item))
        for _, chunk, cost in some:
            if (case, chunk) in seen:
                own["held"] = True
                continue
            total = sum(o["tokens"] for (c, _), o in out.items() if c == case)
            if (own["tokens"] and own["tokens"] + cost > per_item) or total + own["tokens"] + cost > in_all:
                break
            seen.add((case, chunk))
            own["tokens"] += cost
            own["blocks"].append(chunk)
            own["held"] = True
        own["state"] = "unresolved" if not some else "ok" if own["held"] else "truncated"
        out[case, item] = own
    return {k: (o["state"], o["tokens"], o["blocks"]) for k, o in out.items()}


def test_assembly_against_the_walk(spark):
    import random

    rnd = random.Random(6)
    items = [(c, i) for c in ("p", "q", None, "empty") for i in range(6)]
    candidates = [(c, i, n, f"c{rnd.randint(0, 14)}", rnd.randint(1, 9)) for c, i in items if c != "empty" and i != 4 for n in range(rnd.randint(1, 8))]
    candidates.append(("p", 0, 99, "big", 500))
    d = spark.createDataFrame(items, "case string, item int").repartition(3)
    e = spark.createDataFrame(candidates, "case string, item int, no int, chunk string, size int").repartition(5)
    for per_item, in_all in ((12, 40), (5, 1000), (1000, 11), (3, 2)):
        got = {(r["case"], r["item"]): (r["state"], r["tokens"], [b["chunk"] for b in r["blocks"]]) for r in assembly.assembled(d, e, ["case"], "item", ["no"], "chunk", "size", per_item, in_all).collect()}
        assert got == assemble(items, candidates, per_item, in_all)
        used = {}
        for (case, _), (_, tokens, _) in got.items():
            used[case] = used.get(case, 0) + tokens
        assert max(used.values()) <= in_all and got["empty", 0] == ("unresolved", 0, [])


def test_blocks_stand_by_themselves(spark):
    rows = [("tender", "a.pdf", "【第 3 页】", "1 > 2", "t"), ("bid", None, "页码未知", "x", "u")]
    d = spark.createDataFrame(rows, "s string, f string, a string, c string, t string")
    got = [r[0] for r in d.select(assembly.block_text(*(F.col(c) for c in "sfact"))).collect()]
    assert got == ["=== 招标文件底稿 ===\n### 文件: a.pdf\n【第 3 页】\n【章节: 1 > 2】\nt", "=== 投标文件底稿 ===\n### 文件: 投标文件\n【章节: x】\nu"]


def test_the_gate(spark):
    row = lambda *states: [(s, [("c", 1)] if s == "ok" else []) for s in states]
    cases = [(False, 3, None, row("ok")), (True, 0, None, row("ok")), (True, None, None, None), (True, 2, "window_too_small", None), (True, 2, None, row("unresolved", "unresolved")), (True, 2, None, None), (True, 2, None, row("ok", "truncated")), (True, 2, None, row("ok"))]
    d = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, has boolean, n int, cause string, ledger array<struct<state: string, blocks: array<struct<chunk: string, tokens: long>>>>")
    got = [tuple(r["g"]) for r in d.select("i", assembly.gate(F.col("has"), F.col("n"), F.col("cause"), F.col("ledger")).alias("g")).orderBy("i").collect()]
    assert got == [("skipped", False), ("unavailable", True), ("unavailable", True), ("exhausted", True), ("all_unresolved", True), ("all_unresolved", True), ("warnings", False), ("ok", False)]
