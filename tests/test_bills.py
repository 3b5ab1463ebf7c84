"""Entries of bills against plain Python on random lines."""

import random
import re

from dossier.operators import bills
from dossier.operators.drafts import ANCHOR


def plain(lines):
    page, since, found = None, 0, {"total": [], "subtotal": [], "amount": []}
    value = lambda a: float(a.replace(",", ""))
    for i, raw in enumerate(lines):
        if m := re.search(ANCHOR, raw.strip()):
            page, since = int(m[2]), 0
            continue
        since += 1
        here, s = page if since <= bills.CARRY_LINES else None, raw.strip()
        if not s:
            continue
        near = [raw, *[x for x in lines[i + 1 :] if x.strip()][:3], *[x for x in reversed(lines[:i]) if x.strip()][:2]]
        if bills.TOTAL in s and (some := [a for x in near for a in re.findall(bills.LOOSE, x)]):
            caps = next((m[0] for x in [raw, *[x for x in lines[i + 1 :] if x.strip()][:3]] if (m := re.search(bills.CAPITALS, x))), None)
            score = 3 * (here is not None and here <= 5) + 3 * ("小写" in s) + 2 * bool(caps) - 3 * any(k in " ".join(lines[max(0, i - 2) : i + 3]) for k in bills.PARTIAL)
            found["total"].append((score, max(some, key=value), here, s, caps))
        if any(k in s for k in bills.SUBTOTALS) and (some := [a for x in near for a in re.findall(bills.EXACT, x)]):
            found["subtotal"].append((value(some[0]), some[0], here, s[:40], None))
        found["amount"] += [(value(a), a, here, s[:50], None) for a in re.findall(bills.EXACT, s)]
    out = {k: sorted(v, key=lambda x: -x[0]) for k, v in found.items()}
    seen, once = {value(out["total"][0][1])} if out["total"] else set(), []
    for x in out["amount"]:
        if x[0] not in seen:
            seen.add(x[0])
            once.append(x)
    out["amount"] = once
    return {k: [(a, p, t, c) for _, a, p, t, c in v[: bills.MOST[k]]] for k, v in out.items() if v}


def test_entries_and_summaries(spark):
    rnd = random.Random(8)
    pool = ["【第 {n} 页】", "投标总价（小写）", "投标总价 {a}", "{a}", "规费 {a}", "", "  ", "合计 {a} {a}", "单位工程投标总价", "壹佰贰拾万元整", "{i}", "x", "序号 12345"]
    docs = []
    for k in range(40):
        lines = []
        for n in range(rnd.choice([3, 30, 90])):
            a = rnd.choice(["1,234,567.80", "99.5", "100.00", f"{rnd.randint(1, 99)},{rnd.randint(100, 999)}.25", f"{rnd.randint(1, 40)}.00"])
            lines.append(rnd.choice(pool).format(n=n // 9 + 1, a=a, i=rnd.randint(1, 10**7)))
        docs.append(lines if k % 10 else lines + ["x"] * 310 + ["合计 5.50"])
    d = spark.createDataFrame([(k, i, x) for k, lines in enumerate(docs) for i, x in enumerate(lines)], "doc long, no long, line string").repartition(4)
    entries = bills.entries(d, ["doc"], "no", "line")
    got = {}
    for r in entries.orderBy("doc", "kind", "place").collect():
        got.setdefault(r["doc"], {}).setdefault(r["kind"], []).append((r["amount"], r["page"], r["text"], r["capitals"]))
    assert got == {k: e for k, lines in enumerate(docs) if (e := plain(lines))}
    told = {r["doc"]: r["summary"] for r in bills.summary(entries, ["doc"]).collect()}
    assert set(told) == {k for k, e in got.items() if "total" in e or "subtotal" in e}
    assert all(("grand total" in t) == ("total" in got[k]) and all(a in t for a, *_ in got[k].get("total", [])) for k, t in told.items())
    plan = entries._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert plan.count("Exchange hashpartitioning") == 1
