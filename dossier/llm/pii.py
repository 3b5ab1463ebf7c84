"""Personal data by weak supervision, with DataFrame operations only.

Fixed patterns give the base spans.  Wider patterns give candidates, and four labelers vote on each (yes, no or
abstain): a strict pattern, a gazetteer (top-level domains, card issuers, area codes, countries of accounts, given
names), the words before it, and its check (check digits, remainders, ranges).  Counts of votes and span features over all
documents, a table whose size doesn't depend on the data, are read by the driver, where expectation-maximisation
estimates how reliable each labeler is.  A logistic span classifier is then trained on its posteriors, with the votes and
the span's own features (length, share of digits, separators, what stands before it), and applied to every candidate.
What it accepts apart from base spans is added.  Weights of counts are shares, so a table of any size is treated alike.

Defined results: a null or empty text has no spans; repeated rows and null doc_ids are scanned like any other;
offsets are code points, ends exclusive; an empty table gives an empty result and trains nothing.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import let
from .secrets import joined
from .shared import written

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "id", "iban", "person")
_LOCAL = "[A-Za-z0-9._%+-]"
# Possessive groups match what greedy ones would here, without recursion on long texts.
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+"
CARD = r"[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# What the labelers know.
TITLES = "Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora"
NAMES = "Adam|Alan|Alice|Amy|Ana|Andrea|Andrew|Ann|Anna|Anne|Antoine|Antonio|Barbara|Ben|Bernd|Brian|Carlos|Carmen|Carol|Charles|Charlotte|Chris|Christine|Claire|Claudia|Daniel|David|Diana|Diego|Dieter|Donald|Edward|Elena|Elisabeth|Elizabeth|Emily|Emma|Eric|Eva|Frank|Fred|Gabriel|George|Grace|Hans|Heidi|Helen|Henry|Hugo|Ines|Isabel|Jack|Jacques|James|Jan|Jane|Javier|Jean|Jennifer|Jessica|John|Jorge|Jose|Joseph|Juan|Julia|Julie|Karen|Karl|Kate|Kevin|Klaus|Laura|Linda|Lisa|Louis|Lucia|Luis|Maria|Marie|Mark|Martin|Mary|Max|Michael|Miguel|Monika|Nancy|Nicole|Olivia|Otto|Pablo|Patricia|Paul|Pedro|Peter|Pierre|Rachel|Richard|Robert|Rosa|Ruth|Sabine|Sandra|Sara|Sarah|Sofia|Sophie|Stefan|Stephen|Steven|Susan|Susanne|Thomas|Ursula|Walter|William|Wolfgang"
DOMAINS = "com|org|net|edu|gov|mil|int|info|biz|io|co|app|dev|de|at|ch|fr|be|nl|lu|es|pt|it|ie|uk|eu|dk|se|no|fi|pl|cz|us|ca|mx|br|ar|au|nz|jp|cn|in"
COUNTRIES = "AD|AE|AL|AT|AZ|BA|BE|BG|BH|BR|CH|CR|CY|CZ|DE|DK|DO|EE|ES|FI|FO|FR|GB|GE|GI|GL|GR|GT|HR|HU|IE|IL|IS|IT|JO|KW|KZ|LB|LI|LT|LU|LV|MC|MD|ME|MK|MR|MT|MU|NL|NO|PK|PL|PS|PT|QA|RO|RS|SA|SE|SI|SK|SM|TN|TR|UA|VG|XK"
#: Wider patterns of candidates, by kind.
WIDE = {
    "email": r"[A-Za-z0-9._%+-]{2,64}+\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,64}+\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z]{2,24}+",
    "ip": IP,
    "card": CARD,
    "phone": r"(?<![0-9A-Za-z.+-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])",
    "id": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "person": rf"(?<![\p{{L}}])(?:(?:{TITLES})\.?\x20[A-Z][a-z]+(?:\x20[A-Z][a-z]+)?|(?:{NAMES})\x20[A-Z][a-z]+)(?![\p{{L}}])",
}
#: A text without this has no match: spares most texts the patterns.
_NEEDS = {"email": r"@|\(at\)|\[at\]", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": "[0-9]{4}", "id": "[0-9]-[0-9]", "iban": "[A-Z]{2}[0-9]{2}", "person": rf"\b(?:{TITLES})\.?\x20[A-Z]|\b(?:{NAMES})\x20[A-Z]"}
GAZETTEER = {
    "email": rf"(?i)(?:{DOMAINS})$",
    "ip": r"^(?:[1-9][0-9]?|1[0-9]{2}|2[01][0-9]|22[0-3])\.",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)",
    "phone": r"^\(?[2-9](?!11)[0-9]{2}\)?.[2-9]",
    "id": r"^(?!000|666|9)",
    "iban": rf"^(?:{COUNTRIES})",
    "person": rf"(?:^|\x20)(?:{NAMES})\x20",
}
CONTEXT_FOR = {
    "email": r"(?:mail|contact|write|kontakt|correo|courriel)",
    "ip": r"(?:\bip\b|address|host|server|client)",
    "card": r"(?:card|visa|credit|karte|carte|tarjeta|payment)",
    "phone": r"(?:phone|\btel|call|mobile|fax|telefon)",
    "id": r"(?:ssn|social|security|\bid\b|taxpayer)",
    "iban": r"(?:iban|account|konto|compte|cuenta|bank)",
    "person": r"(?:dear|name|contact|signed|sincerely|regards|by)",
}
CONTEXT_AGAINST = r"(?:version|\bv\.?|section|figure|table|isbn|doi|order|part|page|serial|invoice|model|build|#)\W*$"
STRICT = {"email": rf"^{_LOCAL}+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+$", "ip": r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$", "card": r"^(?:[0-9]{12,19}|[0-9]{4}(?:([\x20-])[0-9]{4})(?:\1[0-9]{1,4})+)$", "phone": r"^(?:\([0-9]{3}\)\x20|[0-9]{3}([.-]))[0-9]{3}(?:-|\1)[0-9]{4}$", "id": r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$", "iban": r"^[A-Z]{2}[0-9]{2}(?:\x20[A-Z0-9]{4}|[A-Z0-9]{4})+", "person": rf"^(?:{TITLES})\.?\x20[A-Z]"}
LABELERS = 4
_SPAN = "array<struct<from: int, to: int, kind: string>>"


def matches(text: Column, pattern: str, needs: str) -> Column:
    """(from, to, m) of all matches, leftmost and non-overlapping: places follow from the lengths between them."""
    none = F.array().cast("array<struct<from: int, to: int, m: string>>")
    lengths = lambda xs: F.transform(xs, lambda x: F.length(x))
    add = lambda xs, n: F.aggregate(F.slice(xs, F.lit(1), n), F.lit(0), lambda a, b: a + b)

    def places(found: Column) -> Column:
        def each(between: Column, own: Column) -> Column:
            def one(m: Column, i: Column) -> Column:
                start = add(between, i + 1) + add(own, i)
                return let(start, lambda s: F.struct(s.alias("from"), (s + F.length(m)).alias("to"), m.alias("m")))

            return F.transform(found, one)

        return let(lengths(F.split(text, pattern, -1)), lambda b: let(lengths(found), lambda o: each(b, o)))

    some = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda f: F.when(F.size(f) > 0, places(f)).otherwise(none))
    return F.when(text.rlike(needs), some).otherwise(none)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _octets(m: Column) -> Column:
    """Whether all parts are at most 255."""
    return F.forall(F.split(m, r"\."), lambda p: let(F.regexp_replace(p, "^0+(?=[0-9])", ""), lambda d: (F.length(d) < 3) | ((F.length(d) == 3) & (d <= "255"))))


def _fits(kind: str, m: Column) -> Column:
    if kind == "ip":
        return _octets(m)
    if kind == "card":
        return let(_digits(m), lambda d: F.length(d).between(12, 19) & F.call_function("luhn_check", d))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _remainder(m: Column) -> Column:
    """Whether an account number leaves 1 when its letters are numbers (A is 10), its first four characters come last, and it is divided by 97."""
    plain = F.replace(m, F.lit(" "), F.lit(""))
    turned = F.split(F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4))), "")
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.transform(turned, value), F.lit(0), lambda a, v: ((F.when(v > 9, a * 100).otherwise(a * 10) + v) % 97).cast("int")) == 1


def _checked(kind: str, m: Column) -> Column:
    if kind in ("ip", "card"):
        return _fits(kind, m)
    if kind == "iban":
        return _remainder(m)
    if kind == "id":
        return m.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)")
    if kind == "phone":
        return F.length(_digits(m)) == 10
    return m.rlike(r"\x20[A-Z][a-z]+\x20[A-Z][a-z]+$") if kind == "person" else F.length(m) > 5


#: Numbers of values of the features of a span.
FEATURES = (4, 4, 4, 3)


def _own_features(m: Column, before: Column) -> Column:
    """Steps of length, share of digits, separators, and what stands right before."""
    n, d = F.length(m), F.length(_digits(m))
    long = F.when(n <= 12, 0).when(n <= 20, 1).when(n <= 34, 2).otherwise(3)
    digits = F.when(d == 0, 0).when(2 * d < n, 1).when(d < n, 2).otherwise(3)
    apart = F.when(m.contains("-"), 1).when(m.contains(" "), 2).when(m.contains("."), 3).otherwise(0)
    return F.array(long, digits, apart, F.when(before.rlike(r"[:=]\s*$"), 2).when(before.rlike(r"[\p{L}0-9]\s*$"), 1).otherwise(0))


def _spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda x: F.struct(x["from"].alias("from"), x["to"].alias("to"), F.lit(kind).alias("kind")))


def base_spans(text: Column) -> Column:
    patterns = {"email": (EMAIL, "@"), "ip": (IP, "[0-9]"), "card": (CARD, "[0-9]"), "phone": (PHONE, r"\+")}

    def own(kind: str, pattern: str, needs: str) -> Column:
        return _spans(F.filter(matches(text, pattern, needs), lambda x: _fits(kind, x["m"])), kind)

    return F.concat(*(own(kind, *p) for kind, p in patterns.items()))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _voted(text: Column, kind: str) -> Column:
    """Candidates of a kind, with the votes of all labelers."""

    def votes(x: Column) -> Column:
        m = x["m"]
        before = F.lower(F.substr(text, F.greatest(x["from"] - 29, F.lit(1)), F.least(x["from"], F.lit(30))))
        before = F.when(x["from"] > 0, before).otherwise("")
        shape = _checked(kind, m)
        strict, known = m.rlike(STRICT[kind]), m.rlike(GAZETTEER[kind])
        given = [x["from"].alias("from"), x["to"].alias("to"), F.lit(kind).alias("kind")]
        return let(before, lambda b: F.struct(*given, F.array(_vote(strict, ~strict), _vote(known, ~known), _vote(b.rlike(CONTEXT_FOR[kind]), b.rlike(CONTEXT_AGAINST)), _vote(shape, ~shape)).alias("votes"), _own_features(m, b).alias("own")))

    return F.transform(matches(text, WIDE[kind], _NEEDS[kind]), votes)


Pattern = tuple[str, tuple[int, ...], tuple[int, ...]]  # kind, votes, features


def estimate(counts: dict[Pattern, int], rounds: int = 60, trust: float = 20.0) -> dict[Pattern, float]:
    """Posterior of each pattern, by expectation-maximisation of a two-class model with one table of vote rates for each labeler.

    Labelers are taken to be right more often than not; that counts as much as `trust` spans of each class.  Kinds have priors of their own.
    """
    if not counts:
        return {}
    keys, n = list(counts), np.array(list(counts.values()), float)
    votes = np.array([k[1] for k in keys]) + 1
    kinds = {k: i for i, k in enumerate(sorted({k[0] for k in keys}))}
    kind = np.array([kinds[k[0]] for k in keys])
    first = np.empty((2, LABELERS, 3))
    first[1], first[0] = (0.15, 0.25, 0.6), (0.6, 0.25, 0.15)
    rates, prior = first.copy(), np.full(len(kinds), 0.5)
    for _ in range(rounds):
        like = [np.log(rates[c][np.arange(LABELERS), votes]).sum(axis=1) for c in (0, 1)]
        odds = like[1] - like[0] + np.log(prior[kind] / (1 - prior[kind]))
        post = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
        for c, w in ((0, n * (1 - post)), (1, n * post)):
            for j in range(LABELERS):
                seen = np.bincount(votes[:, j], w, 3) + trust * first[c, j]
                rates[c, j] = seen / seen.sum()
        prior = np.clip((np.bincount(kind, n * post) + 1) / (np.bincount(kind, n) + 2), 0.05, 0.95)
    return dict(zip(keys, post.tolist(), strict=True))


def _width() -> int:
    return len(ALL_KINDS) + 3 * LABELERS + sum(FEATURES)


def _features(kind: str, votes: tuple[int, ...], own: tuple[int, ...]) -> np.ndarray:
    x = np.zeros(_width())
    x[ALL_KINDS.index(kind)] = 1
    x[[len(ALL_KINDS) + 3 * j + v + 1 for j, v in enumerate(votes)]] = 1
    x[[len(ALL_KINDS) + 3 * LABELERS + sum(FEATURES[:j]) + v for j, v in enumerate(own)]] = 1
    return x


def classifier(counts: dict[Pattern, int], posterior: dict[Pattern, float], steps: int = 60, ridge: float = 1.0, weight: float = 1e4) -> np.ndarray:
    """Weights of a logistic model of the posteriors, fitted by Newton's method over all patterns; all counts together weigh `weight`."""
    w = np.zeros(_width())
    if not counts:
        return w
    x = np.array([_features(*k) for k in counts])
    n, y = np.array([counts[k] for k in counts], float), np.array([posterior[k] for k in counts])
    n *= weight / n.sum()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (n * p * (1 - p))) @ x + ridge * np.eye(len(w)), x.T @ (n * (y - p)) - ridge * w)
        w += step / max(1.0, float(np.abs(step).max()) / 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def personal_spans(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """Per document: doc_id, base spans and added spans, as arrays of (from, to, kind).  least: probability of an added span."""
    text = F.col("text")
    found = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    found = found.select("doc_id", base_spans(text).alias("base"), F.concat(*(_voted(text, k) for k in ALL_KINDS)).alias("tried"))
    found = written(found, "personal")
    each = found.select(F.explode("tried").alias("t")).groupBy("t.kind", "t.votes", "t.own").count()
    counts = {(r["kind"], tuple(r["votes"]), tuple(r["own"])): r["count"] for r in each.collect()}  # 7 kinds, 81 votes and 192 features at most
    w = classifier(counts, estimate(counts))
    of_kind = F.create_map(*(x for i, k in enumerate(ALL_KINDS) for x in (F.lit(k), F.lit(float(w[i])))))
    pick = lambda c, start, n: F.element_at(F.array(*(F.lit(float(v)) for v in w[start : start + n])), c + 1)
    votes = lambda t: sum((pick(F.get(t["votes"], F.lit(j)) + 1, len(ALL_KINDS) + 3 * j, 3) for j in range(LABELERS)), F.element_at(of_kind, t["kind"]))
    score = lambda t: sum((pick(F.get(t["own"], F.lit(j)), len(ALL_KINDS) + 3 * LABELERS + sum(FEATURES[:j]), n) for j, n in enumerate(FEATURES)), votes(t))
    apart = lambda t: ~F.exists("base", lambda b: (b["from"] < t["to"]) & (t["from"] < b["to"]))
    added = F.filter("tried", lambda t: (score(t) >= math.log(least / (1 - least))) & apart(t))
    return found.select("doc_id", "base", F.transform(added, lambda t: F.struct(t["from"].alias("from"), t["to"].alias("to"), t["kind"].alias("kind"))).alias("added"))


def personal_report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, counts and digest of base spans, and all spans as text."""
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return personal_spans(docs).select("doc_id", *map(n, KINDS), F.sha2(joined(F.col("base"), KINDS), 256).alias("base_sha256"), joined(F.concat("base", "added"), ALL_KINDS).alias("spans"))
