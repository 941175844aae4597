"""Personal data by weak supervision.

Patterns propose spans in one scan. Three labelers vote on each: the pattern's own checks (digits, Luhn, octets, remainders of
account numbers, titles), a gazetteer (domains, calling codes, card issuers, reserved networks, countries, given names, street
types) and the words before the span. Votes are +1, 0 or -1, so the corpus shrinks to one count per kind and vote pattern, a table
bounded by their number. Expectation-maximisation on it estimates each labeler's reliability and each pattern's probability; a
logistic classifier over votes, length and share of digits is trained on those probabilities, again from counts, and applied as one
expression. Spans of the base kinds that pass their checks always stay; the classifier adds spans of the other kinds where they
overlap no base span.

Null and empty texts have no spans. Texts of any length, with any number of matches, take time linear in both. Repeated rows, ties
and null doc_ids keep a row each. An empty table gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import apart, cut, let, match_rows, pieces

# The base patterns, written so that failing and overlong runs cost linear time and matches stay the same.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Patterns of the added kinds.
ID_NUMBER = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
LOCAL_PHONE = r"(?<![0-9+().-])\([0-9]{3}\)\x20?[0-9]{3}-[0-9]{4}(?![0-9-])"
ACCOUNT = r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Z0-9])"
# Titles before a name, and given names.
TITLES = "Mr Mrs Ms Dr Prof Herr Frau Mme Monsieur Señor Señora".split()
GIVEN = (
    "James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Daniel Karen "
    "Hans Anna Peter Ursula Wolfgang Monika Klaus Petra Jürgen Sabine Pierre Marie Jean Nathalie Michel Isabelle Philippe Sophie Nicolas Camille "
    "José María Antonio Carmen Manuel Ana Francisco Isabel Juan Laura Wei Li Yuki Hiroshi Olga Ivan Fatima Ahmed Priya Raj"
).split()
STREETS = "Street Avenue Road Lane Drive Boulevard Court Square Terrace Parkway".split()
SHORT_STREETS = "St Ave Rd Ln Dr Blvd Ct Sq".split()
CAPITAL = r"\p{Lu}\p{L}+"
PERSON = rf"(?<![\p{{L}}])(?:(?:{'|'.join(TITLES)})\.?\x20{CAPITAL}(?:\x20{CAPITAL})?|(?:{'|'.join(GIVEN)})\x20{CAPITAL})"
ADDRESS = rf"(?<![0-9.,-])[0-9]{{1,5}}\x20(?:{CAPITAL}\x20){{1,3}}(?:{'|'.join(STREETS)}|(?:{'|'.join(SHORT_STREETS)})\b\.?)(?![\p{{L}}])"

KINDS = ("email", "ip", "card", "phone", "idnum", "localphone", "account", "person", "address")
PATTERNS = (EMAIL, IP, CARD, PHONE, ID_NUMBER, LOCAL_PHONE, ACCOUNT, PERSON, ADDRESS)
BASE = 4
BEFORE = 32
# Cue words before a span of each kind.
CUES = (
    "mail|contact|write|schreib|correo|courriel",
    r"\bip\b|server|host|address|adresse|dirección",
    "card|visa|master|credit|karte|carte|tarjeta",
    "tel|phone|call|mobile|fax|ruf|móvil",
    r"ssn|social|security|\bid\b|number|nummer|numéro|número",
    "tel|phone|call|mobile|fax|ruf|móvil",
    "iban|account|bank|konto|compte|cuenta",
    r"\bname|contact|dear|patient|customer|employee|signed|nom\b|nombre|kunde",
    r"address|\blives?\b|resid|home|ship|adresse|dirección|wohn",
)
# Gazetteers.
DOMAINS = "com org net edu gov mil int info io de fr es uk it nl eu us ca ch at be pl se no dk fi pt ie cz gr hu ro ru jp cn in br mx au nz za kr".split()
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
COUNTRIES = "AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LT LU LV MT NL NO PL PT RO SE SI SK".split()

VOTES = ("regex", "gazetteer", "context")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(d: Column) -> Column:
    at = lambda i: F.substring(d, F.char_length(d) - i, F.lit(1)).cast("int")
    doubled = lambda x: F.when(x > 4, 2 * x - 9).otherwise(2 * x)
    total = F.aggregate(F.sequence(F.lit(0), F.char_length(d) - 1), F.lit(0), lambda a, i: a + F.when(i % 2 == 1, doubled(at(i))).otherwise(at(i)))
    return total % 10 == 0


def _octets(m: Column) -> Column:
    """Parts of at most 255: after leading zeros, three digits at most and no larger than 255."""
    return F.forall(F.split(m, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def _mod97(m: Column) -> Column:
    """Whether an account number's check digits are right: four characters to the end, letters as 10 to 35, remainder 1."""
    turned = F.concat(F.substring(m, F.lit(5), F.char_length(m)), F.substring(m, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    step = lambda a, c: F.pmod(F.when(c.rlike("[0-9]"), a * 10).otherwise(a * 100) + value(c), F.lit(97)).cast("int")
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


def _checks(k: int, m: Column) -> Column:
    """The pattern labeler: whether a match meets its kind's own conditions."""
    if KINDS[k] == "ip":
        return _octets(m)
    if KINDS[k] == "card":
        return let(_digits(m), lambda d: F.char_length(d).between(13, 19) & _luhn(d))
    if KINDS[k] == "phone":
        return F.char_length(_digits(m)).between(9, 15)
    if KINDS[k] == "idnum":
        return ~m.rlike("-00-|-0000$")
    if KINDS[k] == "localphone":
        return m.rlike(r"^\([2-9][0-9]{2}\)\x20?[2-9]")
    if KINDS[k] == "account":
        return _mod97(m)
    if KINDS[k] == "person":
        return m.rlike(rf"^(?:{'|'.join(TITLES)})\b")
    if KINDS[k] == "address":
        return m.rlike("^[1-9]")
    return F.lit(True)


def _gazetteer(k: int, m: Column) -> Column:
    yes = {
        "email": lambda: F.element_at(F.split(F.lower(m), r"\."), -1).isin(DOMAINS),
        "ip": lambda: ~m.rlike(r"^(?:0|10|127|22[4-9]|2[3-9][0-9])\.|^192\.168\.|^169\.254\."),
        "card": lambda: m.rlike("^(?:3[47]|4|5[1-5]|2[2-7]|6)"),
        "phone": lambda: m.rlike(rf"^\+(?:{'|'.join(CALLING)})"),
        "idnum": lambda: ~m.rlike("^(?:000|666|9)"),
        "localphone": lambda: ~m.rlike(r"^\((?:[2-9]11|800|888|877|900)\)"),
        "account": lambda: F.substring(m, 1, 2).isin(COUNTRIES),
        "person": lambda: m.rlike(rf"(?:^|\x20)(?:{'|'.join(GIVEN)})(?:\x20|$)"),
        "address": lambda: m.rlike(rf"(?:{'|'.join(STREETS)})$"),
    }[KINDS[k]]()
    return F.when(yes, F.lit(1)).otherwise(F.lit(-1))


def candidates(text: Column, k: int) -> Column:
    """The matches of kind `k` in a text with their votes, array<struct<n,l,ok,regex,gazetteer,context,digits>>."""
    t = F.coalesce(text, F.lit(""))

    def one(x: Column) -> Column:
        ok = _checks(k, x["m"])
        context = F.when(x["c"].rlike(CUES[k]), F.lit(1)).otherwise(F.lit(0))
        return F.struct(
            x["n"].alias("n"), F.char_length(x["m"]).alias("l"), ok.alias("ok"), F.when(ok, F.lit(1)).otherwise(F.lit(-1)).alias("regex"), _gazetteer(k, x["m"]).alias("gazetteer"),
            context.alias("context"), F.char_length(_digits(x["m"])).alias("digits"),
        )

    found = F.transform(pieces(t, PATTERNS[k], BEFORE), one)
    none = F.array().cast("array<struct<n:int,l:int,ok:boolean,regex:int,gazetteer:int,context:int,digits:int>>")
    some = F.contains(t, F.lit("@")) if k == 0 else F.contains(t, F.lit("+")) if KINDS[k] == "phone" else F.lit(True) if KINDS[k] == "person" else t.rlike("[0-9]")
    return F.when(some, found).otherwise(none)


def proposed(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): (rid, doc) of every row, and (rid, k, s, e, ok, regex, gazetteer, context, digits) of every span that a pattern proposes.

    Spans of the added kinds go where they overlap a base span that passes its checks.
    """
    arrays = [f"c{k}" for k in range(len(KINDS))]
    found = cut(docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).alias("doc"), *[candidates(F.col(text), k).alias(a) for k, a in enumerate(arrays)]))
    rows = match_rows(found, arrays, []).drop("i")
    # a base match that fails its checks stays as a negative example, but keeps nothing away
    return found.select("rid", "doc"), cut(apart(rows, (F.col("k") < BASE) & F.col("ok"), F.col("k") < BASE))


def estimate(counts: dict[tuple, int], rounds: int = 50) -> dict[tuple, float]:
    """Expectation-maximisation over (kind, votes) counts: the probability that a span with these votes is personal data.

    Labelers vote independently given the truth. The first guess is the share of positive votes.
    """
    truth = {p: min(0.95, max(0.05, 0.5 + 0.25 * sum(p[1:]))) for p in counts}
    for _ in range(rounds):
        prior, rate = {}, {}
        for kind in {p[0] for p in counts}:
            own = {p: n for p, n in counts.items() if p[0] == kind}
            prior[kind] = (1 + sum(n * truth[p] for p, n in own.items())) / (2 + sum(own.values()))
        for j in range(len(VOTES)):
            for true in (True, False):
                mass = {v: 1.0 + (v == 1 if true else v == -1) for v in (-1, 0, 1)}
                for p, n in counts.items():
                    mass[p[1 + j]] += n * (truth[p] if true else 1 - truth[p])
                for v, m in mass.items():
                    rate[j, true, v] = m / sum(mass.values())
        for p in counts:
            yes = math.log(prior[p[0]]) + sum(math.log(rate[j, True, v]) for j, v in enumerate(p[1:]))
            no = math.log(1 - prior[p[0]]) + sum(math.log(rate[j, False, v]) for j, v in enumerate(p[1:]))
            truth[p] = 1 / (1 + math.exp(min(50.0, no - yes)))
    return truth


def features(kind: int, votes: tuple, length: int, digits: int) -> list[float]:
    return [1.0, *(float(v) for v in votes), *(1.0 if kind == k else 0.0 for k in range(len(KINDS))), length / 3, digits / 3]


def train(rows: list[tuple[list[float], float, int]], rounds: int = 80, rate: float = 0.5) -> list[float]:
    """Weights of a logistic classifier from (features, probability, count) rows, by gradient descent with a small penalty."""
    size = len(features(0, (0, 0, 0), 0, 0))
    weights, total = [0.0] * size, max(1, sum(n for *_, n in rows))
    for _ in range(rounds):
        slope = [1e-3 * w for w in weights]
        for x, y, n in rows:
            z = max(-30.0, min(30.0, sum(w * v for w, v in zip(weights, x, strict=True))))
            err = n / total * (1 / (1 + math.exp(-z)) - y)
            slope = [s + err * v for s, v in zip(slope, x, strict=True)]
        weights = [w - rate * s for w, s in zip(weights, slope, strict=True)]
    return weights


def _buckets() -> tuple[Column, Column]:
    length = F.col("e") - F.col("s")
    size = F.when(length < 12, 0).when(length < 18, 1).when(length < 30, 2).otherwise(3)
    return size, F.floor(3 * F.col("digits") / F.greatest(length, F.lit(1))).cast("int")


def score(weights: list[float]) -> Column:
    """The classifier's log-odds for a proposed span."""
    length, digits = _buckets()
    values = [F.lit(1.0), *(F.col(v) for v in VOTES), *(F.when(F.col("k") == k, 1.0).otherwise(0.0) for k in range(len(KINDS))), length / 3, digits / 3]
    return reduce(lambda a, b: a + b, (F.lit(w) * v for w, v in zip(weights, values, strict=True)))


def fit(spans: DataFrame) -> list[float]:
    """Weights from all proposed spans. Only counts by kind, votes and buckets reach the driver, a table bounded by their number."""
    length, digits = _buckets()
    seen = spans.groupBy("k", *VOTES, length.alias("length"), digits.alias("share")).agg(F.count("*").alias("n")).collect()
    counts: dict[tuple, int] = {}
    for r in seen:
        p = (r["k"], *(r[v] for v in VOTES))
        counts[p] = counts.get(p, 0) + r["n"]
    truth = estimate(counts)
    rows = [(features(r["k"], tuple(r[v] for v in VOTES), r["length"], r["share"]), truth[r["k"], *(r[v] for v in VOTES)], r["n"]) for r in seen]
    return train(sorted(rows))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", weights: list[float] | None = None) -> DataFrame:
    """(doc_id, spans): per row of `docs` its spans, array<struct<k,s,e,odds>> by kind, then start. `weights` saves the fit."""
    rows, spans = proposed(docs, doc_id, text)
    odds = score(weights or fit(spans))
    kept = spans.withColumn("odds", F.round(odds, 3)).where(F.when(F.col("k") < BASE, F.col("ok")).otherwise(odds > 0))
    per_row = kept.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("k", "s", "e", "odds"))).alias("spans"))
    empty = F.array().cast("array<struct<k:int,s:int,e:int,odds:double>>")
    return rows.join(per_row, "rid", "left").select(F.col("doc").alias(doc_id), F.coalesce("spans", empty).alias("spans"))


def listed(xs: Column) -> Column:
    kind = lambda x: F.get(F.array(*[F.lit(k) for k in KINDS]), x["k"])
    return F.array_join(F.transform(xs, lambda x: F.concat_ws(":", kind(x), x["s"], x["e"])), ",")
