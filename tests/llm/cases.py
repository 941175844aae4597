"""Small inputs that every operator must stand, and brute-force versions of what they compute."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

WS = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in WS.split(text or "") if w]


def hard_docs(n=120, seed=1):
    """(doc_id, text): nulls, empty, one very long text, copies, near copies, shared passages, odd characters."""
    r = random.Random(seed)
    vocab = ["alpha", "Beta", "gamma", "été", "naïve", "delta", "7", "x,", "END.", "日本", "🙂"] + [f"w{i}" for i in range(60)]
    text = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    passage, base = text(60), text(80)
    out = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "one two"), (5, base), (6, base), (7, base.replace(" ", "\n", 5)), (8, text(30) + " " + passage), (9, passage + "\n" + text(20)), (10, text(6000)), (11, "a " * 90), (12, "<|endoftext|> a  b   c\n\n  d<|startoftext|>")]
    for i in range(13, n):
        kind = r.randrange(4)
        if kind == 0:
            w = base.split(" ")
            for _ in range(r.randrange(6)):
                w[r.randrange(len(w))] = r.choice(vocab)
            out.append((i, " ".join(w)))
        elif kind == 1:
            out.append((i, text(r.randrange(1, 40)) + " " + passage + " " + text(3)))
        else:
            out.append((i, text(r.randrange(0, 60))))
    return out


def frame(spark, docs, id_type="long"):
    """The documents with extra columns whose names clash with those the operators use."""
    rows = [(i, t, "en" if i is None or i % 2 else None, f"s{(i or 0) % 3}", 5, "x", 1, [1]) for i, t in docs]
    return spark.createDataFrame(rows, f"doc_id {id_type}, text string, lang string, source string, n_chars long, hash string, n int, spans array<int>")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def jaccard(docs):
    """{doc_id: (set size, component, links)} by comparing all pairs."""
    sets = {}
    for d, t in docs:
        w = words(lower(t))
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    parent, links = {d: d for d in sets}, Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d), links[d]) for d in ids}


def repeats(docs, size=35):
    return sorted(repeats_in_order(docs, size))


def repeats_in_order(docs, size=35):
    """(doc_id, words, removed, hash of the kept words) by counting all windows."""
    split = [(d, words(t)) for d, t in docs]
    count = Counter(tuple(w[i : i + size]) for _, w in split for i in range(len(w) - size + 1))
    out = []
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if count[tuple(w[i : i + size])] > 1:
                gone[i : i + size] = [True] * size
        out.append((d, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    return out


def kept_by_quality(text, thresholds, stop_words):
    """The quality verdict from first principles."""
    t = text or ""
    w = words(t)
    lines = [x for x in t.split("\n") if words(x)]
    where = defaultdict(list)
    for i in range(len(w) - 7):
        where[tuple(w[i : i + 8])].append(i)
    repeat = len({i + k for at in where.values() if len(at) > 1 for i in at for k in range(8)})
    chars = sum(map(len, w))
    m = {
        "n_words": len(w), "mean_word_chars": chars / len(w) if w else 0.0, "symbol_ratio": len(re.findall(r"[#*$%&|<>]", t)) / chars if chars else 0.0, "stop_words": len(set(w) & set(stop_words)),
        "dup_line_ratio": (len(lines) - len(set(lines))) / len(lines) if lines else 0.0, "repeat_word_ratio": repeat / len(w) if w else 0.0,
    }
    failed = len(w) < 20 or 100 * repeat > 30 * len(w)
    return not failed and all(m[k] >= b if op == ">=" else m[k] <= b for k, op, b in thresholds)


NORMAL = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def leaks(docs, items, size=10):
    """{doc_id: (words, hit words, items)}."""
    wanted = defaultdict(set)
    for item, t in items:
        w = NORMAL.findall(lower(t))
        n = min(len(w), size)
        for i in range(len(w) - n + 1 if n else 0):
            wanted[tuple(w[i : i + n])].add(item)
    out = {}
    for d, t in docs:
        w = NORMAL.findall(lower(t))
        hit, found = set(), set()
        for n in {len(k) for k in wanted}:
            for i in range(len(w) - n + 1):
                if items_ := wanted.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= items_
        out[d] = (len(w), len(hit), found)
    return out


BASE_PII = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
)
BASE_SECRETS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def personal(text):
    return [(k, m.start(), m.end()) for k, p, ok in BASE_PII for m in re.finditer(p, text or "") if ok(m[0])]


def proposed_pii(text, pii):
    """(k, s, e, ok, votes, digits) of every proposed span of a text, by plain loops over the operator's own tables."""
    import regex

    words = lambda xs: "|".join(xs)
    t, out = text or "", []
    for k, pattern in enumerate(pii.PATTERNS):
        kind, at = pii.KINDS[k], 0
        for m in regex.finditer(pattern, t):
            v, before = m[0], t[at : m.start()][-pii.BEFORE :].lower()
            at = m.end()
            digits = re.sub("[^0-9]", "", v)
            turned = "".join(str(int(c, 36)) for c in v[4:] + v[:4]) if kind == "account" else ""
            ok = {
                "email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in v.split(".")), "card": lambda: 13 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15,
                "idnum": lambda: v[4:6] != "00" and v[7:] != "0000", "localphone": lambda: v[1] in "23456789" and v[5:].lstrip(" ")[0] in "23456789", "account": lambda: int(turned) % 97 == 1,
                "person": lambda: any(re.match(rf"{x}\b", v) for x in pii.TITLES), "address": lambda: v[0] != "0",
            }[kind]()
            known = {
                "email": lambda: v.rsplit(".", 1)[-1].lower() in pii.DOMAINS, "ip": lambda: not re.match(r"(?:0|10|127|22[4-9]|2[3-9][0-9])\.|192\.168\.|169\.254\.", v),
                "card": lambda: v[:1] in "46" or v[:2] in "34 37 51 52 53 54 55 22 23 24 25 26 27".split(), "phone": lambda: re.match(rf"\+(?:{words(pii.CALLING)})", v),
                "idnum": lambda: v[:3] not in ("000", "666") and v[0] != "9", "localphone": lambda: v[1:4] not in ("800", "888", "877", "900") and not re.match("[2-9]11", v[1:4]), "account": lambda: v[:2] in pii.COUNTRIES,
                "person": lambda: set(v.split(" ")) & set(pii.GIVEN), "address": lambda: v.rsplit(" ", 1)[-1] in pii.STREETS,
            }[kind]()
            out.append((k, m.start(), m.end(), ok, (1 if ok else -1, 1 if known else -1, 1 if regex.search(pii.CUES[k], before) else 0), len(digits)))
    solid = [(s, e) for k, s, e, ok, *_ in out if k < pii.BASE and ok]
    return [x for x in out if x[0] < pii.BASE or not any(s < x[2] and x[1] < e for s, e in solid)]


def secret_spans(text):
    found = [(m.start(), i, k, m.end()) for i, (k, p, ok) in enumerate(BASE_SECRETS) for m in re.finditer(p, text or "") if ok(m)]
    return [(k, s, e) for s, _, k, e in sorted(found)]


def soup(pieces, n, seed=3):
    r = random.Random(seed)
    return [(0, None), (1, "")] + [(i, "".join(r.choice(pieces) for _ in range(r.randrange(1, 14)))) for i in range(2, n)]
