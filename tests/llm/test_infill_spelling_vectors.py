import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from bibspark.llm import infill, spelling, vectors
from pyspark.sql import functions as F

from . import cases

UNITS = {"token": re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+"), "line": re.compile(r"[^\n]*\n|[^\n]+"), "char": re.compile(r"(?s).")}


def cut_by_hand(doc, text, unit):
    x, ts = text or "", UNITS[unit].findall(text or "")
    digest = hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(ts) + 1), h[1] % (len(ts) + 1)))
    p, m, s = "".join(ts[:a]), "".join(ts[a:b]), "".join(ts[b:])
    if not x or any(mark in x for mark in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(ts), "plain", None, None, x
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return len(ts), form, len(p), len(m), out


@pytest.mark.parametrize("unit", sorted(UNITS))
def test_fill_in_middle(spark, unit):
    texts = [None, "", " ", "\n\n", "a", "é", "🙂 x", "<P", "<S> b", "x <M", "a b c d", " lead", "trail \t\n", "<", "no\r\nend\x0bof line", "word " * 40_000, "日本語 " * 999]
    docs = [*cases.hard_docs(400), *((1000 + i, t) for i, t in enumerate(texts * 7)), (None, "no id at all"), (None, None), (5, "again, an id")]
    done = infill.transform(cases.frame(spark, docs), unit=unit)
    assert done.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    rows = done.withColumn("restored", infill.restore(F.col("output"), F.col("form"))).collect()
    assert sorted(map(repr, (tuple(r) for r in rows))) == sorted(repr((d, *cut_by_hand(d, t, unit), t or "")) for d, t in docs)
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"}


def test_ranks_of_a_wavelet_matrix():
    r = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 65, 1000):
        symbols = r.integers(0, 7, n).astype(np.uint8)
        tree, places = infill.Wavelet(symbols), np.arange(n + 1)
        for s in range(8):
            assert (tree.rank(s, places) == np.r_[0, np.cumsum(symbols == s)]).all()
        kinds = (1, 4, 6)
        stands = np.flatnonzero(np.isin(symbols, kinds)) + 1
        zero = np.zeros(len(stands) + 1, dtype=np.int64)
        assert (tree.place(kinds, np.arange(len(stands) + 1), zero, zero + n) == np.r_[0, stands]).all()


def variants_by_hand(count, ratio=5):
    near = {w: set() for w in count}
    for w in count:
        for i in range(len(w) + 1):
            for c in sorted(set("".join(count))):
                near[w] |= {w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]} & count.keys()
            near[w] |= {w[:i] + w[i + 1 :]} & count.keys()
        near[w].discard(w)
    best = {w: min(near[w], key=lambda o: (-count[o], o), default=None) for w in count}
    form = {w: b for w, b in best.items() if b and count[b] >= ratio * count[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, n, len(near[w]), form.get(w), count[form[w]] if w in form else None, root(w)) for w, n in count.items())


def words_by_hand(docs):
    count = Counter()
    for d, t in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = cases.lower(w)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            count[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w] += 1
    return {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}


def found(df):
    return sorted((r["word"], r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect())


def test_spelling_variants_of_texts(spark):
    r = np.random.default_rng(3)
    base = ["harbour", "Straße", "élèves", "ÉLÈVES", "colours", "colour", "aaaaaa", "aaaaaaa", "recette", "×÷×÷×÷"]
    docs = [(i if i % 50 else None, " ".join(r.choice(base, 30)) + "1_" + "".join(r.choice(list("ab"), 6))) for i in range(600)]
    docs += [(7, None), (8, ""), (9, "short word"), (10, "x" * 30_000), (11, ("y" * 3000 + " ") * 6 + ("y" * 3001 + " ") * 40)]
    got = found(spelling.variants(cases.frame(spark, docs)))
    count = words_by_hand(docs)
    small = {w: n for w, n in count.items() if len(w) < 99}
    assert [x for x in got if len(x[0]) < 99] == variants_by_hand(small)
    assert [(len(x[0]), x[1], x[2], len(x[3] or ""), len(x[5])) for x in got if len(x[0]) > 99] == [(len(w), count[w], 1, 3001 if len(w) == 3000 else 0, 3001) for w in sorted(w for w in count if len(w) > 99)]
    assert spelling.variants(cases.frame(spark, docs).limit(0)).count() == 0


@pytest.mark.parametrize(("sample", "rows"), [(200_000, 32_768), (40, 7), (1, 1)])
def test_spelling_trees_find_every_pair(spark, sample, rows):
    r = np.random.default_rng(5)
    words = {"".join(r.choice(list("abé"), r.integers(6, 9))) for _ in range(700)} | {"".join(r.choice(list("abcdefghijklmnop"), 8)) for _ in range(100)} | {"aaaaaaaaaaaaaaaaaa", "aaaaaaaaaaaaaaaaa", "aaaaaaaaaaaaaaaaab"}
    count = {w: int(5 ** r.integers(1, 5) + r.integers(0, 3)) for w in words}
    frame = spark.createDataFrame([(w, n, 1) for w, n in count.items()], "word string, n long, form int")
    assert found(spelling.group(frame, sample=sample, rows=rows)) == variants_by_hand(count)


def vectors_by_hand(rows, least=0.95):
    good = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    near = {i: set() for i in range(len(rows))}
    unit = {i: np.array(rows[i][1]) / np.abs(rows[i][1]).max() for i in good}
    for a in good:
        for b in good:
            if a != b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] / np.linalg.norm(unit[a]) / np.linalg.norm(unit[b]) >= least:
                near[a].add(b)
    out, seen = [], {}
    for i in range(len(rows)):
        if i not in seen:
            todo, part = [i], {i}
            while todo:
                more = near[todo.pop()] - part
                part |= more
                todo += more
            seen.update(dict.fromkeys(part, min((rows[k][0] for k in part if rows[k][0] is not None), default=None)))
        out.append((rows[i][0], len(near[i]), seen[i], rows[i][0] == seen[i]))
    return sorted(map(repr, out))


def vector_rows():
    r = np.random.default_rng(2)
    rows = []
    for _ in range(12):
        base = r.normal(size=8)
        rows += [list(map(float, base + r.normal(size=8) * r.choice([0.01, 0.1, 0.2, 0.3]))) for _ in range(9)]
    rows += [rows[0]] * 30 + [[x * 1e-3 for x in rows[5]], [x * 1e250 for x in rows[5]], [1e-300] * 8, None, [], [0.0] * 8, [1.0, None] * 4, [float("nan")] * 8, [float("inf")] + [0.0] * 7, [1.0, 0.0], [1.0, 0.3], [-0.0, 1.0], [0.0, 1.0], [3.0], [-2.0], [1.0] * 3000, [1.0] * 2999 + [1.5]]
    ids = [*range(len(rows))]
    r.shuffle(ids)
    ids[3] = ids[40] = ids[-1] = None
    ids[7] = ids[8]
    return [(i, v) for i, v in zip([None if i is None else int(i) for i in ids], rows, strict=True)]


@pytest.mark.parametrize(("block", "tile"), [(65_536, 1024), (20, 7), (1, 1)])
def test_embedding_dedup(spark, monkeypatch, block, tile):
    rows = vector_rows() if block > 1 else vector_rows()[:40]
    monkeypatch.setattr(vectors, "BLOCKS", 3)
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, row int, cls int")
    got = vectors.near(frame, block=block, tile=tile).collect()
    assert sorted(repr(tuple(r)) for r in got) == vectors_by_hand(rows)
    assert vectors.near(frame.limit(0)).count() == 0


def test_quantised_products_are_within_their_bounds():
    r = np.random.default_rng(4)
    for d in (2, 3, 64, 1500):
        base = r.normal(size=d)
        x = vectors.units(np.concatenate([r.normal(size=(60, d)), base + r.normal(size=(60, d)) * r.choice([0.01, 0.22, 0.33], (60, 1))]))
        for least in (0.95, 0.5, -0.2):
            a, b = vectors.Quantised(x[::2]), vectors.Quantised(x[1::2])
            hit, open_ = vectors.links(a, b, least)
            assert (hit == (a.x @ b.x.T >= least)).all()
            assert open_ < hit.size / 2  # most pairs need no full precision


def test_labels_reach_the_smallest_node():
    n = 500
    chain = np.random.default_rng(6).permutation(n)
    assert (vectors.roots(chain[:-1], chain[1:], n) == 0).all()
    assert vectors.roots(np.array([3, 1]), np.array([4, 2]), 6).tolist() == [0, 1, 1, 3, 3, 5]
