import datetime

from bibspark.functions import lex
from bibspark.functions import normalize as N
from bibspark.operators import events, extract, fixes, library, parse, resolve, rules
from pyspark.sql import functions as F

from .conftest import SF

HARD = """text @ here 50% @nothing
% @article{hidden, title = {no}}
@string{ven = {A } # "B {"}" # ven2}
@STRING(ven2 = "C")
@article{k1, title = {x {y} \\} z}, year = 1999, journal = ven, month = jan # "~1",}
@comment{free {braces}}
@preamble{"\\x" # ven}
@book(k2, title = "é" ,)
@misc{broken, title = {never closed
@misc{k3}
"""


def test_lexer_covers_every_byte_and_resolves_macros():
    blocks = lex.parse(HARD)
    raw = HARD.encode()
    assert b"".join(raw[b["start"] : b["end"]] for b in blocks) == raw
    entries = [b for b in blocks if b["kind"] == "entry"]
    assert [e["citation_key"] for e in entries] == ["k1", "k2", "k3"]
    assert [f["resolved"] for f in entries[0]["fields"]] == ["x {y} \\} z", "1999", 'A B {"}C', "January~1"]
    assert [b["code"] for b in blocks if b["kind"] == "failed"] == [lex.UNCLOSED]
    assert entries[1]["delimiter"] == "parenthesis" and entries[1]["trailing_comma"]


def test_macro_cycles_and_unknown_macros_stay_unresolved():
    blocks = lex.parse("@string{a = b}@string{b = a}@misc{k, x = a, y = nope, z = 1 # {2}}")
    assert [f["resolved"] for f in blocks[-1]["fields"]] == [None, None, "12"]


def test_macros_have_candidates_and_bounds():
    blocks = lex.parse("@string{a = {x}}@string{a = {y } # b}@string{b = {z}}@misc{k, t = a # b, u = jan, v = a # nope}")
    assert [(f["resolved"], f["candidates"], f["unresolved"]) for f in blocks[-1]["fields"]] == [("y zz", ["xz", "y zz"], []), ("January", ["January"], []), (None, [], ["nope"])]
    many = "".join(f"@string{{m{i} = m{i + 1} # m{i + 1}}}" for i in range(60)) + "@string{m60 = {ab}}@misc{k, x = m0, y = m50}"
    x, y = lex.parse(many)[-1]["fields"]
    assert x["resolved"] is None and len(y["resolved"]) == 2048
    loop = "".join(f"@string{{m{i} = m{i + 1} # m{(i + 7) % 40}}}" for i in range(40)) + "@misc{k, x = m0}"
    assert lex.parse(loop)[-1]["fields"][0]["resolved"] is None
    wide = "".join(f"@string{{w = {{{i}}}}}" for i in range(50)) + "@misc{k, x = w # w}"
    assert len(lex.parse(wide)[-1]["fields"][0]["candidates"]) == 32


def test_people_respect_braces():
    raws = lambda s: [p["raw"] for p in lex.people(s)]
    assert raws("{Barnes and Noble} and Ann Lee AND Bob") == ["{Barnes and Noble}", "Ann Lee", "Bob"]
    assert raws("Anderson and Sand") == ["Anderson", "Sand"] and raws(" and ") == [] and raws("A \\{ and B") == ["A \\{", "B"]
    parts = lambda s: tuple(lex.person(s)[k] for k in ("given", "prefix", "family", "suffix", "literal"))
    assert parts("{OpenSource Team}") == ([], [], [], [], "OpenSource Team")
    assert parts("van der Berg, Jr, Ann") == (["Ann"], ["van", "der"], ["Berg"], ["Jr"], None)
    assert parts("Ludwig van Beethoven") == (["Ludwig"], ["van"], ["Beethoven"], [], None)
    assert parts("Plato") == ([], [], ["Plato"], [], None) and parts("{A} and, {B, C}")[0] == ["{B,", "C}"]


def test_inline_comments_are_outside_values():
    b = "@misc{k, % note\n  title = {50% off}, % more\n  x = {1}\\% \n}".encode()
    block = next(x for x in lex.parse(b.decode()) if x["kind"] in ("entry", "failed"))
    found = lex.inline_comments(b, {"start": 0, "end": len(b), "fields": block.get("fields", [{"value_start": b.index(b"{50"), "value_end": b.index(b"}, % more") + 1}])})
    assert [b[c["start"] : c["end"]] for c in found] == [b"% note", b"% more"]


def test_lexer_never_fails_on_odd_sources():
    for s in ("", "@", "@a", "@a{", "@a{k", "@a{k,", "@a{k,x", "@a{k,x=", "@a{k,x={", '@a{k,x="', "@a{k,x=1", "@string{", "}{@", "@a{,x=1}", "\\@a{k}", "@a{k, x = {\\"):
        raw = s.encode()
        assert b"".join(raw[b["start"] : b["end"]] for b in lex.parse(s)) == raw


def test_normalizers(spark):
    row = spark.range(1).select(
        N.doi(F.lit("https://dx.doi.org/10.1234/ABC ")).alias("doi"), N.doi(F.lit("10.12/x")).alias("bad"), N.arxiv(F.lit("arXiv:2001.01234v3")).alias("ax"), N.issn(F.lit("1234-567x")).alias("issn"),
        N.month(F.lit("Sept.")).alias("m"), N.year(F.lit("99")).alias("y"), N.venue_alias(F.lit("Proceedings of the 12th  Conf of X, 2019")).alias("v"), N.title_for_display(F.lit("{A} \\{b\\}  c")).alias("t"),
        N.venue_alias(F.lit("Computational  Linguistics (Volume 2: Long Papers)")).alias("w"), N.doi_found(F.lit("see 10.1000/a.b), and 10.1000/A.B.")).alias("found"),
    ).first()
    assert (row.doi, row.bad, row.ax.base, row.ax.version, row.issn, row.m, row.y) == ("10.1234/abc", None, "2001.01234", "v3", "1234-567X", 9, None)
    assert (row.v, row.w, row.t) == ("conf of x", "computational linguistics", "A {b} c")
    assert row.found == ["10.1000/a.b"]


def test_fix_conflicts_and_application(spark):
    docs = spark.createDataFrame([(1, "abcdef"), (2, None)], "doc_id long, source string")
    edits = spark.createDataFrame([(1, "a", 1, 3, "X"), (1, "b", 2, 4, "Y"), (1, "b", 0, 0, "("), (1, "c", 5, 5, ","), (1, "d", 5, 5, ";")], "doc_id long, fix_id string, start long, end long, replacement string")
    assert fixes.conflicts(edits).count() == 2
    # the fix b goes as a whole, d touches an insertion that is already there
    assert sorted((r.doc_id, r.source, r.n_edits, r.problem) for r in fixes.apply(docs, edits).collect()) == [(1, "aXde,f", 2, None), (2, "", 0, None)]
    bad = spark.createDataFrame([(1, "a", 4, 9, "X")], "doc_id long, fix_id string, start long, end long, replacement string")
    assert [(r.source, r.n_edits, r.problem) for r in fixes.apply(docs.where("doc_id = 1"), bad).collect()] == [("abcdef", 0, "out_of_bounds")]


def test_plans_are_refused_with_a_reason(spark):
    docs = spark.createDataFrame([(i, "abcdef") for i in range(6)], "doc_id long, source string")
    fix = "doc_id long, fix_id string, applicability string, start long, end long, replacement string"
    found = spark.createDataFrame([(i, f, a, s, e, "x") for i in range(6) for f, a, s, e in (("f1", "safe", 0, 1), ("f2", "safe", 3, 4), ("f3", "unsafe", 3, 5))], fix)
    stale = docs.select("doc_id", F.when(F.col("doc_id") == 5, "sha256:0").otherwise(N.revision(F.col("source"))).alias("revision"))
    chosen = spark.createDataFrame([(0, ["f1", "f2"]), (1, ["f1", "f1"]), (2, ["f9"]), (3, ["f2", "f3"]), (4, ["f3"]), (5, ["f1"])], "doc_id long, ids array<string>")
    out = {r.doc_id: (r.problem, r.n_fixes) for r in fixes.planned(docs, found, stale, chosen).collect()}
    assert out == {0: (None, 2), 1: ("duplicate", 0), 2: ("unknown", 0), 3: ("overlap", 0), 4: (None, 1), 5: ("stale", 0)}


def test_safe_fixes_reach_a_fixed_point(spark):
    source = '@misc{k, TITLE="a",\n  year = "1\n2", doi="https://doi.org/10.1234/x"}'
    docs = spark.createDataFrame([(1, source), (2, "no entries"), (3, None)], "doc_id long, source string")
    out = {r.doc_id: r for r in fixes.fixed_point(docs).collect()}
    assert out[1].source == '@misc{k, title = {a},\n  year = {1 2}, doi = {10.1234/x},}' and out[1].status == "done" and out[1].passes >= 2
    assert (out[2].source, out[2].passes, out[3].passes) == ("no entries", 0, 0)
    assert fixes.fixed_point(docs.where("doc_id = 1"), most=1).first().status == "pass_limit"


def test_the_policy_names_every_code_and_meaning_blocks(spark):
    from bibspark.operators import identity, semrules

    source = "@string{m = {A}}\n@string{m = {B}}\n" + "\n".join(["@article{a, author = {and}, title = {t}, year = 2000, journal = nosuch}", "@book{b, author = {X}, title = m, year = 2000, date = {1999-01}, url = {nowhere}, eprint = {arXiv:2001.00001}, archiveprefix = {arXiv}}", "@misc{c, title = {x}, TITLE = {y},\n % note\n doi = {10.1234/a}, DOI = {10.1234/b}, eprint = {z1}, archiveprefix = {Zork}}", "@misc{c, title = {fine}, author = {Ann Lee}, year = 2000}"])
    entries = parse.entries(parse.blocks(spark.createDataFrame([(1, source), (2, "@misc{ok, title = {t}, author = {Ann Lee}, year = {2000},}"), (3, "@misc{p, title = {t}, author = {and}, year = {2000},}"), (4, "text only")], "doc_id long, source string")))
    registry = spark.createDataFrame([("hal", "HAL", "HAL", "^x$", "https://a/{identifier}")], "alias string, name string, archive_prefix string, pattern string, url_template string")
    given = {r["code"] for r in rules.found(entries, registry).select("code").distinct().collect()} | {r["code"] for r in semrules.findings(identity.repositories(identity.described(entries), registry)).select("code").distinct().collect()}
    assert given <= {c for c, *_ in rules.POLICY} and len(given) > 12
    got = {r["doc_id"]: r for r in rules.decision(entries, rules.validate(entries, rules.policy(spark), registry)).collect()}
    assert {d: r["accepted"] for d, r in got.items()} == {1: False, 2: True, 3: False}  # a document without records isn't listed
    assert got[3]["n_blocking"] >= 1


def test_incremental_fixes_equal_the_whole_way(spark):
    import random

    r = random.Random(9)
    fields = ['TITLE="a"', 'year = "1\n2"', 'doi="https://doi.org/10.1234/x"', "journal = ven", 'note = "two\n {x} lines"', "x = {y", 'Author = "é" # ven', "year = 3"]

    def entry(i):
        return f"@misc{{k{i}, " + ", ".join(r.choice(fields) for _ in range(r.randrange(5))) + r.choice(["}", ",}", ", % c\n}"])

    docs = [(i, r.choice(["", "text % @x\n", '@string{ven = {V} # "W"}\n']) + r.choice(["\n", "\n\n% note\n", " ", ""]).join(entry(j) for j in range(r.randrange(6)))) for i in range(60)] + [(60, None), (61, "no entries"), (62, HARD), (63, '@misc{k, TITLE="a",\n  year = "1\n2", doi="https://doi.org/10.1234/x"}')]
    frame = spark.createDataFrame(docs, "doc_id long, source string")
    whole = {x["doc_id"]: tuple(x) for x in fixes.fixed_point(frame).select("doc_id", "source", "passes", "n_edits", "status").collect()}
    got = {x["doc_id"]: x for x in fixes.incremental(frame).collect()}
    assert {d: tuple(x)[:5] for d, x in got.items()} == whole
    assert {x[2] for x in whole.values()} >= {0, 1, 2}
    limited = fixes.incremental(frame.where("doc_id = 63"), most=1).first()
    assert (limited["status"], limited["source"]) == ("pass_limit", fixes.fixed_point(frame.where("doc_id = 63"), most=1).first()["source"])


def test_one_edit_lexes_one_entry(spark):
    entries = [f"@misc{{k{i},\n  title = {{t{i}}},\n}}" for i in range(1000)]
    entries[500] = "@misc{k500,\n  TITLE = {t500},\n}"
    source = "\n\n".join(entries)
    out = fixes.incremental(spark.createDataFrame([(1, source)], "doc_id long, source string")).first()
    assert out["source"] == source.replace("TITLE", "title") and out["passes"] == out["n_edits"] == 1
    assert out["lexed"] == len(source) + len(entries[500])


def test_validation_order_and_policy(spark):
    docs = spark.createDataFrame([(1, "@article{k, TITLE = \"x\", title = {y}, year={1}}")], "doc_id long, source string")
    out = rules.validate(parse.entries(parse.blocks(docs)), rules.policy(spark)).orderBy("place").collect()
    assert [r.code for r in out] == ["BIB-SEMANTIC-003", "BIB-SYNTAX-002", "BIB-SYNTAX-005", "BIB-SYNTAX-005", "BIB-SYNTAX-001", "BIB-SYNTAX-006", "BIB-SYNTAX-004"]
    assert rules.validate(parse.entries(parse.blocks(docs)), rules.policy(spark, [("BIB-SYNTAX-004", "hint", False, False)])).count() == 0


def test_search_tests_query_and_author_on_one_row(spark):
    refs = spark.createDataFrame([(1, "t", "k", "v", "e", 2000, None)], "id long, title string, citation_key string, venue string, entry_type string, year int, updated_at timestamp_ntz")
    people = spark.createDataFrame([(1, "Ann"), (1, "Bob")], "id long, display_name string")
    assert library.search(refs, people, query="ann", author="ANN").count() == 1
    assert library.search(refs, people, query="ann", author="bob").count() == 0
    assert library.search(refs, people, query="%").count() == 0


def test_extract(spark):
    rows = spark.createDataFrame([("a\n```bib\n@x{<http://u|l>&amp;}\n```",), ("```a``` ```b```",), (None,)], "m string").select(extract.code_block(F.col("m")).alias("b")).collect()
    assert [r.b for r in rows] == ["@x{http://u&}\n", None, None]


def test_keys_are_unique(spark):
    wanted = spark.createDataFrame([(1, i, "same") for i in range(20)], "doc_id long, rec long, base string")
    keys = [r.key for r in resolve.assign_keys(wanted).collect()]
    assert len(set(keys)) == 20 and "same" in keys


def test_stream_matches_batch(spark, tmp_path):
    from bibspark import streaming

    at = datetime.datetime(2024, 1, 1)
    rows = [(i, at + datetime.timedelta(minutes=i), i % 3) for i in range(100)] + [(200, at + datetime.timedelta(days=2), 0)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, k long")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streaming.source(spark, str(tmp_path / "in"), df)
    got = streaming.drain(streaming.windowed(stream, "ts", ["k"], "10 minutes", "1 minute"), "w", "complete")
    expected = df.groupBy(F.window("ts", "10 minutes"), "k").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "k", "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))
    assert streaming.drain(streaming.deduplicated(streaming.source(spark, str(tmp_path / "in"), df), "ts", ["k"], "1 hour"), "d").count() >= 3


def test_token_bucket_orders_by_time(spark):
    at = datetime.datetime(2024, 1, 1)
    ev = spark.createDataFrame([(i, 1, at + datetime.timedelta(seconds=s)) for i, s in enumerate((0, 0, 1, 10))], "event_id long, user_id long, ts timestamp_ntz")
    out = events.token_bucket(ev, "user_id", "ts", "event_id", 0.1, 1.0).orderBy("event_id").collect()
    assert [(r.allowed, r.retry_after) for r in out] == [(True, 0), (False, 10), (False, 9), (True, 0)]


def _whole_groups(df):
    return "FlatMapGroupsInPandas" in df._jdf.queryExecution().executedPlan().toString()


def test_first_seen_streams_hot_keys(spark):
    at = datetime.datetime(2024, 1, 1)
    rows = [(i, 1, "a", at + datetime.timedelta(seconds=s)) for i, s in enumerate((0, 5, 9, 10, 19, 20, 20, 31))] + [(90, 2, "a", at), (91, None, "b", at), (92, None, "b", at), (93, 3, None, at)]
    ev = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp_ntz")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        out = events.first_seen(ev, ["user_id", "event_type"], "ts", "event_id", 10)
        assert not _whole_groups(out)
        assert [r.event_id for r in out.where("fresh").orderBy("event_id").collect()] == [0, 3, 5, 7, 90, 91, 93]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_keys_stream_over_batches(spark):
    wanted = spark.createDataFrame([(d, i, f"b{i % 4}") for d in (1, 2) for i in range(20)], "doc_id long, rec long, base string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        out = resolve.assign_keys(wanted)
        assert not _whole_groups(out)
        rows = out.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len({(r.doc_id, r.key) for r in rows}) == 40
    assert sorted((r.doc_id, r.rec) for r in rows if "-" not in r.key) == [(d, i) for d in (1, 2) for i in range(4)]


def test_shortlist_counts_every_token(spark):
    import random
    from collections import Counter

    from bibspark.operators import resolve

    r = random.Random(4)
    words = ["the"] * 30 + [f"w{i}" for i in range(40)]
    sides = [[(i, sorted({r.choice(words) for _ in range(r.randrange(0, 9))})) for i in range(n)] for n in (60, 300)]
    frames = [spark.createDataFrame(x, "id long, tokens array<string>").repartition(3) for x in sides]
    expected = {}
    for l, ts in sides[0]:
        shared = Counter({rid: len(set(ts) & set(other)) for rid, other in sides[1]})
        expected[l] = sorted(((-n, rid) for rid, n in shared.items() if n))[:7]
    for block, span in ((2000, 100_000), (9, 40)):
        got = {}
        for row in resolve.shortlist(*frames, 7, block, span).orderBy("rank").collect():
            got.setdefault(row["l"], []).append((-row["shared"], row["r"]))
        assert got == {k: v for k, v in expected.items() if v}


def test_shortlist_draws_its_ranges_once(spark, monkeypatch):
    from bibspark.operators import blocking, resolve

    drawn = []

    def moving(rows, span):
        drawn.append(100 + 37 * len(drawn))  # quantiles found anew may differ
        return drawn[-1:], rows.withColumn("rng", (F.col("id") > drawn[-1]).cast("int"))

    monkeypatch.setattr(blocking, "bordered", moving)
    left = spark.createDataFrame([(1, ["a"])], "id long, tokens array<string>")
    right = spark.range(300).select("id", F.array(F.lit("a")).alias("tokens"))
    assert sorted(r["r"] for r in resolve.shortlist(left, right, 120).collect()) == list(range(120))


def test_lists_of_classes_match_plain_counts(spark, monkeypatch):
    import random

    from bibspark.operators import blocking, resolve

    r = random.Random(9)
    common, seen, plain = [f"c{i}" for i in range(4)], [], blocking.shortlist

    def side(n, rare):
        return [(i, sorted({r.choice(common) for _ in range(r.randrange(0, 3))} | {f"{rare}{r.randrange(60)}" for _ in range(r.randrange(0, 2))} | {f"w{r.randrange(40)}" for _ in range(r.randrange(0, 3))}), f"x{i}") for i in range(n)]

    left, right = side(150, "l"), side(400, "r")
    expected = {}
    for i, ts, _ in left:
        best = sorted((-len(set(ts) & set(other)), k, x) for k, other, x in right if set(ts) & set(other))[:30]
        if best:
            expected[i] = best

    def counted(a, b, *more):
        seen.append((a.count(), b.count()))
        return plain(a, b, *more)

    monkeypatch.setattr(blocking, "shortlist", counted)
    frames = [spark.createDataFrame(x, "id long, tokens array<string>, " + n) for x, n in ((left, "own string"), (right, "x string"))]
    for rare, listed in ((8, 100_000), (8, 0), (0, 100_000), (1000, 100_000)):
        monkeypatch.setattr(resolve, "RARE", rare)
        monkeypatch.setattr(resolve, "LISTED", listed)
        got = {x["id"]: (x["own"], [tuple(f) for f in x["found"]]) for x in resolve.shortlists(*frames, 30).collect()}
        assert got == {i: (f"x{i}", best) for i, best in expected.items()}
    monkeypatch.setattr(resolve, "RARE", 8)
    # copies: 500 references and 900 records of two titles are two classes, and of each class 30 records
    copies = [spark.range(n).select("id", F.when(F.col("id") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"), F.lit("c"))).alias("tokens")) for n in (500, 900)]
    got = resolve.shortlists(*copies, 30).select("id", "found.id").collect()
    assert seen[-1] == (2, 60)
    assert len(got) == 500 and all(sorted(x[1]) == [k for k in range(x[0] % 2, 60, 2)] for x in got)


def test_scores_match_plain_loops(spark):
    import difflib

    from bibspark.operators import reconstruct, resolve

    titles = ["Deep parsing of trees", "Deep parsing of {Trees}", "Parsing deep forests", "Zebra", "the of and", "A study of bees", "Another study of bees"]
    refs = [(i, t, f"Lee {i % 2}", 2000 + i % 3, None) for i, t in enumerate(titles)]
    recs = [(10 + i, "arxiv", t.upper() if i % 2 else t + " extended", "Lee 1", 2001, None) for i, t in enumerate(titles)]
    got = {(x["ref_id"], x["record_id"]): x["score"] for x in reconstruct.scored(spark.createDataFrame(refs, "ref_id long, title string, authors string, year int, doi string"), spark.createDataFrame(recs, "record_id long, source string, title string, authors string, year int, doi string")).collect()}
    key = resolve.comparison_text
    found = lambda t: {w for w in key(t).split() if len(w) >= 3 and w not in resolve.SEARCH_STOP_WORDS}
    expected = {}
    for i, t, a, *_ in refs:
        exact = [x for x in recs if key(x[2]) == key(t)]
        scan = [max(recs, key=lambda x: (difflib.SequenceMatcher(None, key(t), key(x[2])).ratio(), -x[0]))]
        for rid, _, other, *_ in exact or [x for x in recs if found(t) & found(x[2])] or scan:
            ratio = difflib.SequenceMatcher(None, key(t), key(other)).ratio()
            mine, theirs = set(a.lower().split()) - {"0", "1"}, {"lee"}
            expected[i, rid] = round(0.7 * ratio + 0.3 * len(mine & theirs) / len(mine | theirs) if ratio else 0.0, 6)
    assert got == expected
    left = spark.createDataFrame([(4, titles[4])], "id long, title string")
    best = resolve.best_of_all(left, spark.createDataFrame([(x[0], x[2]) for x in recs], "id long, title string")).collect()
    assert [(b["l"], b["r"]) for b in best] == [(4, max((difflib.SequenceMatcher(None, key(titles[4]), key(x[2])).ratio(), -x[0]) for x in recs)[1] * -1)]


def test_sweep_finds_every_conflict(spark):
    import random
    import time

    r = random.Random(6)
    rows = [(d, f"f{r.randrange(40):02}", s, s + r.choice([0, 0, 1, 2, 9])) for d in range(3) for s in (r.randrange(30) for _ in range(60))]
    expected = []
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            touch = a[2] == a[3] == b[2] == b[3]
            if a[0] == b[0] and a[1] != b[1] and (touch or (a[2] < b[3] and b[2] < a[3])):
                x, y = sorted((a[1:], b[1:]))
                expected.append((a[0], *x, *y))
    schema = "doc_id long, fix_id string, start long, end long"
    assert sorted(map(tuple, fixes.conflicts(spark.createDataFrame(rows, schema)).collect())) == sorted(expected)
    many = spark.range(200_000).select(F.lit(1).alias("doc_id"), F.concat(F.lit("f"), "id").alias("fix_id"), (F.col("id") * 3).alias("start"), (F.col("id") * 3 + 2).alias("end"))
    began = time.time()
    assert fixes.conflicts(many).count() == 0
    assert time.time() - began < 30


def test_fix_ids_keep_numbers_apart_and_in_order(spark):
    numbers = [0, 9, 10, 9999, 10_000, 10_001, 99_999, 100_000, 1_000_000]
    rows = spark.createDataFrame([(n,) for n in numbers], "n long")
    assert [r["n"] for r in rows.orderBy(fixes.fix_id(F.lit("C"), F.lit(1), F.col("n"))).collect()] == numbers
    big = [1, 999_999_999, 1_000_000_000, 20_000_000_000]
    assert [r["n"] for r in spark.createDataFrame([(n,) for n in big], "n long").orderBy(fixes.fix_id(F.lit("C"), F.col("n"), F.lit(0))).collect()] == big


def test_cycles_of_any_length(spark):
    from bibspark.operators import semrules

    rows = [(f"p{i}", f"p{(i + 1) % 130}") for i in range(130)] + [(f"q{i}", f"q{i + 1}") for i in range(300)] + [("r", "p0"), ("own", "own"), ("a", "b"), ("b", "a"), ("none", None)]
    got = {r["profile"] for r in semrules.inheritance_cycles(spark.createDataFrame(rows, "profile string, parent string")).collect()}
    assert got == {f"p{i}" for i in range(130)} | {"own", "a", "b"}
    assert semrules.inheritance_cycles(spark.createDataFrame([("x", None)], "profile string, parent string")).count() == 0


def test_near_titles_match_a_loop_over_all_pairs(spark):
    import difflib

    from bibspark.operators import resolve
    from bibspark.plans import more

    def authors(x):
        return {w for w in "".join(c if c.isalnum() else " " for c in (x or "").lower()).split() if len(w) >= 2}

    refs, recs = more.title_rows(spark, SF).collect(), more.found_title_rows(spark, SF).collect()
    keys = [(x, resolve.comparison_text(x["title"]), authors(x["authors"])) for x in recs]
    search = [{w for w in k.split() if len(w) >= 3 and w not in resolve.SEARCH_STOP_WORDS} for _, k, _ in keys]
    expected = {}
    for ref in refs:
        key, mine = resolve.comparison_text(ref["title"]), authors(ref["authors"])
        if not key:
            continue
        words = {w for w in key.split() if len(w) >= 3 and w not in resolve.SEARCH_STOP_WORDS}
        some = [i for i, (_, k, _) in enumerate(keys) if k == key]
        if not some:
            shared = sorted((-len(words & search[i]), x["record_id"], i) for i, (x, _, _) in enumerate(keys) if words & search[i])
            some = [i for *_, i in shared[:200]]
        if not some:
            some = [max(range(len(keys)), key=lambda i: (difflib.SequenceMatcher(None, key, keys[i][1]).ratio() if keys[i][1] else 0.0, -keys[i][0]["record_id"]))]
        for i in some:
            x, k, theirs = keys[i]
            t = difflib.SequenceMatcher(None, key, k).ratio() if k else 0.0
            score = round(0.0 if t == 0 else 0.7 * t + 0.3 * len(mine & theirs) / len(mine | theirs) if mine and theirs else t, 6)
            if score >= 0.6:
                consistent = ref["year"] == x["year"] and (not mine or len(mine & theirs) / len(mine | theirs) >= 0.5)
                expected[ref["ref_id"], x["record_id"]] = (score, consistent, "match" if score >= 0.8 else "weak")
    got = {(x["ref_id"], x["record_id"]): (x["score"], x["consistent"], x["status"]) for x in more.jon11_near_titles(spark, SF).collect()}
    assert got == expected
    assert {x[2] for x in got.values()} == {"match", "weak"} and any(r // 10 != l for l, r in got)


def test_bounds_never_pass_below_a_ratio():
    import difflib
    import random

    import numpy as np
    from bibspark.functions import gestalt

    r = random.Random(8)
    texts = ["", "a", "é🙂", *("".join(r.choice("abcde f") for _ in range(r.randrange(1, 40))) for _ in range(80))]
    most = gestalt.bounds(gestalt.profiles(texts)[:, None], gestalt.profiles(texts)[None])
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            ratio = difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0
            assert ratio <= most[i, j] + 1e-12
            assert 2 * gestalt.common_subsequence(gestalt.places(b), len(b), a) + 1e-9 >= ratio * (len(a) + len(b))
            for least in (0.0, ratio, ratio + 1e-9, 0.9):
                known = gestalt.Ratio(b).at_least(a, least)
                assert known == ratio or (known == -1 and ratio < least)
    assert np.all(most >= 0)


def test_matching_rules(spark):
    from bibspark.operators import reconstruct
    from pyspark.sql import functions as F

    pairs = spark.createDataFrame([(1, "10.1/a", "10.1/a", 0.0, "A Lee", "B Ray", 2000, 2005), (2, "10.1/a", "10.1/b", 1.0, "A Lee", "A Lee", 2000, 2000), (3, None, "10.1/b", 0.8, "A Lee", "Lee, Ann", 2000, 2000), (4, None, None, 0.79, "A Lee", "A Lee", 2000, 2000), (5, None, None, 0.9, "A Lee", "B Ray", 2000, 2000), (6, None, None, 0.9, "", "B Ray", None, 2000), (7, None, None, 0.9, "", "B Ray", 1999, 2000)], "id int, doi string, r_doi string, t double, authors string, r_authors string, year int, r_year int")
    assert {r["id"] for r in pairs.where(reconstruct.local_match(pairs)).collect()} == {1, 3, 6}
    found = spark.createDataFrame([(1, "10.1/a", "10.1/a", "t", 0.9), (2, "10.1/a", None, "t", 0.9), (3, "10.1/a", "10.1/b", "t", 0.9), (4, "10.1/a", "10.1/a", None, 0.0), (5, "10.1/a", "10.1/a", "t", 0.5)], "id int, wanted_doi string, doi string, title string, t double")
    assert [r["reason"] for r in reconstruct.evidence(found).orderBy("id").collect()] == [None, "doi_missing", "doi_mismatch", "title_missing", "title_mismatch"]
    tries = spark.createDataFrame([(1, 1, False, True, False), (1, 2, True, True, False), (1, 3, True, True, False), (2, 1, True, True, True), (2, 2, True, True, False), (3, 1, True, False, False)], "ref_id int, ord int, accepted boolean, complete boolean, conflict boolean")
    assert [tuple(r) for r in reconstruct.first_final(tries).collect()] == [(1, 2)]
    basics = spark.createDataFrame([(1, i, x) for i, x in enumerate([0.5, 0.95, 0.2, 0.97, 0.1])] + [(2, i, 0.5) for i in range(5)], "ref_id int, record_id int, score double")
    assert sorted((r["ref_id"], r["record_id"]) for r in reconstruct.details_to_fetch(basics).collect()) == [(1, 3), (2, 0), (2, 1), (2, 2)]
    groups = spark.createDataFrame([(1, 2, "deep trees", "lee", ["other", "deep trees"], [["kim"], ["lee"]])], "l int, r int, title string, authors string, titles array<string>, groups array<array<string>>")
    assert reconstruct.group_score(groups).first()["score"] == 1.0
    asked = reconstruct.providers_to_ask(spark.createDataFrame([(1, "see arXiv:2001.00001"), (2, "plain"), (3, None)], "ref_id int, text string"), spark.createDataFrame([("crossref", 0), ("arxiv", 1)], "source string, ord int"))
    assert sorted((r["ref_id"], r["source"]) for r in asked.collect()) == [(1, "arxiv"), (2, "arxiv"), (2, "crossref"), (3, "arxiv"), (3, "crossref")]


def keyed_events(n, seed):
    import random

    r, out = random.Random(seed), []
    for i in range(n):
        kind = r.choice(["request", "verify", "verify", "verify", "create", "consume", "consume"])
        out.append((r.choice(["a", "b", "c", None]), r.randrange(4000) * 1_000_000 + r.randrange(3), i, kind, r.choice(["u1", "u2"]), r.choice(["x", "y"])))
    return out


def test_challenges_and_pending_requests(spark):
    from bibspark.streaming import states

    s = 1_000_000
    rows = [("a", 0, 0, "verify", "u", "x"), ("a", 1 * s, 1, "request", "u", "x"), ("a", 61 * s, 2, "request", "u", "y"), ("a", 62 * s, 3, "request", "u", "z"), ("a", 63 * s, 4, "verify", "u", "x"), ("a", 64 * s, 5, "verify", "u", "z"), ("a", 65 * s, 6, "verify", "u", "z")]
    rows += [("b", 0, 10, "request", "u", "x")] + [("b", k * s, 10 + k, "verify", "u", "no") for k in range(1, 7)] + [("c", 0, 20, "request", "u", "x"), ("c", 600 * s, 21, "verify", "u", "x"), ("d", 0, 30, "request", "u", "x"), ("d", 599 * s, 31, "verify", "u", "x"), ("d", 599 * s, 32, "other", "u", "x")]
    got = {r["id"]: r["status"] for r in states.fold(spark.createDataFrame(rows, states.EVENT), "challenge").collect()}
    assert got == {0: "none", 1: "accepted", 2: "cooldown", 3: "accepted", 4: "wrong", 5: "ok", 6: "none", 10: "accepted", 11: "wrong", 12: "wrong", 13: "wrong", 14: "wrong", 15: "ended", 16: "none", 20: "accepted", 21: "none", 30: "accepted", 31: "ok", 32: "unknown"}
    rows = [("r", 0, 0, "consume", "u", None), ("r", s, 1, "create", "u", None), ("r", 2 * s, 2, "consume", "v", None), ("r", 3 * s, 3, "consume", "u", None), ("r", 4 * s, 4, "consume", "u", None), ("q", 0, 5, "create", "u", None), ("q", 900 * s, 6, "consume", "u", None)]
    got = {r["id"]: r["status"] for r in states.fold(spark.createDataFrame(rows, states.EVENT), "pending").collect()}
    assert got == {0: "expired", 1: "created", 2: "wrong_user", 3: "ok", 4: "expired", 5: "created", 6: "expired"}


def test_streams_of_keyed_events_equal_the_fold(spark, tmp_path):
    import random

    from bibspark import streaming
    from bibspark.streaming import states

    rows = keyed_events(300, 5)
    random.Random(1).shuffle(rows)
    end = [("~", 100_000 * 1_000_000, 10_000, "end", None, None)]  # lets the watermark pass all others
    frame = spark.createDataFrame(rows + end, states.EVENT).where("key is not null")
    folder = str(tmp_path / "in")
    for part in (rows[:120], rows[120:], end):
        spark.createDataFrame(part, states.EVENT).where("key is not null").coalesce(1).write.mode("append").parquet(folder)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    for what in ("challenge", "pending"):
        expected = sorted(map(tuple, states.fold(frame, what).where("key <> '~'").collect()))
        source = spark.readStream.schema(states.EVENT).option("maxFilesPerTrigger", 1).parquet(folder)
        try:
            got = streaming.drain(states.stream(source, what, "2 hours"), f"keyed_{what}")
            assert sorted(map(tuple, got.where("key <> '~'").collect())) == expected
        finally:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_profiles_write_records_or_say_what_stands_in_the_way(spark):
    from bibspark.operators import identity, profiles

    source = "\n".join([
        "@string{v = {A}}\n@string{v = {B}}",
        "@article{a1, title = {R & D of {{{{DNA}}}}}, author = {Lee, Ann and {Group and Co}}, year = 2000, month = mar, journal = {J_1}, doi = {10.1234/x_y}, note = {50% off}, keywords = {k}}",
        "@book{b1, title = {{Whole}}, author = {van der Berg, Bob}, year = 1999, url = {https://a.org/x_y}}",
        "@misc{p1, title = {Pre}, author = {Ann Lee}, year = 2021, eprint = {2101.00001}, archiveprefix = {arXiv}}",
        "@misc{bad key, title = {x}}", "@misc{u1, title = nosuch}", "@misc{d1, title = {x}, date = {someday}}", "@misc{m1, title = v}", "@misc{t1, title = {x}, TITLE = {y}}",
        "@misc{c1, title = {x}, year = 2000, date = {1999-01}}", "@misc{o1, title = {x}, author = {and}}", "@zork{z1, title = {x}, author = {Ann Lee}}",
    ])
    docs = spark.createDataFrame([(1, source)], "doc_id long, source string")
    rows = profiles.profile_frame(spark, [
        {"profile": "plain", "protected": []},
        {"profile": "journal", "field_order": ["Author", "title"], "deny": ["keywords", "note"], "renames": {"journal": "journaltitle"}, "month_format": "macro", "types": ["article", "misc"], "indent": "\t", "trailing_comma": False, "representation": "misc-howpublished"},
        {"profile": "clash", "renames": {"doi": "note"}, "quotes": True, "include_extra": False, "allow": ["title", "author", "note", "year"], "include_url": False},
    ])
    got = {(r["profile"], r["key"]): r for r in profiles.exported(identity.described(parse.entries(parse.blocks(docs))).withColumn("detail", F.lit(1)).drop("detail"), rows).join(parse.entries(parse.blocks(docs)).select("doc_id", "entry_idx", F.col("citation_key").alias("key")), ["doc_id", "entry_idx"]).collect()}
    assert got["plain", "a1"]["bibtex"] == "@article{a1,\n  author = {Lee, Ann and {Group and Co}},\n  doi = {10.1234/x_y},\n  journal = {J\\_1},\n  keywords = {k},\n  month = {3},\n  note = {50\\% off},\n  title = {R \\& D of DNA},\n  year = {2000},\n}\n"
    assert got["journal", "a1"]["bibtex"] == "@article{a1,\n\tauthor = {Lee, Ann and {Group and Co}},\n\ttitle = {{R \\& D of DNA}},\n\tdoi = {10.1234/x_y},\n\tjournaltitle = {J\\_1},\n\tmonth = mar,\n\tyear = {2000}\n}\n"
    assert got["clash", "b1"]["bibtex"] == '@book{b1,\n  author = "van der Berg, Bob",\n  title = "{Whole}",\n  year = "1999",\n}\n'
    assert got["journal", "p1"]["bibtex"] == "@misc{p1,\n\tauthor = {Lee, Ann},\n\ttitle = {{Pre}},\n\thowpublished = {arXiv:2101.00001},\n\tyear = {2021}\n}\n"
    assert "  url = {https://a.org/x_y},\n" in got["plain", "b1"]["bibtex"]
    why = lambda p, k: (got[p, k]["reason"], got[p, k]["detail"])
    assert [why("plain", k) for k in ("u1", "d1", "m1", "t1", "c1", "o1", "z1")] == [("unresolved", "title"), ("date", "someday"), ("ambiguous", "title"), ("ambiguous", "title"), ("conflict", "date"), ("uncertain", "author"), ("unknown_type", "zork")]
    assert why("journal", "b1") == ("unsupported_type", "book")
    assert got["plain", "u1"]["bibtex"] is None


def test_strict_export_checks_its_output(spark):
    from bibspark.operators import identity, profiles

    docs = spark.createDataFrame([(1, "@misc{a, title = {t}, author = {Ann Lee}, year = {2000},}"), (2, "@misc{a, author = {Ann Lee}, title = {t}, title = {t}}"), (3, "@zork{a, title = {t}, author = {Ann Lee}, year = {2000},}")], "doc_id long, source string")
    entries = parse.entries(parse.blocks(docs))
    rows = profiles.profile_frame(spark, [{"profile": "good"}, {"profile": "upper", "renames": {"title": "TITLE"}}])
    policy = rules.policy(spark, [("BIB-SYNTAX-001", "error", True, True), ("BIB-SYNTAX-002", "error", True, True)])
    got = {(r["profile"], r["doc_id"]): (r["status"], r["codes"], r["source"] is not None) for r in profiles.strict(entries, identity.described(entries), rows, policy).collect()}
    assert got == {("good", 1): ("exported", "", True), ("upper", 1): ("output_blocked", "BIB-SYNTAX-002", False), ("good", 2): ("input_blocked", "BIB-SYNTAX-001", False), ("upper", 2): ("input_blocked", "BIB-SYNTAX-001", False), ("good", 3): ("not_exported", "unknown_type", False), ("upper", 3): ("not_exported", "unknown_type", False)}


def test_feeds_with_entities_sections_and_markup(spark):
    from bibspark.operators import records

    entry = lambda body: f"<entry><id> urn:1 </id><title type='html'>{body}</title><author><name>Ann &amp; Co</name></author><author><name>B&#233;</name></author></entry>"
    feeds = [f"<feed xmlns='http://www.w3.org/2005/Atom' xmlns:x='urn:x'>{entry(b)}</feed>" for b in ("<![CDATA[A & B <i>]]>", "a &quot;b&quot; &#233; &lt;c&gt;", "x <x:i>nested <b>deep</b></x:i> y\n z", "")]
    feeds += ["<!DOCTYPE feed><feed/>", "<feed><entry></feed>", None, "<feed/>", "<feed><entry/></feed>"]
    rows = spark.createDataFrame(list(enumerate(feeds)), "i int, xml string").select("i", records.feed_entries("xml").alias("x")).orderBy("i").collect()
    got = [None if r["x"] is None else [(e["id"], e["title"], e["authors"]) for e in r["x"]] for r in rows]
    people = ["Ann & Co", "Bé"]
    assert got == [[("urn:1", "A & B <i>", people)], [("urn:1", 'a "b" é <c>', people)], [("urn:1", "x nested deep y z", people)], [("urn:1", None, people)], None, None, None, [], [(None, None, [])]]


def test_reference_lists_end_at_the_next_section(spark):
    from bibspark.operators import citations

    texts = {
        1: "Intro\nReferences\n[1] Lee, Ann. Deep trees. 2001.\n  goes on\n2) Ray, Bob. Shallow trees. 2002.\n\nshort\nAppendix\n[3] Not this one at all.",
        2: "References\nLee, A. B. and van Ray, C. 2001a. On trees. In Forests.\n Doe, J. 1999. Two words here.",
        3: "no list here\nAppendix",
        4: "References\nOne entry that no year of its own parts, and goes on.",
        5: "References\nAppendix right after the header\nAppendix",
    }
    lines = extract.lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    got = [(r["doc_id"], r["entry"], r["text"]) for r in extract.references(extract.reference_block(lines, citations.HEADER)).orderBy("doc_id", "entry").collect()]
    assert got == [
        (1, 1, "Lee, Ann. Deep trees. 2001. goes on"), (1, 2, "Ray, Bob. Shallow trees. 2002."),
        (2, 1, "Lee, A. B. and van Ray, C. 2001a. On trees. In Forests."), (2, 2, "Doe, J. 1999. Two words here."), (4, 1, "One entry that no year of its own parts, and goes on."), (5, 1, "Appendix right after the header"),
    ]


def test_syntax_codes_and_strict_mode(spark):
    from bibspark.plans import bibtex

    rows = [(i, x.encode()) for i, (x, _) in enumerate(bibtex.DAMAGE)] + [(50, b"@misc{a, b = {c}}"), (51, b"\xff@misc{"), (52, None), (53, b"@misc{a b, c = 1}"), (54, b"@misc{d, = {x}}\n@misc{e, = {x}}"), (55, b"@misc{key"), (56, b"@preamble{1 2}")]
    docs = spark.createDataFrame(rows, "doc_id long, source binary")
    got = {r["doc_id"]: (r["accepted"], r["codes"]) for r in parse.strict(docs).collect()}
    code = lambda n: (n is None, f"BIB-SYNTAX-{n}" if n else "")
    assert got == {i: code(c) for i, (_, c) in enumerate(bibtex.DAMAGE)} | {50: code(None), 51: code("112"), 52: code(None), 53: code("107"), 54: code("104"), 55: code("109"), 56: code("108")}
    places = parse.diagnostics(docs.where("doc_id = 54")).orderBy("start").collect()
    assert [(r["start"], r["end"], r["message"]) for r in places] == [(9, 10, "expected field name"), (25, 26, "expected field name")]
    tolerant = parse.blocks(docs.where("doc_id = 1").select("doc_id", F.col("source").cast("string").alias("source"))).where("kind = 'entry'").first()
    assert [f["name"] for f in tolerant["fields"]] == ["a", "b"]  # what the strict mode refuses is repaired


def test_required_fields_broadcast_the_policy(spark):
    entries = parse.entries(parse.blocks(spark.createDataFrame([(1, "@misc{a, title = {x}}\n@misc{b, Year = 1, author = {y}, title = {z}}\n@book{c, }")], "doc_id long, source string")))
    required = spark.createDataFrame([("misc", "year", 1), ("misc", "author", 0), ("misc", "title", 2), ("article", "year", 0)], "entry_type string, lname string, ord int")
    found = rules.missing_required(entries, required)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan and "SortMergeJoin" not in plan
    assert [tuple(x) for x in found.collect()] == [(1, 0, "author, year")]


def test_tasks_hold_a_bounded_number_of_blocks():
    import pyarrow as pa

    class Docs:
        """Keeps the function that a task runs."""

        columns = ("doc_id", "source")

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            return run

    source = "".join(f"@misc{{k{i}, title = {{x}}}}\n" for i in range(20))
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array([source] * 300)], ["doc_id", "source"])
    out = list(parse.blocks(Docs())(iter([batch])))
    assert max(b.num_rows for b in out) <= 1000
    assert [b["block_idx"] for b in pa.Table.from_batches(out).select(["block_idx"]).to_pylist()][:2] == [0, 1]
    entries = [r for b in out for r in b.select(["doc_id", "entry_idx", "kind"]).to_pylist() if r["kind"] == "entry"]
    assert [(r["doc_id"], r["entry_idx"]) for r in entries] == [(d, i) for d in range(300) for i in range(20)]
    assert [len(x) for x in parse.bounded(["a" * 600_000] * 3 + ["b"], len)] == [2, 2]
