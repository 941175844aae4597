import gzip

from bibspark.functions import tex
from bibspark.sources import files


def test_bib_files_round_trip(spark, tmp_path):
    (tmp_path / "a.bib").write_text("@misc{a, title = {é}}\n")
    with gzip.open(tmp_path / "b.bib.gz", "wt") as f:
        f.write("@misc{b}\n")
    docs = files.read_bib(spark, str(tmp_path / "a.bib"), str(tmp_path / "b.bib.gz"))
    assert [(r.doc_id, r.source) for r in docs.orderBy("doc_id").collect()] == [(0, "@misc{a, title = {é}}\n"), (1, "@misc{b}\n")]
    files.write_bib(spark.createDataFrame([("@misc{a}",), ("@misc{b}",)], "bibtex string").coalesce(1), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out"), wholetext=True).first().value == "@misc{a}\n\n@misc{b}\n\n"


def test_extraction_takes_known_keys_and_counts_again(spark):
    rows = spark.createDataFrame([('{"file_name": "f", "reference_count": 9, "references": [{"title": "t", "x": 1}]}',), ("not json",), (None,)], "payload string")
    assert [(r.file_name, r.reference_count) for r in files.extraction(rows).collect()] == [("f", 1), (None, 0), (None, 0)]


def test_backup_and_restore(spark, tmp_path):
    files.backup({"t": spark.range(5)}, str(tmp_path / "b"))
    assert files.restore(spark, str(tmp_path / "b"), ["t"])["t"].count() == 5


def test_tex_contexts():
    assert tex.specials(r"a % \% {b_c} \emph{d_e}") == [(2, "%", "plain"), (9, "_", "plain"), (20, "_", "command")]
    assert tex.specials(r"$a_b$ $c") == [(2, "_", "math"), (6, "$", "plain")]
    assert tex.specials(r"{$x} y$") == [(1, "$", "command")[:2] + ("plain",), (6, "$", "plain")]
    assert tex.specials(r"\verb|%| \url{a%{b_}} \(x^2\) ^") == [(15, "%", "url"), (18, "_", "url"), (25, "^", "math"), (30, "^", "plain")]
    for odd in ("", "\\", "{", "}", "$", "$$", "\\verb", "\\verb|", "\\(", "}{$}\\]", "\\emph", "a\\"):
        assert isinstance(tex.escaped(odd), str)
    assert tex.escaped("50% & a_b\n c $x_1$ #") == r"50\% \& a\_b c $x_1$ \#"


def test_tex_scanner_is_linear():
    import time

    began = time.time()
    tex.specials("{" * 20_000 + "a_b$" * 20_000)
    assert time.time() - began < 20


def test_settings_are_read_from_toml(spark, tmp_path):
    from bibspark.operators import generate, semrules
    from bibspark.sources import files

    (tmp_path / "a.toml").write_text('profile = "b"\nfield_order = ["title", "title"]\nindent = "x"\nsupported_entry_types = []\n[field_renames]\na = "c"\nb = "c"\n')
    (tmp_path / "b.toml").write_text('profile = "a"\nfield_order = ["title"]\nsupported_entry_types = ["misc"]\n')
    rows = files.profile_rows(spark, files.read_toml(spark, str(tmp_path)))
    assert [r.profile for r in rows.collect()] == ["a", "b"]
    assert sorted(tuple(r) for r in generate.profile_problems(rows).collect()) == [("b", "indent"), ("b", "no types"), ("b", "repeated field"), ("b", "repeated rename")]
    (tmp_path / "r.toml").write_text("[[repositories]]\nid = 'hal'\nfull_name = 'HAL'\naliases = ['Hal Archive']\narchive_prefix = 'HAL'\nidentifier_pattern = '^hal-[0-9]+$'\nurl_template = 'https://hal.science/{identifier}'\n")
    registry = files.repository_rows(spark, files.read_toml(spark, str(tmp_path / "r.toml")))
    assert registry.count() == 1 and semrules.registry_problems(registry).count() == 0


def test_specials_beyond_the_list_are_counted(spark):
    from bibspark.operators import texscan

    rows = texscan.occurrences(spark.createDataFrame([(1, "a & " * 300), (2, "b & c")], "id long, text string")).collect()
    assert sorted((r.id, r.omitted) for r in rows if r.verdict == "omitted") == [(1, 44)] and len(rows) == 256 + 1 + 1


def test_split_files_give_the_entries_of_whole_files(spark, tmp_path):
    import gzip
    import random

    from bibspark.functions import lex
    from bibspark.operators import parse
    from bibspark.sources import pieces

    r = random.Random(3)
    odd = ["@misc{a, note = {line\n@misc{inside, x = {1}}\nend}}", "@misc{open, title = {never closed", "@misc{q, t = \"two\n@book{in quotes}\n lines\"}", "text @ here", "% @misc{hidden}", "@string{v = {Ven é}}", "@misc{m, journal = v}", "@comment{x\n@misc{c1,}\n}", "@misc{two, a = 1} @misc{three, b = 2}", "@misc{late, d = {a\n@x{\n@y{\n@z{ } } }\n}}"]
    texts = ["\n".join(r.choice(odd) if r.random() < 0.4 else f"@article{{k{i},\n  title = {{T {i} " + "é" * r.randrange(60) + "},\n  year = 2000,\n}" for i in range(n)) + r.choice(["", "\n"]) for n in (0, 1, 3, 300, 40)]
    for i, t in enumerate(texts):
        (tmp_path / f"f{i}.bib").write_text(t, newline="")
    with gzip.open(tmp_path / "f9.bib.gz", "wt") as f:
        f.write(texts[3])
    expected = []
    for d, t in enumerate([t for t in texts if t] + [texts[3]]):
        expected += [(d, b["citation_key"], b["start"], b["end"], str([(f["name"], f["resolved"]) for f in b["fields"]])) for b in lex.parse(t if t.endswith("\n") else t + "\n") if b["kind"] == "entry"]
    for size in ("1g", "97", "1500"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            read = pieces.read(spark, str(tmp_path))
            rows = read.withColumnRenamed("start", "at")
            got = parse.blocks(rows).where("kind = 'entry'").join(rows.select("doc_id", "part", "at"), ["doc_id", "part"]).collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert sorted((x["doc_id"], x["citation_key"], x["start"] + x["at"], x["end"] + x["at"], str([(f["name"], f["resolved"]) for f in x["fields"]])) for x in got) == sorted(expected), size
    assert pieces.read(spark, str(tmp_path), since="2999-01-01T00:00:00").count() == 0


def test_repeated_definitions_are_given_twice_at_most(spark, tmp_path):
    from bibspark.functions import lex
    from bibspark.operators import parse
    from bibspark.sources import pieces

    texts = ["@string{m = {one}}\n", *["@string{m = {two}}\n@misc{k, title = m}\n"] * 200, "@string{m = {one}}\n@misc{last, title = m}\n"]
    (tmp_path / "a.bib").write_text("".join(texts))
    rows = pieces.read(spark, str(tmp_path))
    assert max(len(r["before"] or "") for r in rows.collect()) < 100
    found = parse.entries(parse.blocks(rows)).collect()
    whole = [b for b in lex.parse("".join(texts)) if b["kind"] == "entry"]
    assert len(found) == len(whole) == 201
    assert {(f["fields"][0]["resolved"], tuple(f["fields"][0]["candidates"])) for f in found} == {(b["fields"][0]["resolved"], tuple(b["fields"][0]["candidates"])) for b in whole} == {("one", ("one", "two"))}
