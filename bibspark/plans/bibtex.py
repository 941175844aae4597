"""Queries that parse, analyse, validate, fix and export the derived BibTeX corpus. The SQL tells the answers from `part`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normalize as N
from ..operators import export, fixes, parse, rules, semantic
from ..operators.storage import new_folder
from ..sources import corpus, pieces, table

P = corpus.PER_DOC
#: The columns of `part` that the SQL needs, by key.
BASE = f"""b AS (SELECT k, k // {P} AS doc_id, (k % {P})::INT AS e, p_name, CASE k % 3 WHEN 0 THEN 'article' WHEN 1 THEN 'inproceedings' ELSE 'misc' END AS et,
  CASE WHEN k % 23 = 0 AND k % {P} <> 0 THEN 'PART' || (k - 1) ELSE 'part' || k END AS ck,
  '10.1000/part.' || CASE WHEN k % 19 = 0 AND k % {P} <> 0 THEN k - 1 ELSE k END AS doi FROM (SELECT p_partkey AS k, p_name FROM part))"""


def _parsed(spark, sf_dir, clean=False):
    return parse.blocks(corpus.documents(spark, sf_dir, clean))


def _entries(spark, sf_dir):
    return parse.entries(_parsed(spark, sf_dir))


def _diagnostics(spark, sf_dir):
    return rules.validate(_entries(spark, sf_dir), rules.policy(spark))


def par05_entries(spark, sf_dir):
    return _entries(spark, sf_dir).select("doc_id", "entry_idx", "entry_type", "citation_key", "delimiter", "trailing_comma", F.size("fields").alias("n_fields"))


def par06_atoms(spark, sf_dir):
    return parse.atoms(parse.fields(_parsed(spark, sf_dir))).groupBy("kind").agg(F.count("*").alias("n"))


def par10_summary(spark, sf_dir):
    return parse.summary(_parsed(spark, sf_dir))


def par11_to_source(spark, sf_dir):
    docs = corpus.documents(spark, sf_dir)
    return parse.to_source(docs, parse.blocks(docs))


def par12_line_column(spark, sf_dir):
    docs = corpus.documents(spark, sf_dir)
    prefix = F.decode(F.substring(F.encode("source", "utf-8"), F.lit(1), F.col("start").cast("int")), "utf-8")
    lines = F.split(prefix, "\n")
    rows = parse.entries(parse.blocks(docs)).select("doc_id", "entry_idx", "start").join(docs, "doc_id")
    return rows.select("doc_id", "entry_idx", F.size(lines).alias("line"), (F.char_length(F.element_at(lines, -1)) + 1).alias("col"))


def sem_records(spark, sf_dir):
    r = semantic.records(_entries(spark, sf_dir))
    return r.select("doc_id", "entry_idx", "title", "year", "venue_raw", "doi", "arxiv", "arxiv_version", "work_type", "year_conflict", F.size("people").alias("n_people"))


def sem07_persons(spark, sf_dir):
    return semantic.persons(semantic.records(_entries(spark, sf_dir))).drop("name", "literal")


def sem21_ambiguities(spark, sf_dir):
    f = parse.fields(_parsed(spark, sf_dir))
    return f.groupBy("doc_id", "entry_idx", "lname").agg(F.count("*").alias("n"), F.countDistinct("raw").alias("n_values")).where("n_values > 1")


def sem26_venue_alias(spark, sf_dir):
    r = semantic.records(_entries(spark, sf_dir)).where("venue_raw is not null")
    text = F.concat(F.lit("Proceedings of the 12th  "), F.upper("venue_raw"), F.lit(" (Volume 2: Long Papers), 2019"))
    return r.groupBy(N.venue_alias(text).alias("alias")).agg(F.count("*").alias("n"))


def val_counts(spark, sf_dir):
    return _diagnostics(spark, sf_dir).groupBy("code", "severity", "blocking").agg(F.count("*").alias("n"))


def val_rule(code):
    def query(spark, sf_dir):
        return _diagnostics(spark, sf_dir).where(F.col("code") == code).select("doc_id", "entry_idx").distinct()

    return query


def val20(what):
    def query(spark, sf_dir):
        return rules.duplicates(_entries(spark, sf_dir), what)

    return query


def val24_required(spark, sf_dir):
    rows = [(t, name, i) for t, names in rules.REQUIRED.items() for i, name in enumerate(names)]
    return rules.missing_required(_entries(spark, sf_dir), spark.createDataFrame(rows, "entry_type string, lname string, ord int"))


def val25_forbidden(spark, sf_dir):
    forbidden = spark.createDataFrame([("misc", "eprint"), ("article", "booktitle")], "entry_type string, lname string")
    found = parse.fields(_parsed(spark, sf_dir)).join(forbidden, ["entry_type", "lname"], "left_semi")
    return found.select("doc_id", "entry_idx", "lname")


def val28_order(spark, sf_dir):
    return _diagnostics(spark, sf_dir).where("place = 1").select("doc_id", "code")


def win05_ordinals(spark, sf_dir):
    return _diagnostics(spark, sf_dir).select("doc_id", "code", F.col("ordinal").cast("long").alias("ordinal"))


def val31_decision(spark, sf_dir):
    entries = _entries(spark, sf_dir)
    return rules.decision(entries, rules.validate(entries, rules.policy(spark))).drop("unresolved")


def agg09_codes(spark, sf_dir):
    codes = F.array_join(F.sort_array(F.collect_set("code")), ",")
    return _diagnostics(spark, sf_dir).groupBy("doc_id").agg(codes.alias("codes"))


def _fixed(spark, sf_dir):
    docs = corpus.documents(spark, sf_dir)
    return docs, fixes.apply(docs, fixes.plan(rules.in_entries(parse.entries(parse.blocks(docs)))))


def fix04_apply(spark, sf_dir):
    return _fixed(spark, sf_dir)[1].select("doc_id", F.sha2("source", 256).alias("sha256"), F.col("n_edits").cast("long").alias("n_edits"))


def fix05_fixed_point(spark, sf_dir):
    done = fixes.fixed_point(corpus.documents(spark, sf_dir))
    return done.select("doc_id", "passes", F.col("n_edits").cast("long").alias("n_edits"), "status", F.sha2("source", 256).alias("sha256"))


def fix05_incremental(spark, sf_dir):
    """The fixed point by blocks: later passes lex only the entries that were changed."""
    done = fixes.incremental(corpus.documents(spark, sf_dir))
    return done.select("doc_id", "passes", F.col("n_edits").cast("long").alias("n_edits"), "status", F.sha2("source", 256).alias("sha256"))


#: What is put into the sources of every twelfth document, and its code.
DAMAGE = (
    ("@misc{, title = {x}}", "102"), ("@misc{d, a = {x} b = {y}}", "103"), ("@misc{d, = {x}}", "104"), ("@misc{d, a = , b = {y}}", "105"), ("@misc{d, a = {x} # , b = {y}}", "106"), ("@misc{d, a {x}}", "107"),
    ("@misc{d, a = {x} {y}}", "108"), ("@misc{d, a = {x},", "109"), ("@misc{d, a = {x, b = {y}", "110"), ('@misc{d, a = "x, b = {y}}', "111"), ("text only", None), ("@comment{fine}", None),
)


def par09_codes(spark, sf_dir):
    """The strict mode on documents of which each has one kind of damage at its end, by modulus."""
    d = corpus.documents(spark, sf_dir)
    damage = F.get(F.array(*[F.lit(x) for x, _ in DAMAGE]), (F.col("doc_id") % len(DAMAGE)).cast("int"))
    return parse.strict(d.select("doc_id", F.concat("source", damage).alias("source")))


#: Files that the documents are written to, each with every fourth of them.
FILES = 4


def src02_lint(spark, sf_dir):
    """Findings by file and code: the documents are written to a few files, which are read in splits and lexed in pieces, in file order."""
    folder = new_folder(spark, "bib")
    shard = (F.col("doc_id") % FILES).alias("shard")
    docs = corpus.documents(spark, sf_dir).select("doc_id", shard, "source").repartition(FILES, "shard").sortWithinPartitions("shard", "doc_id")
    docs.select("shard", F.col("source").alias("value")).write.partitionBy("shard").text(folder)
    found = rules.in_entries(parse.entries(parse.blocks(pieces.read(spark, folder))))
    return found.groupBy(F.col("doc_id").alias("file"), "code").agg(F.count("*").alias("n"))


def jon14_overlaps(spark, sf_dir):
    """Overlapping intervals of each user's events, as edits of a document: a third are insertions at round seconds, others last as many seconds as their value says."""
    e = table(spark, sf_dir, "events")
    at = F.unix_timestamp("ts")
    start = F.when(F.col("event_id") % 3 == 0, F.floor(at / 3600) * 3600).otherwise(at).cast("long")
    width = F.when(F.col("event_id") % 3 == 0, 0).otherwise(600 * (1 + F.col("event_id") % 40)).cast("long")
    edits = e.select(F.col("user_id").alias("doc_id"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("fix_id"), start.alias("start"), (start + width).alias("end"))
    return fixes.conflicts(edits)


def fix02_conflicts(spark, sf_dir):
    return fixes.conflicts(fixes.plan(rules.in_entries(_entries(spark, sf_dir)))).agg(F.count("*").alias("n"))


def fix06_diff(spark, sf_dir):
    docs, fixed = _fixed(spark, sf_dir)
    return fixes.diff(docs, fixed).select("doc_id", F.col("added").cast("long").alias("added"), F.col("removed").cast("long").alias("removed"))


def exp14_serialize(spark, sf_dir):
    profile = export.Profile(deny=("author",), rename={"booktitle": "eventtitle"})
    return export.text(_entries(spark, sf_dir), profile)


def exp_documents(spark, sf_dir):
    texts = export.documents(export.text(_entries(spark, sf_dir), export.Profile(allow=("title", "doi"), trailing_comma=False)))
    return texts.select("doc_id", F.sha2("bibtex", 256).alias("sha256"))


def _dup_sql(value, where="true"):
    return f"""WITH {BASE}, v AS (SELECT doc_id, e, {value} AS value FROM b WHERE {where})
      SELECT doc_id, value, count(*) AS n, min(e) AS first_entry, string_agg(e::VARCHAR, ',' ORDER BY e) AS entries FROM v GROUP BY 1, 2 HAVING count(*) > 1"""


def _rule_sql(where):
    return f"WITH {BASE} SELECT doc_id, e AS entry_idx FROM b WHERE {where}"


#: How often each rule fires for an entry, as SQL over its key.
FIRES = {
    "BIB-SYNTAX-001": "(k % 13 = 0 AND k % 41 <> 0)::INT",
    "BIB-SYNTAX-002": "(k % 29 = 0)::INT",
    "BIB-SYNTAX-004": "(k % 7 = 0)::INT",
    "BIB-SYNTAX-005": "2 * (k % 11 = 0)::INT",
    "BIB-SEMANTIC-001": "(k % 17 = 0)::INT",
    "BIB-SEMANTIC-003": "(k % 3 < 2 AND k % 41 = 0 AND k % 13 <> 0)::INT",
}
_DUP_DOCS = {"BIB-SEMANTIC-009": "lower(ck)", "BIB-SEMANTIC-010": "lower(doi)"}
_SEVERITY = {c: (s, b) for c, s, b, _ in rules.POLICY}
_ALL = f"""{BASE}, d AS ({" UNION ALL ".join(f"SELECT doc_id, e, '{c}' AS code, {n} AS n FROM b" for c, n in FIRES.items())} UNION ALL
  {" UNION ALL ".join(f"SELECT doc_id, min(e) AS e, '{c}' AS code, 1 AS n FROM b GROUP BY doc_id, {v} HAVING count(*) > 1" for c, v in _DUP_DOCS.items())}),
  p AS (SELECT * FROM (VALUES {", ".join(f"('{c}', '{s}', {str(b).lower()})" for c, (s, b) in _SEVERITY.items())}) AS t(code, severity, blocking))"""
_EDITS = "(k % 29 = 0)::INT + (k % 7 = 0)::INT + 2 * (k % 11 = 0)::INT + (k % 17 = 0)::INT"
_VENUE = "CASE WHEN k % 3 = 2 THEN NULL WHEN k % 10 = 3 THEN 'Journal of Parts' ELSE 'Venue ' || (k % 5) END"
_YEAR = "CASE WHEN k % 41 <> 0 THEN (1990 + k % 30)::INT WHEN k % 13 = 0 THEN 2001 END"
_TITLE = "trim(regexp_replace(p_name, '\\s+', ' ', 'g'))"
_N_FIELDS = "3 + (k % 41 <> 0)::INT + (k % 13 = 0)::INT + CASE WHEN k % 3 < 2 THEN 1 ELSE 2 END"
_RAW_DOI = "CASE WHEN k % 17 = 0 THEN 'https://doi.org/' ELSE '' END || '10.1000/' || CASE WHEN k % 31 = 0 THEN 'PART.' ELSE 'part.' END || CASE WHEN k % 19 = 0 AND k % 20 <> 0 THEN k - 1 ELSE k END"

QUERIES = {
    "flagship": val20("doi"), "par05_entries": par05_entries, "par06_atoms": par06_atoms, "par10_summary": par10_summary, "par11_to_source": par11_to_source, "par12_line_column": par12_line_column,
    "sem01_records": sem_records, "sem07_persons": sem07_persons, "sem21_ambiguities": sem21_ambiguities, "sem26_venue_alias": sem26_venue_alias,
    "val_counts": val_counts, "val01_duplicate_field": val_rule("BIB-SYNTAX-001"), "val02_field_case": val_rule("BIB-SYNTAX-002"), "val04_trailing_comma": val_rule("BIB-SYNTAX-004"),
    "val05_quoted": val_rule("BIB-SYNTAX-005"), "val11_doi_prefix": val_rule("BIB-SEMANTIC-001"), "val13_required_data": val_rule("BIB-SEMANTIC-003"),
    "val20_duplicate_key": val20("key"), "val20_duplicate_doi": val20("doi"), "val20_duplicate_arxiv": val20("arxiv"), "val24_required": val24_required, "val25_forbidden": val25_forbidden,
    "val28_order": val28_order, "win05_ordinals": win05_ordinals, "val31_decision": val31_decision, "agg09_codes": agg09_codes, "fix02_conflicts": fix02_conflicts, "jon14_overlaps": jon14_overlaps, "fix04_apply": fix04_apply, "src02_lint": src02_lint, "par09_codes": par09_codes, "fix05_fixed_point": fix05_fixed_point, "fix05_incremental": fix05_incremental,
    "fix06_diff": fix06_diff, "exp14_serialize": exp14_serialize, "exp01_documents": exp_documents,
}
ORACLES = {
    "flagship": _dup_sql("lower(doi)"),
    "par05_entries": f"WITH {BASE} SELECT doc_id, e AS entry_idx, et AS entry_type, ck AS citation_key, 'brace' AS delimiter, k % 7 <> 0 AS trailing_comma, ({_N_FIELDS})::INT AS n_fields FROM b",
    "par06_atoms": f"WITH {BASE}, a AS (SELECT sum((k % 11 = 0)::INT) AS q, sum((k % 3 < 2 AND k % 10 = 3)::INT) AS m, sum({_N_FIELDS}) AS n FROM b) SELECT 'quoted' AS kind, q::BIGINT AS n FROM a UNION ALL SELECT 'macro', m::BIGINT FROM a UNION ALL SELECT 'braced', (n - q - m)::BIGINT FROM a",
    "par10_summary": f"WITH {BASE} SELECT doc_id, count(*) AS n_entries, 1::BIGINT AS n_strings, 0::BIGINT AS n_failed, 1::BIGINT AS n_comments, 'ok' AS status FROM b GROUP BY doc_id",
    "par11_to_source": f"SELECT doc_id, sha256(source) AS sha256, true AS lossless FROM {corpus.sql()}",
    "par12_line_column": f"WITH {BASE} SELECT doc_id, e AS entry_idx, (3 + coalesce(sum({_N_FIELDS} + 3) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS line, 1::INT AS col FROM b",
    "sem01_records": f"WITH {BASE} SELECT doc_id, e AS entry_idx, {_TITLE} AS title, {_YEAR} AS year, {_VENUE} AS venue_raw, lower(doi) AS doi, CASE WHEN k % 3 = 2 THEN '2001.' || lpad((k % 100000)::VARCHAR, 5, '0') END AS arxiv, CASE WHEN k % 3 = 2 THEN 'v2' END AS arxiv_version, CASE k % 3 WHEN 0 THEN 'article' WHEN 1 THEN 'conference' ELSE 'unknown' END AS work_type, k % 41 <> 0 AND k % 13 = 0 AND 1990 + k % 30 <> 2001 AS year_conflict, 2::INT AS n_people FROM b",
    "sem07_persons": f"WITH {BASE} SELECT doc_id, e AS entry_idx, 0::INT AS position, 'Ann' AS given, NULL::VARCHAR AS prefix, 'Smith' || (k % 10) AS family, NULL::VARCHAR AS suffix, 'Ann Smith' || (k % 10) AS display_name FROM b UNION ALL SELECT doc_id, e, 1, 'Bob', 'van der', 'Jones' || (k % 7), NULL, 'Bob van der Jones' || (k % 7) FROM b",
    "sem21_ambiguities": f"WITH {BASE} SELECT doc_id, e AS entry_idx, 'year' AS lname, 2::BIGINT AS n, 2::BIGINT AS n_values FROM b WHERE k % 41 <> 0 AND k % 13 = 0 AND 1990 + k % 30 <> 2001",
    "sem26_venue_alias": f"WITH {BASE} SELECT lower({_VENUE}) AS alias, count(*) AS n FROM b WHERE k % 3 < 2 GROUP BY 1",
    "val_counts": f"WITH {_ALL} SELECT code, severity, blocking, sum(n)::BIGINT AS n FROM d JOIN p USING (code) WHERE n > 0 GROUP BY ALL",
    **{q: _rule_sql(f"{FIRES[c]} > 0") for q, c in (("val01_duplicate_field", "BIB-SYNTAX-001"), ("val02_field_case", "BIB-SYNTAX-002"), ("val04_trailing_comma", "BIB-SYNTAX-004"), ("val05_quoted", "BIB-SYNTAX-005"), ("val11_doi_prefix", "BIB-SEMANTIC-001"), ("val13_required_data", "BIB-SEMANTIC-003"))},
    "val20_duplicate_key": _dup_sql("lower(ck)"),
    "val20_duplicate_doi": _dup_sql("lower(doi)"),
    "val20_duplicate_arxiv": _dup_sql("'2001.' || lpad((k % 100000)::VARCHAR, 5, '0')", "k % 3 = 2"),
    "val24_required": f"WITH {BASE} SELECT doc_id, e AS entry_idx, 'year' AS missing FROM b WHERE k % 41 = 0 AND k % 13 <> 0",
    "val25_forbidden": f"WITH {BASE} SELECT doc_id, e AS entry_idx, 'eprint' AS lname FROM b WHERE k % 3 = 2",
    "win05_ordinals": f"WITH {_ALL} SELECT doc_id, code, unnest(generate_series(0, sum(n)::BIGINT - 1)) AS ordinal FROM d GROUP BY doc_id, code HAVING sum(n) > 0",
    "val31_decision": f"WITH {_ALL}, x AS (SELECT doc_id, sum(n * blocking::INT)::BIGINT AS nb FROM d JOIN p USING (code) GROUP BY doc_id) SELECT doc_id, nb AS n_blocking, nb = 0 AS accepted FROM x",
    "agg09_codes": f"WITH {_ALL} SELECT doc_id, string_agg(DISTINCT code, ',' ORDER BY code) AS codes FROM d WHERE n > 0 GROUP BY doc_id",
    "fix02_conflicts": "SELECT 0::BIGINT AS n",
    "jon14_overlaps": """WITH x AS (SELECT user_id AS doc_id, lpad(event_id::VARCHAR, 12, '0') AS f, event_id, floor(epoch(ts))::BIGINT AS sec FROM events),
      e AS (SELECT doc_id, f, CASE WHEN event_id % 3 = 0 THEN sec // 3600 * 3600 ELSE sec END AS s, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 600 * (1 + event_id % 40) END AS w FROM x)
      SELECT a.doc_id, a.f AS a_fix_id, a.s AS a_start, a.s + a.w AS a_end, b.f AS b_fix_id, b.s AS b_start, b.s + b.w AS b_end FROM e a JOIN e b ON a.doc_id = b.doc_id AND a.f < b.f
      AND ((a.s < b.s + b.w AND b.s < a.s + a.w) OR (a.w = 0 AND b.w = 0 AND a.s = b.s))""",
    "fix04_apply": f"WITH {BASE}, c AS (SELECT doc_id, sum({_EDITS})::BIGINT AS n_edits FROM b GROUP BY doc_id) SELECT doc_id, sha256(source) AS sha256, n_edits FROM {corpus.sql(clean=True)} JOIN c USING (doc_id)",
    "fix05_fixed_point": f"WITH {BASE}, c AS (SELECT doc_id, sum({_EDITS})::BIGINT AS n_edits FROM b GROUP BY doc_id) SELECT doc_id, (n_edits > 0)::INT AS passes, n_edits, 'done' AS status, sha256(source) AS sha256 FROM {corpus.sql(clean=True)} JOIN c USING (doc_id)",
    "fix06_diff": f"WITH {BASE}, c AS (SELECT doc_id, sum((k % 29 = 0 OR k % 11 = 0)::INT + (k % 17 = 0 AND NOT (k % 7 = 0 AND k % 3 < 2))::INT + (k % 7 = 0)::INT)::BIGINT AS n FROM b GROUP BY doc_id) SELECT doc_id, n AS added, n AS removed FROM c",
    "exp14_serialize": f"""WITH {BASE} SELECT doc_id, e AS entry_idx, '@' || et || '{{' || ck || ',' || chr(10) || '  title = {{' || regexp_replace(p_name, '\\s+', ' ', 'g') || '}}' ||
      CASE WHEN k % 3 = 0 THEN ',' || chr(10) || '  journal = {{' || {_VENUE} || '}}' WHEN k % 3 = 1 THEN ',' || chr(10) || '  eventtitle = {{' || {_VENUE} || '}}' ELSE '' END ||
      CASE WHEN {_YEAR} IS NOT NULL THEN ',' || chr(10) || '  year = {{' || {_YEAR} || '}}' ELSE '' END || ',' || chr(10) || '  doi = {{' || {_RAW_DOI} || '}}' ||
      CASE WHEN k % 3 = 2 THEN ',' || chr(10) || '  archiveprefix = {{arXiv}},' || chr(10) || '  eprint = {{2001.' || lpad((k % 100000)::VARCHAR, 5, '0') || 'v2}}' ELSE '' END || ',' || chr(10) || '}}' AS bibtex FROM b""",
    "exp01_documents": f"""WITH {BASE} SELECT doc_id, sha256(string_agg('@' || et || '{{' || ck || ',' || chr(10) || '  title = {{' || regexp_replace(p_name, '\\s+', ' ', 'g') || '}},' || chr(10) || '  doi = {{' || {_RAW_DOI} || '}}' || chr(10) || '}}', chr(10) || chr(10) ORDER BY k)) AS sha256 FROM b GROUP BY doc_id""",
}
ORACLES["src02_lint"] = f"WITH {BASE} SELECT doc_id % {FILES} AS file, code, sum(n)::BIGINT AS n FROM ({' UNION ALL '.join(f"SELECT doc_id, '{c}' AS code, {n} AS n FROM b" for c, n in FIRES.items())}) GROUP BY ALL HAVING sum(n) > 0"
_CODES = ", ".join("NULL" if c is None else f"'BIB-SYNTAX-{c}'" for _, c in DAMAGE)
ORACLES["par09_codes"] = f"WITH {BASE}, c AS (SELECT DISTINCT doc_id, ([{_CODES}])[doc_id % {len(DAMAGE)} + 1] AS code FROM b) SELECT doc_id, code IS NULL AS accepted, coalesce(code, '') AS codes FROM c"
ORACLES["fix05_incremental"] = ORACLES["fix05_fixed_point"]
