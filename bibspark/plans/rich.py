"""Queries over the documents derived from `customer`: identifiers, preprints, rules on meaning, generated exports. The SQL tells the answers from the keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fixes, generate, identity, outcome, parse, profiles, rules, semrules, workflow
from ..sources import rich

P = rich.PER_DOC
#: What the SQL needs of each customer, by key.
K = f"k AS (SELECT c_custkey AS k, c_custkey // {P} AS doc_id, (c_custkey % {P})::INT AS e FROM customer)"
_TYPE = "CASE WHEN k % 10 = 1 THEN 'conference' ELSE CASE k % 5 WHEN 0 THEN 'article' WHEN 1 THEN 'inproceedings' WHEN 2 THEN 'book' WHEN 3 THEN 'misc' ELSE 'phdthesis' END END"
_N5 = "lpad((k % 100000)::VARCHAR, 5, '0')"
#: Identifier rows by key, with their places in the order of schemes.
IDS = f"""ids AS (
  SELECT doc_id, e, k, 1 AS o, 'doi' AS scheme, '10.5555/c.' || k AS value, 'normalized' AS status, 'high' AS confidence FROM k WHERE k % 4 = 0
  UNION ALL SELECT doc_id, e, k, 2, 'doi', '10.5555/d.' || k, 'normalized', 'high' FROM k WHERE k % 12 = 0
  UNION ALL SELECT doc_id, e, k, 3, 'doi', '10.5555/u.' || k, 'inferred', 'high' FROM k WHERE k % 6 = 0
  UNION ALL SELECT doc_id, e, k, 4, 'isbn', '978316148410' || (k % 10), 'normalized', 'high' FROM k WHERE k % 9 = 0
  UNION ALL SELECT doc_id, e, k, 5, 'issn', '1234-567X', 'normalized', 'high' FROM k WHERE k % 9 = 1
  UNION ALL SELECT doc_id, e, k, 6, 'pmid', '123' || k, 'explicit', 'high' FROM k WHERE k % 9 = 2
  UNION ALL SELECT doc_id, e, k, 7, 'pmcid', 'PMC' || k, 'explicit', 'high' FROM k WHERE k % 9 = 3
  UNION ALL SELECT doc_id, e, k, 8, 'arxiv', '2102.' || {_N5}, 'normalized', 'high' FROM k WHERE k % 10 = 3
  UNION ALL SELECT doc_id, e, k, 9, 'arxiv', '2101.' || {_N5} || 'v2', 'inferred', 'high' FROM k WHERE k % 6 = 1)"""
#: The preprint of each record: repository, identifier, version; and its work type.
PRE = f"""pre AS (SELECT *, {_TYPE} AS et, CASE WHEN k % 30 = 28 THEN 'Zork' WHEN k % 10 = 8 THEN 'HAL' WHEN k % 10 = 3 OR k % 6 = 1 THEN 'arXiv' END AS repo,
    CASE WHEN k % 30 = 28 THEN 'z' || k WHEN k % 20 = 18 THEN 'bad id' WHEN k % 10 = 8 THEN 'hal-000' || {_N5} WHEN k % 10 = 3 THEN '2102.' || {_N5} WHEN k % 6 = 1 THEN '2101.' || {_N5} END AS ident,
    CASE WHEN k % 10 NOT IN (3, 8) AND k % 6 = 1 THEN 'v2' END AS version,
    CASE WHEN k % 5 = 0 AND k % 55 <> 0 AND k % 95 = 0 THEN NULL WHEN k % 55 = 0 THEN 'Venue A Prime' WHEN k % 5 = 0 THEN 'Journal A' WHEN k % 5 = 1 THEN 'Conf B' END AS venue FROM k),
  wt AS (SELECT *, CASE WHEN repo IS NOT NULL AND (et = 'misc' OR (et = 'article' AND venue IS NULL AND k % 4 <> 0 AND k % 6 <> 0)) THEN 'preprint'
    ELSE CASE et WHEN 'inproceedings' THEN 'conference' WHEN 'phdthesis' THEN 'thesis' ELSE et END END AS work_type FROM pre)"""


def _parsed(spark, sf_dir):
    return parse.blocks(rich.documents(spark, sf_dir))


def _described(spark, sf_dir):
    return identity.described(parse.entries(_parsed(spark, sf_dir)))


def _registry(spark):
    """Registered repositories: (alias, name, archive_prefix, pattern, url_template)."""
    return spark.createDataFrame([("hal", "HAL", "HAL", "^hal-[0-9]{8}$", "https://hal.science/{identifier}"), ("hal archive", "HAL", "HAL", "^hal-[0-9]{8}$", "https://hal.science/{identifier}")], "alias string, name string, archive_prefix string, pattern string, url_template string")


def _registered(spark, sf_dir):
    return identity.repositories(_described(spark, sf_dir), _registry(spark))


def _findings(spark, sf_dir):
    return semrules.findings(_registered(spark, sf_dir))


def sem15_all_schemes(spark, sf_dir):
    return _described(spark, sf_dir).select("doc_id", "entry_idx", F.posexplode("ids").alias("position", "i")).select("doc_id", "entry_idx", "position", "i.*")


def sem17_from_urls(spark, sf_dir):
    return sem15_all_schemes(spark, sf_dir).where("status = 'inferred'").groupBy("scheme").agg(F.count("*").alias("n"))


def sem18_preprints(spark, sf_dir):
    return _described(spark, sf_dir).where("preprint is not null").select("doc_id", "entry_idx", "preprint.repository", "preprint.identifier", "preprint.version")


def sem19_work_types(spark, sf_dir):
    return _described(spark, sf_dir).select("doc_id", "entry_idx", "work_type")


def sem20_repository_names(spark, sf_dir):
    k = F.col("c_custkey")
    text = F.concat(F.get(F.array(*[F.lit(x) for x in ("see ", "x", "[", "")]), (k % 4).cast("int")), F.lit("HAL"), F.get(F.array(*[F.lit(x) for x in (" ok", "y", "]")]), (k % 3).cast("int")))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").where(identity.contains_name(text, F.lit(" hal "))).select(k)


def sem23_ambiguities(spark, sf_dir):
    return identity.ambiguities(_described(spark, sf_dir))


def sem25_raw_fields(spark, sf_dir):
    f = parse.fields(_parsed(spark, sf_dir))
    return f.groupBy("lname").agg(F.count("*").alias("n"), F.bool_and(identity.is_raw_identifier(F.col("lname"))).alias("raw"))


def sem28_repositories(spark, sf_dir):
    return _registered(spark, sf_dir).where("repository_accepts is not null").select("doc_id", "entry_idx", "repository_known", "repository_accepts", "archive_prefix", "repository_url")


def sem31_entry_source(spark, sf_dir):
    docs = rich.documents(spark, sf_dir)
    rows = identity.entry_source(parse.entries(parse.blocks(docs)), docs)
    return rows.select("doc_id", "entry_idx", F.substring("source", 1, 1).alias("first"), F.substring_index(F.substring_index("source", "{", -1), "{", 1).isNotNull().alias("whole"), F.regexp_extract("source", r"\{(c[0-9]+),", 1).alias("key"))


def sem32_shredded(spark, sf_dir):
    return identity.shredded(_described(spark, sf_dir)).groupBy("what", "scheme").agg(F.count("*").alias("n"), F.max("position").alias("last"))


def sem06_people(spark, sf_dir):
    author = F.get(F.filter("fields", lambda f: F.lower(f["name"]) == "author"), F.lit(0))
    rows = parse.entries(_parsed(spark, sf_dir)).select("doc_id", "entry_idx", F.posexplode(author["people"]).alias("position", "p"))
    return rows.select("doc_id", "entry_idx", "position", generate.person(F.col("p")).alias("person"), F.col("p.literal").alias("literal"))


def sem02_macros(spark, sf_dir):
    f = parse.fields(_parsed(spark, sf_dir)).where("size(candidates) > 0 or size(unresolved) > 0")
    return f.select("doc_id", "entry_idx", "lname", "resolved", F.array_join("candidates", "|").alias("candidates"), F.array_join("unresolved", "|").alias("unresolved"))


def finding(code):
    def query(spark, sf_dir):
        return _findings(spark, sf_dir).where(F.col("code") == code).select("doc_id", "entry_idx", "detail")

    return query


def val10_macro_specials(spark, sf_dir):
    return semrules.specials_through_macros(_parsed(spark, sf_dir))


def val33_metadata(spark, sf_dir):
    k = F.col("c_custkey")
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(k, F.when(k % 5 == 0, " ").otherwise("t").alias("title"), F.when(k % 3 == 0, 990 + k % 20).alias("year"), F.array(F.lit("a"), F.when(k % 7 == 0, " ").otherwise("b")).alias("authors"))
    return semrules.metadata_problems(rows).select("c_custkey", "problem")


def val32_registry(spark, sf_dir):
    k = F.col("s_suppkey")
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("r"), F.when(k % 10 == 3, k - 1).otherwise(k)).alias("id"), F.array(F.concat(F.lit("Alias "), F.when(k % 10 == 5, k - 1).otherwise(k)), F.concat(F.lit("other"), k)).alias("aliases"), F.when(k % 10 == 6, "^(x$").otherwise("^(x)$").alias("pattern"), F.when(k % 10 == 7, "https://a.org/").otherwise("https://a.org/{identifier}").alias("url_template"))
    return semrules.registry_problems(rows)


def val32_cycles(spark, sf_dir):
    k = F.col("s_suppkey")
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(k.alias("profile"), F.when(k % 10 == 9, F.when(k % 20 == 9, k - 3)).otherwise(k + 1).alias("parent"))
    return semrules.inheritance_cycles(rows)


def fix05_two_passes(spark, sf_dir):
    """Documents by the passes their safe fixes need: quoted values over two lines need two."""
    return fixes.fixed_point(rich.documents(spark, sf_dir)).groupBy("passes", "status").agg(F.count("*").alias("n"))


def _named(df):
    return df.withColumns({"venue_short": F.when(F.col("venue") == "Journal A", "J. A"), "venue_full": F.when(F.col("venue") == "Journal A", "The Journal of A")})


def exp04_fields(spark, sf_dir):
    rows = _named(_described(spark, sf_dir)).select("doc_id", "entry_idx", F.posexplode(generate.fields("macro", style="abbreviated", url=False, doi=False, extra=False)).alias("i", "f"))
    return rows.where(F.col("f.name").isin("journal", "booktitle", "year", "date", "month", "author")).select("doc_id", "entry_idx", "f.name", "f.value")


def exp05_preprints(spark, sf_dir):
    d = _named(_described(spark, sf_dir))
    part = lambda how: d.select("doc_id", "entry_idx", F.lit(how).alias("how"), F.explode(F.array_compact(F.array(*generate.preprint_fields(how)))).alias("f")).select("doc_id", "entry_idx", "how", "f.name", "f.value")
    return part("misc-eprint").unionByName(part("misc-howpublished")).unionByName(part("article-journal"))


def exp06_identifiers(spark, sf_dir):
    fields = F.explode(F.array_compact(F.array(*generate.identifier_fields(True, False))))
    return _described(spark, sf_dir).select("doc_id", "entry_idx", fields.alias("f")).select("doc_id", "entry_idx", "f.name", "f.value")


def exp07_notes(spark, sf_dir):
    rows = _named(_described(spark, sf_dir)).select("doc_id", "entry_idx", F.explode(generate.fields(representation="misc-howpublished")).alias("f"))
    return rows.where("f.name = 'note'").select("doc_id", "entry_idx", "f.value")


def exp13_written(spark, sf_dir):
    k, name = F.col("c_custkey"), F.get(F.array(*[F.lit(x) for x in ("title", "note", "doi")]), (F.col("c_custkey") % 3).cast("int"))
    value = F.when(k % 4 == 0, F.concat(F.lit("{Case  "), k, F.lit("}"))).when(k % 4 == 1, F.concat(F.lit("{A} of {B"), k, F.lit("}"))).otherwise(F.concat(F.lit("plain  "), k))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(k, generate.written(name, value, ("title",)).alias("value"))


def exp08_rename_problems(spark, sf_dir):
    out = generate.exported(_named(_described(spark, sf_dir)), rename={"date": "year"})
    return out.groupBy("problem").agg(F.count("*").alias("n"), F.count("bibtex").alias("texts"))


def exp15_warnings(spark, sf_dir):
    return generate.exported(_named(_described(spark, sf_dir)), style="abbreviated").groupBy("warnings").agg(F.count("*").alias("n"))


def _validated(spark, sf_dir):
    return rules.validate(parse.entries(_parsed(spark, sf_dir)), rules.policy(spark), _registry(spark))


def val_all_counts(spark, sf_dir):
    """Diagnostics of all rules, on syntax and on meaning, by code."""
    return _validated(spark, sf_dir).groupBy("code", "severity", "blocking").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


def val31_registration(spark, sf_dir):
    """Which documents may be registered, and with unresolved meaning allowed."""
    entries, found = parse.entries(_parsed(spark, sf_dir)), _validated(spark, sf_dir)
    open_ = rules.decision(entries, found, allow_unresolved=True).select("doc_id", F.col("accepted").alias("accepted_open"), F.col("n_blocking").alias("n_blocking_open"))
    return rules.decision(entries, found).join(open_, "doc_id")


#: Sixteen profiles: every combination of month format, venue names, DOIs and types.
_PROFILES = [
    {"profile": f"p{i}", "month_format": ("numeric", "macro")[i % 2], "style": ("full", "abbreviated")[i // 2 % 2], "include_doi": i // 4 % 2 == 0, "types": (["article", "inproceedings", "misc"], [])[i // 8], "field_order": ["title", "author"][:: 1 - 2 * (i % 2)]}
    for i in range(16)
]


def exp16_profiles(spark, sf_dir):
    """Records by profile and by what stands in the way of their export; of those that are written how many have a DOI, a month macro and the author first."""
    out = profiles.exported(_named(_described(spark, sf_dir)), profiles.profile_frame(spark, _PROFILES))
    has = lambda pattern: F.count_if(F.col("bibtex").rlike(pattern))
    return out.groupBy("profile", F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count("*").alias("n"), F.count("bibtex").alias("texts"), has(r"\n  doi = ").alias("dois"), has(r"\n  month = mar,").alias("macros"), has(r"^@[a-z]+\{c[0-9]+,\n  author = ").alias("authors_first"))


def exp17_profiles(spark, sf_dir):
    """The strict way under two profiles: input checked, records written, output parsed and checked again."""
    entries = parse.entries(_parsed(spark, sf_dir))
    done = profiles.strict(entries, _named(_described(spark, sf_dir)), profiles.profile_frame(spark, [_PROFILES[0], _PROFILES[15]]), rules.policy(spark, [("BIB-SEMANTIC-006", "error", True, True), ("BIB-SEMANTIC-101", "error", True, True)]), _registry(spark))
    return done.select("profile", "doc_id", "status", "codes", F.col("source").isNotNull().alias("written"))


def sem33_api_urls(spark, sf_dir):
    return outcome.api_rows_with_links(_described(spark, sf_dir))


def exp17_strict(spark, sf_dir):
    blocking = _findings(spark, sf_dir).where("code in ('BIB-SEMANTIC-006', 'BIB-SEMANTIC-101')")
    out = generate.strict(generate.exported(_named(_described(spark, sf_dir))), blocking)
    return out.select("doc_id", "codes", F.col("bibtex").isNotNull().alias("written"))


def exp18_workflow(spark, sf_dir):
    done = workflow.advisory(rich.documents(spark, sf_dir))
    return done.select("doc_id", F.col("input_edits").cast("long").alias("input_edits"), F.col("output_edits").cast("long").alias("output_edits"), "problems")


def _w(where, detail="NULL::VARCHAR"):
    return f"WITH {K} SELECT doc_id, e AS entry_idx, {detail} AS detail FROM k WHERE {where}"


_AUTHORS = "a AS (SELECT doc_id, e, k, unnest(CASE WHEN k % 17 = 0 THEN []::VARCHAR[] WHEN k % 7 = 0 THEN ['{Group and Co ' || (k % 9) || '}', 'Lee, Ann'] ELSE ['Lee, Jr, Ann', 'van der Berg' || (k % 6) || ', Bob'] END) AS person, unnest(CASE WHEN k % 17 = 0 THEN []::INT[] ELSE [0, 1] END) AS position FROM k)"
_NOTE = "CASE WHEN k % 18 = 0 THEN 'two' || chr(10) || ' lines' WHEN k % 21 = 0 THEN 'R & D' END"
_ALSO = "CASE WHEN repo IS NOT NULL AND work_type <> 'preprint' THEN 'Also available as ' || repo || ':' || ident || coalesce(version, '') END"
_EXPECTED = "CASE work_type WHEN 'preprint' THEN 'misc' WHEN 'conference' THEN 'inproceedings' WHEN 'thesis' THEN 'phdthesis' ELSE work_type END"
_DOIS = "k % 12 = 0 OR (k % 4 = 0 AND k % 6 = 0)"
_AMBIGUOUS = f"({_DOIS}) OR (k % 10 = 3 AND k % 6 = 1) OR k % 55 = 0 OR (k % 18 <> 0 AND k % 21 = 0 AND false)"
_UNRES = "(k % 5 = 0 AND k % 55 <> 0 AND k % 95 = 0)"
#: Every finding by key: (code, doc_id, e); the others' SQL says where they are.
_FOUND = [
    ("BIB-SYNTAX-001", "k % 12 = 0"), ("BIB-SYNTAX-002", "k % 10 IN (3, 8)"), ("BIB-SYNTAX-005", "k % 18 = 0"), ("BIB-SYNTAX-005", "k % 18 = 0"), ("BIB-SYNTAX-006", "k % 16 = 0"), ("BIB-SYNTAX-007", "k % 14 = 0"),
    ("BIB-SYNTAX-009", "k % 18 = 0"), ("BIB-SEMANTIC-002", "k % 10 = 3"), ("BIB-SEMANTIC-006", "k % 17 = 0"), ("BIB-SEMANTIC-007", "k % 13 = 0"), ("BIB-SEMANTIC-008", f"k % 13 = 0 OR {_UNRES} OR {_AMBIGUOUS}"),
    ("BIB-SEMANTIC-012", "k % 10 = 8 AND (k % 30 = 28 OR k % 20 = 18)"), ("BIB-SEMANTIC-101", _UNRES), ("BIB-SEMANTIC-102", "k % 55 = 0"), ("BIB-SEMANTIC-106", "k % 6 = 2"),
]
_EVERY = f"""{K}, {IDS}, {PRE}, f AS ({" UNION ALL ".join(f"SELECT '{c}' AS code, doc_id, e FROM k WHERE {w}" for c, w in _FOUND)}
  UNION ALL SELECT 'BIB-SEMANTIC-004', doc_id, e FROM (SELECT *, {_EXPECTED} AS asked FROM wt WHERE work_type <> 'misc') WHERE asked <> et
  UNION ALL SELECT 'BIB-SEMANTIC-005', doc_id, e FROM ids WHERE scheme IN ('doi', 'arxiv') GROUP BY doc_id, e, k, scheme HAVING count(*) > 1),
  p AS (SELECT * FROM (VALUES {", ".join(f"('{c}', '{s}', {str(b).lower()})" for c, s, b, _ in rules.POLICY)}) AS t(code, severity, blocking)), g AS (SELECT * FROM f JOIN p USING (code))"""

_WRITTEN = f"""{K}, {PRE}, x AS (SELECT k, doc_id, e, i, i % 2 = 1 AS macros, i // 4 % 2 = 0 AS dois, CASE work_type WHEN 'preprint' THEN 'misc' WHEN 'conference' THEN 'inproceedings' WHEN 'thesis' THEN 'phdthesis' ELSE work_type END AS t FROM wt, generate_series(0, 15) AS g(i)),
  r AS (SELECT *, CASE WHEN {_UNRES} THEN 'unresolved' WHEN k % 55 = 0 OR k % 12 = 0 OR (k % 10 = 3 AND k % 6 = 1) THEN 'ambiguous' WHEN k % 13 = 0 THEN 'conflict' WHEN k % 17 = 0 THEN 'uncertain' WHEN i < 8 AND t NOT IN ('article', 'inproceedings', 'misc') THEN 'unsupported_type' ELSE '' END AS reason FROM x)"""

QUERIES = {
    "exp16_profiles": exp16_profiles, "exp17_profiles": exp17_profiles, "sem33_api_urls": sem33_api_urls, "val_all_counts": val_all_counts, "val31_registration": val31_registration,
    "sem15_all_schemes": sem15_all_schemes, "sem17_from_urls": sem17_from_urls, "sem18_preprints": sem18_preprints, "sem19_work_types": sem19_work_types, "sem20_repository_names": sem20_repository_names,
    "sem23_ambiguities": sem23_ambiguities, "sem25_raw_fields": sem25_raw_fields, "sem28_repositories": sem28_repositories, "sem31_entry_source": sem31_entry_source, "sem32_shredded": sem32_shredded,
    "sem06_people": sem06_people, "sem02_macros": sem02_macros, "val08_inline_comment": finding("BIB-SYNTAX-007"), "val10_macro_specials": val10_macro_specials, "val12_arxiv_prefix": finding("BIB-SEMANTIC-002"),
    "val14_type": finding("BIB-SEMANTIC-004"), "val16_conflict": finding("BIB-SEMANTIC-005"), "val17_author": finding("BIB-SEMANTIC-006"), "val18_date": finding("BIB-SEMANTIC-007"), "val19_unresolved": finding("BIB-SEMANTIC-008"),
    "val21_repository": finding("BIB-SEMANTIC-012"), "val22_unknown_macro": finding("BIB-SEMANTIC-101"), "val22_ambiguous_macro": finding("BIB-SEMANTIC-102"), "val22_bad_url": finding("BIB-SEMANTIC-106"), "val26_url": finding("LAB-URL-001"),
    "val32_registry": val32_registry, "val32_cycles": val32_cycles, "val33_metadata": val33_metadata, "fix05_two_passes": fix05_two_passes, "exp04_fields": exp04_fields, "exp05_preprints": exp05_preprints,
    "exp06_identifiers": exp06_identifiers, "exp07_notes": exp07_notes, "exp08_rename_problems": exp08_rename_problems, "exp13_written": exp13_written, "exp15_warnings": exp15_warnings, "exp17_strict": exp17_strict, "exp18_workflow": exp18_workflow,
}
ORACLES = {
    "sem15_all_schemes": f"WITH {K}, {IDS} SELECT doc_id, e AS entry_idx, (row_number() OVER (PARTITION BY k ORDER BY o) - 1)::INT AS position, scheme, value, status, confidence FROM ids",
    "sem17_from_urls": f"WITH {K}, {IDS} SELECT scheme, count(*) AS n FROM ids WHERE status = 'inferred' GROUP BY 1",
    "sem18_preprints": f"WITH {K}, {PRE} SELECT doc_id, e AS entry_idx, repo AS repository, ident AS identifier, version FROM pre WHERE repo IS NOT NULL",
    "sem19_work_types": f"WITH {K}, {PRE} SELECT doc_id, e AS entry_idx, work_type FROM wt",
    "sem20_repository_names": "SELECT c_custkey FROM customer WHERE c_custkey % 4 <> 1 AND c_custkey % 3 <> 1",
    "sem23_ambiguities": f"""WITH {K}, {IDS}, m AS (SELECT doc_id, e, scheme, string_agg(value, '|' ORDER BY o) AS vs FROM ids GROUP BY doc_id, e, k, scheme HAVING count(*) > 1)
      SELECT doc_id, e AS entry_idx, 'multiple-dois' AS kind, vs AS "values" FROM m WHERE scheme = 'doi' UNION ALL SELECT doc_id, e, 'multiple-arxiv-identifiers', vs FROM m WHERE scheme = 'arxiv'
      UNION ALL SELECT doc_id, e, 'macro-candidates', 'Venue A|Venue A Prime' FROM k WHERE k % 55 = 0 UNION ALL SELECT doc_id, e, 'unresolved-value', 'nosuch' FROM k WHERE {_UNRES}""",
    "sem25_raw_fields": f"""WITH {K}, f AS (SELECT unnest(['title', 'author', 'year']) AS lname, 1 AS w FROM k UNION ALL SELECT 'date', 1 FROM k WHERE k % 13 = 0 UNION ALL SELECT 'month', 1 FROM k WHERE k % 10 = 1
      UNION ALL SELECT 'journal', 1 FROM k WHERE k % 5 = 0 UNION ALL SELECT 'booktitle', 1 FROM k WHERE k % 5 = 1 UNION ALL SELECT 'doi', 1 FROM k WHERE k % 4 = 0 UNION ALL SELECT 'doi', 1 FROM k WHERE k % 12 = 0 UNION ALL SELECT 'url', 1 FROM k WHERE k % 6 < 3
      UNION ALL SELECT unnest(['eprint', 'archiveprefix']), 1 FROM k WHERE k % 10 IN (3, 8) UNION ALL SELECT CASE k % 9 WHEN 0 THEN 'isbn' WHEN 1 THEN 'issn' WHEN 2 THEN 'pmid' ELSE 'pmcid' END, 1 FROM k WHERE k % 9 < 4
      UNION ALL SELECT 'note', 1 FROM k WHERE k % 18 = 0 OR k % 21 = 0) SELECT lname, count(*) AS n, lname NOT IN ('title', 'author', 'year', 'date', 'month', 'journal', 'booktitle', 'note') AS raw FROM f GROUP BY lname""",
    "sem28_repositories": f"WITH {K}, {PRE}, r AS (SELECT *, repo = 'HAL' AND k % 20 <> 18 AS ok FROM pre WHERE repo IN ('HAL', 'Zork')) SELECT doc_id, e AS entry_idx, repo = 'HAL' AS repository_known, ok AS repository_accepts, CASE WHEN ok THEN 'HAL' END AS archive_prefix, CASE WHEN ok THEN 'https://hal.science/' || ident END AS repository_url FROM r",
    "sem31_entry_source": f"WITH {K}, n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM k) SELECT doc_id, e AS entry_idx, '@' AS first, true AS whole, 'c' || k AS key FROM n",
    "sem32_shredded": f"""WITH {K}, {IDS}, {_AUTHORS}, i AS (SELECT scheme, row_number() OVER (PARTITION BY k ORDER BY o) - 1 AS p FROM ids)
      SELECT 'contributor' AS what, 'author' AS scheme, count(*) AS n, max(position)::INT AS last FROM a UNION ALL SELECT 'identifier', scheme, count(*), max(p)::INT FROM i GROUP BY scheme UNION ALL SELECT 'url', 'url', count(*), 0 FROM k WHERE k % 6 < 2""",
    "sem06_people": f"WITH {K}, {_AUTHORS} SELECT doc_id, e AS entry_idx, position, person, CASE WHEN person LIKE '{{%' THEN person[2:-2] END AS literal FROM a",
    "sem02_macros": f"""WITH {K} SELECT doc_id, e AS entry_idx, 'month' AS lname, 'March' AS resolved, 'March' AS candidates, '' AS unresolved FROM k WHERE k % 10 = 1
      UNION ALL SELECT doc_id, e, 'journal', 'Venue A Prime', 'Venue A|Venue A Prime', '' FROM k WHERE k % 55 = 0 UNION ALL SELECT doc_id, e, 'journal', NULL, '', 'nosuch' FROM k WHERE {_UNRES}
      UNION ALL SELECT doc_id, e, 'note', 'R & D', 'R & D', '' FROM k WHERE k % 18 <> 0 AND k % 21 = 0""",
    "exp16_profiles": f"""WITH {_WRITTEN} SELECT 'p' || i AS profile, reason, count(*) AS n, count(*) FILTER (reason = '') AS texts, count(*) FILTER (reason = '' AND dois AND (k % 4 = 0 OR k % 6 = 0)) AS dois,
      count(*) FILTER (reason = '' AND macros AND k % 10 = 1) AS macros, count(*) FILTER (reason = '' AND macros) AS authors_first FROM r GROUP BY ALL""",
    "exp17_profiles": f"""WITH {_WRITTEN}, b AS (SELECT doc_id, string_agg(DISTINCT code, ',' ORDER BY code) AS codes FROM (SELECT doc_id, 'BIB-SEMANTIC-006' AS code FROM k WHERE k % 17 = 0 UNION ALL SELECT doc_id, 'BIB-SEMANTIC-101' FROM k WHERE {_UNRES}) GROUP BY doc_id),
      d AS (SELECT i, doc_id, count(*) FILTER (reason <> '') AS bad, coalesce(string_agg(DISTINCT reason, ',' ORDER BY reason) FILTER (reason <> ''), '') AS reasons FROM r WHERE i IN (0, 15) GROUP BY i, doc_id)
      SELECT 'p' || i AS profile, doc_id, CASE WHEN codes IS NOT NULL THEN 'input_blocked' WHEN bad > 0 THEN 'not_exported' ELSE 'exported' END AS status, coalesce(codes, reasons) AS codes, codes IS NULL AND bad = 0 AS written FROM d LEFT JOIN b USING (doc_id)""",
    "sem33_api_urls": f"""WITH {K} SELECT doc_id, e AS entry_idx, 'Study of Case ' || k AS title, CASE WHEN k % 17 = 0 THEN '' WHEN k % 7 = 0 THEN '{{Group and Co ' || (k % 9) || '}}; Ann Lee' ELSE 'Lee, Jr, Ann; Bob van der Berg' || (k % 6) END AS authors, (2000 + k % 20)::INT AS year,
      CASE WHEN k % 4 = 0 THEN '10.5555/c.' || k WHEN k % 6 = 0 THEN '10.5555/u.' || k END AS doi, CASE k % 6 WHEN 0 THEN 'https://doi.org/10.5555/u.' || k WHEN 1 THEN 'http://arxiv.org/abs/2101.' || {_N5} || 'v2' END AS url FROM k""",
    "val_all_counts": f"WITH {_EVERY} SELECT code, severity, blocking, count(*) AS n, count(DISTINCT doc_id) AS docs FROM g GROUP BY ALL",
    "val31_registration": f"""WITH {_EVERY}, b AS (SELECT doc_id, count(*) FILTER (blocking OR severity = 'error') AS n, count(*) FILTER ((blocking OR severity = 'error') AND code <> 'BIB-SEMANTIC-008') AS m, bool_or(code = 'BIB-SEMANTIC-008') AS u FROM g GROUP BY doc_id)
      SELECT DISTINCT doc_id, coalesce(n, 0) AS n_blocking, coalesce(u, false) AS unresolved, coalesce(n, 0) = 0 AS accepted, coalesce(m, 0) = 0 AS accepted_open, coalesce(m, 0) AS n_blocking_open FROM k LEFT JOIN b USING (doc_id)""",
    "val08_inline_comment": _w("k % 14 = 0", "'1'"),
    "val10_macro_specials": f"WITH {K} SELECT doc_id, 'spec' AS macro, '&' AS char, count(*) AS n_fields FROM k WHERE k % 18 <> 0 AND k % 21 = 0 GROUP BY doc_id",
    "val12_arxiv_prefix": _w("k % 10 = 3", f"'2102.' || {_N5}"),
    "val14_type": f"WITH {K}, {PRE}, x AS (SELECT *, {_EXPECTED} AS asked FROM wt WHERE work_type <> 'misc') SELECT doc_id, e AS entry_idx, asked AS detail FROM x WHERE asked <> et",
    "val16_conflict": f"WITH {K}, {IDS} SELECT doc_id, e AS entry_idx, min(value) AS detail FROM ids WHERE scheme IN ('doi', 'arxiv') GROUP BY doc_id, e, k, scheme HAVING count(*) > 1",
    "val17_author": _w("k % 17 = 0"),
    "val18_date": _w("k % 13 = 0", "'1999-05'"),
    "val19_unresolved": _w(f"k % 13 = 0 OR {_UNRES} OR {_AMBIGUOUS}", f"CASE WHEN k % 13 = 0 THEN 'date' WHEN {_UNRES} THEN 'value' ELSE 'ambiguous' END"),
    "val21_repository": _w("k % 10 = 8 AND (k % 30 = 28 OR k % 20 = 18)", "CASE WHEN k % 30 = 28 THEN 'not registered' ELSE 'pattern' END"),
    "val22_unknown_macro": _w(_UNRES, "'nosuch'"),
    "val22_ambiguous_macro": _w("k % 55 = 0", "'journal'"),
    "val22_bad_url": _w("k % 6 = 2", "'not a url'"),
    "val26_url": _w("k % 6 < 3", "'discourage'"),
    "val32_registry": """WITH s AS (SELECT 'r' || CASE WHEN s_suppkey % 10 = 3 THEN s_suppkey - 1 ELSE s_suppkey END AS id, s_suppkey AS k FROM supplier) SELECT id, 'duplicate id' AS problem FROM s WHERE k % 10 = 3 AND k - 1 IN (SELECT k FROM s)
      UNION ALL SELECT id, 'alias conflict' FROM s WHERE (k % 10 = 5 AND k - 1 IN (SELECT k FROM s)) OR (k % 10 = 4 AND k + 1 IN (SELECT k FROM s)) UNION ALL SELECT id, 'bad pattern' FROM s WHERE k % 10 = 6 UNION ALL SELECT id, 'bad template' FROM s WHERE k % 10 = 7""",
    "val32_cycles": "SELECT s_suppkey AS profile FROM supplier WHERE s_suppkey % 20 IN (6, 7, 8, 9) AND s_suppkey // 20 * 20 + 9 IN (SELECT s_suppkey FROM supplier)",
    "val33_metadata": "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'title' WHEN c_custkey % 3 = 0 AND 990 + c_custkey % 20 < 1000 THEN 'year' WHEN c_custkey % 7 = 0 THEN 'author' END AS problem FROM customer",
    "fix05_two_passes": f"WITH {K}, d AS (SELECT doc_id, bool_or(k % 18 = 0) AS two FROM k GROUP BY doc_id) SELECT CASE WHEN two THEN 2 ELSE 1 END::INT AS passes, 'done' AS status, count(*) AS n FROM d GROUP BY 1",
    "exp04_fields": f"""WITH {K}, {PRE}, {_AUTHORS} SELECT doc_id, e AS entry_idx, 'author' AS name, string_agg(person, ' and ' ORDER BY position) AS value FROM a GROUP BY doc_id, e, k
      UNION ALL SELECT doc_id, e, 'year', CASE WHEN k % 13 = 0 THEN '1999' ELSE (2000 + k % 20)::VARCHAR END FROM k UNION ALL SELECT doc_id, e, 'date', '1999-05' FROM k WHERE k % 13 = 0 UNION ALL SELECT doc_id, e, 'month', 'mar' FROM k WHERE k % 10 = 1 AND k % 13 <> 0
      UNION ALL SELECT doc_id, e, CASE work_type WHEN 'article' THEN 'journal' ELSE 'booktitle' END, CASE WHEN venue = 'Journal A' THEN 'J. A' ELSE venue END FROM wt WHERE venue IS NOT NULL AND work_type <> 'preprint'""",
    "exp05_preprints": f"""WITH {K}, {PRE}, x AS (SELECT *, ident || coalesce(version, '') AS v, work_type = 'preprint' AS alone FROM wt WHERE repo IS NOT NULL)
      SELECT doc_id, e AS entry_idx, 'misc-eprint' AS how, 'eprint' AS name, v AS value FROM x UNION ALL SELECT doc_id, e, 'misc-eprint', 'archivePrefix', repo FROM x
      UNION ALL SELECT doc_id, e, 'misc-howpublished', CASE WHEN alone THEN 'howpublished' ELSE 'note' END, CASE WHEN alone THEN '' ELSE 'Also available as ' END || repo || ':' || v FROM x
      UNION ALL SELECT doc_id, e, 'article-journal', CASE WHEN alone THEN 'journal' ELSE 'eprint' END, CASE WHEN alone THEN repo || ':' || v ELSE v END FROM x UNION ALL SELECT doc_id, e, 'article-journal', 'archivePrefix', repo FROM x WHERE NOT alone""",
    "exp06_identifiers": f"WITH {K}, {IDS} SELECT doc_id, e AS entry_idx, scheme AS name, CASE WHEN scheme = 'doi' THEN arg_min(value, o) ELSE string_agg(value, ', ' ORDER BY o) END AS value FROM ids WHERE scheme <> 'arxiv' GROUP BY doc_id, e, k, scheme",
    "exp07_notes": f"WITH {K}, {PRE}, x AS (SELECT *, {_NOTE} AS own, {_ALSO} AS also FROM wt) SELECT doc_id, e AS entry_idx, CASE WHEN own IS NULL THEN also WHEN also IS NULL THEN own ELSE own || '; ' || also END AS value FROM x WHERE own IS NOT NULL OR also IS NOT NULL",
    "exp08_rename_problems": f"WITH {K} SELECT CASE WHEN k % 13 = 0 THEN 'duplicate field' END AS problem, count(*) AS n, count(*) FILTER (k % 13 <> 0) AS texts FROM k GROUP BY 1",
    "exp13_written": "WITH x AS (SELECT c_custkey, c_custkey % 3 AS f, CASE c_custkey % 4 WHEN 0 THEN '{Case  ' || c_custkey || '}' WHEN 1 THEN '{A} of {B' || c_custkey || '}' ELSE 'plain  ' || c_custkey END AS v FROM customer) SELECT c_custkey, '{' || CASE WHEN f = 2 THEN v WHEN f = 0 AND c_custkey % 4 <> 0 THEN '{' || replace(v, '  ', ' ') || '}' ELSE replace(v, '  ', ' ') END || '}' AS value FROM x",
    "exp15_warnings": f"WITH {K}, {PRE} SELECT CASE WHEN venue IS NOT NULL AND venue <> 'Journal A' THEN 'no short name' ELSE '' END AS warnings, count(*) AS n FROM wt GROUP BY 1",
    "exp18_workflow": f"WITH {K}, {PRE} SELECT doc_id, sum((k % 10 IN (3, 8))::INT + 3 * (k % 18 = 0)::INT + (k % 16 = 0)::INT)::BIGINT AS input_edits, count(repo)::BIGINT AS output_edits, 0::BIGINT AS problems FROM wt GROUP BY doc_id",
    "exp17_strict": f"WITH {K}, c AS (SELECT doc_id, 'BIB-SEMANTIC-006' AS code FROM k WHERE k % 17 = 0 UNION SELECT doc_id, 'BIB-SEMANTIC-101' FROM k WHERE {_UNRES}), g AS (SELECT doc_id, string_agg(code, ',' ORDER BY code) AS codes FROM c GROUP BY doc_id) SELECT DISTINCT doc_id, coalesce(codes, '') AS codes, codes IS NULL AS written FROM k LEFT JOIN g USING (doc_id)",
}
