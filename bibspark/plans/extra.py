"""TeX specials, export gates, identifiers and JSON sources over rows derived from `part`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fixes, outcome, semantic, texscan
from ..sources import corpus, files, table
from .bibtex import _TITLE, _YEAR, BASE, _entries, _fixed
from .more import _SCORED, er13_selected


def _tex(spark, sf_dir):
    k = F.col("p_partkey")
    tail = F.when(k % 4 == 0, r" & 5\% \emph{a_b} 50%").when(k % 4 == 1, r" $x_1 & y$ cost $5").when(k % 4 == 2, r" \url{http://a_b/%c#d} \verb|#_| #1").otherwise(r" {a_b} \(x^2_i\) c^d")
    return table(spark, sf_dir, "part").select(k.alias("id"), F.concat(F.regexp_replace("p_name", r"[%&#_^$\\{}]", " "), tail).alias("text"))


def val09_tex_specials(spark, sf_dir):
    return texscan.occurrences(_tex(spark, sf_dir)).groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "char", "context", "verdict"))), lambda x: F.concat(x["char"], x["context"], F.lit(":"), x["verdict"])), " ").alias("found"))


def exp12_escape(spark, sf_dir):
    return _tex(spark, sf_dir).select("id", texscan.escape("text").alias("escaped"))


def exp02_gate(spark, sf_dir):
    g = outcome.gate(semantic.records(_entries(spark, sf_dir)))
    return g.groupBy(F.coalesce("reason", F.lit("-")).alias("reason"), F.coalesce("target_type", F.lit("-")).alias("target_type")).agg(F.count("*").alias("n"))


def exp01_first_failure(spark, sf_dir):
    return outcome.document_gate(outcome.gate(semantic.records(_entries(spark, sf_dir))))


def sem15_identifiers(spark, sf_dir):
    return outcome.identifiers(semantic.records(_entries(spark, sf_dir)))


def sem24_unresolved(spark, sf_dir):
    return semantic.records(_entries(spark, sf_dir)).groupBy("doc_id").agg(F.bool_or(outcome.unresolved()).alias("unresolved"))


def sem33_api_rows(spark, sf_dir):
    return outcome.api_rows(semantic.records(_entries(spark, sf_dir)))


def fix07_line_diff(spark, sf_dir):
    docs, fixed = _fixed(spark, sf_dir)
    return fixes.line_diff(docs, fixed).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


def src04_extraction(spark, sf_dir):
    k = F.col("p_partkey")
    ref = F.struct(F.col("p_name").alias("title"), F.array(F.lit("A")).alias("authors"), (1990 + k % 30).cast("string").alias("year"), F.lit("x").alias("unknown_key"))
    payload = table(spark, sf_dir, "part").groupBy(F.floor(k / 7).alias("doc_id")).agg(F.to_json(F.struct(F.lit("f.pdf").alias("file_name"), F.lit(-1).alias("reference_count"), F.sort_array(F.collect_list(ref)).alias("references"))).alias("payload"))
    return files.extraction(payload).select("doc_id", F.col("reference_count").cast("long").alias("n"), F.array_max(F.transform("references", lambda r: r["year"])).alias("last_year"))


def snk02_report(spark, sf_dir):
    return files.report(er13_selected(spark, sf_dir))


def sem_derived_sources(spark, sf_dir):
    return corpus.documents(spark, sf_dir).select("doc_id", F.concat(F.lit("sha256:"), F.sha2("source", 256)).alias("revision"))


_CLEAN = r"regexp_replace(p_name, '[%&#_^$\\{}]', ' ', 'g')"
QUERIES = {
    "val09_tex_specials": val09_tex_specials, "exp12_escape": exp12_escape, "exp02_gate": exp02_gate, "exp01_first_failure": exp01_first_failure, "sem15_identifiers": sem15_identifiers, "sem24_unresolved": sem24_unresolved,
    "sem33_api_rows": sem33_api_rows, "fix07_line_diff": fix07_line_diff, "src04_extraction": src04_extraction, "snk02_report": snk02_report, "sem30_revision": sem_derived_sources,
}
ORACLES = {
    "val09_tex_specials": "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN '&plain:safe _command:review %plain:safe' WHEN 1 THEN '$plain:review' WHEN 2 THEN '#plain:safe' ELSE '_plain:safe ^plain:review' END AS found FROM part",
    "exp12_escape": rf"SELECT p_partkey AS id, {_CLEAN} || CASE p_partkey % 4 WHEN 0 THEN ' \& 5\% \emph{{a\_b}} 50\%' WHEN 1 THEN ' $x_1 & y$ cost \$5' WHEN 2 THEN ' \url{{http://a_b/%c#d}} \verb|#_| \#1' ELSE ' {{a\_b}} \(x^2_i\) c\textasciicircum{{}}d' END AS escaped FROM part",
    "exp02_gate": f"WITH {BASE}, g AS (SELECT CASE WHEN k % 41 <> 0 AND k % 13 = 0 AND 1990 + k % 30 <> 2001 THEN 'conflict' WHEN {_TITLE} = '' THEN 'no_title' WHEN k % 3 = 2 THEN 'unknown_type' ELSE '-' END AS reason, k FROM b) SELECT reason, CASE WHEN reason <> '-' THEN '-' WHEN k % 3 = 0 THEN 'article' ELSE 'inproceedings' END AS target_type, count(*) AS n FROM g GROUP BY ALL",
    "exp01_first_failure": f"WITH {BASE}, g AS (SELECT doc_id, e, CASE WHEN k % 41 <> 0 AND k % 13 = 0 AND 1990 + k % 30 <> 2001 THEN 'conflict' WHEN k % 3 = 2 THEN 'unknown_type' END AS reason FROM b) SELECT doc_id, min(e) AS entry_idx, arg_min(reason, e) AS reason FROM g WHERE reason IS NOT NULL GROUP BY 1",
    "sem15_identifiers": f"WITH {BASE} SELECT doc_id, e AS entry_idx, 'doi' AS scheme, lower(doi) AS value, 0::INT AS position FROM b UNION ALL SELECT doc_id, e, 'arxiv', '2001.' || lpad((k % 100000)::VARCHAR, 5, '0'), 1 FROM b WHERE k % 3 = 2",
    "sem24_unresolved": f"WITH {BASE} SELECT doc_id, bool_or(k % 3 = 2 OR (k % 41 <> 0 AND k % 13 = 0 AND 1990 + k % 30 <> 2001)) AS unresolved FROM b GROUP BY 1",
    "sem33_api_rows": f"WITH {BASE} SELECT doc_id, e AS entry_idx, {_TITLE} AS title, 'Smith' || (k % 10) || ', Ann; Bob van der Jones' || (k % 7) AS authors, {_YEAR} AS year, lower(doi) AS doi FROM b",
    "src04_extraction": "SELECT p_partkey // 7 AS doc_id, count(*) AS n, max(1990 + p_partkey % 30)::VARCHAR AS last_year FROM part GROUP BY 1",
    "snk02_report": f"WITH {_SCORED}, t AS (SELECT count(*) AS n, count(*) FILTER (k IN (SELECT ref_id FROM s WHERE consistent)) AS r FROM p) SELECT '{{\"total\":' || n || ',\"ready\":' || r || ',\"manual_review\":' || (n - r) || '}}' AS value FROM t",
    "sem30_revision": f"SELECT doc_id, 'sha256:' || sha256(source) AS revision FROM {corpus.sql()}",
    "fix07_line_diff": f"""WITH a AS (SELECT doc_id, unnest(string_split(trim(source, chr(10)), chr(10))) AS l, generate_subscripts(string_split(trim(source, chr(10)), chr(10)), 1) AS i FROM {corpus.sql()}),
      c AS (SELECT doc_id, unnest(string_split(trim(source, chr(10)), chr(10))) AS l, generate_subscripts(string_split(trim(source, chr(10)), chr(10)), 1) AS i FROM {corpus.sql(clean=True)}),
      j AS (SELECT doc_id, a.l = c.l AS same FROM a JOIN c USING (doc_id, i))
      SELECT doc_id, 'equal' AS kind, count(*) AS n FROM j WHERE same GROUP BY 1 UNION ALL SELECT doc_id, unnest(['added', 'removed']), count(*) FROM j WHERE NOT same GROUP BY 1""",
}
