"""BibTeX documents derived from `part`, with defects placed by key modulus so that SQL can tell the expected answers.

A document holds the entries of `PER_DOC` consecutive part keys, after one macro definition and a comment line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import table

PER_DOC = 20
HEAD = "% derived corpus\n@string{jop = {Journal of Parts}}\n"


def _pick(when: Column, yes, no) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.when(when, lit(yes)).otherwise(lit(no))


def entries(parts: DataFrame, clean: bool = False) -> DataFrame:
    """(doc_id, k, bib): one entry for each part. `clean` leaves out the defects that safe fixes repair."""
    k = F.col("p_partkey")
    bad = (lambda n: F.lit(False)) if clean else (lambda n: k % n == 0)
    inside = k % PER_DOC != 0
    kind = _pick(k % 3 == 0, "article", _pick(k % 3 == 1, "inproceedings", "misc"))
    key = _pick((k % 23 == 0) & inside, F.concat(F.lit("PART"), k - 1), F.concat(F.lit("part"), k))
    title = _pick(bad(11), F.concat(F.lit('"'), "p_name", F.lit('"')), F.concat(F.lit("{"), "p_name", F.lit("}")))
    venue = _pick(k % 10 == 3, "jop", F.concat(F.lit("{Venue "), k % 5, F.lit("}")))
    doi_of = _pick((k % 19 == 0) & inside, k - 1, k)
    doi = F.concat(_pick(bad(17), "https://doi.org/", ""), F.lit("10.1000/"), _pick(k % 31 == 0, "PART.", "part."), doi_of)
    line = lambda name, value: F.concat(F.lit("\n  "), name if isinstance(name, Column) else F.lit(name), F.lit(" = "), value)
    braced = lambda c: F.concat(F.lit("{"), c, F.lit("}"))
    fields = [
        line(_pick(bad(29), "TITLE", "title"), title),
        line("author", braced(F.concat(F.lit("Smith"), k % 10, F.lit(", Ann and Bob van der Jones"), k % 7))),
        F.when(k % 41 != 0, line("year", braced((1990 + k % 30).cast("string")))),
        F.when(k % 13 == 0, line("year", F.lit("{2001}"))),
        F.when(k % 3 == 0, line("journal", venue)).when(k % 3 == 1, line("booktitle", venue)),
        line("doi", braced(doi)),
        F.when(k % 3 == 2, F.concat(line("eprint", braced(F.concat(F.lit("2001."), F.lpad((k % 100000).cast("string"), 5, "0"), F.lit("v2")))), F.lit(","), line("archiveprefix", F.lit("{arXiv}")))),
    ]
    body = F.array_join(F.array_compact(F.array(*fields)), ",")
    bib = F.concat(F.lit("@"), kind, F.lit("{"), key, F.lit(","), body, _pick(bad(7), "", ","), F.lit("\n}"))
    return parts.select(F.floor(k / PER_DOC).cast("long").alias("doc_id"), k.alias("k"), bib.alias("bib"))


def documents(spark: SparkSession, sf_dir: str, clean: bool = False) -> DataFrame:
    """(doc_id, source)."""
    ordered = F.sort_array(F.collect_list(F.struct("k", "bib")))  # PER_DOC entries at most
    text = F.array_join(F.transform(ordered, lambda x: x["bib"]), "\n\n")
    return entries(table(spark, sf_dir, "part"), clean).groupBy("doc_id").agg(F.concat(F.lit(HEAD), text, F.lit("\n")).alias("source"))


def sql(clean: bool = False) -> str:
    """The same documents in DuckDB's SQL, from `part`, as a relation of (doc_id, source)."""
    bad = (lambda n: "false") if clean else (lambda n: f"k % {n} = 0")
    return rf"""
      (SELECT k // {PER_DOC} AS doc_id, '% derived corpus' || chr(10) || '@string{{jop = {{Journal of Parts}}}}' || chr(10) || string_agg(bib, chr(10) || chr(10) ORDER BY k) || chr(10) AS source
       FROM (SELECT k, '@' || CASE k % 3 WHEN 0 THEN 'article' WHEN 1 THEN 'inproceedings' ELSE 'misc' END || '{{' ||
          CASE WHEN k % 23 = 0 AND k % {PER_DOC} <> 0 THEN 'PART' || (k - 1) ELSE 'part' || k END || ',' || chr(10) || '  ' ||
          CASE WHEN {bad(29)} THEN 'TITLE' ELSE 'title' END || ' = ' || CASE WHEN {bad(11)} THEN '"' || p_name || '"' ELSE '{{' || p_name || '}}' END || ',' || chr(10) ||
          '  author = {{Smith' || (k % 10) || ', Ann and Bob van der Jones' || (k % 7) || '}}' ||
          CASE WHEN k % 41 <> 0 THEN ',' || chr(10) || '  year = {{' || (1990 + k % 30) || '}}' ELSE '' END ||
          CASE WHEN k % 13 = 0 THEN ',' || chr(10) || '  year = {{2001}}' ELSE '' END ||
          CASE WHEN k % 3 < 2 THEN ',' || chr(10) || CASE k % 3 WHEN 0 THEN '  journal = ' ELSE '  booktitle = ' END || CASE WHEN k % 10 = 3 THEN 'jop' ELSE '{{Venue ' || (k % 5) || '}}' END ELSE '' END ||
          ',' || chr(10) || '  doi = {{' || CASE WHEN {bad(17)} THEN 'https://doi.org/' ELSE '' END || '10.1000/' || CASE WHEN k % 31 = 0 THEN 'PART.' ELSE 'part.' END ||
          CASE WHEN k % 19 = 0 AND k % {PER_DOC} <> 0 THEN k - 1 ELSE k END || '}}' ||
          CASE WHEN k % 3 = 2 THEN ',' || chr(10) || '  eprint = {{2001.' || lpad((k % 100000)::VARCHAR, 5, '0') || 'v2}},' || chr(10) || '  archiveprefix = {{arXiv}}' ELSE '' END ||
          CASE WHEN {bad(7)} THEN '' ELSE ',' END || chr(10) || '}}' AS bib
        FROM (SELECT p_partkey AS k, p_name FROM part)) GROUP BY 1)"""
