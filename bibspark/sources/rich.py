"""BibTeX documents derived from `customer`: every kind of identifier, preprint, date and name, with defects placed by key modulus.

A document holds the entries of `PER_DOC` consecutive customer keys after the definitions of its macros.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import table

PER_DOC = 20
HEAD = "@string{venuea = {Venue A}}\n@string{venuea = {Venue A Prime}}\n@string{spec = {R & D}}\n"
TYPES = ("article", "conference", "book", "misc", "phdthesis", "article", "inproceedings", "book", "misc", "phdthesis")


def entries(customers: DataFrame) -> DataFrame:
    """(doc_id, k, bib): one entry for each customer."""
    k = F.col("c_custkey")
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    pick = lambda *cases: _pick([(c, lit(v)) for c, v in cases])
    key = lambda head: F.concat(F.lit(head), k)
    braced = lambda c: F.concat(F.lit("{"), lit(c), F.lit("}"))
    line = lambda name, value: F.concat(F.lit(f"  {name} = "), value)
    number = lambda head: F.concat(F.lit(head), F.lpad((k % 100000).cast("string"), 5, "0"))
    author = pick((k % 17 == 0, "{}"), (k % 7 == 0, F.concat(F.lit("{{Group and Co "), k % 9, F.lit("} and Ann Lee}"))), (k >= 0, F.concat(F.lit("{Lee, Jr, Ann and Bob van der Berg"), k % 6, F.lit("}"))))
    year = (2000 + k % 20).cast("string")
    fields = [
        line("title", braced(key("Study of Case "))),
        line("author", author),
        pick((k % 16 == 0, F.concat(F.lit("  year={"), year, F.lit("}"))), (k >= 0, line("year", braced(year)))),
        pick((k % 13 == 0, line("date", F.lit("{1999-05}")))),
        pick((k % 10 == 1, line("month", F.lit("mar")))),
        pick((k % 5 == 0, line("journal", pick((k % 55 == 0, "venuea"), (k % 95 == 0, "nosuch"), (k >= 0, "{Journal A}"))))),
        pick((k % 5 == 1, line("booktitle", F.lit("{Conf B}")))),
        pick((k % 4 == 0, line("doi", braced(key("10.5555/c."))))),
        pick((k % 12 == 0, line("doi", braced(key("10.5555/d."))))),
        pick((k % 6 == 0, line("url", braced(key("https://doi.org/10.5555/u.")))), (k % 6 == 1, line("url", braced(F.concat(number("http://arxiv.org/abs/2101."), F.lit("v2"))))), (k % 6 == 2, line("url", F.lit("{not a url}")))),
        pick((k % 10 == 3, F.concat(line("eprint", braced(number("arXiv:2102."))), F.lit(",\n"), line("archivePrefix", F.lit("{arXiv}"))))),
        pick((k % 30 == 28, F.concat(line("eprint", braced(key("z"))), F.lit(",\n"), line("archivePrefix", F.lit("{Zork}")))), (k % 10 == 8, F.concat(line("eprint", pick((k % 20 == 18, "{bad id}"), (k >= 0, braced(number("hal-000"))))), F.lit(",\n"), line("archivePrefix", F.lit("{HAL}"))))),
        pick((k % 9 == 0, line("isbn", F.concat(F.lit("{978-3-16-148410-"), k % 10, F.lit("}")))), (k % 9 == 1, line("issn", F.lit("{1234 567x}"))), (k % 9 == 2, line("pmid", braced(key(" 123")))), (k % 9 == 3, line("pmcid", braced(key("PMC"))))),
        pick((k % 18 == 0, line("note", F.lit('"two\n lines"'))), (k % 21 == 0, line("note", F.lit("spec")))),
    ]
    body = F.array_join(F.array_compact(F.array(*fields)), ",\n")
    comment = F.when(k % 14 == 0, ",\n  % checked\n").otherwise(",\n")
    return customers.select(F.floor(k / PER_DOC).cast("long").alias("doc_id"), k.alias("k"), F.concat(F.lit("@"), F.get(F.array(*[F.lit(t) for t in TYPES]), (k % 10).cast("int")), F.lit("{"), key("c"), comment, body, F.lit(",\n}")).alias("bib"))


def _pick(cases: list[tuple[Column, Column]]) -> Column:
    out = F.when(*cases[0])
    for c, v in cases[1:]:
        out = out.when(c, v)
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source)."""
    ordered = F.sort_array(F.collect_list(F.struct("k", "bib")))  # PER_DOC entries at most
    text = F.array_join(F.transform(ordered, lambda x: x["bib"]), "\n\n")
    return entries(table(spark, sf_dir, "customer")).groupBy("doc_id").agg(F.concat(F.lit(HEAD), text, F.lit("\n")).alias("source"))
