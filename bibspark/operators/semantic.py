"""Typed records from parsed entries: every column is an expression over the entry's own fields, so no row is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as N

# Work types by entry type.
WORK_TYPES = {"article": "article", "inproceedings": "conference", "conference": "conference", "book": "book", "incollection": "chapter", "inbook": "chapter", "phdthesis": "thesis", "mastersthesis": "thesis", "techreport": "report", "proceedings": "proceedings", "dataset": "dataset", "software": "software", "unpublished": "unpublished"}
VENUE_FIELDS = ("journal", "journaltitle", "booktitle", "eventtitle")


def first(name: str, fields: str = "fields") -> Column:
    """The first field with this name, whatever its case; the first one wins."""
    return F.get(F.filter(fields, lambda f: F.lower(f["name"]) == name), F.lit(0))


def text(name: str) -> Column:
    return N.squeeze(first(name)["resolved"])


def records(entries: DataFrame) -> DataFrame:
    # the first venue field present decides, even if it is empty
    places = F.array(*[F.lit(v) for v in VENUE_FIELDS])
    rank = lambda f: F.array_position(places, F.lower(f["name"]))
    venues = F.array_sort(F.transform(F.filter("fields", lambda f: rank(f) > 0), lambda f: F.struct(rank(f).alias("r"), f["name_start"].alias("at"), f["resolved"].alias("v"))))
    arx = N.arxiv(first("eprint")["resolved"])
    doi = N.doi(first("doi")["resolved"])
    base = F.create_map(*[F.lit(x) for kv in WORK_TYPES.items() for x in kv])
    date = F.split(text("date"), "[-/]")
    part = lambda i, fn, field: F.coalesce(fn(F.get(date, F.lit(i))), fn(text(field)))
    distinct = F.size(F.array_distinct(F.transform(F.filter("fields", lambda f: F.lower(f["name"]) == "year"), lambda f: f["raw"])))
    return entries.select(
        "doc_id", "entry_idx", "entry_type", "citation_key", "start", "end",
        N.title_for_display(first("title")["resolved"]).alias("title"),
        F.coalesce(first("author")["people"], F.array()).alias("people"),
        part(0, N.year, "year").alias("year"), part(1, N.month, "month").alias("month"),
        N.squeeze(F.get(venues, F.lit(0))["v"]).alias("venue_raw"),
        doi.alias("doi"), arx["base"].alias("arxiv"), arx["version"].alias("arxiv_version"),
        F.when(arx.isNotNull() & doi.isNull(), "preprint").otherwise(F.coalesce(F.try_element_at(base, F.col("entry_type")), F.lit("unknown"))).alias("work_type"),
        (distinct > 1).alias("year_conflict"),
    )


def persons(recs: DataFrame) -> DataFrame:
    """(doc_id, entry_idx, position, name, given, prefix, family, suffix, literal, display_name) of every author."""
    each = recs.select("doc_id", "entry_idx", F.posexplode("people").alias("position", "person"))
    p = N.person_text(F.col("person"))
    return each.select("doc_id", "entry_idx", "position", F.col("person.raw").alias("name"), p.alias("p")).select("doc_id", "entry_idx", "position", "name", "p.*", N.display_name(F.col("p")).alias("display_name"))
