"""What stands between a record and its export, its identifiers, and its row for an API."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Entry types a plain profile writes, by work type.
TARGETS = {"article": "article", "conference": "inproceedings", "preprint": "misc", "book": "book", "thesis": "phdthesis", "report": "techreport"}


def unresolved() -> Column:
    """Whether a record leaves something open: an unknown work type, disagreeing years, no title or no one to name."""
    return (F.col("work_type") == "unknown") | F.col("year_conflict") | F.col("title").isNull() | (F.size("people") == 0)


def gate(records: DataFrame) -> DataFrame:
    """Records with `reason`, the first obstacle in the order of the contract, or null, and the entry type to write."""
    reason = F.coalesce(
        F.when(~F.col("citation_key").rlike(r"^[^\s{}(),=\\\"#%~']+$"), "bad_key"),
        F.when(F.col("year_conflict"), "conflict"),
        F.when(F.col("title").isNull(), "no_title"),
        F.when(F.col("work_type") == "unknown", "unknown_type"),
    )
    target = F.try_element_at(F.create_map(*[F.lit(x) for kv in TARGETS.items() for x in kv]), F.col("work_type"))
    return records.withColumns({"reason": reason, "target_type": F.when(reason.isNull(), F.coalesce(target, F.lit("misc")))})


def document_gate(gated: DataFrame) -> DataFrame:
    """(doc_id, reason): a document's first failing record decides."""
    return gated.where("reason is not null").groupBy("doc_id").agg(F.min(F.struct("entry_idx", "reason")).alias("m")).select("doc_id", "m.entry_idx", "m.reason")


def identifiers(records: DataFrame) -> DataFrame:
    """(doc_id, entry_idx, scheme, value, position): identifiers once each, the first kept; a DOI that names an arXiv paper gives that too."""
    inferred = F.nullif(F.regexp_extract("doi", r"^10\.48550/arxiv\.(.+)$", 1), F.lit(""))
    listed = F.array_compact(F.array(
        F.when(F.col("doi").isNotNull(), F.struct(F.lit("doi").alias("scheme"), F.col("doi").alias("value"))),
        F.when(F.col("arxiv").isNotNull(), F.struct(F.lit("arxiv").alias("scheme"), F.col("arxiv").alias("value"))),
        F.when(inferred.isNotNull(), F.struct(F.lit("arxiv").alias("scheme"), inferred.alias("value"))),
    ))
    return records.select("doc_id", "entry_idx", F.posexplode(F.array_distinct(listed)).alias("position", "i")).select("doc_id", "entry_idx", "i.scheme", "i.value", "position")


def api_rows_with_links(described: DataFrame) -> DataFrame:
    """One row for each `identity.described` record: title or key, authors in order, year, first DOI of all, first URL."""
    from ..functions import normalize as N
    from . import identity
    from .semantic import first

    people = F.transform(F.coalesce(first("author")["people"], F.array()), lambda p: p["raw"])
    dois = identity.of_scheme(F.col("ids"), "doi")
    title = F.coalesce(N.title_for_display(first("title")["resolved"]), F.col("citation_key"))
    return described.select("doc_id", "entry_idx", title.alias("title"), F.array_join(people, "; ").alias("authors"), N.year(first("year")["resolved"]).alias("year"), F.get(dois, F.lit(0)).alias("doi"), F.get(identity.urls(), F.lit(0)).alias("url"))


def api_rows(records: DataFrame) -> DataFrame:
    """One row for each record: title or key, authors in order, first DOI."""
    return records.select("doc_id", "entry_idx", F.coalesce("title", "citation_key").alias("title"), F.array_join("people.raw", "; ").alias("authors"), "year", "doi")
