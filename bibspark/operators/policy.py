"""Profile-driven rules: order, keys, types, representation, completeness; severity thresholds and rule selectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import SEVERITY
from .semantic import first

# The venue kinds an entry type agrees with.
VENUE_KINDS = {"article": ("journal",), "inproceedings": ("conference", "workshop")}


def out_of_order(entries: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """(doc_id, entry_idx, names): entries in which a ranked field follows one of a higher rank, with the names in policy order.

    Unknown names rank last and keep their places among themselves.
    """
    places = F.array(*[F.lit(x) for x in order])
    rank = lambda f: F.when(F.array_position(places, F.lower(f["name"])) > 0, F.array_position(places, F.lower(f["name"]))).otherwise(F.lit(len(order) + 1))
    ranks = F.transform("fields", rank)
    inverted = F.exists(F.zip_with(F.slice(ranks, 1, F.greatest(F.size(ranks) - 1, F.lit(0))), F.slice(ranks, 2, F.greatest(F.size(ranks) - 1, F.lit(0))), lambda a, b: a > b), lambda x: x)
    sorted_names = F.transform(F.array_sort(F.transform("fields", lambda f, i: F.struct(rank(f).alias("r"), i.alias("i"), F.lower(f["name"]).alias("n")))), lambda x: x["n"])
    return entries.where(inverted).select("doc_id", "entry_idx", F.array_join(sorted_names, ",").alias("names"))


def bad_keys(entries: DataFrame, pattern: str) -> DataFrame:
    """Keys that don't match a policy's pattern, with a normalised proposal."""
    proposal = F.regexp_replace(F.regexp_replace(F.lower("citation_key"), "[^a-z0-9:_-]+", "-"), "^-|-$", "")
    return entries.where(~F.col("citation_key").rlike(pattern)).select("doc_id", "entry_idx", "citation_key", proposal.alias("proposal"))


def with_venue_kind(records: DataFrame, venues: DataFrame) -> DataFrame:
    """Records with the kind of their venue, from a registry of (alias, venue_id, kind, ord); the first of equal aliases counts."""
    from ..functions.normalize import venue_alias

    best = venues.groupBy("alias").agg(F.min(F.struct("ord", "venue_id", "kind")).alias("m")).select("alias", "m.venue_id", "m.kind")
    return records.withColumn("alias", venue_alias(F.col("venue_raw"))).join(best, "alias", "left").drop("alias")


def kind_mismatch(enriched: DataFrame) -> DataFrame:
    """Records whose entry type disagrees with the kind of their venue."""
    ok = None
    for entry_type, kinds in VENUE_KINDS.items():
        test = (F.col("entry_type") == entry_type) & ~F.col("kind").isin(*kinds)
        ok = test if ok is None else ok | test
    return enriched.where(F.col("kind").isNotNull() & ok)


def arxiv_representation(entries: DataFrame, required: tuple[str, ...] = ("eprint", "archiveprefix", "primaryclass")) -> DataFrame:
    """Preprint-looking entries that lack fields of the wanted representation."""
    lacking = F.array_compact(F.array(*[F.when(first(n).isNull(), F.lit(n)) for n in required]))
    looks = first("eprint").isNotNull() | F.coalesce(F.lower(first("journal")["resolved"]).rlike("^arxiv"), F.lit(False))
    return entries.where(looks & (F.size(lacking) > 0)).select("doc_id", "entry_idx", F.array_join(lacking, ",").alias("lacking"))


def completeness(entries: DataFrame) -> DataFrame:
    """(doc_id, entry_idx, missing): what a complete entry would still need; empty if nothing."""
    has = lambda *names: F.coalesce(*[first(n)["resolved"] for n in names]).isNotNull()
    need = [F.when(~has("title"), "title"), F.when(~has("author", "editor"), "author"), F.when(~has("year", "date"), "year")]
    need += [F.when((F.col("entry_type") == "article") & ~has("journal", "journaltitle"), "journal"), F.when((F.col("entry_type") == "inproceedings") & ~has("booktitle"), "booktitle")]
    return entries.select("doc_id", "entry_idx", F.array_join(F.array_compact(F.array(*need)), ",").alias("missing"))


def selected(code: Column, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """Whether a rule takes part: every rule, or the included ones, but never the excluded."""
    out = F.lit(True) if include is None else code.isin(*include) if include else F.lit(False)
    return out & ~code.isin(*exclude) if exclude else out


def at_least(severity: Column, minimum: str) -> Column:
    rank = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])
    return rank[severity] >= SEVERITY[minimum]
