"""Records to BibTeX text under a profile: fields renamed, selected, ranked and written, all as expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Profile:
    """What an export writes; empty `allow` means every field."""

    allow: tuple[str, ...] = ()
    deny: tuple[str, ...] = ()
    order: tuple[str, ...] = ("title", "author", "journal", "booktitle", "year", "doi")
    rename: dict[str, str] = field(default_factory=dict)
    indent: str = "  "
    trailing_comma: bool = True


def selected(profile: Profile) -> Column:
    """The entry's fields by rank, name and place: first occurrence of each name, allowed and not denied, renamed."""
    fields = F.col("fields")
    low = lambda f: F.lower(f["name"])
    kept = F.filter(fields, lambda f, i: f["resolved"].isNotNull() & ~F.exists(F.slice(fields, 1, i), lambda g: low(g) == low(f)))
    if profile.allow:
        kept = F.filter(kept, lambda f: low(f).isin(*profile.allow))
    if profile.deny:
        kept = F.filter(kept, lambda f: ~low(f).isin(*profile.deny))
    names = F.create_map(*[F.lit(x) for kv in (profile.rename or {"": ""}).items() for x in kv])
    order = F.array(*[F.lit(x) for x in profile.order])
    rank = lambda f: F.when(F.array_position(order, low(f)) > 0, F.array_position(order, low(f))).otherwise(F.lit(len(profile.order) + 1))
    return F.array_sort(F.transform(kept, lambda f, i: F.struct(rank(f).alias("rank"), F.coalesce(F.try_element_at(names, low(f)), low(f)).alias("name"), i.alias("i"), f["resolved"].alias("v"))))


def text(entries: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """(doc_id, entry_idx, bibtex)."""
    line = lambda f: F.concat(F.lit("\n" + profile.indent), f["name"], F.lit(" = {"), F.regexp_replace(f["v"], r"\s+", " "), F.lit("}"))
    body = F.array_join(F.transform(selected(profile), line), ",")
    end = F.lit(",\n}" if profile.trailing_comma else "\n}")
    return entries.select("doc_id", "entry_idx", F.concat(F.lit("@"), "entry_type", F.lit("{"), "citation_key", F.lit(","), body, end).alias("bibtex"))


def documents(texts: DataFrame) -> DataFrame:
    """(doc_id, bibtex): entries of a document in order, a blank line between them."""
    rows = F.sort_array(F.collect_list(F.struct("entry_idx", "bibtex")))
    return texts.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda x: x["bibtex"]), "\n\n").alias("bibtex"))
