"""The reference library: search, paging, history, restore, overlay, registration. All joins, windows and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def like(text: str) -> str:
    """A LIKE pattern for a substring, wild cards escaped."""
    for c in "\\%_":
        text = text.replace(c, "\\" + c)
    return f"%{text}%"


def contains(column: str, text: str) -> Column:
    return F.col(column).ilike(like(text))


def search(references: DataFrame, contributors: DataFrame | None = None, query: str | None = None, author: str | None = None, year: int | None = None, venue: str | None = None, entry_type: str | None = None, since=None, until=None, identifier: str | None = None, identifiers: DataFrame | None = None) -> DataFrame:
    """References (id, title, citation_key, venue, entry_type, year, updated_at) that meet every filter given.

    `identifier` is compared whole, trimmed and in lower case, with the (id, value) rows of `identifiers`.

    The query may match a contributor; author and query then are tested on the same contributor row. The contributor join is
    made only if one of them is given.
    """
    rows = references
    if identifier:
        rows = rows.join(identifiers.where(F.lower(F.trim("value")) == identifier.strip().lower()).select("id"), "id", "left_semi")
    if query or author:
        rows = rows.join(contributors.select("id", "display_name"), "id", "left")
    if query:
        rows = rows.where(contains("title", query) | contains("citation_key", query) | contains("venue", query) | F.coalesce(contains("display_name", query), F.lit(False)))
    if author:
        rows = rows.where(contains("display_name", author))
    if year is not None:
        rows = rows.where(F.col("year") == year)
    if venue:
        rows = rows.where(contains("venue", venue))
    if entry_type:
        rows = rows.where(F.lower("entry_type") == entry_type.lower())
    if since is not None:
        rows = rows.where(F.col("updated_at") >= F.lit(since))
    if until is not None:
        rows = rows.where(F.col("updated_at") <= F.lit(until))
    return rows.select(references.columns).distinct() if query or author else rows


def ordered(references: DataFrame, mode: str) -> DataFrame:
    title, ident = F.asc_nulls_last("title"), F.asc("id")
    by = {
        "updated_desc": [F.desc_nulls_last("updated_at"), ident], "updated_asc": [F.asc_nulls_last("updated_at"), ident],
        "year_desc": [F.desc_nulls_last("year"), title, ident], "year_asc": [F.asc_nulls_last("year"), title, ident], "title_asc": [title, ident],
    }[mode]
    return references.orderBy(*by)


def page(references: DataFrame, mode: str, offset: int, limit: int) -> DataFrame:
    """A page of 1 to 100 references in order, each with the number of all that were found."""
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("a page has 1 to 100 rows and no negative offset")
    total = references.agg(F.countDistinct("id").alias("total"))
    return ordered(references, mode).offset(offset).limit(limit).join(F.broadcast(total))


def assembled(references: DataFrame, contributors: DataFrame) -> DataFrame:
    """Each reference with its contributors' names in order of position."""
    names = contributors.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("position", "display_name"))).alias("c"))
    listed = F.array_join(F.transform(F.coalesce("c", F.array()), lambda x: x["display_name"]), "; ")
    return references.join(names, "id", "left").withColumn("authors", listed).drop("c")


def revisions(events: DataFrame, key: str = "reference_id", at: str = "occurred_at", ident: str = "event_id") -> DataFrame:
    """Events numbered 1, 2, ... for each reference in order of time."""
    return events.withColumn("revision", F.row_number().over(Window.partitionBy(key).orderBy(at, ident)))


def heads(revised: DataFrame) -> DataFrame:
    """(reference_id, latest_revision, updated_at)."""
    return revised.groupBy("reference_id").agg(F.max("revision").alias("latest_revision"), F.max("occurred_at").alias("updated_at"))


def history(revised: DataFrame, live: DataFrame) -> DataFrame:
    """The head event of each reference and whether the reference is live."""
    head = heads(revised)
    joined = head.join(revised, (head["reference_id"] == revised["reference_id"]) & (head["latest_revision"] == revised["revision"])).select(head["*"], "action")
    return joined.join(live.select("reference_id", F.lit(True).alias("live")), "reference_id", "left").withColumn("live", F.coalesce("live", F.lit(False)))


def without_head(references: DataFrame, head: DataFrame) -> DataFrame:
    """References that have no event get revision 0."""
    return references.join(head, "reference_id", "left_anti").select("reference_id", F.lit(0).alias("latest_revision"))


def restored(revised: DataFrame, requests: DataFrame) -> DataFrame:
    """Restore events for (reference_id, to_revision, expected_head): status ok with the snapshot, stale, or not_found."""
    head = heads(revised).select("reference_id", "latest_revision")
    old = revised.select("reference_id", F.col("revision").alias("to_revision"), "snapshot")
    joined = requests.join(head, "reference_id", "left").join(old, ["reference_id", "to_revision"], "left")
    status = F.when(F.col("latest_revision").isNull() | F.col("snapshot").isNull(), "not_found").when(F.col("latest_revision") != F.col("expected_head"), "stale").otherwise("ok")
    ok = F.col("status") == "ok"
    return joined.withColumn("status", status).select("reference_id", "to_revision", "status", F.when(ok, F.col("latest_revision") + 1).alias("new_revision"), F.when(ok, F.col("snapshot")).alias("snapshot"))


def as_of(revised: DataFrame, moment) -> DataFrame:
    """The last event of each reference up to a moment: time travel."""
    last = Window.partitionBy("reference_id").orderBy(F.desc("revision"))
    return revised.where(F.col("occurred_at") <= F.lit(moment)).withColumn("r", F.row_number().over(last)).where("r = 1").drop("r")


def overlay(built_in: DataFrame, override: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Built-in settings with overrides laid over them by key; customs are added. `origin` tells which."""
    right = override.select(*keys, *[F.col(v).alias(f"_{v}") for v in values], F.lit(True).alias("_over"))
    left = built_in.select(*keys, *values, F.lit(True).alias("_base"))
    merged = left.join(right, keys, "full")
    origin = F.when(F.col("_over").isNull(), "built_in").when(F.col("_base").isNull(), "custom").otherwise("override")
    return merged.select(*keys, *[F.when(F.col("_over"), F.col(f"_{v}")).otherwise(F.col(v)).alias(v) for v in values], origin.alias("origin"))


def taken_identities(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming (scheme, value, id) whose strong identity another reference holds."""
    held = stored.select("scheme", "value", F.col("id").alias("held_by"))
    return incoming.where(F.col("scheme").isin("doi", "arxiv")).join(held, ["scheme", "value"]).where(F.col("id") != F.col("held_by"))


def counters(requests: DataFrame, by: list[str], duration: str) -> DataFrame:
    """Request counts and summed durations, one row for each label set, and its exposition line."""
    out = requests.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.sum(duration), 6).alias("total"))
    labels = F.concat_ws(",", *[F.concat(F.lit(f'{b}="'), F.col(b).cast("string"), F.lit('"')) for b in by])
    return out.withColumn("line", F.concat(F.lit("requests_total{"), labels, F.lit("} "), "n"))


def users_by_mail(users: DataFrame, offset: int = 0, limit: int = 100) -> DataFrame:
    """A page of users (id, mail, status) in order of their mail address without case, with their places; ties go to the smaller id."""
    top = users.withColumn("mail", F.lower("mail")).orderBy("mail", "id").offset(offset).limit(limit)
    return top.withColumn("place", F.row_number().over(Window.orderBy("mail", "id")) + offset)  # a page of rows
