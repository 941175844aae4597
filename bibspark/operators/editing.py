"""Changes to sources as edits, and what must stay the same: keys, missing fields, inventories, diagnostics of two versions, places in text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fields that may be taken over from another source.
PORTABLE = "title author editor year journal booktitle publisher volume number pages series address month doi url".split()


def new_keys(entries: DataFrame, keys: DataFrame) -> DataFrame:
    """Edits that replace citation keys only. `keys` has (doc_id, entry_idx, key). The key begins after the opening delimiter and white space."""
    rows = entries.join(keys, ["doc_id", "entry_idx"])
    at = F.col("key_start")
    return rows.select("doc_id", F.concat(F.lit("key:"), F.lpad(F.col("entry_idx").cast("string"), 9, "0")).alias("fix_id"), at.alias("start"), (at + F.octet_length("citation_key")).alias("end"), F.col("key").alias("replacement"))


def filled(entries: DataFrame, supplements: DataFrame) -> DataFrame:
    """Edits that add the portable fields an entry lacks and fill its empty ones, from (doc_id, entry_idx, source, name, value).

    Only a record with exactly one supplementing source is changed.
    """
    wanted = supplements.where(F.lower("name").isin(*PORTABLE))
    one = wanted.groupBy("doc_id", "entry_idx").agg(F.countDistinct("source").alias("n"), F.sort_array(F.collect_set(F.struct(F.lower("name").alias("name"), "value"))).alias("new")).where("n = 1")
    rows = entries.join(one, ["doc_id", "entry_idx"]).where(F.size("fields") > 0)
    own = lambda n: F.get(F.filter("fields", lambda f: F.lower(f["name"]) == n), F.lit(0))
    absent = F.filter("new", lambda x: own(x["name"]).isNull())
    empty = F.filter("new", lambda x: own(x["name"]).isNotNull() & (F.trim(F.coalesce(own(x["name"])["resolved"], F.lit("?"))) == ""))
    end = F.element_at("fields", -1)["end"]
    text = F.array_join(F.transform(absent, lambda x: F.concat(F.lit(",\n  "), x["name"], F.lit(" = {"), x["value"], F.lit("}"))), "")
    added = F.when(F.size(absent) > 0, F.array(F.struct(end.alias("start"), end.alias("end"), text.alias("replacement")))).otherwise(F.array())
    put = F.transform(empty, lambda x: F.struct(own(x["name"])["value_start"].alias("start"), own(x["name"])["value_end"].alias("end"), F.concat(F.lit("{"), x["value"], F.lit("}")).alias("replacement")))
    edits = F.concat(added.cast("array<struct<start:bigint,end:bigint,replacement:string>>"), put.cast("array<struct<start:bigint,end:bigint,replacement:string>>"))
    name = F.concat(F.lit("fill:"), F.lpad(F.col("entry_idx").cast("string"), 9, "0"))
    return rows.select("doc_id", name.alias("fix_id"), F.explode(edits).alias("x")).select("doc_id", "fix_id", "x.*")


def inventory(parsed: DataFrame) -> DataFrame:
    """(doc_id, item, n): what a document holds, however it is written: entries with their sorted fields, macros, preambles, comments."""
    value = lambda f: F.trim(F.regexp_replace(F.coalesce(f["resolved"], f["raw"]), r"\s+", " "))
    listed = F.array_join(F.array_sort(F.transform("fields", lambda f: F.concat(F.lower(f["name"]), F.lit("="), value(f)))), "\u0001")
    item = F.when(F.col("kind").isin("entry", "string", "preamble"), F.concat_ws("\u0002", "kind", "entry_type", "citation_key", listed)).otherwise(F.col("kind"))
    return parsed.where("kind <> 'text'").groupBy("doc_id", item.alias("item")).agg(F.count("*").alias("n"))


def same_inventory(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id, same): whether two versions hold the same things equally often."""
    sides = inventory(before).withColumn("s", F.lit(1)).unionByName(inventory(after).withColumn("s", F.lit(-1)))
    return sides.groupBy("doc_id", "item").agg(F.sum(F.col("n") * F.col("s")).alias("d")).groupBy("doc_id").agg(F.bool_and(F.col("d") == 0).alias("same"))


def canonical(docs: DataFrame, fixed: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id, source, kept): the fixed source where it holds the same things as the original, else the original."""
    same = same_inventory(before, after)
    rows = docs.select("doc_id", F.col("source").alias("old")).join(fixed.select("doc_id", F.col("source").alias("new")), "doc_id").join(same, "doc_id", "left")
    ok = F.coalesce("same", F.lit(True))
    return rows.select("doc_id", F.when(ok, F.col("new")).otherwise(F.col("old")).alias("source"), ok.alias("kept"))


def delta(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Diagnostics of one version only: (keys..., change) with added or removed. Equal ones are told apart by their number."""
    numbered = lambda df, s: df.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("s", F.lit(s))
    both = numbered(before, -1).unionByName(numbered(after, 1)).groupBy(*keys).agg(F.sum(F.col("n") * F.col("s")).alias("d")).where("d <> 0")
    return both.select(*keys, F.when(F.col("d") > 0, "added").otherwise("removed").alias("change"), F.abs("d").alias("n"))


def utf16_index(text: Column, at: Column) -> Column:
    """The UTF-16 index of a byte offset; an offset inside a character counts as that character's beginning, one past the end as the end."""
    raw = F.encode(text, "UTF-8")
    inside = lambda i: F.coalesce(F.hex(F.substring(raw, i + 1, F.lit(1))).rlike("^[89AB]"), F.lit(False))
    i = F.least(F.greatest(at, F.lit(0)), F.octet_length(text))
    back = F.when(~inside(i), 0).when(~inside(i - 1), 1).when(~inside(i - 2), 2).otherwise(3)
    prefix = F.decode(F.substring(raw, F.lit(1), i - back), "UTF-8")
    return F.char_length(prefix) + F.regexp_count(prefix, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def inspected() -> Column:
    """An entry as JSON: type, key and field names with their places."""
    fields = F.transform("fields", lambda f: F.struct(f["name"].alias("name"), f["start"].alias("start"), f["end"].alias("end")))
    return F.to_json(F.struct("entry_type", "citation_key", fields.alias("fields")))


def rendered(row: DataFrame, key: Column, entry_type: Column, names: tuple[str, ...]) -> Column:
    """BibTeX of the columns `names` that have a value, in their order: a deterministic rendering of metadata."""
    lines = F.array_compact(F.array(*[F.when(F.coalesce(F.trim(F.col(n).cast("string")), F.lit("")) != "", F.concat(F.lit(f"\n  {n} = {{"), F.trim(F.col(n).cast("string")), F.lit("}"))) for n in names]))
    return F.concat(F.lit("@"), entry_type, F.lit("{"), key, F.lit(","), F.array_join(lines, ","), F.lit("\n}"))
