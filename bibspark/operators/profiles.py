"""Export under profiles that are rows: one pass writes every record under every profile, or says what stands in its way.

A profile row holds what it selects (allow, deny), renames and in which order, which types it takes, how months, preprints and venues are
written, which fields keep their case, delimiters, indent and line ending. Records meet the few profiles by an explode, and each
choice is a column, so profiles need no code of their own. Values are escaped for TeX in context; identifiers and links stay as they are.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lex, tex
from ..functions import normalize as N
from . import generate, identity, parse, rules, semrules
from .semantic import first

PROFILE = (
    "profile string, allow array<string>, deny array<string>, field_order array<string>, renames map<string,string>, types array<string>, month_format string, "
    "representation string, style string, protected array<string>, quotes boolean, include_doi boolean, include_url boolean, include_extra boolean, indent string, line_end string, trailing_comma boolean"
)
# What a profile row has where its settings say nothing.
DEFAULTS = {
    "profile": "modern", "allow": [], "deny": [], "field_order": [], "renames": {}, "types": [], "month_format": "numeric", "representation": "misc-eprint", "style": "full", "protected": ["title"],
    "quotes": False, "include_doi": True, "include_url": True, "include_extra": True, "indent": "  ", "line_end": "\n", "trailing_comma": True,
}


def profile_frame(spark, settings: list[dict]) -> DataFrame:
    """Profile rows from settings; names of fields count without case."""
    low = lambda xs: [x.lower() for x in xs]
    rows = [DEFAULTS | s for s in settings]
    rows = [r | {"allow": low(r["allow"]), "deny": low(r["deny"]), "field_order": low(r["field_order"]), "types": low(r["types"]), "protected": low(r["protected"]), "renames": {k.lower(): v for k, v in r["renames"].items()}} for r in rows]
    return spark.createDataFrame([tuple(r[n] for n in DEFAULTS) for r in rows], PROFILE)


@F.pandas_udf(T.ArrayType(T.StringType()))
def inner_texts(values: pd.Series, raw: pd.Series, protect: pd.Series) -> pd.Series:
    """Values as they stand between delimiters: escaped with single spaces unless raw, in one more pair of braces where protected and not in one already."""

    def one(value: str, as_is: bool, keep: bool) -> str:
        text = value if as_is else re.sub(r"\s+", " ", tex.escaped(value))
        return "{" + text + "}" if keep and not lex._whole_group(text) else text

    return pd.Series([[one(*x) for x in zip(v, r, p, strict=True)] for v, r, p in zip(values, raw, protect, strict=True)])


def chosen_fields() -> Column:
    """Generated and other fields of a record under the profile in column p, before selection."""
    p, chosen = F.col("p"), []
    pick = lambda test, a, b: [F.when(test, x).otherwise(y) for x, y in zip(a, b, strict=True)]
    chosen += [generate._field("title", N.title_for_display(first("title")["resolved"])), generate._field("author", generate.people("author")), generate._field("editor", generate.people("editor"))]
    chosen += pick(p["style"] == "abbreviated", [generate.venue_field("abbreviated")], [generate.venue_field("full")])
    chosen += pick(p["month_format"] == "numeric", generate.date_fields("numeric"), generate.date_fields("macro"))
    for how in ("misc-eprint", "misc-howpublished", "article-journal"):
        chosen += [F.when(p["representation"] == how, x) for x in generate.preprint_fields(how)]
    *ids, doi, url = generate.identifier_fields(True, True)
    chosen += [*ids, F.when(p["include_doi"], doi), F.when(p["include_url"], url)]
    made = F.array_compact(F.array(*chosen)).cast(generate.FIELD)
    name = lambda f: F.lower(f["name"])
    others = F.filter("fields", lambda f, i: p["include_extra"] & ~name(f).isin(*generate.COVERED) & f["resolved"].isNotNull() & ~F.exists(F.slice("fields", 1, i), lambda g: name(g) == name(f)))
    own = F.transform(others, lambda f: F.struct(name(f).alias("name"), f["resolved"].alias("value")))
    of = lambda rows, n: F.get(F.filter(rows, lambda x: F.lower(x["name"]) == n), F.lit(0))["value"]
    both = F.transform(made, lambda x: F.struct(x["name"].alias("name"), F.when(x["name"].isin("note", "howpublished") & of(own, x["name"]).isNotNull(), generate.merged(of(own, x["name"]), x["value"])).otherwise(x["value"]).alias("value")))
    return F.concat(both, F.filter(own, lambda x: of(made, F.lower(x["name"])).isNull())).cast(generate.FIELD)


def obstacles() -> Column:
    """The first obstacle between a record and its export, as (reason, detail), or null: key, unresolved value, date, ambiguity, conflict,
    uncertain field, work type, type that the profile lacks, field that comes twice, name that is none."""
    ids, lost = F.col("ids"), F.filter("fields", lambda f: (F.size(f["unresolved"]) > 0) | f["resolved"].isNull())
    names = lambda f: F.lower(f["name"])
    distinct = lambda scheme: F.size(F.array_distinct(identity.of_scheme(ids, scheme))) > 1
    doubled = F.filter("fields", lambda f: F.exists("fields", lambda g: (names(g) == names(f)) & (g["resolved"] != f["resolved"])))
    several = F.filter("fields", lambda f: F.size(f["candidates"]) > 1)
    out = F.transform("out", lambda f: F.lower(f["name"]))
    at = lambda rows: names(F.get(rows, F.lit(0)))
    nameless = F.filter("out", lambda f: ~f["name"].rlike(r"^[A-Za-z][A-Za-z0-9_:.+-]*$"))
    case = lambda test, reason, detail: F.when(test, F.struct(F.lit(reason).alias("reason"), detail.cast("string").alias("detail")))
    date = N.squeeze(first("date")["resolved"])
    return F.coalesce(
        case(~F.col("citation_key").rlike(r"^[^\s{}(),=\\\"#%~']+$"), "bad_key", F.col("citation_key")),
        case(F.size(lost) > 0, "unresolved", at(lost)),
        case(date.isNotNull() & N.year(F.get(F.split(date, "[-/]"), F.lit(0))).isNull(), "date", date),
        case(F.size(several) > 0, "ambiguous", at(several)),
        case(distinct("doi"), "ambiguous", F.lit("doi")),
        case(distinct("arxiv"), "ambiguous", F.lit("arxiv")),
        case(F.size(doubled) > 0, "ambiguous", at(doubled)),
        case(semrules.date_conflict(), "conflict", F.lit("date")),
        case(first("author").isNotNull() & (F.size(F.coalesce(first("author")["people"], F.array())) == 0), "uncertain", F.lit("author")),
        case(F.col("work_type") == "unknown", "unknown_type", F.col("entry_type")),
        case((F.size("p.types") > 0) & ~F.array_contains("p.types", F.col("target")), "unsupported_type", F.col("target")),
        case(F.size(F.array_distinct(out)) < F.size(out), "duplicate_field", F.get(F.filter(out, lambda n: F.size(F.filter(out, lambda m: m == n)) > 1), F.lit(0))),
        case(F.size(nameless) > 0, "bad_field", F.get(nameless, F.lit(0))["name"]),
    )


def target_type() -> Column:
    """The type to write: misc for preprints, the record's own where the profile lists it, else the usual one of its work type."""
    fits, own = generate.entry_type(), F.lower("entry_type")
    return F.when(F.col("work_type") == "preprint", "misc").when(F.array_contains("p.types", own), own).otherwise(fits)


def exported(described: DataFrame, profiles: DataFrame) -> DataFrame:
    """(profile, doc_id, entry_idx, reason, detail, bibtex): every `identity.described` record under every row of `profiles`."""
    rows = described if "venue_short" in described.columns else described.withColumns({"venue_short": F.lit(None).cast("string"), "venue_full": F.lit(None).cast("string")})
    listed = profiles.agg(F.collect_list(F.struct(*profiles.columns)).alias("ps")).withColumn("one", F.lit(1))  # a catalog of a few profiles, one row
    met = rows.withColumn("one", F.lit(1)).join(listed, "one").withColumn("p", F.explode("ps")).drop("ps", "one")
    name = lambda f: F.lower(f["name"])
    p = F.col("p")
    renamed = F.transform("made", lambda f: F.struct(F.coalesce(F.try_element_at(p["renames"], name(f)), f["name"]).alias("name"), f["value"].alias("value")))
    kept = F.filter(renamed, lambda f: ((F.size(p["allow"]) == 0) | F.array_contains(p["allow"], name(f))) & ~F.array_contains(p["deny"], name(f)))
    rank = lambda f: F.when(F.array_position(p["field_order"], name(f)) > 0, F.array_position(p["field_order"], name(f))).otherwise(F.lit(2**31))
    ordered = F.transform(F.array_sort(F.transform(kept, lambda f, i: F.struct(rank(f).alias("r"), name(f).alias("low"), i.alias("i"), f["name"].alias("name"), f["value"].alias("value")))), lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value")))
    out = met.withColumn("made", chosen_fields()).withColumn("out", ordered).withColumn("target", target_type()).withColumn("stop", obstacles())
    values = F.transform("out", lambda f: f["value"])
    raw = F.transform("out", lambda f: identity.is_raw_identifier(f["name"]))
    protect = F.transform("out", lambda f: F.array_contains(p["protected"], name(f)) & ~identity.is_raw_identifier(f["name"]))
    texts = out.withColumn("inner", inner_texts(values, raw, protect))
    macro = lambda f, t: (p["month_format"] != "numeric") & (name(f) == "month") & t.isin(*[m.lower()[:3] for m in generate.MONTHS])
    within = lambda f, t: F.when(macro(f, t), t).when(p["quotes"], F.concat(F.lit('"'), t, F.lit('"'))).otherwise(F.concat(F.lit("{"), t, F.lit("}")))
    lines = F.zip_with("out", "inner", lambda f, t: F.concat(p["line_end"], p["indent"], f["name"], F.lit(" = "), within(f, t)))
    end = F.concat(F.when(p["trailing_comma"], F.lit(",")).otherwise(F.lit("")), p["line_end"], F.lit("}"), p["line_end"])
    text = F.concat(F.lit("@"), F.col("target"), F.lit("{"), F.col("citation_key"), F.lit(","), F.array_join(lines, ","), end)
    return texts.select("p.profile", "doc_id", "entry_idx", "stop.reason", "stop.detail", F.when(F.col("stop").isNull(), text).alias("bibtex"))


def strict(entries: DataFrame, described: DataFrame, profiles: DataFrame, policy: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """(profile, doc_id, status, codes, source): documents written in full under each profile, or why not.

    A document with a blocking finding is stopped before (`input_blocked`, the codes); one with a record that can't be written gives no
    text (`not_exported`, the reasons); what was written is parsed and validated again under the same policy (`output_blocked`).
    """
    from .storage import cut

    listed = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    blocked = lambda found: found.where("blocking").groupBy("doc_id").agg(listed("code").alias("codes"))
    before = blocked(rules.validate(entries, policy, registry)).withColumnRenamed("codes", "input_codes")
    rows = F.transform(F.sort_array(F.collect_list(F.struct("entry_idx", "bibtex"))), lambda x: x["bibtex"])
    whole = exported(described, profiles).groupBy("profile", "doc_id").agg(F.array_join(rows, "\n").alias("text"), listed("reason").alias("reasons"), F.count("reason").alias("stopped"))
    open_ = cut(whole.join(before, "doc_id", "left").withColumn("key", F.monotonically_increasing_id()))
    written = open_.where("stopped = 0 and input_codes is null").select(F.col("key").alias("doc_id"), F.col("text").alias("source"))
    after = blocked(rules.validate(parse.entries(parse.blocks(written)), policy, registry)).select(F.col("doc_id").alias("key"), F.col("codes").alias("output_codes"))
    judged = open_.join(after, "key", "left")
    status = F.when(F.col("input_codes").isNotNull(), "input_blocked").when(F.col("stopped") > 0, "not_exported").when(F.col("output_codes").isNotNull(), "output_blocked").otherwise("exported")
    codes = F.coalesce("input_codes", F.nullif("reasons", F.lit("")), "output_codes", F.lit(""))
    return judged.select("profile", "doc_id", status.alias("status"), codes.alias("codes"), F.when(status == "exported", F.col("text")).alias("source"))
