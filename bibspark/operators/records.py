"""Stored records: snapshots and their revisions, baselines, contexts, sessions, settings; synthesis and pickers over provider rows; layouts and feeds."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import normalize as N
from . import resolve

SNAPSHOT = "struct<version:int,title:string,bibtex:string,raw_bibtex:string>"


def get(references: DataFrame, wanted: DataFrame, key: str = "reference_id") -> DataFrame:
    """The wanted references that there are; each key once."""
    return references.join(wanted.select(key).distinct(), key, "left_semi")


def snapshot(data: Column) -> Column:
    """struct<version, title, bibtex, complete> of a stored snapshot; the first version kept its source as raw_bibtex."""
    x = F.from_json(data, SNAPSHOT)
    source = F.coalesce(x["bibtex"], x["raw_bibtex"])
    return F.when(x.isNotNull(), F.struct(F.coalesce(x["version"], F.lit(1)).alias("version"), x["title"].alias("title"), source.alias("bibtex"), source.isNotNull().alias("complete")))


def projected(events: DataFrame) -> DataFrame:
    """Revisions for display: the title after, else before, else the key; whether a revision can be restored."""
    after, before = snapshot(F.col("after_data")), snapshot(F.col("before_data"))
    title = F.coalesce(F.nullif(F.trim(after["title"]), F.lit("")), F.nullif(F.trim(before["title"]), F.lit("")), F.col("reference_id").cast("string"))
    return events.select("reference_id", "revision", title.alias("title"), F.coalesce(after["bibtex"], before["bibtex"]).alias("bibtex"), (F.coalesce(after["complete"], F.lit(False)) & (F.col("action") != "delete")).alias("restorable"))


def audit_action(before: Column, after: Column) -> tuple[Column, Column]:
    """(action, data kept on a downgrade): a row without data afterwards was a deletion; older tables keep one side only."""
    return F.when(after.isNull(), "delete").otherwise("change"), F.coalesce(after, before)


def baselines(head_events: DataFrame) -> DataFrame:
    """A baseline event after each head whose snapshot is not complete: (reference_id, revision, action)."""
    whole = F.coalesce(snapshot(F.col("after_data"))["complete"], F.lit(False))
    return head_events.where(~whole & (F.col("action") != "delete")).select("reference_id", (F.col("revision") + 1).alias("revision"), F.lit("baseline").alias("action"))


def with_contexts(references: DataFrame, contexts: DataFrame) -> DataFrame:
    """References with their citation contexts in order of time, each text once, and a revision more where any is new."""
    first_ = contexts.groupBy("reference_id", "text").agg(F.min(F.struct("at", "ident")).alias("m"))
    listed = first_.groupBy("reference_id").agg(F.sort_array(F.collect_list(F.struct("m", "text"))).alias("c"))
    out = references.join(listed, "reference_id", "left")
    return out.select("reference_id", F.size(F.coalesce("c", F.array())).alias("n_contexts"), F.get(F.col("c"), F.lit(0))["text"].alias("first_context"), (F.col("revision") + F.col("c").isNotNull().cast("int")).alias("revision"))


def session_status(sessions: DataFrame, disabled: DataFrame, at: Column, keep: str = "30 days") -> DataFrame:
    """`sessions` (user_id, session_id, created, expires, revoked) with status at a moment; disabling a user revokes the sessions open then.

    `removed` marks what retention cleanup deletes: sessions that ended longer ago than `keep`.
    """
    off = disabled.groupBy("user_id").agg(F.min("disabled_at").alias("disabled_at"))
    rows = sessions.join(off, "user_id", "left").withColumn("revoked", F.coalesce("revoked", F.when(F.col("disabled_at") < F.col("expires"), F.greatest("disabled_at", "created"))))
    ended = F.least("expires", "revoked")
    status = F.when(F.col("revoked") <= at, "revoked").when(F.col("expires") <= at, "expired").otherwise("open")
    return rows.select("session_id", status.alias("status"), (ended + F.expr(f"interval {keep}") <= at).alias("removed"))


def setting_history(changes: DataFrame) -> DataFrame:
    """Changes of each kind in order of time, latest first, then key and falling revision, with their places."""
    order = Window.partitionBy("kind").orderBy(F.desc("occurred_at"), "key", F.desc("revision"))
    return changes.withColumn("place", F.row_number().over(order))


# Entry types by publication type of providers.
PUBLICATION_TYPES = {"journal-article": "article", "journalarticle": "article", "proceedings-article": "inproceedings", "conference": "inproceedings", "book": "book", "book-chapter": "incollection", "dissertation": "phdthesis", "report": "techreport"}


def mapped_type(types: Column) -> Column:
    """The entry type of a record's publication types if they map to exactly one."""
    table = F.create_map(*[F.lit(x) for kv in PUBLICATION_TYPES.items() for x in kv])
    kinds = F.array_distinct(F.array_compact(F.transform(types, lambda t: F.try_element_at(table, F.lower(F.regexp_replace(t, r"\s+", ""))))))
    return F.when(F.size(kinds) == 1, F.get(kinds, F.lit(0)))


def venue_agrees(wanted: Column, found: Column) -> Column:
    """Whether two venue names may be one: one holds the other, one is the other's acronym, or half of their words are shared."""
    a, b = resolve.comparison_key(wanted), resolve.comparison_key(found)
    acronym = lambda x: F.array_join(F.transform(F.filter(F.split(x, " "), lambda w: ~w.isin("of", "the", "on", "and", "for", "in")), lambda w: F.substring(w, 1, 1)), "")
    alike = resolve.jaccard(resolve.tokens(a), resolve.tokens(b)) >= 0.5
    return F.when((F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == ""), True).otherwise(F.contains(a, b) | F.contains(b, a) | (acronym(a) == b) | (acronym(b) == a) | alike)


def synthesized(rows: DataFrame) -> DataFrame:
    """(id, entry_type, problem, provenance) of provider rows (id, source, title, authors, year, venue, wanted_venue, types): what a record made of them would be.

    Refused without one entry type, with another venue, or without a field that the type needs. Provenance names each field's source.
    """
    kind = mapped_type(F.col("types"))
    lacking = F.array_compact(F.array(F.when(F.col("title").isNull(), "title"), F.when(F.size(F.coalesce("authors", F.array().cast("array<string>"))) == 0, "author"), F.when(F.col("year").isNull(), "year"), F.when(kind.isin("article", "inproceedings") & F.col("venue").isNull(), "venue")))
    problem = F.when(kind.isNull(), "type").when(~venue_agrees(F.col("wanted_venue"), F.col("venue")), "venue").when(F.size(lacking) > 0, F.concat(F.lit("incomplete:"), F.array_join(lacking, ",")))
    names = F.array_compact(F.array(*[F.when(F.col(n).isNotNull(), F.concat(F.lit(f"{n}@"), "source")) for n in ("title", "authors", "year", "venue")]))
    return rows.select("id", kind.alias("entry_type"), problem.alias("problem"), F.when(problem.isNull(), F.array_join(names, ",")).alias("provenance"))


def with_clues(references: DataFrame, embedded: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """References whose missing values come from BibTeX found in their own text, field by field."""
    other = embedded.select("ref_id", *[F.col(n).alias(f"e_{n}") for n in names])
    return references.join(other, "ref_id", "left").select("ref_id", *[F.coalesce(F.nullif(F.trim(F.col(n)), F.lit("")), F.col(f"e_{n}")).alias(n) for n in names])


def picked(first_of: Column, date_parts: Column, localized: Column, languages: Column) -> Column:
    """A provider's lists as single values: the first text, year, month and day, a text in English or else any, the most frequent language."""
    part = lambda i: F.get(date_parts, F.lit(i))
    english = F.get(F.filter(localized, lambda x: x["lang"] == "en"), F.lit(0))["text"]
    counted = F.transform(F.array_distinct(languages), lambda l: F.struct(F.size(F.filter(languages, lambda x: x == l)).alias("n"), (-F.array_position(languages, l)).alias("at"), l.alias("lang")))
    return F.struct(F.get(F.filter(first_of, lambda x: F.trim(x) != ""), F.lit(0)).alias("first"), part(0).alias("year"), part(1).alias("month"), part(2).alias("day"), F.coalesce(english, F.get(localized, F.lit(0))["text"]).alias("text"), F.array_max(counted)["lang"].alias("language"))


# Words that no citation key takes as its concept.
CONCEPT_STOP = "a an and are as at by for from in into is of on or that the their to towards toward using via we with".split()


def concepts(title: Column, most: int = 8) -> Column:
    """Concept candidates of a title: the words before a colon, acronyms, then the other words; no stop words, each once."""
    plain = F.regexp_replace(F.coalesce(title, F.lit("")), r"[{}\\]", "")
    head = F.when(plain.contains(":"), F.split(F.lower(F.substring_index(plain, ":", 1)), r"[^\p{L}\p{N}]+")).otherwise(F.array().cast("array<string>"))
    head = F.when(F.size(head) <= 3, head).otherwise(F.array().cast("array<string>"))
    acronyms = F.transform(F.regexp_extract_all(plain, F.lit(r"(?<![\p{L}\p{N}])((?:\p{Lu}[\p{Ll}\p{N}]?){2,}s?)(?![\p{L}\p{N}])"), F.lit(1)), lambda x: F.lower(x))
    words = F.split(F.lower(plain), r"[^\p{L}\p{N}]+")
    kept = F.filter(F.array_distinct(F.concat(head, acronyms, words)), lambda w: (F.char_length(w) > 1) & ~w.isin(*CONCEPT_STOP) & ~w.rlike("^[0-9]+$"))
    return F.slice(kept, 1, most)


def representative(candidates: Column, taken: Column) -> Column:
    """The first concept that no other record has taken, else the first."""
    return F.coalesce(F.get(F.array_except(candidates, taken), F.lit(0)), F.get(candidates, F.lit(0)))


AFFILIATION = r"(?i)@|\b(?:universit|institut|department|laborator|school of|college|faculty|inc\.|corp)"


def layout(blocks: DataFrame) -> DataFrame:
    """(doc_id, title, authors, abstract) of layout blocks (doc_id, page, block_order, block_id, label, text).

    The title is the first title block; authors stand in the next seven blocks up to the abstract, without affiliations and mail addresses.
    """
    order = Window.partitionBy("doc_id").orderBy(F.col("page").asc_nulls_last(), F.col("block_order").asc_nulls_last(), F.col("block_id").asc_nulls_last())
    rows = blocks.withColumn("n", F.row_number().over(order))
    doc = Window.partitionBy("doc_id")
    marked = rows.withColumns({"t": F.min(F.when(F.col("label") == "doc_title", F.col("n"))).over(doc), "a": F.min(F.when((F.col("label") == "abstract") | F.lower("text").rlike(r"^\s*abstract\b"), F.col("n"))).over(doc)})
    after = (F.col("n") > F.col("t")) & (F.col("n") <= F.col("t") + 7) & (F.col("n") < F.coalesce("a", F.lit(2**31 - 1))) & ~F.col("text").rlike(AFFILIATION)
    names = F.flatten(F.transform(F.sort_array(F.collect_list(F.when(after, F.struct("n", "text")))), lambda x: F.split(x["text"], r"\s*(?:,|;|\band\b)\s*")))
    title = F.max(F.when(F.col("n") == F.col("t"), N.squeeze(F.col("text"))))
    abstract = F.max(F.when(F.col("n") == F.col("a"), N.squeeze(F.regexp_replace("text", r"(?i)^\s*abstract\b[\s:.-]*", ""))))
    return marked.groupBy("doc_id").agg(title.alias("title"), F.array_join(F.filter(names, lambda x: F.trim(x) != ""), "; ").alias("authors"), abstract.alias("abstract"))


def artifact(payload: Column) -> Column:
    """Layout blocks of an OCR result: pages under either key, blocks with label, text and order under alternative keys."""
    block = "struct<block_label:string,label:string,block_content:string,text:string,block_order:int,order:int,block_id:int>"
    x = F.from_json(payload, f"struct<pages:array<struct<page:int,blocks:array<{block}>>>,results:array<struct<page:int,blocks:array<{block}>>>>")
    pages = F.coalesce(x["pages"], x["results"], F.array().cast(f"array<struct<page:int,blocks:array<{block}>>>"))
    one = lambda p: F.transform(F.coalesce(p["blocks"], F.array().cast(f"array<{block}>")), lambda b: F.struct(p["page"].alias("page"), F.coalesce(b["block_order"], b["order"]).alias("block_order"), b["block_id"].alias("block_id"), F.coalesce(b["block_label"], b["label"]).alias("label"), F.coalesce(b["block_content"], b["text"]).alias("text")))
    return F.flatten(F.transform(pages, one))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("id", T.StringType()), T.StructField("title", T.StringType()), T.StructField("authors", T.ArrayType(T.StringType()))])))
def feed_entries(xml: pd.Series) -> pd.Series:
    """Entries of an Atom-like feed, the text of elements flattened, in any name space. Null for a document type or an entity declaration,
    which a safe parser refuses, and for what is no XML."""
    import re
    from xml.etree import ElementTree

    def local(e) -> str:
        return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""

    def plain(e) -> str | None:
        return None if e is None else " ".join("".join(e.itertext()).split()) or None

    def entry(e) -> dict:
        child = lambda n: next((x for x in e if local(x) == n), None)
        return {"id": plain(child("id")), "title": plain(child("title")), "authors": [plain(x) for x in e.iter() if local(x) == "name"]}

    def parsed(text):
        if text is None or re.search(r"(?i)<!DOCTYPE|<!ENTITY", text):
            return None
        try:
            return [entry(e) for e in ElementTree.fromstring(text).iter() if local(e) == "entry"]
        except ElementTree.ParseError:
            return None

    return xml.map(parsed)


def unnumbered_starts(line: Column) -> Column:
    """Whether a line opens an unnumbered reference: a surname, an initial or given name, and a year further on."""
    return line.rlike(r"^\p{Lu}[\p{L}'-]+,\s+\p{Lu}[\p{L}.]*.*(?:19|20)[0-9]{2}[a-z]?\)?[.,:]") | line.rlike(r"^\p{Lu}[\p{L}'-]+(?:\s+(?:and|et al\.?|&)\b.*)?\s*\((?:19|20)[0-9]{2}[a-z]?\)")


def repaired(stored: DataFrame, parsed: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Stored references with their deficient fields taken from a new reading of their text: blank ones, and venues that hold a year or pages."""
    other = parsed.select("ref_id", *[F.col(n).alias(f"p_{n}") for n in names])
    bad = lambda n: (F.coalesce(F.trim(F.col(n)), F.lit("")) == "") | (F.col(n).rlike(r"(?:19|20)[0-9]{2}|\bpp?\.") if n == "venue" else F.lit(False))
    return stored.join(other, "ref_id", "left").select("ref_id", *[F.when(bad(n), F.coalesce(F.col(f"p_{n}"), F.col(n))).otherwise(F.col(n)).alias(n) for n in names])


def split_merged(text: Column) -> Column:
    """The references of a text in which several numbered ones run together."""
    return F.filter(F.transform(F.split(text, r"\s+(?=\[[0-9]{1,3}\]\s)"), lambda x: F.trim(x)), lambda x: F.char_length(x) >= 12)


def summary_text(title: Column, authors: Column, n: Column, form: str) -> Column:
    """One document's summary as csv, markdown, text or json."""
    if form == "json":
        return F.to_json(F.struct(title.alias("title"), authors.alias("authors"), n.alias("references")))
    if form == "csv":
        quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(c, '"', '""'), F.lit('"'))
        return F.concat_ws(",", quoted(title), quoted(authors), n.cast("string"))
    head = ("# ", "- Authors: ", "- References: ") if form == "markdown" else ("Title: ", "Authors: ", "References: ")
    return F.concat_ws("\n", *[F.concat(F.lit(h), c.cast("string")) for h, c in zip(head, (title, authors, n), strict=True)])
