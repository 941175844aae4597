"""Identifier, date, name and venue normalisation as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names by their first three letters.
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def squeeze(c: Column) -> Column:
    """White space collapsed and trimmed; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))


def doi(c: Column) -> Column:
    """Lower-case DOI without resolver or scheme prefix; null unless it is 10.<4+ digits>/<no white space>."""
    bare = F.lower(F.regexp_replace(F.trim(c), r"(?i)^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)", ""))
    return F.when(bare.rlike(r"^10\.[0-9]{4,}/\S+$"), bare)


def doi_found(c: Column) -> Column:
    """The DOIs in running text, trailing punctuation dropped, in order and once each."""
    found = F.regexp_extract_all(c, F.lit(r"(?i)\b(10\.[0-9]{4,9}/[^\s\"<>{}]+)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.lower(F.regexp_replace(x, r"[.,;)]+$", ""))))


def arxiv(c: Column) -> Column:
    """struct<base, version> of an arXiv identifier or URL, or null."""
    bare = F.regexp_replace(F.trim(c), r"(?i)^(?:https?://arxiv\.org/(?:abs|pdf)/|arxiv:\s*)", "")
    base = F.regexp_extract(bare, r"^([0-9]{4}\.[0-9]{4,5}|[A-Za-z][A-Za-z.-]*/[0-9]{7})(v[0-9]+)?$", 1)
    version = F.nullif(F.regexp_extract(bare, r"(v[0-9]+)$", 1), F.lit(""))
    return F.when(base != "", F.struct(base.alias("base"), version.alias("version")))


def isbn(c: Column) -> Column:
    return F.nullif(F.regexp_replace(F.upper(c), "[^0-9X]", ""), F.lit(""))


def issn(c: Column) -> Column:
    bare = isbn(c)
    return F.when(F.char_length(bare) == 8, F.concat(F.substring(bare, 1, 4), F.lit("-"), F.substring(bare, 5, 4))).otherwise(bare)


def year(c: Column) -> Column:
    return F.when(F.trim(c).rlike("^[0-9]{4}$"), F.trim(c).cast("int"))


def month(c: Column) -> Column:
    t = F.lower(F.trim(c))
    named = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.substring(t, 1, 3)).cast("int")
    return F.when(t.rlike("^(?:0?[1-9]|1[0-2])$"), t.try_cast("int")).when(t.rlike("^[a-z]{3}") & (named > 0), named)


def person_text(p: Column) -> Column:
    """struct<given, prefix, family, suffix, literal> of a parsed person, words joined."""
    join = lambda name: F.nullif(F.array_join(p[name], " "), F.lit("")).alias(name)
    return F.struct(*[join(n) for n in ("given", "prefix", "family", "suffix")], p["literal"].alias("literal"))


def display_name(p: Column) -> Column:
    whole = F.concat_ws(", ", F.nullif(F.concat_ws(" ", p["given"], p["prefix"], p["family"]), F.lit("")), p["suffix"])
    return F.coalesce(p["literal"], whole)


def venue_alias(c: Column) -> Column:
    """Lower-case venue name without volume, year at the end, "proceedings of (the)", and an edition or year at the beginning."""
    t = F.trim(F.lower(F.regexp_replace(c, r"\s+", " ")))
    t = F.regexp_replace(t, r"(?: \(volume |: volume ).*$", "")
    # a word that is a year but for punctuation around it
    t = F.regexp_replace(t, r"(?:^|(?<= ))[,.:;()\[\]]*(?:19|20|21)[0-9]{2}[,.:;()\[\]]*$", "\u0001")
    t = F.regexp_replace(t, "[\\s,.:;\\-\u2013]*\u0001$", "")
    t = F.regexp_replace(t, r"^proceedings of (?:the )?", "")
    return F.nullif(F.regexp_replace(t, r"^(?:[0-9]+(?:st|nd|rd|th)|(?:19|20|21)[0-9]{2}) ", ""), F.lit(""))


def title_for_display(c: Column) -> Column:
    """Braces dropped, escaped braces kept as braces, white space collapsed."""
    held = F.regexp_replace(F.regexp_replace(c, r"\\\{", "\u0001"), r"\\\}", "\u0002")
    return squeeze(F.translate(F.translate(held, "{}", ""), "\u0001\u0002", "{}"))


def revision(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c, 256))
