"""Reference strings to fields, and documents' reference sections to reference strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as N

HEADER = r"^\s*(?:\d+\.?\s*)?(?:References|Bibliography|Literatur)\s*$"
NUMBERED = r"^\s*(?:\[\d+\]|\d+\.)\s+"


def year(text: Column) -> Column:
    """The year after the authors if one stands in parentheses, else the last one."""
    near = F.regexp_extract(text, r"^[^()]{0,200}\(((?:19|20)[0-9]{2})[a-z]?\)", 1)
    every = F.regexp_extract_all(text, F.lit(r"(?<![0-9])((?:19|20)[0-9]{2})(?![0-9])"), F.lit(1))
    return F.when(near != "", near).otherwise(F.try_element_at(every, F.lit(-1))).cast("int")


def pages(text: Column) -> Column:
    return F.nullif(F.regexp_replace(F.regexp_extract(text, r"(?:pp?\.\s*|,\s*)([0-9]{1,5}\s*[-–]\s*[0-9]{1,5})(?![0-9])", 1), r"\s*[-–]\s*", "-"), F.lit(""))


def authors(text: Column) -> Column:
    """Names before the year, split at "and" and ";"."""
    front = F.regexp_replace(F.regexp_extract(text, r"^(.*?)[,.]?\s*\((?:19|20)[0-9]{2}[a-z]?\)", 1), NUMBERED, "")
    return F.filter(F.transform(F.split(front, r"\s*;\s*|\s+(?:and|&)\s+"), lambda x: F.trim(x)), lambda x: x.rlike(r"\p{L}{2}"))


def title(text: Column) -> Column:
    """The sentence after the year."""
    return N.squeeze(F.regexp_extract(text, r"\((?:19|20)[0-9]{2}[a-z]?\)[.,:]?\s*(.+?)[.?!](?:\s|$)", 1))


def venue(text: Column) -> Column:
    rest = F.regexp_extract(text, r"\((?:19|20)[0-9]{2}[a-z]?\)[.,:]?\s*.+?[.?!]\s+([^,.]+)", 1)
    return N.squeeze(F.regexp_replace(rest, r"^(?i:in:?\s+)", ""))


def parsed(rows: DataFrame, text: str = "text") -> DataFrame:
    """`rows` with authors, title, venue, year, pages and doi of a reference string."""
    t = N.squeeze(F.col(text))
    return rows.withColumns({"authors": F.array_join(authors(t), "; "), "title": title(t), "venue": venue(t), "year": year(t), "pages": pages(t), "doi": F.get(N.doi_found(t), F.lit(0))})


def section(docs: DataFrame) -> DataFrame:
    """(doc_id, entry, text) of the numbered references after a document's last reference header."""
    from . import extract

    return extract.grouped_entries(extract.after_last_header(extract.lines(docs), HEADER), NUMBERED).where(F.char_length("text") >= 12)


def alias_value(payload: Column, names: tuple[str, ...]) -> Column:
    """The first of several keys that a JSON object has."""
    return F.coalesce(*[N.squeeze(F.get_json_object(payload, f"$.{n}")) for n in names])
