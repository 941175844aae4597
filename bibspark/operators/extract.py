"""Citation text, chat messages and HTML to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FENCE = r"(?s)```(.*?)```"


def code_block(message: Column) -> Column:
    """The body of a message's only fenced block, without its language tag; null if there is none or more than one."""
    found = F.regexp_extract_all(message, F.lit(FENCE), F.lit(1))
    body = F.regexp_replace(F.get(found, F.lit(0)), r"^(?i:bib(?:tex)?)?[ \t]*\n", "")
    links = F.regexp_replace(body, r"<(https?://[^|>\s]+)(?:\|[^>]*)?>", "$1")
    return F.when(F.size(found) == 1, F.replace(F.replace(F.replace(links, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&")))


def links(html: Column) -> Column:
    """Targets of a page's links in order, once each."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r"(?i)<a\s[^>]*?href=\"([^\"]*)\""), F.lit(1)))


def title(html: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " ")), F.lit(""))


def lines(docs: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """(doc_id, n, line)."""
    return docs.select(F.col(ident).alias("doc_id"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("n", "line"))


def after_last_header(line_rows: DataFrame, header: str) -> DataFrame:
    """Lines after the last one that matches `header`; documents without one give none."""
    last = F.max(F.when(F.col("line").rlike(header), F.col("n"))).over(Window.partitionBy("doc_id"))
    return line_rows.withColumn("h", last).where("n > h").drop("h")


# The lines that end a list of references, the numbers that open one, and the least characters of one.
SECTION = r"^\s*(?i:acknowledge?ments?|appendix|supplementary|付録)\b"
NUMBERED = r"^\s*(?:\[[0-9]+\]|[0-9]+[.)])\s*(?=\S)"
LEAST = 12
_NAME = r"(?:\p{Lu}[\p{L}'’-]*\.?|van|von|der|den|de|la|del|and|et|al\.?|&)"


def reference_block(line_rows: DataFrame, header: str, section: str = SECTION) -> DataFrame:
    """Lines after the last one that matches `header`, up to the next section; a section right after the header doesn't count."""
    after = after_last_header(line_rows, header)
    doc = Window.partitionBy("doc_id")
    placed = after.withColumn("first", F.min("n").over(doc))
    ended = placed.withColumn("end", F.min(F.when(F.col("line").rlike(section) & (F.col("n") > F.col("first")), F.col("n"))).over(doc))
    return ended.where(F.col("end").isNull() | (F.col("n") < F.col("end"))).drop("first", "end")


def unnumbered(text: Column) -> Column:
    """The references of a text that runs them together: each begins with a sentence of names before one that is a year. Initials end no sentence."""
    names, year = rf"^{_NAME}(?:[,;]?\s+{_NAME})*\.$", r"^(?:19|20)[0-9]{2}[a-z]?\.$"
    s = F.split(text, r"(?<=\.)(?<!\b\p{Lu}\.)\s+")
    both = names[:-1] + r"\s+(?:19|20)[0-9]{2}[a-z]?\.$"  # names that end with an initial, and the year
    starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.get(s, i).rlike(both) | (F.get(s, i).rlike(names) & F.coalesce(F.get(s, i + 1).rlike(year), F.lit(False))))
    part = lambda p, k: F.array_join(F.slice(s, p + 1, F.coalesce(F.get(starts, k + 1), F.size(s)) - p), " ")
    return F.when(F.size(starts) <= 1, F.array(text)).otherwise(F.filter(F.transform(starts, part), lambda x: F.char_length(x) >= LEAST))


def references(block: DataFrame) -> DataFrame:
    """(doc_id, entry, text) of the lines of reference blocks: a number or a blank line before opens an entry, other lines go on with it;
    short ones go, and a block of one entry is taken apart by names and years."""
    order = Window.partitionBy("doc_id").orderBy("n")
    clean = block.withColumn("t", F.trim(F.regexp_replace("line", r"\s+", " ")))
    opens = F.col("t").rlike(NUMBERED) | (F.coalesce(F.lag("t").over(order), F.lit("")) == "")
    filled = clean.withColumn("opens", opens.cast("int")).where("t <> ''").withColumn("entry", F.sum("opens").over(order))
    rows = F.sort_array(F.collect_list(F.struct("n", F.regexp_replace("t", NUMBERED, "").alias("t"))))
    entries = filled.groupBy("doc_id", "entry").agg(F.array_join(F.transform(rows, lambda x: x["t"]), " ").alias("text")).where(F.char_length("text") >= LEAST)
    several = entries.withColumn("many", F.count("*").over(Window.partitionBy("doc_id")) > 1)
    parts = several.select("doc_id", "entry", F.posexplode(F.when(F.col("many"), F.array("text")).otherwise(unnumbered(F.col("text")))).alias("k", "text"))
    return parts.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("entry", "k")).alias("entry"), "text")


def embedded_bibtex(html: Column) -> Column:
    """The first preformatted block, text area or code of a page that begins with an entry, without tags and with its entities resolved; null if there is none."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<(pre|textarea|code)\b[^>]*>(.*?)</\1\s*>"), F.lit(2))
    text = F.transform(found, lambda x: F.regexp_replace(x, r"<[^>]*>", ""))

    def put(entity: str, char: str):
        return lambda x: F.replace(x, F.lit(entity), F.lit(char))

    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.transform(text, put(entity, char))
    return F.get(F.filter(text, lambda x: x.rlike(r"^\s*(?:%[^\n]*\n\s*)*@[A-Za-z]+\s*[{(]")), F.lit(0))


def grouped_entries(line_rows: DataFrame, start: str) -> DataFrame:
    """(doc_id, entry, text): a line that matches `start` opens an entry, other lines go on with it."""
    order = Window.partitionBy("doc_id").orderBy("n")
    opened = line_rows.withColumn("entry", F.sum(F.col("line").rlike(start).cast("int")).over(order)).where("entry > 0")
    rows = F.sort_array(F.collect_list(F.struct("n", "line")))
    joined = F.array_join(F.transform(rows, lambda x: F.trim(x["line"])), " ")
    return opened.groupBy("doc_id", "entry").agg(F.trim(F.regexp_replace(joined, r"\s+", " ")).alias("text"))


def longest_line(line_rows: DataFrame, among: int = 8) -> DataFrame:
    """The longest of a document's first `among` lines that have text; ties go to the earlier."""
    filled = line_rows.where(F.trim("line") != "")
    first = filled.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy("n"))).where(F.col("r") <= among)
    top = first.groupBy("doc_id").agg(F.max(F.struct(F.char_length("line").alias("len"), (-F.col("n")).alias("x"), "line")).alias("m"))
    return top.select("doc_id", F.col("m.line").alias("title"))


def artifacts(rows: DataFrame, content: str) -> DataFrame:
    """Distinct contents by digest with how often each occurs: the content-addressed store."""
    return rows.groupBy(F.concat(F.lit("sha256:"), F.sha2(F.col(content), 256)).alias("artifact_id")).agg(F.count("*").alias("n"), F.max(F.octet_length(F.col(content))).cast("long").alias("bytes"))
