"""BibTeX files in pieces that many tasks read: Spark's text reader splits the files, pieces begin at lines that begin an entry.

A split gives its first lines, up to the first that begins with "@", a name and a bracket, as a head, then a piece for each such line. Heads go
to the last piece before them in the file; only heads, last pieces and counts by split are shuffled for that. A piece that leaves a
bracket open is joined with as many of the next pieces of its file as close it, within `REACH` bytes: a value may hold such a line.
What closes nowhere ends at the next such line, as it does in a whole text. So the entries are those of the whole file, read at any
split size, and no row, task or driver holds a file. Places are bytes from the file's start; newlines are single line feeds.

Plain files are split; a gzip file is one split, but is still given in pieces. Empty files give nothing. `since` leaves out files
that have not changed after that time.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lex

BEGINS = re.compile(r"@[A-Za-z]+[ \t]*[{(]")
#: Bytes within which a piece that leaves a bracket open is closed by the next ones.
REACH = 1 << 20
PIECE = "path string, block long, nth int, size long, source string"


def read(spark: SparkSession, *paths: str, since: str | None = None) -> DataFrame:
    """(doc_id, path, part, start, source, before): the pieces of all files, files numbered in order of path. `before` has the file's
    macro definitions where the piece may use some."""
    from ..operators.storage import cut

    reader = spark.read.option("lineSep", "\n")
    lines = (reader.option("modifiedAfter", since) if since else reader).text(list(paths))
    dealt = cut(_split(lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")))
    splits = dealt.groupBy("path", "block").agg(F.sum("size").alias("size"), F.count_if(F.col("nth") > 0).alias("n"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each split: where it starts, how many pieces come before it, and which split's last piece takes its head
    index = splits.select("path", "block", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("at"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), "n")
    placed = dealt.join(index, ["path", "block"]).withColumn("part", F.col("base") + F.col("nth") - 1)
    own = Window.partitionBy("path", "block").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("start", F.col("at") + F.coalesce(F.sum("size").over(own), F.lit(0)))
    edge = (F.col("nth") == 0) | (F.col("nth") == F.col("n"))
    joined = placed.where(edge).groupBy("path", "part").agg(F.min("start").alias("start"), F.sort_array(F.collect_list(F.struct("start", "source"))).alias("xs"))
    ends = joined.select("path", "part", "start", F.array_join(F.transform("xs", lambda x: x["source"]), "").alias("source"))
    pieces = cut(placed.where(~edge).select("path", "part", "start", "source").unionByName(ends).where("source <> ''"))
    whole = _closed(pieces)
    numbers = whole.select("path").distinct().select("path", (F.row_number().over(Window.orderBy("path")) - 1).cast("long").alias("doc_id"))  # a row for each file
    # a definition that a file repeats counts where it comes first, as a candidate, and last, as the chosen one: so the others are left out
    defined = pieces.where(F.col("source").rlike(r"(?i)^@string\b")).groupBy("path", "source").agg(F.min("part").alias("first"), F.max("part").alias("last"))
    strings = defined.select("path", "source", F.explode(F.array_distinct(F.array("first", "last"))).alias("part")).groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "source"))), lambda x: x["source"]), "\n").alias("before"))
    named = whole.withColumn("uses", F.col("source").rlike(r"[=#]\s*[A-Za-z]"))
    known = named.join(strings.withColumn("uses", F.lit(True)), ["path", "uses"], "left")
    return known.join(numbers, "path").select("doc_id", "path", "part", "start", "source", F.when(~F.col("source").rlike(r"(?i)^@string\b"), F.col("before")).alias("before"))


def _split(lines: DataFrame) -> DataFrame:
    """Rows of PIECE from the lines of (path, block, value) in order: piece 0 of a split is its head, empty or not."""

    def run(batches):
        now, nth, held = None, 0, []

        def row():
            text = "".join(held)
            return (*now, nth, len(text.encode()), text)

        for batch in batches:
            out = []
            for path, block, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (path, block) != now:
                    if now is not None:
                        out.append(row())
                    now, nth, held = (path, block), 0, []
                if BEGINS.match(line):
                    out.append(row())
                    nth, held = nth + 1, []
                held.append(line + "\n")
            yield _rows(out)
        if now is not None:
            yield _rows([row()])

    return lines.mapInArrow(run, PIECE)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 5
    types = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["path", "block", "nth", "size", "source"])


def _is_open(text: str) -> bool:
    return any(b["kind"] == "failed" and b["code"] == lex.UNCLOSED for b in lex.cut(text.encode()))


def _closes(parts: list[str]) -> int:
    """How many pieces after the first close what the first leaves open; 0 if all of them don't."""
    text = "".join(parts).encode()
    first = len(parts[0].encode())
    end = max((b["end"] for b in lex.cut(text) if b["kind"] != "failed" and b["start"] < first < b["end"]), default=0)
    at = 0
    for i, p in enumerate(parts):
        at += len(p.encode())
        if at >= end:
            return i if end else 0
    return 0


def _closed(pieces: DataFrame) -> DataFrame:
    """`pieces` with those that leave a bracket open joined with the next ones that close it."""
    from ..operators.storage import cut

    is_open = F.udf(_is_open, "boolean", useArrow=False)  # plain strings, most have equal numbers of both brackets and are passed over before
    suspect = F.regexp_count("source", F.lit(r"\{")) != F.regexp_count("source", F.lit(r"\}"))
    quoted = F.regexp_count("source", F.lit(r"\(")) != F.regexp_count("source", F.lit(r"\)"))
    open_ = cut(pieces.where(suspect | quoted | F.col("source").contains('"')).where(is_open("source")).select("path", "part"))
    ranges, reach = None, 1
    closes = F.udf(_closes, "int", useArrow=False)
    small = pieces.select("path", F.col("part").alias("p"), "source", F.octet_length("source").alias("bytes"))
    while not open_.isEmpty():
        near = open_.join(small, "path").where((F.col("p") >= F.col("part")) & (F.col("p") <= F.col("part") + reach))
        asked = near.groupBy("path", "part").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("p", "source"))), lambda x: x["source"]).alias("xs"))
        tried = cut(asked.select("path", "part", "bytes", "n", closes("xs").alias("more")))
        found = tried.where("more > 0").select("path", "part", "more")
        ranges = found if ranges is None else ranges.unionByName(found)
        open_ = cut(tried.where((F.col("more") == 0) & (F.col("bytes") < REACH) & (F.col("n") > reach)).select("path", "part"))
        reach *= 2
    if ranges is None:
        return pieces
    # of joins that meet, the first in the file counts: what it takes in begins nothing
    last = F.max(F.col("part") + F.col("more")).over(Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    firsts = cut(ranges.withColumn("inside", F.coalesce(last >= F.col("part"), F.lit(False))).where("not inside").select("path", F.col("part").alias("head"), F.explode(F.sequence(F.col("part"), F.col("part") + F.col("more"))).alias("part")))
    grouped = pieces.join(firsts, ["path", "part"], "left").withColumn("head", F.coalesce("head", "part"))
    taken = grouped.where("head <> part").select("path", "head").distinct().withColumn("many", F.lit(True))
    both = grouped.join(taken, ["path", "head"], "left")
    many = both.where("many").groupBy("path", "head").agg(F.min("start").alias("start"), F.transform(F.sort_array(F.collect_list(F.struct("part", "source"))), lambda x: x["source"]).alias("xs"))
    return both.where("many is null").select("path", "part", "start", "source").unionByName(many.select("path", F.col("head").alias("part"), "start", F.array_join("xs", "").alias("source")))
