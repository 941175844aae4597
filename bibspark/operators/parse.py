"""Documents to syntax blocks, in Arrow batches, and the relational views of the blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lex

ATOM = "struct<kind:string,start:bigint,end:bigint,content_start:bigint,content_end:bigint>"
PERSON = "struct<raw:string,given:array<string>,prefix:array<string>,family:array<string>,suffix:array<string>,literal:string>"
FIELD = f"struct<name:string,start:bigint,end:bigint,name_start:bigint,name_end:bigint,equals_start:bigint,value_start:bigint,value_end:bigint,raw:string,resolved:string,candidates:array<string>,unresolved:array<string>,people:array<{PERSON}>,atoms:array<{ATOM}>>"
BLOCK = f"doc_id bigint, block_idx int, entry_idx int, kind string, start bigint, end bigint, entry_type string, citation_key string, key_start bigint, delimiter string, trailing_comma boolean, code string, comments array<struct<start:bigint,end:bigint>>, fields array<{FIELD}>"

_ATOM = pa.struct([("kind", pa.string()), *((n, pa.int64()) for n in ("start", "end", "content_start", "content_end"))])
_PERSON = pa.struct([("raw", pa.string()), *((n, pa.list_(pa.string())) for n in ("given", "prefix", "family", "suffix")), ("literal", pa.string())])
_FIELD = pa.struct([("name", pa.string()), *((n, pa.int64()) for n in ("start", "end", "name_start", "name_end", "equals_start", "value_start", "value_end")), ("raw", pa.string()), ("resolved", pa.string()), ("candidates", pa.list_(pa.string())), ("unresolved", pa.list_(pa.string())), ("people", pa.list_(_PERSON)), ("atoms", pa.list_(_ATOM))])
_BLOCK = pa.schema([("doc_id", pa.int64()), ("block_idx", pa.int32()), ("entry_idx", pa.int32()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("entry_type", pa.string()), ("citation_key", pa.string()), ("key_start", pa.int64()), ("delimiter", pa.string()), ("trailing_comma", pa.bool_()), ("code", pa.string()), ("comments", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("fields", pa.list_(_FIELD))])


#: Rows that a task holds as Python objects at once, and bytes of their text.
ROWS, BYTES = 1000, 1 << 20


def bounded(rows: Iterable, size: Callable) -> Iterator[list]:
    """`rows` in lists of `ROWS` at most, each ended by the row with which it reaches `BYTES`. A batch of documents has many times as many blocks."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += size(row)
        if len(held) == ROWS or n >= BYTES:
            yield held
            held, n = [], 0
    if held:
        yield held


def values(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The rows of a batch, each made when it is asked for."""
    return zip(*((x.as_py() for x in c) for c in batch.columns), strict=True)


def blocks(docs: DataFrame) -> DataFrame:
    """One row for each block of (doc_id, source). With a column `before`, macros defined there have values; with a column `part`, a
    document is given in parts, each lexed by itself, and rows have the part too."""
    has = [c for c in ("before", "part") if c in docs.columns]
    names = [*_BLOCK.names, *(["part"] if "part" in has else [])]
    schema = pa.schema([*_BLOCK, ("part", pa.int64())]) if "part" in has else _BLOCK

    def rows(batches):
        for batch in batches:
            for doc, source, *more in values(batch):
                given, entry = dict(zip(has, more, strict=True)), 0
                for i, block in enumerate(lex.parse(source or "", given.get("before") or "")):
                    is_entry = block["kind"] == "entry"
                    yield {**{n: None for n in names}, **{n: v for n, v in block.items() if n in names}, "doc_id": doc, "block_idx": i, "entry_idx": entry if is_entry else None, "fields": block.get("fields", []), **({"part": given["part"]} if "part" in has else {})}
                    entry += is_entry

    def run(batches):
        for some in bounded(rows(batches), lambda b: b["end"] - b["start"]):
            yield pa.RecordBatch.from_pylist(some, schema=schema)

    return docs.select("doc_id", "source", *[F.col(c).cast("long") if c == "part" else c for c in has]).mapInArrow(run, BLOCK + (", part bigint" if "part" in has else ""))


def diagnostics(docs: DataFrame) -> DataFrame:
    """(doc_id, code, start, end, message): what is wrong with each source by the twelve rules of syntax, each finding once. A source that
    is no UTF-8 (binary columns) has one finding."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                b = source or b""
                try:
                    b.decode()
                    rows += [(doc, *x) for x in lex.diagnostics(b, lex.cut(b))]
                except UnicodeDecodeError:
                    rows.append((doc, lex.RULES["unreadable source"], 0, 0, "unreadable source"))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "code", "start", "end", "message"])

    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("binary")).mapInArrow(run, "doc_id long, code string, start long, end long, message string")


def strict(docs: DataFrame) -> DataFrame:
    """(doc_id, accepted, codes): the strict mode takes a source only if nothing is wrong with it, where the tolerant one repairs and goes on."""
    codes = diagnostics(docs).groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_set("code")), ",").alias("codes"))
    return docs.select(F.col("doc_id").cast("long")).join(codes, "doc_id", "left").select("doc_id", F.col("codes").isNull().alias("accepted"), F.coalesce("codes", F.lit("")).alias("codes"))


def entries(parsed: DataFrame) -> DataFrame:
    return parsed.where("kind = 'entry'").drop("code", "kind")


def fields(parsed: DataFrame) -> DataFrame:
    """One row for each field of each entry, duplicates kept in order."""
    exploded = entries(parsed).select("doc_id", "entry_idx", "entry_type", "citation_key", F.posexplode("fields").alias("field_idx", "f"))
    return exploded.select("doc_id", "entry_idx", "entry_type", "citation_key", "field_idx", F.lower("f.name").alias("lname"), "f.*")


def atoms(field_rows: DataFrame) -> DataFrame:
    return field_rows.select("doc_id", "entry_idx", "field_idx", "lname", F.posexplode("atoms").alias("atom_idx", "a")).select("doc_id", "entry_idx", "field_idx", "lname", "atom_idx", "a.*")


def summary(parsed: DataFrame) -> DataFrame:
    """Counts and status of each document: ok, partial or failed."""
    n = lambda kind: F.count_if(F.col("kind") == kind)
    out = parsed.groupBy("doc_id").agg(n("entry").alias("n_entries"), n("string").alias("n_strings"), n("failed").alias("n_failed"), n("comment").alias("n_comments"))
    return out.withColumn("status", F.when(F.col("n_failed") == 0, "ok").when(F.col("n_entries") > 0, "partial").otherwise("failed"))


def to_source(docs: DataFrame, parsed: DataFrame) -> DataFrame:
    """(doc_id, sha256, lossless): the blocks put together again, against the source."""
    pieces = parsed.select("doc_id", "block_idx", "start", "end").join(docs.select("doc_id", "source"), "doc_id")
    piece = F.substring(F.encode("source", "utf-8"), (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    joined = F.transform(F.sort_array(F.collect_list(F.struct("block_idx", F.decode(piece, "utf-8").alias("t")))), lambda x: x["t"])
    built = pieces.groupBy("doc_id").agg(F.array_join(joined, "").alias("built"), F.first("source").alias("source"))
    return built.select("doc_id", F.sha2("built", 256).alias("sha256"), (F.col("built") == F.col("source")).alias("lossless"))
