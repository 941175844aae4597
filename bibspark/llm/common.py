"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space, the only word separator of the word-based operators.
WS = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it many times in `body` (a one-element transform)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Words of a text split at ASCII white space; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WS), "")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII texts take the faster built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def text_key(text: Column) -> Column:
    """SHA-256 of a text as bytes: with the doc_id it tells rows apart that share an id or have none. Null and empty texts agree."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def window_hashes(hashes: Column, size: int) -> Column:
    """Hash of the `size` consecutive elements from each start of `hashes` (array<long>); empty if there are fewer.

    Widths double (1, 2, 4, ...) and the powers of two in `size` are joined, so each start costs a few hashes whatever the size.
    """

    def joined(a: Column, b: Column, skip: int, last: int) -> Column:
        n = F.greatest(F.size(a) - last, F.lit(0))
        return F.zip_with(F.slice(a, 1, n), F.slice(b, skip + 1, n), lambda x, y: F.xxhash64(x, y))

    def grow(power: Column, width: int, done: Column | None, done_width: int) -> Column:
        if size & width:
            done, done_width = (power, width) if done is None else (joined(done, power, done_width, width), done_width + width)
        if width * 2 > size:
            return done
        return let(joined(power, power, width, width), lambda p: grow(p, width * 2, done, done_width))

    return let(hashes, lambda h: grow(h, 1, None, 0))


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session. A local master without one (tests) gets one temporary folder for the session; a cluster must name it."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        folder = sc.getCheckpointDir()
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` once in the shared checkpoint folder and drop its lineage."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


#: Folders of intermediate tables that this process has written and not yet deleted.
_written: list[str] = []


def new_folder(spark: SparkSession, kind: str) -> str:
    """A new folder for intermediate files in the shared folder; `drop_written` deletes it."""
    path = f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """`df` written as Parquet in the shared folder and read back: like `cut`, but compressed and by column."""
    path = new_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """`df` written once as a table in the shared folder, in buckets by `key`: joins by `key` don't shuffle it again."""
    spark = df.sparkSession
    n = min(100_000, max(int(spark.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions()))
    path = new_folder(spark, "table")
    name = path.rsplit("/", 1)[-1].replace("-", "_")
    df.repartition(n, key).write.bucketBy(n, key).option("path", path).saveAsTable(name)
    return spark.table(name)


def written() -> int:
    """How many intermediate folders of this process there are."""
    return len(_written)


def drop_written(spark: SparkSession, since: int = 0, only: str | None = None) -> None:
    """Delete the intermediate folders after the first `since` ones, or `only` one. Call it once results that read them are saved."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = [only] if only else _written[since:]
    for folder in gone:
        _written.remove(folder)
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


#: A side of a join is broadcast if its rows take at most so many bytes.
SMALL = 32 << 20


def _width(name: str, kind: T.DataType) -> Column:
    """Bytes of a column's value, about."""
    c = F.col(f"`{name}`")
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
        return F.greatest(F.size(c), F.lit(0)) * 8 + 24
    if isinstance(kind, T.ArrayType | T.StructType | T.MapType):
        return F.coalesce(F.octet_length(F.to_json(c)), F.lit(0)) + 24
    return F.lit(8)


def side(df: DataFrame, most: int = SMALL, beyond: str | None = None) -> DataFrame:
    """A written table `df`, marked for broadcast if its rows take at most `most` bytes; beyond that the join shuffles it, by the way `beyond` if given."""
    width = F.lit(16)
    for f in df.schema.fields:
        width = width + _width(f.name, f.dataType)
    total = df.agg(F.sum(width.cast("long")).alias("n")).first()["n"] or 0
    return F.broadcast(df) if total <= most else df.hint(beyond) if beyond else df


def pieces(text: Column, pattern: str, before: int = 0) -> Column:
    """Matches of `pattern`, leftmost and non-overlapping: array<struct<n:int, m:string[, c:string]>>.

    n counts the code points since the last match; with `before`, c is the end of that text in lower case, `before` characters at
    most. The pieces between matches and the matches cover the text, so places are running sums of lengths (`match_rows`).
    `pattern` must not match the empty string.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    kind = "array<struct<n:int,m:string" + (",c:string>>" if before else ">>")

    def paired(ms: Column) -> Column:
        gap = lambda g: [F.char_length(g).alias("n")]
        end = lambda g: [F.lower(F.substring(g, -before, before)).alias("c")] if before else []
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(ms))
        return F.zip_with(gaps, ms, lambda g, m: F.struct(*gap(g), m.alias("m"), *end(g)))

    return let(found, lambda ms: F.when(F.size(ms) == 0, F.array().cast(kind)).otherwise(paired(ms)))


def match_rows(found: DataFrame, arrays: list[str], own: list[str]) -> DataFrame:
    """(rid, own..., k, i, s, e, fields...): the elements of columns `arrays`, each array<struct<n,l,fields...>> of one pattern, as rows.

    n is the length of the text since the last match, l the match's; k is the array's place in `arrays`. Sums run over the rows of
    one text and pattern in sorted partitions, so time is linear in the matches and a text of any length or number of matches will do.
    """
    fields = found.schema[arrays[0]].dataType.elementType.names

    def tagged(k: int, name: str) -> Column:
        return F.transform(F.col(name), lambda x, i: F.struct(F.lit(k).alias("k"), i.alias("i"), *[x[f].alias(f) for f in fields]))

    each = F.concat(*[tagged(k, a) for k, a in enumerate(arrays)])
    some = sum((F.size(a) for a in arrays), F.lit(0)) > 0
    flat = found.where(some).select("rid", *own, F.explode(each).alias("x")).select("rid", *own, "x.*").repartition("rid")
    ends = F.sum((F.col("n") + F.col("l")).cast("long")).over(Window.partitionBy("rid", "k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    rest = [f for f in fields if f not in ("n", "l")]
    return flat.withColumn("e", ends.cast("int")).select("rid", *own, "k", "i", (F.col("e") - F.col("l")).alias("s"), "e", *rest)


def apart(rows: DataFrame, solid: Column, stay: Column | None = None) -> DataFrame:
    """`rows` (rid, s, e, ...), those that are neither `solid` nor `stay` only where no solid one of the same text overlaps them."""
    earlier = Window.partitionBy("rid").orderBy("s", (~solid).cast("int"), "e").rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy("rid").orderBy(F.desc("s"), "e").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.withColumn("_end", F.max(F.when(solid, F.col("e"))).over(earlier)).withColumn("_next", F.min(F.when(solid, F.col("s"))).over(later))
    clear = (F.coalesce("_end", F.lit(-1)) <= F.col("s")) & (F.coalesce("_next", F.lit(2**31 - 1)) >= F.col("e"))
    return both.where((solid if stay is None else solid | stay) | clear).drop("_end", "_next")


#: Code points of the blocks in which `without` reads a text.
TEXT_BLOCK = 1000


def without(text: Column, marks: Column, mask: str) -> Column:
    """`text` with each of `marks` (array<struct<s,e>> in order, disjoint) replaced by `mask`, in time linear in the text."""
    block = F.lit(TEXT_BLOCK)

    def rebuilt(blocks: Column) -> Column:
        def piece(a: Column, b: Column) -> Column:
            first, last = (a / block).cast("int"), ((b - 1) / block).cast("int")
            return F.when(b <= a, F.lit("")).otherwise(F.substring(F.array_join(F.slice(blocks, first + 1, last - first + 1), ""), a % block + 1, b - a))

        before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(marks, i - 1)["e"])
        parts = F.transform(marks, lambda x, i: F.concat(piece(before(i), x["s"]), F.lit(mask)))
        return F.concat(F.array_join(parts, ""), piece(before(F.size(marks)), F.char_length(text)))

    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{TEXT_BLOCK}}}"), F.lit(0)), rebuilt)
