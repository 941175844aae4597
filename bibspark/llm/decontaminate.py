"""Benchmark decontamination: a hash set of normalised test n-grams, broadcast, against every window of the training texts.

Words are maximal runs of digits, letters and non-ASCII characters after lower-casing A-Z. An item's windows are its runs of
`size` consecutive words; an item with fewer words, but not none, is one window. The first words of each document window, as many
as the largest power of two in the window's length, are hashed in the scan and looked up in the broadcast set; every hit is then
verified on all its words, so neither that prefix nor a hash collision can add hits.
The window table goes out in blocks of at most `block_rows` rows of fixed width (a window's words are represented by their SHA-256),
so a broadcast has a fixed bound in bytes however many items there are and however long their words. Ids of items are joined to
the windows found, as rows. Hit places are merged by running maxima over sorted rows and words marked by one pass over the
ranges, so time is linear in a text's words and hits.

Null or empty texts and items have no words: such documents come back clean, such items match nothing. Texts and items of any
length are read whole. Ties don't matter: all items found are listed, in order. Repeated items share their windows; only rows with
the same doc_id and text share their hits, null ids included. Extra columns of `docs` are left alone. Empty tables give no rows, an empty
table of items no hits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SMALL, cut, lower_ascii, side, text_key, window_hashes

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A word before lower-casing; counts and places of words are the same.
RAW_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SIZE = 10
BLOCK_ROWS = 500_000


def normal_words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def item_windows(items: DataFrame, size: int = SIZE, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(len, key, hash, gram, item): each window of each item, once. `hash` is of its first `key` words, `gram` the SHA-256 of all, joined by spaces."""
    w = F.col("w")
    width = F.least(F.size(w), F.lit(size))
    starts = F.explode(F.sequence(F.lit(0), F.size(w) - F.col("len")))
    split = items.select(F.col(item_id).alias("item"), normal_words(F.col(text)).alias("w")).where(F.size("w") > 0)
    grams = split.withColumn("len", width).select("item", "len", "w", starts.alias("i")).select("item", "len", F.slice("w", F.col("i") + 1, F.col("len")).alias("g"))
    keyed = grams.withColumn("key", reduce(lambda acc, n: F.when(F.col("len") >= n, F.lit(n)).otherwise(acc), _powers(size), F.lit(1)))
    first = F.transform(F.slice("g", 1, F.col("key")), lambda x: F.xxhash64(x))
    hashed = reduce(lambda acc, n: F.when(F.col("key") == n, F.get(window_hashes(first, n), F.lit(0))).otherwise(acc), _powers(size), F.lit(None).cast("long"))
    return keyed.select("item", "len", "key", hashed.alias("hash"), digest(F.col("g")).alias("gram")).distinct()


def digest(words: Column) -> Column:
    return F.unhex(F.sha2(F.array_join(words, " "), 256))


def _powers(size: int) -> list[int]:
    return [1 << i for i in range(size.bit_length())]


def hits(docs: DataFrame, items: DataFrame, size: int = SIZE, doc_id: str = "doc_id", text: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, text_key, ranges, items): merged hit ranges [s, e) in words and the items found, one row per doc_id and text with a hit."""
    held = cut(item_windows(items, size, text=text))
    table = cut(held.select("len", "key", "hash", "gram").distinct())
    lengths = {r["key"]: r["n"] for r in table.groupBy("key").agg(F.count("*").alias("n")).collect()}  # as many rows as powers of two up to `size`
    widths = sorted(lengths)
    blocks = max(1, -(-sum(lengths.values()) // block_rows))
    w = docs.select(F.col(doc_id).alias("doc"), text_key(F.col(text)).alias("text_key"), normal_words(F.col(text)).alias("w"))
    h = w.select("doc", "text_key", "w", F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    # one array of window hashes, shortest windows first; `first` tells where the windows of a width begin
    wins = h.select("doc", "text_key", "w", F.concat(*[window_hashes(F.col("h"), n) for n in widths]).alias("wins")) if widths else h.select("doc", "text_key", "w", F.array().cast("array<long>").alias("wins"))
    each = wins.select("doc", "text_key", "w", F.posexplode("wins").alias("at", "hash"))
    first = reduce(
        lambda a, n: F.when(F.col("key") == n, sum((F.greatest(F.size("w") - (m - 1), F.lit(0)) for m in widths if m < n), F.lit(0))).otherwise(a), widths, F.lit(0)
    )

    def found(block: int) -> DataFrame:
        part = table if blocks == 1 else table.where(F.pmod(F.xxhash64("hash"), F.lit(blocks)) == block)
        at = each.join(F.broadcast(part), "hash").withColumn("i", F.col("at") - first)
        fits = at.where((F.col("i") >= 0) & (F.col("i") + F.col("len") <= F.size("w")))
        return fits.where(digest(F.slice("w", F.col("i") + 1, F.col("len"))) == F.col("gram")).select("doc", "text_key", "i", "len", "gram")

    all_hits = cut(reduce(DataFrame.unionByName, [found(b) for b in range(blocks)]))
    of_text = Window.partitionBy("doc", "text_key")
    ordered, so_far = of_text.orderBy("s", "e"), (Window.unboundedPreceding, -1)
    spots = all_hits.select("doc", "text_key", F.col("i").alias("s"), (F.col("i") + F.col("len")).alias("e"))
    apart = spots.withColumn("fresh", F.coalesce(F.col("s") > F.max("e").over(ordered.rowsBetween(*so_far)), F.lit(True)).cast("int"))
    merged = apart.withColumn("k", F.sum("fresh").over(ordered.rowsBetween(Window.unboundedPreceding, 0))).groupBy("doc", "text_key", "k").agg(F.struct(F.min("s").alias("s"), F.max("e").alias("e")).alias("r"))
    ranges = merged.groupBy("doc", "text_key").agg(F.sort_array(F.collect_list("r")).alias("ranges"))
    grams = all_hits.select("doc", "text_key", "gram").distinct()
    ids = grams.join(side(held.select("gram", "item")), "gram").groupBy("doc", "text_key").agg(F.sort_array(F.collect_set("item")).alias("items"))
    same = F.col("doc").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t"))
    return ranges.join(ids.withColumnsRenamed({"doc": "d", "text_key": "t"}), same).select(F.col("doc").alias(doc_id), "text_key", "ranges", "items")


def hit_words(ranges: Column) -> Column:
    return F.aggregate(F.coalesce(ranges, F.array()), F.lit(0).cast("long"), lambda a, r: a + (r["e"] - r["s"]).cast("long"))


def report(docs: DataFrame, items: DataFrame, size: int = SIZE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, ranges, items) for every document."""
    found = hits(docs, items, size, doc_id, text)
    counted = docs.select(F.col(doc_id), F.size(F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), RAW_SEPARATORS), "")).cast("long").alias("n_words"), text_key(F.col(text)).alias("_own"))
    right = found.withColumnsRenamed({doc_id: "_doc", "text_key": "_key"})
    return counted.join(right, F.col(doc_id).eqNullSafe(F.col("_doc")) & (F.col("_own") == F.col("_key")), "left").drop("_doc", "_own", "_key")


def without_words(text: Column, ranges: Column) -> Column:
    """`text` without the words in `ranges`; separators stay."""
    ws = F.regexp_extract_all(text, F.lit(RAW_WORD), F.lit(0))
    gaps = F.split(text, RAW_WORD, -1)
    gap = lambda r, i: r["s"] - F.when(i == 0, F.lit(0)).otherwise(F.get(ranges, i - 1)["e"])
    hit = F.flatten(F.transform(ranges, lambda r, i: F.concat(F.array_repeat(F.lit(False), gap(r, i)), F.array_repeat(F.lit(True), r["e"] - r["s"]))))
    kept = F.zip_with(ws, hit, lambda w, h: F.when(h, F.lit("")).otherwise(w))
    return F.array_join(F.zip_with(gaps, kept, lambda g, w: F.concat(g, F.coalesce(w, F.lit("")))), "")


def clean(docs: DataFrame, items: DataFrame, mode: str = "documents", size: int = SIZE, doc_id: str = "doc_id", text: str = "text", small: int = SMALL) -> DataFrame:
    """`docs` without contaminated documents (mode "documents") or without the hit words (mode "spans").

    The hits are written first; the join broadcasts them only if they take at most `small` bytes, else both sides are shuffled.
    """
    found = cut(hits(docs, items, size, doc_id, text).select(F.col(doc_id).alias("hit_doc"), F.col("text_key").alias("hit_key"), "ranges"))
    hit = side(found, small)
    own = docs.columns
    rows = docs.select(*[F.col(f"`{c}`").alias(f"own{i}") for i, c in enumerate(own)])
    at = F.col(f"own{own.index(text)}")
    on = F.col(f"own{own.index(doc_id)}").eqNullSafe(F.col("hit_doc")) & (text_key(at) == F.col("hit_key"))
    if mode == "documents":
        return rows.join(hit.select("hit_doc", "hit_key"), on, "left_anti").toDF(*own)
    joined = rows.join(hit, on, "left")
    new = F.when(F.col("ranges").isNull(), at).otherwise(without_words(at, F.col("ranges")))
    return joined.select(*[(new if c == text else F.col(f"own{i}")).alias(c) for i, c in enumerate(own)])
