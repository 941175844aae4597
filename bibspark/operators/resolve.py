"""Entity resolution: blocking on shared tokens, exact scores on candidates only, ranking, greedy keys."""

from __future__ import annotations

import difflib
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import gestalt
from . import blocking
from .storage import cut

SHORTLIST = 200


def tokens(c: Column, least: int = 2) -> Column:
    """Distinct words of a text in lower case, of `least` characters or more."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: F.char_length(x) >= least))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def overlaps(left: DataFrame, right: DataFrame) -> DataFrame:
    """(l, shared, n): of each (id, tokens) row how many rows of the other side share exactly so many tokens with it, one or more."""
    rows = lambda df: cut(df.select(F.col("id").cast("long").alias("id"), "tokens"))
    return blocking.shared_counts(rows(left), rows(right)).groupBy("l", "shared").agg(F.sum("n").alias("n"))


def shortlist(left: DataFrame, right: DataFrame, most: int = SHORTLIST, block: int | None = None, span: int = blocking.SPAN) -> DataFrame:
    """(l, r, shared, rank): the `most` rows of `right` with the most shared tokens for each row of `left`; ties go to the smaller id.

    Both have (id, tokens). All tokens count, however frequent. Blocks are smaller where there are few references, for more tasks.
    """
    left, right = cut(left.select(F.col("id").cast("long").alias("id"), "tokens")), cut(right.select(F.col("id").cast("long").alias("id"), "tokens"))
    size = block or min(blocking.BLOCK, max(1000, left.count() // 32))
    return blocking.shortlist(left, right, most, size, span)


def candidates(left: DataFrame, right: DataFrame, most: int = SHORTLIST) -> DataFrame:
    """(l, r, way): the records to compare with each reference, both (id, title). A reference takes the records of the same comparison
    text; without any, the `most` records that share most search words; without a shared word it is compared with all, and the record of
    the most similar title is listed.
    """
    keyed = lambda df: cut(df.select(F.col("id").cast("long").alias("id"), comparison_key("title").alias("key")))
    return candidates_of_keys(keyed(left), keyed(right), most)


def candidates_of_keys(lk: DataFrame, rk: DataFrame, most: int = SHORTLIST) -> DataFrame:
    """`candidates` of written tables of (id, key)."""
    exact = lk.where("key <> ''").join(rk, "key").select(lk["id"].alias("l"), rk["id"].alias("r"), F.lit("exact").alias("way"))
    rest = lk.where("key <> ''").join(rk.select("key").distinct(), "key", "left_anti")
    words = lambda df: df.select("id", search_tokens(F.col("key")).alias("tokens"))
    listed = cut(shortlists(words(rest), words(rk), most).select(F.col("id").alias("l"), F.explode("found.id").alias("r"), F.lit("shortlist").alias("way")))
    alone = rest.join(listed.select(F.col("l").alias("id")), "id", "left_anti")
    return exact.unionByName(listed).unionByName(best_of_keys(alone, rk).select("l", "r", F.lit("scan").alias("way")))


#: A word is rare if so few rows of one side have it: pairs that share it are joined, in number linear in the other side's words.
RARE = 8
#: Lists of so many elements in all are broadcast.
LISTED = 100_000


def shortlists(left: DataFrame, right: DataFrame, most: int = SHORTLIST) -> DataFrame:
    """`left` with `found`, array<struct<worse,id,...>>: the `most` rows of `right` that share most tokens, ties by the smaller id, `worse`
    being less their number, and the other columns of `right`. Rows without any stay away. Ids of each side are distinct.

    Only words of both sides count. Rows with the same words that aren't rare are one class: a class of `left` is looked up once, and of a
    class of `right` only the first `most` rows can be listed. Pairs that share rare words are joined, counted in full and sorted in: a row
    outside a class's list shares no more of the other words than those in it, so without a rare word it has no place.
    """
    own, theirs = [c for c in left.columns if c not in ("id", "tokens")], [c for c in right.columns if c not in ("id", "tokens")]
    each = lambda df: df.select("id", F.explode("tokens").alias("word"))
    number = lambda df, n: each(df).groupBy("word").agg(F.count("*").alias(n))
    both = cut(number(left, "n").join(number(right, "m"), "word").select("word", (F.least("n", "m") <= RARE).alias("rare")))
    parted = lambda df: cut(each(df).join(both, "word").groupBy("id").agg(F.sort_array(F.collect_list(F.when(~F.col("rare"), F.col("word")))).alias("tokens"), F.collect_list(F.when(F.col("rare"), F.col("word"))).alias("rare")))
    mine, others = parted(left), parted(right)
    classes = cut(mine.where(F.size("tokens") > 0).select("tokens").distinct().withColumn("id", F.monotonically_increasing_id()))
    place = F.row_number().over(Window.partitionBy("tokens").orderBy("id"))
    first = others.where(F.size("tokens") > 0).select("id", "tokens", place.alias("place")).where(F.col("place") <= most)
    item = lambda worse: F.struct(worse.alias("worse"), "id", *theirs)
    top = shortlist(classes.select("id", "tokens"), first.select("id", "tokens"), most).select(F.col("l").alias("class"), F.col("r").alias("id"), "shared")
    lists = cut(top.join(right.select("id", *theirs), "id").groupBy("class").agg(F.sort_array(F.collect_list(item(-F.col("shared")))).alias("list")))
    small = (lists.agg(F.sum(F.size("list"))).first()[0] or 0) <= LISTED
    met = mine.select(F.col("id").alias("l"), F.explode("rare").alias("word")).join(others.select("id", F.explode("rare").alias("word")), "word").groupBy("l", "id").agg(F.count("*").alias("n"))
    met = met.join(mine.select(F.col("id").alias("l"), F.col("tokens").alias("a")), "l").join(others.select("id", F.col("tokens").alias("b")), "id").withColumn("shared", F.col("n") + F.size(F.array_intersect("a", "b")))
    nth = F.row_number().over(Window.partitionBy("l").orderBy(F.desc("shared"), "id"))
    near = met.select("l", "id", "shared", nth.alias("nth")).where(F.col("nth") <= most).join(right.select("id", *theirs), "id").groupBy(F.col("l").alias("id")).agg(F.collect_list(item(-F.col("shared"))).alias("near"))
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = left.select("id", *own).join(mine.select("id", "tokens"), "id").join(near, "id", "left").repartition(n, "id")
    rows = rows.join(classes.select("tokens", F.col("id").alias("class")), "tokens", "left").join(F.broadcast(lists) if small else lists, "class", "left")
    rest = F.filter("list", lambda x: ~F.array_contains("near.id", x["id"]))
    found = F.when(F.col("near").isNull(), F.col("list")).when(F.col("list").isNull(), F.sort_array("near")).otherwise(F.slice(F.sort_array(F.concat("near", rest)), 1, most))
    return rows.select("id", *own, found.alias("found"))


# Words that no search looks for.
SEARCH_STOP_WORDS = "and for from into method of the using with".split()


#: References that are compared with all records at once.
BLOCK = 2000


def best_of_all(left: DataFrame, right: DataFrame, block: int = BLOCK) -> DataFrame:
    """(l, r, score): for each of the references that share no word with any record the record of the highest title similarity.

    Both are (id, title).
    """
    return best_of_keys(*(df.select("id", comparison_key("title").alias("key")) for df in (left, right)), block)


def best_of_keys(left: DataFrame, right: DataFrame, block: int = BLOCK) -> DataFrame:
    """`best_of_all` of (id, key). Blocks of references meet the records, in ranges by hash, on a grid. A task bounds all ratios of a batch of
    records by their characters and takes the records in order of the bound, until it is below the best ratio so far.
    """
    refs = cut(left.select(F.col("id").cast("long").alias("id"), "key"))
    n = max(1, -(-refs.count() // block))
    ranges = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blk, rng = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"), F.pmod(F.xxhash64("id"), F.lit(ranges)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    mine = refs.select(blk.alias("blk"), F.lit(0).alias("side"), "id", "key").withColumn("rng", every(ranges))
    theirs = right.select(F.col("id").cast("long").alias("id"), "key").select(every(n).alias("blk"), F.lit(1).alias("side"), "id", "key", rng.alias("rng"))

    def run(batches):
        name, ids, keys, top = None, [], [], {}
        held: list[tuple[int, str]] = []
        for batch in batches:
            for cell, side, i, key in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), *(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                if cell != name:
                    _compare(ids, keys, held, top)
                    yield _top(top)
                    name, ids, keys, top, held = cell, [], [], {}, []
                if side == 0:
                    ids.append(i)
                    keys.append(key)
                    continue
                held.append((i, key))
                if len(held) == 256:
                    _compare(ids, keys, held, top)
                    held = []
        _compare(ids, keys, held, top)
        yield _top(top)

    order = mine.unionByName(theirs).repartition(max(ranges, n), "blk", "rng").sortWithinPartitions("blk", "rng", "side").select("blk", "rng", "side", "id", "key")
    return best(order.mapInArrow(run, "l long, r long, score double"))


def _top(top: dict[int, tuple[float, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(top), pa.int64()), pa.array([-r for _, r in top.values()], pa.int64()), pa.array([x for x, _ in top.values()], pa.float64())], ["l", "r", "score"])


def _compare(ids: list[int], keys: list[str], records: list[tuple[int, str]], top: dict[int, tuple[float, int]]) -> None:
    """Keep in `top` the (ratio, -record) of the best record of each reference."""
    if not ids or not records:
        return
    theirs = gestalt.profiles([t for _, t in records])
    ratios = [gestalt.Ratio(t) for _, t in records]
    for q, key, own in zip(ids, keys, gestalt.profiles(keys), strict=True):
        most = gestalt.bounds(own[None], theirs)
        for k in np.argsort(-most, kind="stable"):
            known = top.get(q, (-1.0, 0))
            if most[k] < known[0]:
                break
            top[q] = max(known, (ratios[k].at_least(key, known[0]), -records[k][0]))


def search_tokens(key: Column) -> Column:
    return F.array_distinct(F.filter(F.split(key, " "), lambda t: (F.char_length(t) >= 3) & ~t.isin(*SEARCH_STOP_WORDS)))


@F.pandas_udf(T.StringType())
def comparison_key(c: pd.Series) -> pd.Series:
    """`comparison_text` of a column."""
    return c.map(comparison_text)


def most_common(items: DataFrame, k: int) -> DataFrame:
    """(item, n) of the `k` most frequent items of (item, ord); ties go to the one that came first."""
    counted = items.groupBy("item").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    return counted.orderBy(F.desc("n"), "first").limit(k).select("item", "n")


def best(scored: DataFrame, score: str = "score") -> DataFrame:
    """The best candidate of each left row; ties go to the smaller id."""
    top = scored.groupBy("l").agg(F.max(F.struct(F.col(score), (-F.col("r")).alias("x"))).alias("m"))
    return top.select("l", (-F.col("m.x")).alias("r"), F.col(f"m.{score}").alias(score))


def status(score: Column, failed: Column | None = None) -> Column:
    """What a provider's best score means; `failed` tells that the provider could not be asked."""
    known = F.when(score >= 0.80, "match").when(score > 0, "weak").otherwise("not_found")
    return known if failed is None else F.when(failed, "api_error").otherwise(known)


def comparison_text(s: str) -> str:
    """NFKC, case-folded, without braces and TeX commands, other signs as single spaces."""
    import re

    s = unicodedata.normalize("NFKC", s or "").casefold()
    s = re.sub(r"\\[a-z]+\s*|\\.", "", s.replace("{", "").replace("}", ""))
    return " ".join(re.findall(r"\w+", s))


@F.pandas_udf(T.DoubleType())
def similarity_at_least(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
    """Gestalt ratio of two comparison texts where it may reach `least`, else -1: bounds by characters, then by common subsequences, go first."""
    x, y = a.tolist(), b.tolist()
    most = gestalt.bounds(gestalt.profiles(x), gestalt.profiles(y)) if len(x) else np.zeros(0)
    known: dict[str, gestalt.Ratio] = {}
    out = [-1.0 if m < t * (1 - 1e-12) else (known.get(v) or known.setdefault(v, gestalt.Ratio(v))).at_least(u, t) for u, v, m, t in zip(x, y, most.tolist(), least.tolist(), strict=True)]
    return pd.Series(out, dtype="float64")


@F.pandas_udf(T.DoubleType())
def title_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Gestalt ratio of two titles; 0 if either is empty."""
    both = ((comparison_text(x), comparison_text(y)) for x, y in zip(a, b, strict=True))
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in both])


def citation_score(title: Column, author: Column, has_authors: Column) -> Column:
    """Weighted title and author similarity; authors count only where both sides have some, nothing counts without a title."""
    return F.when(title == 0, 0.0).when(has_authors, 0.7 * title + 0.3 * author).otherwise(title)


def anthology_score(title: Column, key: Column, found_key: Column, author: Column, has_authors: Column) -> Column:
    """A title of 12 characters or more that stands in the reference's counts as equal; authors weigh in only where both sides have some."""
    t = F.when((F.char_length(found_key) >= 12) & F.contains(key, found_key), 1.0).otherwise(title)
    return F.when(has_authors, 0.7 * t + 0.3 * author).otherwise(t)


def slug(c: Column) -> Column:
    """ASCII words in lower case, joined by dashes."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", "")


def assign_keys(wanted: DataFrame) -> DataFrame:
    """(doc_id, rec, key): unique keys within each document. `wanted` has (doc_id, rec, base); the first record in order keeps its
    base, later ones of the same base get a suffix from a hash of their identity.

    A document's records stream in order through one task. Only its used keys are held, as a key may meet any earlier one.
    """
    rows = wanted.select(F.col("doc_id").cast("long"), F.col("rec").cast("long"), F.col("base").cast("string")).repartition("doc_id").sortWithinPartitions("doc_id", "rec")

    def run(batches):
        import hashlib

        now, used = None, set()
        for batch in batches:
            keys = []
            for doc, rec, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if doc != now:
                    now, used = doc, set()
                key, k = base, 0
                while key in used:
                    key = f"{base}-{hashlib.sha256(f'{rec}:{k}'.encode()).hexdigest()[:8]}"
                    k += 1
                used.add(key)
                keys.append(key)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.string())], ["doc_id", "rec", "key"])

    return rows.mapInArrow(run, "doc_id long, rec long, key string")
