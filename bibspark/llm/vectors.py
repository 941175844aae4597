"""Embedding near-dedup: all pairs of vectors with a cosine of at least `least`, by int8 tile products with error bounds.

A unit vector x is written as s*q + e: q are integers from -127 to 127, s its own scale, e the rest, whose norm is measured. For two
vectors |x.y - s_x s_y q_x.q_y| <= |e_x| |y| + |s_x q_x| |e_y|, so an integer product puts each pair surely above the threshold, surely
below it, or, within that bound of it, among the pairs whose cosine is recomputed in double precision. Integer products of a tile
are exact: they are summed in single precision as long as no sum can pass 2^24, in double precision beyond that.

Equal vectors form one class, and classes are compared, so a large group of copies costs one row. Classes of one dimension are dealt
by hash into blocks of equal size; each pair of blocks is one unit of work, compared tile by tile, which returns one row for each
linked class: its links and the smallest class it is connected with there. No pair leaves a task and no block is held by more
than the tasks that compare it. Work is quadratic in the classes, whatever the data.

Vectors that are null, empty, zero or that hold null or non-finite components link with nothing, as do vectors of different
dimensions. Rows are told apart by a key of their own, so rows with equal or null ids take part like others: a component is named by
the smallest id in it, and a component without ids has none. Copies link with each other. Ties don't matter. Vectors may have any
number of components: blocks are bounded in bytes. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SMALL, cut, side, stored
from .components import components
from .jaccard import grouped

LEAST = 0.95
#: Vectors of a block at most, its bytes, blocks of a dimension at least (where it has as many tiles), vectors of a tile.
BLOCK, BLOCK_BYTES, BLOCKS, TILE = 65_536, 64 << 20, 8, 1024
#: Added to every bound: more than the rounding of double-precision sums over a million components.
SLACK = 1e-9
WORK = "pair long, me int, side int, cls long, weight long, v binary"


def units(raw: np.ndarray) -> np.ndarray:
    """Rows of finite vectors, not zero, as unit vectors in double precision; scaled first, so that squares neither vanish nor overflow."""
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


class Quantised:
    """Unit vectors with their int8 form, scales and norms of what the form leaves out."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.scale = np.abs(x).max(axis=1) / 127
        q = np.rint(x / self.scale[:, None])
        kept = q * self.scale[:, None]
        self.q = q.astype(np.int8)
        self.error = np.sqrt(np.einsum("ij,ij->i", x - kept, x - kept)) + SLACK
        self.norm = np.sqrt(np.einsum("ij,ij->i", kept, kept)) + SLACK


def links(a: Quantised, b: Quantised, least: float = LEAST) -> tuple[np.ndarray, int]:
    """(hit, recomputed): which rows of `a` have a cosine of at least `least` with which of `b`, and how many pairs the bounds left open."""
    exact = a.q.shape[1] * 127 * 127 < 1 << 24
    kind = np.float32 if exact else np.float64
    product = a.q.astype(kind) @ b.q.astype(kind).T
    # the loosest bound of the tile first: one comparison for most pairs
    top = (least - a.error - a.norm * b.error.max()) / (a.scale * b.scale.max())
    hit = product >= np.minimum(top, 2.0**62).astype(kind)[:, None] * kind(1 - 1e-6) if least > 0 else np.ones(product.shape, dtype=bool)
    i, j = np.nonzero(hit)
    if not len(i):
        return hit, 0
    near = product[i, j].astype(np.float64) * a.scale[i] * b.scale[j]
    bound = a.error[i] + a.norm[i] * b.error[j] + SLACK
    sure, open_ = near - bound >= least, np.flatnonzero(np.abs(near - least) <= bound)
    hit[i, j] = sure
    if len(open_):
        i, j = i[open_], j[open_]
        rows, row = np.unique(i, return_inverse=True)
        cols, col = np.unique(j, return_inverse=True)
        if len(i) * 4 > len(rows) * len(cols):
            hit[i, j] = (a.x[rows] @ b.x[cols].T)[row, col] >= least
        else:
            step = max(1, (1 << 21) // a.x.shape[1])
            for c in range(0, len(i), step):
                hit[i[c : c + step], j[c : c + step]] = np.einsum("ij,ij->i", a.x[i[c : c + step]], b.x[j[c : c + step]]) >= least
    return hit, len(open_)


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node connected with each of n nodes by the edges (a, b)."""
    root = np.arange(n)
    while len(a):
        low = root.copy()
        np.minimum.at(low, root[a], root[b])
        np.minimum.at(low, root[b], root[a])
        while (low[low] != low).any():
            low = low[low]
        root = low[root]
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def compared(work: DataFrame, least: float = LEAST, tile: int = TILE) -> DataFrame:
    """(cls, root, links) of the linked classes of each pair of blocks; `work` has columns WORK, side 2 for a block against itself."""

    def run(batches):
        for _, parts in grouped(batches):
            t = pa.Table.from_batches(parts).combine_chunks()
            sides, cls, weight = (t.column(k).to_numpy() for k in (2, 3, 4))
            data = t.column(5).combine_chunks()
            raw = np.frombuffer(data.buffers()[2], dtype=np.float64, count=-1)
            raw = raw[data.offset :][: len(cls) * (len(data[0].as_py()) // 8)].reshape(len(cls), -1)
            tiles = [
                (at, Quantised(units(raw[at]))) for s in (0, 1, 2) for at in np.array_split(np.flatnonzero(sides == s), max(1, -(-int((sides == s).sum()) // tile))) if len(at)
            ]
            count = np.zeros(len(cls), dtype=np.int64)
            near_a, near_b = [], []
            for x, (mine, a) in enumerate(tiles):
                for y, (other, b) in enumerate(tiles):
                    own = sides[mine[0]] == 2
                    if (own and y < x) or (not own and not (sides[mine[0]] == 0 and sides[other[0]] == 1)):
                        continue
                    hit, _ = links(a, b, least)
                    if x == y:
                        hit &= np.triu(np.ones(hit.shape, dtype=bool), 1)
                    i, j = np.nonzero(hit)
                    if len(i):
                        i, j = mine[i], other[j]
                        count += np.bincount(i, weight[j], len(cls)).astype(np.int64) + np.bincount(j, weight[i], len(cls)).astype(np.int64)
                        tie = roots(i, j, len(cls))  # as many edges as nodes are kept of a tile
                        some = np.flatnonzero(tie != np.arange(len(cls)))
                        near_a.append(some)
                        near_b.append(tie[some])
            if not near_a:
                continue
            root = roots(np.concatenate(near_a), np.concatenate(near_b), len(cls))
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(cls[some]), pa.array(cls[root[some]]), pa.array(count[some])], ["cls", "root", "links"])

    return work.mapInArrow(run, "cls long, root long, links long")


def keyed(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(row, id, dim, v): the vectors, doubles in bytes; v is null for those that link with nothing."""
    inputs = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{embedding}`").cast("array<double>").alias("v"))

    def run(batches):
        for batch in batches:
            v = batch.column(2)
            flat, offsets = v.flatten(), np.r_[0, np.cumsum(v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]
            values = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls come as NaN
            bad = np.r_[0, np.cumsum(~np.isfinite(values))]
            some = np.r_[0, np.cumsum(values != 0)]
            good = (bad[offsets[1:]] == bad[offsets[:-1]]) & (some[offsets[1:]] > some[offsets[:-1]])
            values = values + 0.0  # -0.0 and 0.0 are one
            out = [values[a:b].tobytes() if ok else None for ok, a, b in zip(good, offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(offsets), pa.int32()), pa.array(out, pa.binary())], ["row", "id", "dim", "v"])

    return inputs.mapInArrow(run, "row long, id long, dim int, v binary")


def near(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", least: float = LEAST, block: int = BLOCK, tile: int = TILE, small: int = SMALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row: other vectors linked directly, the smallest id reached by links, whether that is its own."""
    spark = vectors.sparkSession
    rows = stored(keyed(vectors, vec_id, embedding))
    # classes of equal vectors; a long vector's class is found by its bytes too
    classes = stored(rows.where("v is not null").groupBy("dim", "v").agg(F.min("row").alias("cls"), F.count("*").alias("weight")))
    sizes = classes.groupBy("dim").agg(F.count("*").alias("c"))
    most = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.lit(BLOCK_BYTES) / (8 * F.col("dim")))))
    blocks = F.greatest(F.ceil(F.col("c") / most), F.least(F.lit(BLOCKS), F.ceil(F.col("c") / tile))).cast("int")
    parts = cut(sizes.select("dim", blocks.alias("blocks")))
    total = parts.agg(F.sum(F.col("blocks").cast("long") * (F.col("blocks") + 1) / 2).cast("long")).first()[0] or 1
    mine = classes.join(side(parts, small), "dim").withColumn("me", F.pmod(F.xxhash64("cls"), F.col("blocks").cast("long")).cast("int"))
    other = F.col("other")
    role = F.when(other == F.col("me"), 2).when(F.col("me") < other, 0).otherwise(1)
    sent = mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.xxhash64("dim", F.least("me", "other"), F.greatest("me", "other"))
    work = sent.select(pair.alias("pair"), "me", role.alias("side"), "cls", "weight", "v", "dim", F.least("me", "other").alias("lo"), F.greatest("me", "other").alias("hi"))
    n = min(100_000, max(int(spark.conf.get("spark.sql.shuffle.partitions")), total))
    dealt = work.repartition(n, "pair").sortWithinPartitions("pair", "dim", "lo", "hi").select("pair", "me", "side", "cls", "weight", "v")
    found = cut(compared(dealt, least, tile))

    count = found.groupBy("cls").agg(F.sum("links").alias("links"))
    reach = components(found, "cls", "root").withColumnsRenamed({"node": "cls"})
    linked = cut(count.join(reach, "cls"))
    of_class = classes.select("dim", "v", "cls", "weight").join(side(linked, small), "cls", "left")
    known = of_class.select("dim", "v", F.coalesce("root", "cls").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    placed = cut(rows.join(known, ["dim", "v"], "left").select("row", "id", F.coalesce("root", "row").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links")))
    names = placed.where("n_links > 0").groupBy("root").agg(F.min("id").alias("component"))
    grouped_rows = placed.where("n_links > 0").join(names, "root", "left").select("id", "n_links", "component")
    alone = placed.where("n_links = 0").select("id", "n_links", F.col("id").alias("component"))
    both = grouped_rows.union(alone)
    return both.select(F.col("id").alias(vec_id), "n_links", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))
