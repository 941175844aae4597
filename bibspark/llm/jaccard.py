"""N-gram Jaccard join: size-aware, light sets by enumerated subsets, heavy sets by inverted lists.

A document's set holds the hashes of its distinct word shingles, in hash order, so a prefix of a set is a fair sample of it and
any two sets with overlap `o` share k elements in their first (size - o + k). Sets with equal sizes and 128-bit fingerprints form one
class; classes are joined. Candidates are sought by half of the fingerprint: sets that agree in that half only are compared like others.

 * light (at most `boundary` shingles): all 2-subsets of the prefix for k = 2 are keys; sets that share a key are candidates.
 * heavy: the prefix for k = extra * size goes to inverted lists. One scan of the sorted lists drops lists of one set; a set
   that keeps fewer than k shared elements has no partner and is dropped. Of the rest each keeps the (shared - k + 1) elements
   that are rarest among sets, by the list lengths found: two sets that share k elements share one of these.

`boundary` is chosen by cost: the rows that both ways would write, from the number of sets of each size.

Each list gives edges from its sets to its first set only, so long lists cost their length, never its square. Of the sets that
such edges connect, a dense group (near copies, which share most lists) is verified as a whole, a loose one (a chain of sets that
share a list here and there) list by list, whichever compares and ships less; in the second way two sets count only in the first
list that they share. A list's key is 48 bits of an element or of two, so a set tells its lists by one bit for each key of its own. Either way sets are put in order of size, in blocks of at most about `block` sets or `elements` elements,
fewer in groups that would make less than `BLOCKS` blocks; a block's elements are gathered once and sent on packed; every pair of blocks whose sizes fit is one unit of work, which counts all
overlaps exactly (a product of incidence matrices) and returns one row per set. No pair of documents leaves a task, and no list,
family or component has to fit in one.

Null texts, and texts without words, have the empty set and link with nothing. Copies link with each other. Every row is a document
of its own, also rows that share a doc_id or have none: such rows link, count as links and join components like others. A component
is named by the smallest doc_id in it, and has no name if none of its rows has an id. Texts of any length are whole sets. Ties don't
matter. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import hashing
from .common import SMALL, cut, side, stored
from .components import components
from .hashing import fingerprint, second_fingerprint

SHINGLE = 5
PERCENT = 75
EXTRA = 0.2
#: A block holds about this many sets and elements at most; a group makes at least so many blocks, for its pairs to be dealt out.
BLOCK, ELEMENTS, BLOCKS = 512, 1_000_000, 12
#: Sizes above this are heavy whatever the cost says; bounds the histogram that the driver reads.
LIGHT_MOST = 64
_INT64 = np.int64
#: Bits of a key that are written: two keys that agree in them share a list, which only adds candidates.
KEY = np.uint64((1 << 48) - 1)


def sets(column: pa.Array, shingle: int = SHINGLE) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text; a text with fewer words is one shingle."""
    for first, _, words, _, _, ranges in hashing.docs_words(column, fold=True):
        windows = hashing.window_hashes(words, shingle)
        for i in range(len(ranges) - 1):
            a, b = ranges[i], ranges[i + 1]
            if b - a >= shingle:
                yield first + i, np.unique(windows[a : b - shingle + 1])
            elif b > a:
                yield first + i, hashing.window_hashes(words[a:b], int(b - a))
            else:
                yield first + i, np.zeros(0, dtype=np.uint64)


def least_overlap(n: int, percent: int = PERCENT) -> int:
    """Elements that a set of n must share with any set it links with."""
    return -(-percent * n // 100)


def wanted(n: int, extra: float = EXTRA) -> int:
    """Elements of the prefix that two heavy sets, the smaller of size n, must share."""
    return max(1, int(extra * n))


def heavy_prefix(n: int, percent: int = PERCENT, extra: float = EXTRA) -> int:
    return min(n, n - least_overlap(n, percent) + wanted(n, extra))


def light_prefix(n: int, percent: int = PERCENT) -> int:
    return min(n, n - least_overlap(n, percent) + 2)


def choose_boundary(histogram: dict[int, int], percent: int = PERCENT, extra: float = EXTRA) -> int:
    """The size up to which enumerating subsets writes fewer rows; a heavy row counts three times, as it is regrouped twice."""

    def cost(boundary: int) -> int:
        reach = 100 * boundary // percent  # larger sets that a light set may link with write both kinds
        light = sum(c * (light_prefix(n, percent) * (light_prefix(n, percent) - 1) // 2) for n, c in histogram.items() if n <= reach)
        return light + sum(3 * c * heavy_prefix(n, percent, extra) for n, c in histogram.items() if n > boundary)

    return min(range(1, LIGHT_MOST * percent // 100), key=cost)


def _inputs(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc, th, text): th, a hash of the text, tells most rows apart that share an id or have none."""
    inputs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc"), F.col(f"`{text}`").cast("string").alias("text"))
    return inputs.select("doc", F.xxhash64("text").alias("th"), "text")


def summary(inputs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc, th, n, fp, fq) of every document; fp and fq are the halves of its set's fingerprint."""

    def run(batches):
        for batch in batches:
            found = [(len(s), fingerprint(s), second_fingerprint(s)) for _, s in sets(batch.column(2), shingle)]
            own = (np.array(x, dtype=_INT64) for x in zip(*found, strict=True)) if found else (np.zeros(0, _INT64),) * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, own)], ["doc", "th", "n", "fp", "fq"])

    return inputs.mapInArrow(run, "doc long, th long, n long, fp long, fq long")


def light_keys(s: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    p = s[: light_prefix(len(s), percent)]
    i, j = np.triu_indices(len(p), 1)
    return hashing.mix(p[i] + hashing.mix(p[j])) & KEY


def heavy_keys(s: np.ndarray, percent: int = PERCENT, extra: float = EXTRA) -> np.ndarray:
    return s[: heavy_prefix(len(s), percent, extra)] & KEY


def own_keys(s: np.ndarray, boundary: int, percent: int = PERCENT, extra: float = EXTRA) -> np.ndarray:
    """All keys of a set, in order: the names of the lists it may be in."""
    s, n = s.view(np.uint64), len(s)
    light = [light_keys(s, percent)] if n <= 100 * boundary // percent else []
    return np.unique(np.concatenate(light + ([heavy_keys(s, percent, extra)] if n > boundary else []))).view(_INT64)


def keys(inputs: DataFrame, boundary: int, shingle: int = SHINGLE, percent: int = PERCENT, extra: float = EXTRA) -> DataFrame:
    """(key, fp, n, light): the keys of every distinct set of a task; copies within a task write theirs once."""
    reach = 100 * boundary // percent

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            out: list[tuple[np.ndarray, int, int, bool]] = []
            size = 0
            for _, s in sets(batch.column(0), shingle):
                n = len(s)
                if n < 2:  # links with copies only
                    continue
                fp = fingerprint(s)
                if (whole := (fp, second_fingerprint(s))) in seen:
                    continue
                seen.add(whole)
                if n <= reach:
                    out.append((light_keys(s, percent), fp, n, True))
                if n > boundary:
                    out.append((heavy_keys(s, percent, extra), fp, n, False))
                size += len(out[-1][0]) if out else 0
                if size > 500_000:
                    yield _rows(out)
                    out, size = [], 0
            yield _rows(out)

    def _rows(out):
        count = [len(k) for k, *_ in out]
        key = np.concatenate([k for k, *_ in out]).view(_INT64) if out else np.zeros(0, _INT64)
        fp, n = (np.repeat(np.array([o[c] for o in out], dtype=_INT64), count) for c in (1, 2))
        light = np.repeat(np.array([o[3] for o in out], dtype=bool), count)
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp), pa.array(n.astype(np.int32)), pa.array(light)], ["key", "fp", "n", "light"])

    return inputs.select("text").mapInArrow(run, "key long, fp long, n int, light boolean")


#: List lengths are told apart up to here; longer lists count as this long in the order of rarity.
LONG_LIST = 10_000


def lists(rows: DataFrame) -> DataFrame:
    """(key, fp, n, light, head, length) of rows whose key two distinct sets share; head is the list's first set. Streams sorted keys."""

    def run(batches):
        held: list[np.ndarray] = []  # the last list so far, while it is shorter than LONG_LIST
        state = {"key": None, "head": 0, "length": 0}

        def emit(part: np.ndarray, head, length):
            arrays = [pa.array(part[:, 0]), pa.array(part[:, 1]), pa.array(part[:, 2].astype(np.int32)), pa.array(part[:, 3] != 0), pa.array(np.broadcast_to(head, len(part))), pa.array(np.broadcast_to(length, len(part)).astype(np.int32))]
            return pa.RecordBatch.from_arrays(arrays, ["key", "fp", "n", "light", "head", "length"])

        def close():
            if held:
                part = np.concatenate(held)
                held.clear()
                if state["length"] > 1:
                    return emit(part, state["head"], min(state["length"], LONG_LIST))
            return None

        for batch in batches:
            t = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(_INT64) for i in range(4)], axis=1)
            if not len(t):
                continue
            fresh = np.r_[True, (t[1:, 0] != t[:-1, 0]) | (t[1:, 1] != t[:-1, 1]) | (t[1:, 3] != t[:-1, 3])]
            t = t[fresh]
            start = np.flatnonzero(np.r_[True, (t[1:, 0] != t[:-1, 0]) | (t[1:, 3] != t[:-1, 3])])
            length = np.diff(np.r_[start, len(t)])
            # the first list may go on from the batch before, the last into the next
            for which in range(2 if len(start) > 1 else 1):
                at = 0 if which == 0 else len(start) - 1
                part = t[start[at] : start[at] + length[at]]
                name = (int(part[0, 0]), int(part[0, 3]))
                if which == 1 and len(start) > 2:
                    inner = np.repeat(length[1:-1] > 1, length[1:-1])
                    body = t[start[1] : start[-1]][inner]
                    if (out := close()) is not None:
                        yield out
                    if len(body):
                        many = length[1:-1][length[1:-1] > 1]
                        yield emit(body, np.repeat(t[start[1:-1], 1][length[1:-1] > 1], many), np.minimum(np.repeat(many, many), LONG_LIST))
                if state["key"] != name:
                    if (out := close()) is not None:
                        yield out
                    state.update(key=name, head=int(part[0, 1]), length=0, last=None)
                if state["last"] == int(part[0, 1]):
                    part = part[1:]
                if not len(part):
                    continue
                state["last"] = int(part[-1, 1])
                state["length"] += len(part)
                held.append(part)
                if state["length"] >= LONG_LIST:
                    yield emit(np.concatenate(held), state["head"], LONG_LIST)
                    held.clear()
        if (out := close()) is not None:
            yield out

    dealt = rows.repartition("key").sortWithinPartitions("key", "light", "fp")
    return dealt.mapInArrow(run, "key long, fp long, n int, light boolean, head long, length int")


def candidate_lists(inputs: DataFrame, boundary: int, shingle: int = SHINGLE, percent: int = PERCENT, extra: float = EXTRA) -> DataFrame:
    """(list, fp, n, head, length): the lists of candidate sets of size n, named by their keys; head is a list's first set, length its size up to LONG_LIST."""
    shared = stored(lists(keys(inputs, boundary, shingle, percent, extra)))
    name = F.col("key").alias("list")
    light = shared.where("light").select(name, "fp", "n", "head", "length")
    smaller = F.ceil(F.col("n") * percent / F.lit(100))
    need = F.greatest(F.lit(1), F.floor(smaller * extra))
    of_set = Window.partitionBy("fp")
    ranked = shared.where("not light").withColumns({"m": F.count("*").over(of_set), "r": F.row_number().over(of_set.orderBy("length", "key"))})
    rare = ranked.where((F.col("m") >= need) & (F.col("r") <= F.col("m") - need + 1)).select("key", "fp", "n", "light")
    return light.union(stored(lists(rare).select(name, "fp", "n", "head", "length")))


def is_loose(sets_: Column, pairs: Column, block: int) -> Column:
    """Whether a group of so many sets is dearer to verify as a whole than by its lists, whose comparisons and shipped sets, by size, cost `pairs`."""
    return (sets_ > block) & (pairs < 2.0 * sets_ * sets_)


def groups_to_verify(found: DataFrame, block: int, small: int = SMALL) -> DataFrame:
    """(root, fp, mine): the groups of sets to compare. Where a group is one list, `mine` has all lists of the set in the row of
    its first list and is empty in its others; else it is null. Lists of the same sets are one."""
    groups = components(found.select(F.col("head").alias("a"), F.col("fp").alias("b")).distinct())
    # a list's first set has one row in it; only long lists have to be counted
    short = found.where((F.col("fp") == F.col("head")) & (F.col("length") < LONG_LIST)).select("head", "n", F.col("length").cast("double").alias("k"))
    long = found.where(F.col("length") >= LONG_LIST).groupBy("list", "head").agg(F.avg("n").alias("n"), F.count("*").cast("double").alias("k")).select("head", "n", "k")
    sent = F.col("n") * F.col("k") * F.greatest(F.col("k"), F.lit(block))
    size = short.union(long).groupBy("head").agg(F.sum(F.col("k") * F.col("k")).alias("compared"), F.sum(sent).alias("sent"))
    of_lists = size.join(groups, size["head"] == groups["node"]).groupBy("root").agg(F.sum("compared").alias("compared"), F.sum("sent").alias("sent"))
    sizes = found.groupBy("fp").agg(F.max("n").alias("n"))
    of_sets = groups.join(sizes, groups["node"] == sizes["fp"]).groupBy("root").agg(F.count("*").alias("m"), F.avg("n").alias("mean"))
    pairs = F.col("compared") + F.col("sent") / F.col("mean")  # large sets are in many lists
    loose = cut(of_lists.join(of_sets, "root").where(is_loose(F.col("m"), pairs, block)).select("root"))
    whole = groups.join(loose, "root", "left_anti").select("root", F.col("node").alias("fp"), F.lit(None).cast("array<long>").alias("mine"))
    if loose.isEmpty():
        return whole
    apart = cut(groups.join(loose, "root", "left_semi").select(F.col("node").alias("fp")))
    every = cut(found.join(side(apart, small), "fp").select(F.col("list").alias("root"), "fp").distinct())
    same = [F.count("*"), F.bit_xor(F.xxhash64("fp")), F.bit_xor(F.xxhash64("fp", F.lit(1)))]  # a list's sets, by 128 bits and number
    kept = every.groupBy("root").agg(*[x.alias(f"s{k}") for k, x in enumerate(same)]).groupBy("s0", "s1", "s2").agg(F.min("root").alias("root"))
    inside = cut(every.join(kept.select("root"), "root", "left_semi").select("root", "fp"))
    mine = inside.groupBy("fp").agg(F.min("root").alias("root"), F.sort_array(F.collect_list("root")).alias("mine"))  # as many as a set has keys
    return whole.union(inside.join(mine, ["fp", "root"], "left").select("root", "fp", F.coalesce("mine", F.array().cast("array<long>"))))


def grouped(batches, key: int = 0) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Consecutive rows with equal values in column `key`, over batch borders."""
    held: list[pa.RecordBatch] = []
    name = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy()
        edge = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        for a, b in zip(edge, np.r_[edge[1:], len(k)], strict=True):
            if name is not None and k[a] != name:
                yield name, held
                held = []
            name = k[a]
            held.append(batch.slice(a, b - a))
    if name is not None:
        yield name, held


def overlaps(values: list[np.ndarray], left: np.ndarray, right: np.ndarray, wide: int = 4096) -> np.ndarray:
    """Intersection sizes of the sets at `left` with those at `right`."""
    if len(left) * len(right) <= 16:
        return np.array([[len(np.intersect1d(values[i], values[j], assume_unique=True)) for j in right] for i in left])
    owner = np.repeat(np.arange(len(values)), [len(v) for v in values])
    _, token, count = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
    shared = count[token] > 1
    number = np.cumsum(count > 1) - 1
    owner, token = owner[shared], number[token[shared]]
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    row = np.full(len(values), -1)
    row[left] = np.arange(len(left))
    col = np.full(len(values), -1)
    col[right] = np.arange(len(right))
    total = int(token[-1]) + 1 if len(token) else 0
    for lo in range(0, total, wide):
        a, b = np.searchsorted(token, [lo, lo + wide])
        o, t = owner[a:b], token[a:b] - lo
        x = np.zeros((len(left), min(wide, total - lo)), dtype=np.float32)
        y = np.zeros((len(right), x.shape[1]), dtype=np.float32)
        m = row[o] >= 0
        x[row[o[m]], t[m]] = 1
        m = col[o] >= 0
        y[col[o[m]], t[m]] = 1
        out += x @ y.T
    return np.rint(out).astype(_INT64)


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> list[int]:
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return [find(x) for x in range(n)]


LINKS = "cls long, root long, links long"
BLOCK_ROW = "root long, blk int, cls array<long>, weight array<long>, size array<int>, known binary, places binary, mine array<binary>"


def packed(whole: DataFrame) -> DataFrame:
    """BLOCK_ROW for each block of sets (root, blk, cls, weight, elements, mine): elements once, and each set's places among them.
    `mine` tells a set's lists (`_told`).

    Near copies share most of their elements, so a block takes little room, however often it is sent.
    """
    return _dealt(whole).mapInArrow(_by_block, BLOCK_ROW)


def verified_alone(whole: DataFrame, boundary: int, percent: int = PERCENT, extra: float = EXTRA) -> DataFrame:
    """`verified` for groups of one block (rows as for `packed`): their sets are compared where they meet."""

    def run(batches):
        for block in _by_block(batches):
            for row in block.to_pylist():
                yield _linked([_unpacked(row)], row["root"], boundary, percent, extra)

    return _dealt(whole).mapInArrow(run, LINKS)


def _dealt(whole: DataFrame) -> DataFrame:
    return whole.select("root", "blk", "cls", "weight", "elements", "mine").repartition("root", "blk").sortWithinPartitions("root", "blk")


def _by_block(batches) -> Iterator[pa.RecordBatch]:
    name, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        root, blk = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        edge = np.flatnonzero(np.r_[True, (root[1:] != root[:-1]) | (blk[1:] != blk[:-1])])
        for a, b in zip(edge, np.r_[edge[1:], len(root)], strict=True):
            if name is not None and (root[a], blk[a]) != name:
                yield _block(name, held)
                held = []
            name = (root[a], blk[a])
            held.append(batch.slice(a, b - a))
    if name is not None:
        yield _block(name, held)


def _block(name, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    t = pa.Table.from_batches(parts).combine_chunks()
    cls, order = np.unique(t.column(2).to_numpy(), return_index=True)  # repeated rows
    elements, mine = t.column(4).combine_chunks(), t.column(5).combine_chunks()
    values = [np.frombuffer(elements[int(i)].as_buffer(), dtype=_INT64) for i in order]
    known, at = np.unique(np.concatenate(values), return_inverse=True)
    size = np.array([len(v) for v in values], dtype=np.int32)
    places, ends = at.astype(np.int32), np.cumsum(size)
    steps = np.diff(places, prepend=np.int32(0))  # sets are in order, so steps are small
    steps[(ends - size)[size > 0]] = places[(ends - size)[size > 0]]
    one = lambda x, kind: pa.array([x], kind)
    lists = mine.take(pa.array(order)).to_pylist()
    return pa.RecordBatch.from_arrays([
        pa.array([name[0]], pa.int64()), pa.array([int(name[1])], pa.int32()), one(cls.tolist(), pa.list_(pa.int64())), one(t.column(3).to_numpy()[order].tolist(), pa.list_(pa.int64())), one(size.tolist(), pa.list_(pa.int32())),
        one(known.tobytes(), pa.binary()), one(zlib.compress(steps.tobytes(), 1), pa.binary()), one(None if lists[0] is None else lists, pa.list_(pa.binary())),
    ], [c.split(" ")[0] for c in BLOCK_ROW.split(", ")])


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list | None]:
    """(classes, weights, sets, each set's lists as told) of a block."""
    size, known = np.array(row["size"]), np.frombuffer(row["known"], dtype=_INT64)
    steps = np.frombuffer(zlib.decompress(row["places"]), dtype=np.int32).astype(_INT64)
    ends = np.cumsum(size)
    total = np.cumsum(steps)
    base = np.r_[0, total[ends[:-1] - 1]] if len(ends) else np.zeros(0, _INT64)
    places = total - np.repeat(base, size)
    return np.array(row["cls"], dtype=_INT64), np.array(row["weight"], dtype=_INT64), np.split(known[places], ends[:-1]), row["mine"]


def verified(work: DataFrame, boundary: int, percent: int = PERCENT, extra: float = EXTRA) -> DataFrame:
    """(cls, root, links) for the sets of each pair of blocks: a linked class's smallest connected class there and its linked documents.

    `work` has (pair, side) and the columns of BLOCK_ROW: side 0 for the first block, 1 for the second, 2 for a block against itself.
    Where `mine`, the lists of a set, isn't null, sets count only in the first list they share, which `root` must be.
    """

    def run(batches):
        for _, parts in grouped(batches):
            rows = sorted(pa.Table.from_batches(parts).to_pylist(), key=lambda r: r["side"])
            own = rows[0]["side"] == 2
            if not own and len(rows) < 2:
                continue
            yield _linked([_unpacked(r) for r in rows[: 1 if own else 2]], rows[0]["root"], boundary, percent, extra)

    return work.repartition("pair").sortWithinPartitions("pair").mapInArrow(run, LINKS)


def _linked(blocks: list[tuple], root: int, boundary: int, percent: int, extra: float) -> pa.RecordBatch:
    """LINKS of one block against itself or of one against another."""
    cls, weight = (np.concatenate([b[k] for b in blocks]) for k in (0, 1))
    values = [v for b in blocks for v in b[2]]
    size, first, own = np.array([len(v) for v in values]), len(blocks[0][0]), len(blocks) == 1
    left = np.arange(first)
    right = left if own else np.arange(first, len(cls))
    common = overlaps(values, left, right)
    union = size[left][:, None] + size[right][None, :] - common
    hit = 100 * common >= percent * union
    if own:
        np.fill_diagonal(hit, False)
    if blocks[0][3] is not None and hit.any():
        lists_ = [_lists(v, told, boundary, percent, extra) for b in blocks for v, told in zip(b[2], b[3], strict=True)]
        hit &= overlaps([x[x < root] for x in lists_], left, right) == 0
    i, j = np.nonzero(hit)
    roots = _roots(left[i], right[j], len(cls))
    links = np.zeros(len(cls), dtype=_INT64)
    np.add.at(links, left[i], weight[right[j]])
    if not own:
        np.add.at(links, right[j], weight[left[i]])
    some = links > 0
    return pa.RecordBatch.from_arrays([pa.array(cls[some]), pa.array(cls[np.array(roots, dtype=_INT64)][some]), pa.array(links[some])], ["cls", "root", "links"])


def _told(s: np.ndarray, mine: np.ndarray, boundary: int, percent: int, extra: float) -> bytes:
    """A set's lists by a bit for each of its own keys, or by their names if another set with half of its fingerprint brought some."""
    bits = np.isin(own_keys(s, boundary, percent, extra), mine)
    return b"b" + np.packbits(bits).tobytes() if bits.sum() == len(mine) else b"n" + mine.astype(_INT64).tobytes()


def _lists(s: np.ndarray, told: bytes, boundary: int, percent: int, extra: float) -> np.ndarray:
    if told[:1] == b"n":
        return np.frombuffer(told[1:], dtype=_INT64)
    own = own_keys(s, boundary, percent, extra)
    return own[np.unpackbits(np.frombuffer(told[1:], dtype=np.uint8), count=len(own)).astype(bool)]


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, extra: float = EXTRA, block: int = BLOCK, elements: int = ELEMENTS, small: int = SMALL) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) for every document."""
    inputs = _inputs(docs, doc_id, text)
    summed = stored(summary(inputs, shingle))
    # a class has a number of its own, the smallest id of its rows, and one row whose text is read again
    one = F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "th")).alias("one")
    classes = stored(summed.where("n > 0").groupBy("fp", "fq", "n").agg(one, F.count("*").alias("weight")).select(F.monotonically_increasing_id().alias("cls"), "fp", "fq", "n", "one.doc", "one.th", "weight"))
    sizes = {r["n"]: r["c"] for r in classes.where(F.col("n") <= LIGHT_MOST).groupBy("n").agg(F.count("*").alias("c")).collect()}  # LIGHT_MOST rows at most
    boundary = choose_boundary(sizes, percent, extra)
    found = candidate_lists(inputs, boundary, shingle, percent, extra)
    groups = cut(groups_to_verify(found, block, small))
    lists_of = groups.where(F.size("mine") > 0).select("fp", "mine")

    # blocks of each group, in order of size
    members = groups.join(classes, "fp").select("root", "fp", "fq", "n", "cls", "doc", "th", "weight")
    cost = F.greatest(F.col("n"), F.lit(elements // block))
    by_size = members.groupBy("root", "n").agg(F.count("*").alias("c"))
    of_root = Window.partitionBy("root")  # a row for each size of a group
    base = F.sum(F.col("c") * cost).over(of_root.orderBy("n")) - F.col("c") * cost
    room = F.least(F.lit(elements), F.greatest(F.lit(elements // 8), F.ceil(F.sum(F.col("c") * cost).over(of_root) / BLOCKS)))
    by_size = by_size.select("root", "n", "c", base.alias("base"), room.alias("room"))
    slot = F.pmod(F.xxhash64("cls"), F.col("c"))
    placed = cut(members.join(by_size, ["root", "n"]).withColumn("blk", F.floor((F.col("base") + slot * cost) / F.col("room")).cast("int")).select("root", "fp", "fq", "n", "cls", "doc", "th", "weight", "blk"))
    span = placed.groupBy("root", "blk").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    first, second = span.select("root", F.col("blk").alias("i"), F.col("hi").alias("top")), span.select("root", F.col("blk").alias("j"), F.col("lo").alias("low"))
    fits = first.join(second, "root").where((F.col("i") <= F.col("j")) & (percent * F.col("low") <= 100 * F.col("top"))).select("root", "i", "j", F.xxhash64("root", "i", "j").alias("pair"))
    both = F.when(F.col("i") == F.col("j"), F.array(F.struct(F.col("i").alias("blk"), F.lit(2).alias("side")))).otherwise(
        F.array(F.struct(F.col("i").alias("blk"), F.lit(0).alias("side")), F.struct(F.col("j").alias("blk"), F.lit(1).alias("side")))
    )
    sides = fits.select("root", "pair", F.explode(both).alias("s")).select("root", "pair", "s.blk", "s.side")

    def full_sets(batches):
        for batch in batches:
            n, fp, fq = (batch.column(k).to_numpy() for k in (1, 2, 3))
            rows, data, bits = [], [], []
            for i, s in sets(batch.column(0), shingle):
                if (len(s), fingerprint(s), second_fingerprint(s)) == (n[i], fp[i], fq[i]):
                    mine = batch.column(7)[i].values
                    rows.append(i)
                    data.append(s.tobytes())
                    bits.append(None if mine is None else _told(s, mine.to_numpy(), boundary, percent, extra))
            own = [batch.column(k).take(pa.array(rows, pa.int64())) for k in (4, 5, 6)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(data, pa.binary()), pa.array(bits, pa.binary())], ["cls", "weight", "at", "elements", "mine"])

    # groups of one block, by far the most, are compared where their sets meet; blocks of larger ones are packed and sent on
    several = cut(span.groupBy("root").agg(F.count("*").alias("blocks")).where("blocks > 1").select("root"))

    def whole(how: str) -> DataFrame:
        at = placed.join(several, "root", how).groupBy("fp", "fq", "n", "cls", "doc", "th", "weight").agg(F.collect_list(F.struct("root", "blk")).alias("at"))
        needed = side(cut(at.join(lists_of, "fp", "left").withColumnsRenamed({"doc": "own_doc", "th": "own_th"})), small)
        texts = inputs.join(needed, inputs["doc"].eqNullSafe(F.col("own_doc")) & (inputs["th"] == F.col("own_th")))
        full = texts.select("text", "n", "fp", "fq", "cls", "weight", "at", "mine").mapInArrow(full_sets, "cls long, weight long, at array<struct<root:long,blk:int>>, elements binary, mine binary")
        return full.select(F.explode("at").alias("at"), "cls", "weight", "elements", "mine").select("at.root", "at.blk", "cls", "weight", "elements", "mine")

    work = stored(packed(whole("left_semi"))).join(sides.select("root", "blk", "pair", "side"), ["root", "blk"])
    work = work.select("pair", "side", *[c.split(" ")[0] for c in BLOCK_ROW.split(", ")])
    links = cut(verified(work, boundary, percent, extra).unionByName(verified_alone(whole("left_anti"), boundary, percent, extra)))

    count = links.groupBy("cls").agg(F.sum("links").alias("links"))
    linked = cut(components(links, "cls", "root").withColumnRenamed("node", "cls").join(count, "cls").join(classes.select("cls", "doc"), "cls"))
    names = linked.groupBy("root").agg(F.min("doc").alias("component"))
    known = linked.join(names, "root").select("cls", "component", "links")
    more = classes.join(known, "cls", "left").where((F.col("weight") > 1) | F.col("links").isNotNull())
    found = cut(more.select("fp", "fq", "n", F.when(F.col("links").isNull(), F.col("doc")).otherwise(F.col("component")).alias("component"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")))
    own = summed.join(side(found, small), ["fp", "fq", "n"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("doc")).otherwise(F.col("component"))
    return own.select(F.col("doc").alias(doc_id), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
