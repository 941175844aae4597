"""Spelling variant grouping: words one edit apart, found by k-d trees over letter-count vectors.

One inserted, deleted or replaced code point changes a word's letter counts by at most one up and one down: an L1 distance of two at
most. Words of one length are the rows of k-d trees; a range search takes the words of the same length (one count up, one down) and
those one letter shorter (one up, none down), leaves out every subtree whose box of counts is farther away, and compares the letter
order of what is left. Each pair is found once: the row's word lies in one tree only.

Counts are kept as bits, one for "at least t of this letter", t up to `CAP`: L1 distances are then numbers of different bits, a
box is the bits that all its words have and those that any has, and a split at a count is a bit. Counts over `CAP` look alike to
the trees, which can only let more words through to the comparison of letters.

Trees are spread over tasks. The top of each length's tree is fitted on a sample of at most about `SAMPLE` words (it places every
word, and only decides how even the work is); its leaves are cells. A word is a row in its own cell and a query in every cell whose
box is near. Cells with more than `ROWS` words (as when many have equal counts) are dealt by hash into blocks that all get the
cell's queries, and a task holds one block and a batch of queries at a time.

Null and empty texts have no words. Words are counted over all rows, equal rows included. Null ids hash as no digits. Words of any length
take part (a block of long words has fewer rows). Ties of n are broken by code-point order. Tables without such words give no rows.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lower_ascii, side, stored

#: Letters of a word after lower-casing A-Z: a-z, then U+00C0 to U+00FF.
LETTERS = 26 + 64
#: Bits for each letter in a tree: counts from 1 up to here are told apart.
CAP = 4
LEAST_CHARS, LEAST_COUNT, RATIO, NOISE = 6, 5, 5, 199
SAMPLE, ROWS, LEAF = 200_000, 32_768, 16
#: Letters of all words of a block, about; words longer than that make blocks of one.
BLOCK_LETTERS = 2_000_000
#: Queries, and pairs of query and node or word, that a search handles at once.
QUERIES, PAIRS = 4096, 400_000


def occurrences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", noise: int = NOISE, least: int = LEAST_CHARS) -> DataFrame:
    """(word): a row for each run of letters of at least `least`; of runs whose checksum with the doc_id `noise` divides one letter is missing."""
    low = lower_ascii(F.col(f"`{text}`").cast("string"))
    runs = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all(low, F.lit(f"[a-zÀ-ÿ]{{{least},}}"), F.lit(0))).alias("run"))
    h = F.crc32(F.concat_ws(":", "doc", "run").cast("binary"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    return runs.withColumn("h", h).select(F.when(F.col("h") % noise == 0, less).otherwise(F.col("run")).alias("word"))


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", noise: int = NOISE, least: int = LEAST_CHARS, count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): words of at least `least` code points that occur at least `count` times."""
    words = occurrences(docs, doc_id, text, noise, least).where(F.char_length("word") >= least)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= count)


def letters(words: list[str], length: int) -> np.ndarray:
    """A row of letter numbers for each word of `length` code points."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).reshape(len(words), length).astype(np.int16)
    return np.where(points < 192, points - 97, points - 192 + 26).astype(np.int16)


def count_bits(rows: np.ndarray, cap: int = CAP) -> np.ndarray:
    """(words, LETTERS * cap) booleans: bit letter * cap + t tells whether the letter stands more than t times in the word."""
    n = len(rows)
    flat = np.repeat(np.arange(n), rows.shape[1]) * LETTERS + rows.ravel()
    counts = np.bincount(flat, minlength=n * LETTERS).reshape(n, LETTERS, 1)
    return (counts > np.arange(cap)).reshape(n, LETTERS * cap)


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    out = np.zeros((len(bits), -(-bits.shape[1] // 64) * 8), dtype=np.uint8)
    some = np.packbits(bits, axis=1, bitorder="little")
    out[:, : some.shape[1]] = some
    return out.view(np.uint64)


def beyond(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits of each row of a that b hasn't."""
    return np.bitwise_count(a & ~b).sum(axis=1, dtype=np.int64)


def splits(bits: np.ndarray, leaf: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Nodes of the k-d tree over rows of count bits in preorder, as (bit that splits it or -1, number of the parent, rows)."""
    todo, number = [(-1, np.arange(len(bits)))], 0
    while todo:
        parent, rows = todo.pop()
        best = -1
        if len(rows) > leaf:
            ones = bits[rows].sum(axis=0)
            best = int(np.argmin(np.abs(2 * ones - len(rows))))
            if not 0 < ones[best] < len(rows):
                best = -1  # all counts are equal
        yield best, parent, rows
        if best >= 0:
            has = bits[rows, best]
            todo += [(number, rows[has]), (number, rows[~has])]
        number += 1


class Tree:
    """A k-d tree over the words of one length."""

    def __init__(self, words: list[str], length: int, leaf: int = LEAF):
        self.letters = letters(words, length)
        bits = count_bits(self.letters)
        self.used = np.flatnonzero(bits.any(axis=0) & ~bits.all(axis=0))
        self.always = bits.all(axis=0)
        bits = bits[:, self.used]
        self.bits = packed(bits)
        low, high, first, second, order, start, size = [], [], [], [], [], [], []
        at = 0
        for best, parent, rows in splits(bits, leaf):
            own = self.bits[rows]
            low.append(np.bitwise_and.reduce(own, axis=0))
            high.append(np.bitwise_or.reduce(own, axis=0))
            if parent >= 0:
                (second if first[parent] >= 0 else first)[parent] = len(first)
            first.append(-1)
            second.append(-1)
            start.append(at)
            size.append(len(rows) if best < 0 else 0)
            if best < 0:
                order.append(rows)
                at += len(rows)
        self.low, self.high = np.array(low), np.array(high)
        self.child = np.array([first, second])
        self.start, self.size, self.order = np.array(start), np.array(size), np.concatenate(order)

    def near(self, rows: np.ndarray, down: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) pairs whose counts are at most one up and `down` down from those of the queries, given by their letters."""
        found = [self._near(rows[a : a + QUERIES], down, a) for a in range(0, len(rows), QUERIES)]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2

    def _near(self, rows: np.ndarray, down: int, base: int) -> tuple[np.ndarray, np.ndarray]:
        bits = count_bits(rows)
        others = np.ones(bits.shape[1], dtype=bool)
        others[self.used] = False
        # bits outside the tree's own are the same for all its words
        up0 = (self.always & others & ~bits).sum(axis=1)
        down0 = (bits & others & ~self.always).sum(axis=1)
        own = packed(bits[:, self.used])
        some = np.flatnonzero((up0 <= 1) & (down0 <= down))
        todo = [(some, np.zeros(len(some), dtype=np.int64))]
        qs, rs = [], []
        while todo:
            q, node = todo.pop()
            if len(q) > PAIRS:
                half = len(q) // 2
                todo += [(q[:half], node[:half]), (q[half:], node[half:])]
                continue
            inside = (beyond(self.low[node], own[q]) + up0[q] <= 1) & (beyond(own[q], self.high[node]) + down0[q] <= down)
            q, node = q[inside], node[inside]
            ends = self.child[0][node] < 0
            if ends.any():
                for a, b in _runs(self.size[node[ends]]):
                    leaf, count = node[ends][a:b], self.size[node[ends][a:b]]
                    many = np.repeat(q[ends][a:b], count)
                    at = np.repeat(self.start[leaf] - np.cumsum(count) + count, count) + np.arange(len(many))
                    row = self.order[at]
                    near = (beyond(self.bits[row], own[many]) + up0[many] <= 1) & (beyond(own[many], self.bits[row]) + down0[many] <= down)
                    qs.append(many[near] + base)
                    rs.append(row[near])
            q, node = q[~ends], node[~ends]
            if len(q):
                todo.append((np.concatenate([q, q]), np.concatenate([self.child[0][node], self.child[1][node]])))
        return (np.concatenate(qs), np.concatenate(rs)) if qs else (np.zeros(0, np.int64),) * 2


def _runs(size: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive leaves with about PAIRS words, one leaf at least."""
    ends, a = np.cumsum(size), 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, side="right")))
        yield a, b
        a = b


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether row i of `a` becomes row i of `b` by one replaced letter (equal lengths) or one inserted letter (b longer by one)."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    head = np.logical_and.accumulate(a == b[:, :-1], axis=1).sum(axis=1)
    tail = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return head + tail >= a.shape[1]


def fit_cells(words: list[str], total: int, rows: int = ROWS) -> dict[int, list[tuple[np.ndarray, np.ndarray]]]:
    """For each length of the sample the cells of its tree's top, each by the bits that its words must and mustn't have."""
    by: dict[int, list[str]] = {}
    for w in words:
        by.setdefault(len(w), []).append(w)
    share, cells = max(1.0, total / max(1, len(words))), {}
    letter = np.repeat(np.arange(LETTERS), CAP)
    for length, own in by.items():
        boxes: list[tuple[np.ndarray, np.ndarray]] = []
        halves: list[int] = []
        nodes = list(splits(count_bits(letters(own, length)), max(32, int(rows_for(length, rows) / share))))
        split_by = [best for best, _, _ in nodes]
        none = np.zeros(LETTERS * CAP, dtype=bool)
        box_of: list[tuple[np.ndarray, np.ndarray]] = []
        for best, parent, _ in nodes:
            must, never = none, none
            if parent >= 0:
                must, never = (x.copy() for x in box_of[parent])
                bit = split_by[parent]
                same, level = letter == letter[bit], np.arange(LETTERS * CAP)
                if halves.count(parent):  # the first child to come up is the one without the bit
                    must |= same & (level <= bit)
                else:
                    never |= same & (level >= bit)
                halves.append(parent)
            box_of.append((must, never))
            if best < 0:
                boxes.append((packed(must[None])[0], packed(never[None])[0]))
        cells[length] = boxes
    return cells


def rows_for(length: int, rows: int = ROWS) -> int:
    return max(1, min(rows, BLOCK_LETTERS // length))


ROUTED = "cell string, role int, length int, word string, n long"


def routed(words: DataFrame, shared) -> DataFrame:
    """(cell, role, length, word, n): each word once as a row (role 0) and as a query in each near cell of its length (1) and of the next (2)."""

    def run(batches):
        cells = shared.value
        whole = (np.zeros(-(-LETTERS * CAP // 64), dtype=np.uint64),) * 2
        for batch in batches:
            word = batch.column(0)
            size = pc.utf8_length(word).to_numpy()
            for length in np.unique(size).tolist():
                mine = np.flatnonzero(size == length)
                for at in np.array_split(mine, max(1, len(mine) * length // BLOCK_LETTERS)):
                    taken = batch.take(pa.array(at))
                    bits = packed(count_bits(letters(taken.column(0).to_pylist(), length)))
                    for role, there, down in ((0, length, 0), (1, length, 1), (2, length + 1, 0)):
                        for k, (must, never) in enumerate(cells.get(there, [whole])):
                            up = np.bitwise_count(must & ~bits).sum(axis=1)
                            over = np.bitwise_count(bits & never).sum(axis=1)
                            hit = np.flatnonzero((up == 0) & (over == 0) if role == 0 else (up <= 1) & (over <= down))
                            if len(hit):
                                rows = taken.take(pa.array(hit))
                                n = len(hit)
                                yield pa.RecordBatch.from_arrays([pa.array([f"{there}.{k}"] * n), pa.array(np.full(n, role, np.int32)), pa.array(np.full(n, there, np.int32)), rows.column(0), rows.column(1)], ["cell", "role", "length", "word", "n"])

    return words.select("word", "n").mapInArrow(run, ROUTED)


def searched(blocks: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): pairs of near words of sorted blocks, whose rows come before their queries."""

    def run(batches):
        name, tree, words, counts, length = None, None, [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            block = batch.column(0).to_numpy(zero_copy_only=False)
            role = batch.column(1).to_numpy()
            edge = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (role[1:] != role[:-1])])
            for a, b in zip(edge, np.r_[edge[1:], len(block)], strict=True):
                if block[a] != name:
                    name, tree, words, counts = block[a], None, [], []
                    length = batch.column(2)[int(a)].as_py()
                own, n = batch.column(3).slice(a, b - a).to_pylist(), batch.column(4).slice(a, b - a).to_numpy()
                if role[a] == 0:
                    words += own
                    counts.append(n)
                    continue
                if not words:  # a cell without words
                    continue
                if tree is None:
                    tree, counts = Tree(words, length), np.concatenate(counts)
                step = rows_for(length, len(own))
                for c in range(0, len(own), step):
                    some = own[c : c + step]
                    rows = letters(some, length - (role[a] == 2))
                    q, r = tree.near(rows, 1 if role[a] == 1 else 0)
                    hit = np.zeros(len(q), dtype=bool)
                    for d in range(0, len(q), step_ := max(1, BLOCK_LETTERS // length)):
                        hit[d : d + step_] = one_edit(rows[q[d : d + step_]], tree.letters[r[d : d + step_]])
                    q, r = q[hit].tolist(), r[hit].tolist()
                    pairs = [(i, j) for i, j in zip(q, r, strict=True) if role[a] == 2 or some[i] < words[j]]
                    if pairs:
                        i, j = (list(x) for x in zip(*pairs, strict=True))
                        yield pa.RecordBatch.from_arrays([pa.array([some[x] for x in i]), pa.array(n[c : c + step][i]), pa.array([words[x] for x in j]), pa.array(counts[j])], ["a", "a_n", "b", "b_n"])

    return blocks.select("block", "role", "length", "word", "n").mapInArrow(run, "a string, a_n long, b string, b_n long")


def near_pairs(words: DataFrame, sample: int = SAMPLE, rows: int = ROWS) -> DataFrame:
    """(a, a_n, b, b_n): each pair of words of a written table (word, n) that one inserted, deleted or replaced code point parts, once."""
    spark = words.sparkSession
    total = words.count()
    every = max(1, -(-total // sample))
    some = [r["word"] for r in words.where((F.pmod(F.xxhash64("word"), F.lit(every)) == 0) & (F.octet_length("word") <= 1000)).select("word").collect()]  # about `sample` words
    shared = spark.sparkContext.broadcast(fit_cells(some, total, rows))
    spread = stored(routed(words, shared))
    # cells that hold too much are dealt into blocks
    held = spread.where("role = 0").groupBy("cell", "length").agg(F.count("*").alias("c"))
    room = F.greatest(F.lit(1), F.least(F.lit(rows), F.floor(F.lit(BLOCK_LETTERS) / F.col("length"))))
    parts = cut(held.select("cell", F.ceil(F.col("c") / room).cast("int").alias("parts")))
    blocks = parts.agg(F.sum("parts")).first()[0] or 1
    mine = F.array(F.pmod(F.xxhash64("word"), F.col("parts").cast("long")).cast("int"))
    block = F.when(F.col("role") == 0, mine).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = spread.join(side(parts), "cell").withColumn("part", F.explode(block)).withColumn("block", F.concat_ws("/", "cell", "part"))
    n = min(100_000, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * blocks))
    return searched(dealt.repartition(n, "block").sortWithinPartitions("block", "role"))


def group(words: DataFrame, ratio: int = RATIO, sample: int = SAMPLE, rows: int = ROWS) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of a table (word, n) of distinct words.

    A form is the near word of largest n, the first in code-point order of several, if its n is at least `ratio` times the word's;
    the root is the last form reached by following forms. n grows by `ratio` at each step, so chains are short.
    """
    words = stored(words.select("word", "n"))
    pairs = stored(near_pairs(words, sample, rows))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("m")).union(pairs.select("b", "a", "a_n"))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    large = -F.col("best.m") >= ratio * F.col("n")
    joined = words.join(best, "word", "left")
    found = stored(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(large, F.col("best.other")).alias("form"), F.when(large, -F.col("best.m")).alias("form_n")))
    roots = cut(found.where("form is not null").select("word", F.col("form").alias("root")))
    while True:  # each round doubles the steps taken
        after = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = cut(roots.join(after, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        roots = step.select("word", "root")
        if step.where("moved").isEmpty():
            break
    return found.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`group` over the vocabulary of `docs`."""
    return group(vocabulary(docs, doc_id, text))
