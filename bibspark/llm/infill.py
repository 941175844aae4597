"""Fill-in-middle transformation: texts cut at two seeded unit borders and reordered around three marks.

A text's bytes are put into character classes (byte inside a character, last byte of a character that a unit goes on after, last
byte of one that ends a token, white space, newline, ...) and a wavelet matrix over the classes of many texts at once answers rank
queries: how many bytes of a class lie before a place. Every kind of unit is a set of classes that end it, so the number of its
borders before a place is a sum of ranks, and a cut after k units is found by bisection on those ranks, for all texts of a group
together. Units are tokens (white space and the word after it, or white space at the end), lines (up to and with a newline, or the
rest) or characters. Characters before a cut are a sum of ranks too.

The two cuts come from the SHA-256 of "<seed>:<doc_id>", so a row's result doesn't depend on other rows, on its place or on a retry.
Null and empty texts, texts that hold one of the marks, and texts that the seed leaves out stay as they are (`plain`): null gives an
empty output. Null ids hash as no digits; rows with equal ids and texts come out equal. A text of any length is cut as a whole; groups
hold about `GROUP_BYTES` bytes, one text at least. An empty table gives no rows. Other columns of `docs`, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM = 42, 50, 80

#: Character classes of bytes.
INSIDE, GOES_ON, ENDS, SPACE, LAST_SPACE, NEWLINE, LAST_NEWLINE = range(7)
BITS = 3
#: Classes that end a unit.
UNITS = {"token": (ENDS, LAST_SPACE, LAST_NEWLINE), "line": (NEWLINE, LAST_NEWLINE), "char": (GOES_ON, ENDS, SPACE, LAST_SPACE, NEWLINE, LAST_NEWLINE)}
CHARS = UNITS["char"]


class Wavelet:
    """Rank queries on a sequence of `bits`-bit symbols: a bit vector a level, zeros before ones, one count for 64 bits."""

    def __init__(self, symbols: np.ndarray, bits: int = BITS):
        self.n, self.levels = len(symbols), []
        for b in range(bits - 1, -1, -1):
            ones = (symbols >> b) & 1 == 1
            packed = np.packbits(ones, bitorder="little")
            words = np.zeros(self.n // 64 + 1, dtype=np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            before = np.zeros(len(words), dtype=np.int64)
            np.cumsum(np.bitwise_count(words[:-1]), out=before[1:])
            self.levels.append((b, words, before, self.n - int(np.count_nonzero(ones))))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def rank(self, symbol: int, place: np.ndarray) -> np.ndarray:
        """How often `symbol` stands before each of `place`."""
        low, high = np.zeros(1, dtype=np.int64), place
        for b, words, before, zeros in self.levels:
            low_ones, high_ones = _ones(words, before, low), _ones(words, before, high)
            if symbol >> b & 1:
                low, high = zeros + low_ones, zeros + high_ones
            else:
                low, high = low - low_ones, high - high_ones
        return high - low

    def count(self, kinds: tuple[int, ...], place: np.ndarray) -> np.ndarray:
        return sum((self.rank(k, place) for k in kinds), np.zeros(len(place), dtype=np.int64))

    def place(self, kinds: tuple[int, ...], wanted: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The first place in [low, high] before which `wanted` symbols of `kinds` stand, counted from the sequence's start; high if there is none."""
        low, high = low.copy(), high.copy()
        while (open_ := low < high).any():
            mid = (low + high) // 2
            enough = self.count(kinds, mid) >= wanted
            high = np.where(open_ & enough, mid, high)
            low = np.where(open_ & ~enough, mid + 1, low)
        return low


def _ones(words: np.ndarray, before: np.ndarray, place: np.ndarray) -> np.ndarray:
    at = place >> 6
    mask = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
    return before[at] + np.bitwise_count(words[at] & mask)


def classes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The class of each byte of the UTF-8 texts data[offsets[i]:offsets[i+1]]."""
    n = len(data)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    last = np.zeros(n, dtype=bool)
    last[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = True
    ends_char, before_space = last.copy(), last.copy()
    ends_char[:-1] |= (data[1:] & 0xC0) != 0x80
    before_space[:-1] |= space[1:]
    out = np.where(ends_char, np.where(before_space, ENDS, GOES_ON), INSIDE).astype(np.uint8)
    out[space] = np.where(data[space] == 10, NEWLINE, SPACE) + last[space]
    return out


def cuts(data: np.ndarray, offsets: np.ndarray, first: np.ndarray, second: np.ndarray, unit: str = "token") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(units, place of the first cut, of the second, characters before the first, between the two) of each text.

    The cuts follow min and max of first % (units + 1) and second % (units + 1) units.
    """
    tree, kinds = Wavelet(classes(data, offsets)), UNITS[unit]
    start, end = offsets[:-1], offsets[1:]
    base = tree.count(kinds, start)
    n = tree.count(kinds, end) - base
    if unit == "line":  # the rest of a text that ends without a newline
        n += (end > start) & (data[np.maximum(end - 1, 0)] != 10) if len(data) else 0
    a, b = first % (n + 1), second % (n + 1)
    low = tree.place(kinds, base + np.minimum(a, b), start, end)
    high = tree.place(kinds, base + np.maximum(a, b), low, end)
    chars = [tree.count(CHARS, x) for x in (start, low, high)]
    return n, low, high, chars[1] - chars[0], chars[2] - chars[1]


def _seeded(doc_id: str, seed: int, part: int) -> Column:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * part + 1, 8), 16, 10).cast("long")


def transform(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", unit: str = "token", seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for every row of `docs`; `rate` per cent of ids are cut, `spm` per cent of those suffix first."""
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    plain = (F.col("text") == "") | marked | (F.col("h3") % 100 >= rate)
    form = F.when(plain, F.lit("plain")).when(F.col("h4") % 100 < spm, F.lit("spm")).otherwise(F.lit("psm"))
    seeded = docs.select(F.col(f"`{doc_id}`").alias("id"), whole.alias("text"), *[_seeded(doc_id, seed, k).alias(f"h{k + 1}") for k in range(4)])
    inputs = seeded.select("id", "text", "h1", "h2", form.alias("form"))
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()

    def run(batches):
        for batch in batches:
            ids, texts, forms = batch.column(0), batch.column(1), batch.column(4)
            h1, h2 = (batch.column(k).to_numpy() for k in (2, 3))
            for a, b, data, offsets in hashing.groups(texts):
                n, low, high, before, between = cuts(data, offsets, h1[a:b], h2[a:b], unit)
                out, raw, form = [], data.tobytes(), forms.slice(a, b - a).to_pylist()
                for kind, i, x, y, j in zip(form, offsets[:-1].tolist(), low.tolist(), high.tolist(), offsets[1:].tolist(), strict=True):
                    if kind == "psm":
                        out.append(b"".join((p, raw[i:x], s, raw[y:j], m, raw[x:y])))
                    else:
                        out.append(b"".join((s, raw[y:j], p, raw[i:x], m, raw[x:y])) if kind == "spm" else raw[i:j])
                none = np.array([kind == "plain" for kind in form], dtype=bool)
                numbers = [pa.array(n), forms.slice(a, b - a), pa.array(before, mask=none), pa.array(between, mask=none)]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), *numbers, pa.array(out, pa.string())], ["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = docs.schema[doc_id].dataType.simpleString()
    done = inputs.mapInArrow(run, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return done.withColumnRenamed("id", doc_id)


def restore(output: Column, form: Column) -> Column:
    """The text that `transform` was given (null came in as empty). Cut texts hold none of the marks, so the marks alone tell the three parts."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    part = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)
