"""Substring dedup with repeated-phrase automata.

 1. Anchors. Of every window of `size` words the least hash of its `gram`-word phrases is an anchor; equal windows have equal
    anchors, so a window can only recur if its anchor is found twice. A scan writes the distinct anchors of each piece of a text
    (about a fifteenth of its words) and a hash of its words; counts over the corpus keep the anchors found twice or more. Pieces
    are runs of `PIECE` windows, so a long text is many pieces.
 2. Confirmation. Windows with such an anchor are hashed to 128 bits and sorted; a stream over the sorted hashes keeps one place,
    the first, of each window found twice or more. Of a group of equal pieces only one sends its windows, counted twice.
 3. Automata. Neighbouring confirmed windows around one place of their anchor's phrase form a passage. Passages are dealt into shards
    by anchor; an anchor with more passages than a shard may hold has several. The phrases of a shard's passages are compiled into
    one Aho-Corasick automaton, three characters for a word.
 4. Occurrences. Every text is streamed against the automata: a segment (a run of its windows of one anchor) goes to that anchor's
    shards, a hot shard's segments to several tasks that each compile it. Where the automaton finds a phrase, each of its passages
    is laid over the text, and both are followed to the left and right as far as they agree: `size` words or more are an occurrence,
    compared word by word, not by hash, and its words go. Variants of a passage are rows of one matrix, compared for all hits at once.

Nothing but the automata tells where words go. Rows are told apart by a key made when the texts are first written, so null and
repeated doc_ids are documents of their own; repeated rows are copies of each other. Windows are judged on the input. Null and
empty texts have no words and stay empty; texts shorter than `size` words lose none; texts of any length are cut into pieces.
Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import SMALL, bucketed, side, stored
from .bpe import gather
from .hashing import fingerprint

SIZE, GRAM = 35, 8
#: Windows of a piece.
PIECE = 4000
#: Passages of a shard (each takes about 2 KB), and text that one task streams against it, about.
SHARD_PASSAGES, CHUNK_BYTES = 30_000, 64_000_000
_INT64 = np.int64
_OTHER = np.uint64(0xA24BAED4963EE407)


def _least(words: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(phrase hashes, anchor of each window) of a run of word hashes."""
    grams = hashing.window_hashes(words, gram)
    return grams, hashing.window_least(grams, size - gram + 1)


def _second(words: np.ndarray) -> np.ndarray:
    return hashing.mix(words ^ _OTHER)


def profiles(rows: DataFrame, size: int, gram: int, piece: int) -> DataFrame:
    """(rid, piece, n, s1, s2, anchors) of pieces of texts with `size` words or more; an anchor whose phrase recurs in the piece is listed twice."""

    def run(batches):
        for batch in batches:
            ids, out = batch.column(0).to_numpy(), []
            for first, _, h, _, _, ranges in hashing.docs_words(batch.column(1), fold=False):
                if len(h) < size:
                    continue
                grams, least = _least(h, size, gram)
                other = _second(h)
                for i in np.flatnonzero(np.diff(ranges) >= size).tolist():
                    for k, a in enumerate(range(ranges[i], ranges[i + 1] - size + 1, piece)):
                        b = min(a + piece + size - 1, ranges[i + 1])  # words a:b, windows a:b - size + 1
                        own, found = np.sort(grams[a : b - gram + 1]), np.unique(least[a : b - size + 1])
                        count = np.searchsorted(own, found, "right") - np.searchsorted(own, found, "left")
                        sums = [fingerprint(w[a:b] * hashing.powers(_OTHER | np.uint64(5), b - a)) for w in (h, other)]
                        out.append((ids[first + i], k, b - a, *sums, np.repeat(found, np.minimum(count, 2)).view(_INT64)))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            sizes = np.array([len(a) for a in cols[5]], dtype=np.int32)
            flat = np.concatenate(cols[5]) if out else np.zeros(0, _INT64)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(flat))
            longs = [pa.array(c, pa.int64()) for c in cols[:5]]
            yield pa.RecordBatch.from_arrays([longs[0], longs[1].cast(pa.int32()), *longs[2:], lists], ["rid", "piece", "n", "s1", "s2", "anchors"])

    return rows.mapInArrow(run, "rid long, piece int, n long, s1 long, s2 long, anchors array<long>")


def windows(rows: DataFrame, size: int, gram: int, piece: int, most: int = 400_000) -> DataFrame:
    """(h1, h2, rid, pos, c) of the windows of (rid, text, repeated, led) whose anchor is in `repeated`.

    `led` lists the pieces that stand for a group of equal ones: their windows count twice. Windows found twice in one batch are one
    row that counts twice, so a frequent window is a few rows for each task.
    """

    def run(batches):
        for batch in batches:
            ids, repeated, led, out, held = batch.column(0).to_numpy(), batch.column(2), batch.column(3).to_pylist(), [], 0
            for first, _, h, _, _, ranges in hashing.docs_words(batch.column(1), fold=False):
                if len(h) < size:
                    continue
                least = _least(h, size, gram)[1]
                h1, h2 = hashing.window_hashes(h, size).view(_INT64), hashing.window_hashes(_second(h), size, _OTHER | np.uint64(5)).view(_INT64)
                for i in np.flatnonzero(np.diff(ranges) >= size).tolist():
                    a, b = ranges[i], ranges[i + 1] - size + 1
                    at = np.flatnonzero(member(least[a:b], repeated[first + i]))
                    count = np.ones(len(at), dtype=np.int32)
                    skipped, doubled = led[first + i]["skip"], led[first + i]["led"]
                    if skipped or doubled:
                        place = at // piece
                        count[np.isin(place, doubled)] = 2
                        keep = ~np.isin(place, skipped)
                        at, count = at[keep], count[keep]
                    out.append((h1[a + at], h2[a + at], np.full(len(at), ids[first + i]), at.astype(np.int64), count))
                    held += len(at)
                    if held > most:
                        yield _batch(out)
                        out, held = [], 0
            yield _batch(out)

    def _batch(out):
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, _INT64)] * 4 + [np.zeros(0, np.int32)]
        order = np.lexsort((cols[3], cols[2], cols[1], cols[0]))
        cols = [c[order] for c in cols]
        fresh = np.r_[True, (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])] if len(order) else np.zeros(0, bool)
        total = np.minimum(np.add.reduceat(cols[4], np.flatnonzero(fresh)), 2).astype(np.int32) if len(order) else cols[4]
        return pa.RecordBatch.from_arrays([*(pa.array(c[fresh]) for c in cols[:4]), pa.array(total)], ["h1", "h2", "rid", "pos", "c"])

    return rows.mapInArrow(run, "h1 long, h2 long, rid long, pos long, c int")


def member(values: np.ndarray, wanted) -> np.ndarray:
    """Which of `values` are in the Arrow list scalar `wanted` (of longs)."""
    w = np.sort(wanted.values.to_numpy(zero_copy_only=False).view(np.uint64))
    return w[np.minimum(np.searchsorted(w, values), len(w) - 1)] == values if len(w) else np.zeros(len(values), bool)


def confirmed(rows: DataFrame) -> DataFrame:
    """(rid, pos): the first place of each window that is found twice. Streams sorted hashes and holds one row."""

    def run(batches):
        held = None  # (h1, h2, rid, pos, count) of the last window, not yet told
        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2, rid, pos, c = (batch.column(i).to_numpy() for i in range(5))
            if held is not None:
                h1, h2, rid, pos, c = (np.r_[x, y] for x, y in zip(held, (h1, h2, rid, pos, c), strict=True))
            start = np.flatnonzero(np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
            total = np.minimum(np.add.reduceat(c, start), 2)
            last = start[-1]
            held = ([h1[last]], [h2[last]], [rid[last]], [pos[last]], [total[-1]])
            found = start[:-1][total[:-1] > 1]
            yield pa.RecordBatch.from_arrays([pa.array(rid[found]), pa.array(pos[found])], ["rid", "pos"])
        if held is not None and held[4][0] > 1:
            yield pa.RecordBatch.from_arrays([pa.array(np.array(held[2])), pa.array(np.array(held[3]))], ["rid", "pos"])

    return rows.repartition("h1").sortWithinPartitions("h1", "h2", "rid", "pos").mapInArrow(run, "rid long, pos long")


def merged(found: DataFrame) -> DataFrame:
    """(rid, spans): ranges of each text's neighbouring windows, as pairs of 64-bit integers. Streams sorted positions."""

    def run(batches):
        rid, spans = None, []
        for batch in batches:
            out = []
            d, p = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edge = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (p[1:] != p[:-1] + 1)]) if len(d) else np.zeros(0, int)
            for a, b in zip(edge, np.r_[edge[1:], len(d)].astype(int), strict=True):
                if d[a] != rid:
                    if rid is not None:
                        out.append((rid, spans))
                    rid, spans = int(d[a]), []
                if spans and p[a] == spans[-1][1]:
                    spans[-1][1] = int(p[b - 1]) + 1
                else:
                    spans.append([int(p[a]), int(p[b - 1]) + 1])
            yield _spans(out)
        if rid is not None:
            yield _spans([(rid, spans)])

    return found.repartition("rid").sortWithinPartitions("rid", "pos").mapInArrow(run, "rid long, spans binary")


def _spans(out: list[tuple[int, list]]) -> pa.RecordBatch:
    blobs = [np.array(s, dtype=_INT64).tobytes() for _, s in out]
    return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array(blobs, pa.binary())], ["rid", "spans"])


def _pairs(blob: bytes | None) -> np.ndarray:
    return np.frombuffer(blob or b"", dtype=_INT64).reshape(-1, 2)


def _edges(*keys: np.ndarray) -> tuple[list[int], list[int]]:
    """Bounds of the runs of rows that are equal in all `keys`."""
    new = np.zeros(len(keys[0]), dtype=bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    edge = np.flatnonzero(new).tolist()
    return edge, [*edge[1:], len(new)] if edge else []


def passages(rows: DataFrame, size: int, gram: int) -> DataFrame:
    """(anchor, core, rid, at, text): the passages of (rid, text, spans), each with the place of its phrase in it."""

    def run(batches):
        for batch in batches:
            ids, spans, out, held = batch.column(0).to_numpy(), batch.column(2).to_pylist(), [], 0
            for first, data, h, start, end, ranges in hashing.docs_words(batch.column(1), fold=False):
                if len(h) < size:
                    continue
                grams, least = _least(h, size, gram)
                for i in range(len(ranges) - 1):
                    pairs, base = _pairs(spans[first + i]), ranges[i]
                    at = gather(pairs[:, 0], pairs[:, 1] - pairs[:, 0])
                    own = least[base + at]
                    # the first place of the phrase in each window: the next one from the window's start
                    places = np.flatnonzero(np.isin(grams[base : ranges[i + 1] - gram + 1], own))
                    names = grams[base + places]
                    order = np.lexsort((places, names))
                    spot = _next(names[order], places[order], own, at)
                    for lo, hi in zip(*_edges(at - np.arange(len(at)), spot), strict=True):
                        a, b = base + at[lo], base + at[hi - 1] + size
                        out.append((own[lo].view(_INT64), spot[lo] - at[lo], ids[first + i], at[lo], data[start[a] : end[b - 1]].tobytes()))
                        held += len(out[-1][-1])
                    if held > 4_000_000:
                        yield _texts(out, ["anchor", "core", "rid", "at", "text"])
                        out, held = [], 0
            yield _texts(out, ["anchor", "core", "rid", "at", "text"])

    return rows.mapInArrow(run, "anchor long, core long, rid long, at long, text binary")


def _next(names: np.ndarray, places: np.ndarray, own: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each (own, at) the least of the `places` of that name at `at` or later; (names, places) are sorted."""
    first, last = np.searchsorted(names, own), np.searchsorted(names, own, "right")
    low, high = first.copy(), last.copy()
    while (open_ := low < high).any():  # binary search in each name's places
        mid = (low + high) // 2
        less = open_ & (places[np.minimum(mid, len(places) - 1)] < at)
        low, high = np.where(less, mid + 1, low), np.where(open_ & ~less, mid, high)
    return places[low]


def _texts(out: list[tuple], names: list[str]) -> pa.RecordBatch:
    """Rows of 64-bit integers and a text at the end."""
    cols = list(zip(*out, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([*(pa.array(np.array(c, dtype=_INT64)) for c in cols[:-1]), pa.array(cols[-1], pa.binary())], names)


def segments(rows: DataFrame, size: int, gram: int) -> DataFrame:
    """(anchor, sub, rid, at, text): the runs of windows of (rid, text, routes) that have an anchor of `routes`, once for each of its shards."""

    def run(batches):
        names = ["anchor", "sub", "rid", "at", "text"]
        for batch in batches:
            ids, routes, out, held = batch.column(0).to_numpy(), batch.column(2), [], 0
            for first, data, h, start, end, ranges in hashing.docs_words(batch.column(1), fold=False):
                if len(h) < size:
                    continue
                least = _least(h, size, gram)[1].view(_INT64)
                for i in range(len(ranges) - 1):
                    base = ranges[i]
                    pairs = routes[first + i].values
                    wanted, subs = (pairs.field(c).to_numpy(zero_copy_only=False) for c in ("anchor", "subs"))
                    order = np.argsort(wanted)
                    wanted, subs = wanted[order], subs[order]
                    own = least[base : ranges[i + 1] - size + 1]
                    spot = np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)
                    at = np.flatnonzero(wanted[spot] == own)
                    for lo, hi in zip(*_edges(at - np.arange(len(at)), own[at]), strict=True):
                        text = data[start[base + at[lo]] : end[base + at[hi - 1] + size - 1]].tobytes()
                        for sub in range(subs[spot[at[lo]]]):
                            out.append((own[at[lo]], sub, ids[first + i], at[lo], text))
                            held += len(text)
                            if held > 4_000_000:
                                yield _texts(out, names)
                                out, held = [], 0
            yield _texts(out, names)

    return rows.mapInArrow(run, "anchor long, sub long, rid long, at long, text binary")


#: Characters that stand for a word. Few letters keep every node's children few, which the automaton searches one by one.
LETTERS = 3


def coded(words: np.ndarray) -> str:
    """A text as three characters out of 64 for each word, from its hash; not one-to-one, hits are compared word by word."""
    bits = (words >> np.uint64(40)).astype(np.uint32)
    code = np.stack([bits & 63, bits >> 6 & 63, bits >> 12 & 63], axis=1).astype(np.uint8) + 48
    return code.tobytes().decode("ascii")


def hash_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends, ranges, bytes) of the words of many texts, laid one after the other."""
    flat = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
    offsets = np.r_[0, np.cumsum([len(t) + 1 for t in texts])].astype(_INT64)
    offsets[-1] = len(flat)
    h, start, end = hashing.word_hashes(flat, offsets, fold=False)
    return h, start, end, np.searchsorted(start, offsets), flat


class Phrases:
    """The phrases of a shard's passages in one automaton, and the passages in a matrix, their phrases in the same columns."""

    def __init__(self, rows: list[tuple[int, bytes]], size: int, gram: int):
        self.size, self.gram, self.reach = size, gram, size - gram
        self.texts = hash_texts([t for _, t in rows])
        h, _, _, ranges, _ = self.texts
        at = ranges[:-1] + np.array([c for c, _ in rows], dtype=_INT64)  # the phrases' places in the flat words
        code, numbers = coded(h), {}
        names = [code[LETTERS * a : LETTERS * (a + gram)] for a in at.tolist()]
        number = np.array([numbers.setdefault(n, len(numbers)) for n in names], dtype=_INT64)
        order = np.argsort(number, kind="stable")
        self.at, self.first = at[order], np.searchsorted(number[order], np.arange(len(numbers) + 1))
        self.table = around(h, self.at, ranges[:-1][order], ranges[1:][order], self.reach, gram, 0)
        self.automaton = ahocorasick.Automaton()
        for n, k in numbers.items():
            self.automaton.add_word(n, k)
        self.automaton.make_automaton()

    def covered(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(mark, ranges): which words of the texts, laid one after the other, an occurrence of a window covers."""
        size, gram, reach = self.size, self.gram, self.reach
        h, start, end, ranges, flat = hash_texts(texts)
        mark = np.zeros(len(h), dtype=bool)
        # places at a word's last character; a phrase that reaches into the next text fails below
        hits = [(end // LETTERS - gram + 1, k) for end, k in self.automaton.iter(coded(h)) if end % LETTERS == LETTERS - 1]
        if not hits:
            return mark, ranges
        at, number = (np.array(x, dtype=_INT64) for x in zip(*hits, strict=True))
        many = self.first[number + 1] - self.first[number]
        order = np.argsort(-many, kind="stable")  # hits with j passages or more come first
        at, number, many = at[order], number[order], many[order]
        owner = np.searchsorted(ranges, at, "right") - 1
        table = around(h, at, ranges[owner], ranges[owner + 1], reach, gram, 1)
        # all occurrences at a hit hold its phrase: the widest to the left and to the right cover what they cover together
        wide, rows, ends = np.full((2, len(at)), -1), np.zeros((2, len(at)), dtype=_INT64), np.zeros((2, 2, len(at)), dtype=_INT64)
        for j, k in enumerate(np.searchsorted(-many, -np.arange(1, int(many[0]) + 1), "right").tolist()):
            row = self.first[number[:k]] + j
            same = table[:k] == self.table[row]
            left, right = agreed(same[:, :reach][:, ::-1]), agreed(same[:, reach + gram :])
            found = same[:, reach : reach + gram].all(axis=1) & (left + gram + right >= size)
            for way, length in enumerate((left, right)):
                better = np.flatnonzero(found & (length > wide[way, :k]))
                wide[way, better], rows[way, better] = length[better], row[better]
                ends[way, :, better] = np.stack([left[better], right[better]], axis=1)
        text = (start, end, flat)
        some = np.flatnonzero(wide[0] >= 0)
        lo, hi, shift = at[some] - ends[:, 0, some], at[some] + gram + ends[:, 1, some], self.at[rows[:, some]] - at[some]
        for i, a1, b1, s1, r1, a2, b2, s2, r2 in zip(some.tolist(), lo[0].tolist(), hi[0].tolist(), shift[0].tolist(), rows[0, some].tolist(), lo[1].tolist(), hi[1].tolist(), shift[1].tolist(), rows[1, some].tolist(), strict=True):
            if mark[a1:b2].all():
                continue
            if self.verify(a1, b1, s1, text, mark) and (r1 == r2 or self.verify(a2, b2, s2, text, mark)):
                continue
            for r in range(int(self.first[number[i]]), int(self.first[number[i] + 1])):  # equal hashes of other words: each passage by itself
                self.laid(int(at[i]), table[i], r, text, mark)
        return mark, ranges

    def laid(self, place: int, own: np.ndarray, row: int, text: tuple, mark: np.ndarray) -> None:
        """Lay passage `row` over the text at a hit and mark what it covers."""
        same = own == self.table[row]
        left, right = (int(agreed(x[None])[0]) for x in (same[: self.reach][::-1], same[self.reach + self.gram :]))
        if same[self.reach : self.reach + self.gram].all() and left + self.gram + right >= self.size:
            self.verify(place - left, place + self.gram + right, int(self.at[row]) - place, text, mark)

    def verify(self, lo: int, hi: int, shift: int, text: tuple, mark: np.ndarray) -> bool:
        """Mark the runs of `size` words or more among lo:hi that equal the passage's words at `shift`; whether all are equal."""
        start, end, flat = text
        _, own_start, own_end, _, own_flat = self.texts
        raw, own = flat[start[lo] : end[hi - 1]].tobytes(), own_flat[own_start[lo + shift] : own_end[hi + shift - 1]].tobytes()
        if raw == own or (words := raw.split()) == (others := own.split()):
            mark[lo:hi] = True
            return True
        breaks = [-1, *(i for i, (x, y) in enumerate(zip(words, others, strict=True)) if x != y), hi - lo]
        for x, y in zip(breaks, breaks[1:], strict=False):
            if y - x > self.size:
                mark[lo + x + 1 : lo + y] = True
        return False


def around(h: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, reach: int, gram: int, outside: int) -> np.ndarray:
    """A row for each place: 32 bits of the hashes from `reach` words before it to `reach` words after its phrase, `outside` beyond low:high."""
    spots = at[:, None].astype(np.int32) + np.arange(-reach, gram + reach, dtype=np.int32)
    short = (h >> np.uint64(32)).astype(np.uint32) | np.uint32(2)
    out = short[np.clip(spots, 0, max(len(h) - 1, 0))]
    out[(spots < low[:, None]) | (spots >= high[:, None])] = outside
    return out


def agreed(same: np.ndarray) -> np.ndarray:
    """How many values of each row are true before the first that isn't."""
    return np.where(same.all(axis=1), same.shape[1], same.argmin(axis=1)) if same.shape[1] else np.zeros(len(same), dtype=_INT64)


def occurrences(work: DataFrame, size: int, gram: int) -> DataFrame:
    """(rid, spans) of the segments of (slot, sub, salt, kind, rid, at, core, text): kind 0 rows are a shard's passages, kind 1 rows its segments."""

    def run(batches):
        name, own, phrases = None, [], None
        for batch in batches:
            keys = [batch.column(i).to_numpy() for i in range(4)]
            rid, at, core = (batch.column(i).to_numpy() for i in (4, 5, 6))
            out = []
            for lo, hi in zip(*_edges(*keys), strict=True):
                if name != (here := tuple(k[lo] for k in keys[:3])):
                    name, own, phrases = here, [], None
                if keys[3][lo] == 0:
                    own += zip(core[lo:hi].tolist(), batch.column(7).slice(lo, hi - lo).to_pylist(), strict=True)
                    continue
                phrases = phrases or Phrases(own, size, gram)
                for a in range(lo, hi, 4000):
                    b = min(a + 4000, hi)
                    mark, ranges = phrases.covered(batch.column(7).slice(a, b - a).to_pylist())
                    for i in np.flatnonzero(np.add.reduceat(mark, ranges[:-1])).tolist():
                        step = np.diff(np.r_[0, mark[ranges[i] : ranges[i + 1]].view(np.int8), 0])
                        out.append((int(rid[a + i]), np.stack([np.flatnonzero(step == 1), np.flatnonzero(step == -1)], axis=1) + at[a + i]))
            yield _spans(out)

    dealt = work.repartition("slot", "sub", "salt").sortWithinPartitions("slot", "sub", "salt", "kind")
    return dealt.select("slot", "sub", "salt", "kind", "rid", "at", "core", "text").mapInArrow(run, "rid long, spans binary")


def removed(rows: DataFrame, with_text: bool = False) -> DataFrame:
    """(name, n_words, n_removed, kept_sha256[, kept]) of (name, text, parts); parts are lists of spans."""

    def run(batches):
        for batch in batches:
            out = []
            for text, parts in zip(batch.column(1), batch.column(2), strict=True):
                words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                gone = np.zeros(len(words), dtype=bool)
                for blob in parts.as_py() or ():
                    for a, b in _pairs(blob).tolist():
                        gone[a:b] = True
                lost = int(gone.sum())
                raw = b" ".join([w for w, m in zip(words, gone.tolist(), strict=True) if not m] if lost else words)
                out.append((len(words), lost, hashlib.sha256(raw).hexdigest(), *([raw.decode()] if with_text else [])))
            cols = list(zip(*out, strict=True)) or [[]] * (3 + with_text)
            types = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, types)]], ["name", "n_words", "n_removed", "kept_sha256", "kept"][: 4 + with_text])  # noqa: B905

    kind = rows.schema["name"].dataType.simpleString()
    return rows.mapInArrow(run, f"name {kind}, n_words long, n_removed long, kept_sha256 string" + (", kept string" if with_text else ""))


def located(rows: DataFrame, size: int = SIZE, gram: int = GRAM, small: int = SMALL, piece: int = PIECE, shard_passages: int = SHARD_PASSAGES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(rid, spans) of (rid, text): word ranges that recur, some rows for each text that has any."""
    profile = stored(profiles(rows, size, gram, piece))
    pid = F.xxhash64("rid", "piece")
    copies = profile.groupBy("s1", "s2", "n").agg(F.count("*").alias("c"), F.min(pid).alias("lead")).where("c > 1").drop("c")
    roles = stored(profile.select("rid", "piece", "s1", "s2", "n").join(copies, ["s1", "s2", "n"]).select("rid", "piece", (pid == F.col("lead")).alias("leads")))
    each = profile.select("rid", "piece", F.explode("anchors").alias("anchor"))
    twice = each.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor")
    own = stored(each.join(twice, "anchor").select("rid", "piece", "anchor"))
    near = lambda df: side(df, small, "shuffle_hash")

    # windows of all pieces but the copies of a lead
    led = roles.groupBy("rid").agg(F.collect_list(F.when(~F.col("leads"), F.col("piece"))).alias("skip"), F.collect_list(F.when(F.col("leads"), F.col("piece"))).alias("led"))
    sending = own.join(roles.where("not leads").select("rid", "piece"), ["rid", "piece"], "left_anti")
    mine = sending.groupBy("rid").agg(F.collect_set("anchor").alias("repeated")).join(led, "rid", "left")
    none = F.array().cast("array<int>")
    mine = stored(mine.select("rid", "repeated", F.struct(F.coalesce("skip", none).alias("skip"), F.coalesce("led", none).alias("led")).alias("led")))
    sent = windows(rows.join(near(mine), "rid").select("rid", "text", "repeated", "led"), size, gram, piece)
    spans = stored(merged(confirmed(sent)).select("rid", "spans"))

    # passages in shards, and the way to them by anchors: a shard is a slot of anchors, or a part of it for an anchor with many passages
    kept = stored(passages(rows.join(near(spans), "rid").select("rid", "text", "spans"), size, gram))
    slots = max(1, -(-kept.count() // shard_passages))
    slot = F.pmod(F.xxhash64("anchor"), F.lit(slots)).alias("slot")
    routes = stored(kept.groupBy("anchor").agg(F.ceil(F.count("*") / F.lit(shard_passages)).cast("int").alias("subs")))
    known = side(routes, small)
    routed = stored(own.select("rid", "anchor").distinct().join(known, "anchor"))
    paths = stored(routed.groupBy("rid").agg(F.collect_list(F.struct("anchor", "subs")).alias("routes")))
    # a run of windows of one anchor is about 300 bytes of text
    load = routed.select(slot, F.explode(F.sequence(F.lit(0).cast("long"), F.col("subs").cast("long") - 1)).alias("sub")).groupBy("slot", "sub")
    loads = side(stored(load.agg(F.ceil(F.count("*") * 300 / F.lit(chunk_bytes)).cast("long").alias("salts"))), small)
    heads = kept.join(known, "anchor").select(slot, F.pmod(F.xxhash64("rid", "at"), F.col("subs")).cast("long").alias("sub"), "rid", "at", "core", "text").join(loads, ["slot", "sub"])
    heads = heads.select("slot", "sub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), "rid", "at", "core", "text")
    parts = segments(rows.join(near(paths), "rid").select("rid", "text", "routes"), size, gram).select(slot, "sub", "rid", "at", "text").join(loads, ["slot", "sub"])
    parts = parts.select("slot", "sub", F.pmod(F.xxhash64("rid", "at"), F.col("salts")).alias("salt"), F.lit(1).alias("kind"), "rid", "at", F.lit(0).cast("long").alias("core"), "text")
    return occurrences(heads.union(parts), size, gram)


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, gram: int = GRAM, with_text: bool = False, small: int = SMALL, **kw) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept]) for every row of `docs`.

    What a scan needs to know of each text (anchors, passages, places) is broadcast if it takes at most `small` bytes, else
    joined by shuffle. `kw` goes to `located`.
    """
    rows = bucketed(docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).alias("name"), F.col(text).cast("string").alias("text")), "rid")
    found = stored(located(rows.select("rid", "text"), size, gram, small, **kw).groupBy("rid").agg(F.collect_list("spans").alias("parts")))
    return removed(rows.join(side(found, small, "shuffle_hash"), "rid", "left").select("name", "text", "parts"), with_text).withColumnRenamed("name", doc_id)
