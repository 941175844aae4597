"""Token ids in files of independently reset, checksummed, arithmetic-coded blocks.

A block holds up to `BLOCK` ids. Its model starts empty: order-2 and order-1 tables each predict one id with a confidence, and
the mixed decision "order-2 guess, order-1 guess, neither" is coded with counts kept for each pair of confidences; an id that
neither predicts is coded by its class under adaptive order-0 class counts, then by its place in the class. Classes widen with
the id, as merges get rarer, but for the bytes that end a word. The tables learn at every id; the shares of decisions and classes
are drawn from their counts at fixed steps (`Lanes.STEPS`). Blocks are coded in lockstep, one numpy lane for each, by a range coder
that emits 16-bit words, so a step of all lanes costs a few dozen array operations. Carries are added when a block is complete.

A block's bytes: header, document entries (id, place in the document, count, checksum before), payload, CRC-32 of the ids and of
everything before. Blocks are rows of a Parquet table written by Spark in ascending doc_id order, a range of documents for each
part; a part ends with an empty block. A part's numbers must run from 0 to its end: `round_trip` counts the blocks as it reads them,
`complete` does so without decoding them. Reading checks
every block's bytes and ids, and the chain of checksums of documents that span blocks where both blocks are at hand.

The orders' predictions are not blended into one distribution over ids: orders 2 and 1 each offer one guess, and order 0 predicts
classes, uniform inside. Blending over 49,408 ids costs more than the tool's time for this operator allows (see the README).

Null texts are empty: their document holds the end id only. Null doc_ids come first. Repeated rows and doc_ids are documents of
their own, in any order among themselves. Very long texts span blocks. Extra columns are ignored. An empty table gives end blocks only.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import gather, groups
from .common import cut, new_folder

BLOCK = 2048
LANES = 4096
CONTEXT_BITS = 8
#: Texts are cut and encoded together, about so many bytes at a time.
TOGETHER = 24_000_000
#: Words that a worker keeps with their ids, from task to task.
KEPT = 1_000_000
#: Words that go to the tokenizers library as one text.
JOINED = 200
END_ID = 1
_MAGIC = b"CMR2"
_HEAD = struct.Struct("<4sIqqII")  # magic, block number, ids before it in its part, part, ids, documents
_DOC = struct.Struct("<qBIII")  # doc_id, flags (1 null id, 2 ends here), ids of it before this block, ids here, CRC-32 of those before
TRAILING = ".,!?;:%#$&*|"
#: Letters whose lower case and composed form are one letter each, in any place of a word.
LETTERS = r"^[A-Za-zÀ-ÖØ-öø-ÿА-Яа-яЁё]+$"


def class_widths(vocabulary: int) -> np.ndarray:
    """Bits of the width of each of 64 classes: narrow where bytes that end a word lie (256 to 511, punctuation first), then growing."""
    rest = np.repeat(np.arange(6, 13), [8, 8, 8, 8, 8, 8, 5])
    while 512 + (1 << rest).sum() < vocabulary:
        rest += 1
    return np.concatenate([np.repeat([6, 4, 6], [4, 4, 3]), rest])


#: Shares of a choice are parts of `_ONE`: a decision has `_LEAST` at least, a class `_SMALL`.
_ONE, _LEAST, _SMALL = 1 << 15, 8, 2
#: A number in each 16-bit field, and the bits over the fields, which stay where the number is not below the field.
_EACH, _ABOVE = 0x0001000100010001, 0x8000800080008000


class Lanes:
    """The models of many blocks. Lanes are ordered by length, longest first, so the live ones are always the first `k`.

    A guess and its confidence share one 32-bit cell. Decisions and classes are counted at every id; their shares follow the counts
    at fixed steps, often at a block's beginning, then every 256 ids. A class is found in three
    choices of four, whose starts are compared at once, in the fields of one 64-bit number.
    """

    STEPS = frozenset([8, 16, 32, 64, 96, 128, 192, 256, 384, 512, *range(768, 1 << 16, 256)])
    #: First shares of guesses, by confidence, of `_ONE`; they weigh as much as four decisions.
    FIRST = (64, 4096, 12288, 24576)

    def __init__(self, n: int, vocabulary: int):
        bits = class_widths(vocabulary)
        self.n, self.bits, self.first = n, bits.astype(np.uint64), (np.cumsum(1 << bits) - (1 << bits)).astype(np.int32)
        self.cells = [np.full(n << CONTEXT_BITS, 0, dtype=np.int32) for _ in range(2)]  # not zeros: large pages
        pairs = [(a, (_ONE - a) * (0 if same else b) // _ONE) for a in self.FIRST for b in self.FIRST for same in (0, 1)]
        self.decided = np.tile(np.array([[a, b, _ONE - a - b] for a, b in pairs]).T * 4.0 / _ONE + 0.125, n)
        self.counted = np.full((n, 64), 0.5)
        self.decisions, self.classes = [], []
        lane = np.arange(n, dtype=np.int64)
        self.base, self.lane32 = lane << CONTEXT_BITS, lane << 5
        self.prev, self.older = np.zeros(n, dtype=np.uint32), np.zeros(n, dtype=np.uint32)
        self.share()

    def share(self) -> None:
        """Shares from the counts."""
        if self.decisions:
            self.decided += np.bincount(np.concatenate(self.decisions), minlength=self.n * 96).reshape(3, -1)
            self.counted += np.bincount(np.concatenate(self.classes), minlength=self.n * 64).reshape(-1, 64)
            self.decisions, self.classes = [], []
        zero, one, two = self.decided
        one = zero + one
        scale = (_ONE - 3 * _LEAST) / (one + two)
        self.kind = (zero * scale + _LEAST).astype(np.uint64) | (one * scale + 2 * _LEAST).astype(np.uint64) << 16 | _ONE << 32
        ends = np.cumsum(self.counted, axis=1)
        ends = (ends * ((_ONE - 64 * _SMALL) / ends[:, -1:])).astype(np.int32) + np.arange(1, 65, dtype=np.int32) * _SMALL
        starts = np.zeros((self.n, 64), dtype="<u2")
        starts[:, 1:] = ends[:, :-1]
        self.parts = (starts | (ends - starts) << 16).astype(np.uint32).ravel()
        self.levels = [np.ascontiguousarray(starts[:, ::apart]).view("<u8").ravel() for apart in (16, 4, 1)]

    def look(self, k: int) -> None:
        """Find the guesses of the live lanes and the shares of their decision."""
        prev = self.prev[:k]
        down = 32 - CONTEXT_BITS
        mixed = prev * np.uint32(2654435761)
        self.at = (self.base[:k] + ((mixed + self.older[:k]) >> down), self.base[:k] + (mixed >> down))
        self.older[:k] = prev * np.uint32(2246822519)
        self.held = [c.take(at) for c, at in zip(self.cells, self.at, strict=True)]
        self.two, self.one = self.held[0] >> 2, self.held[1] >> 2
        ctx = ((self.held[0] & 3) << 3) + ((self.held[1] & 3) << 1)
        ctx += self.two == self.one
        self.ctx = self.lane32[:k] + ctx
        self.cell = self.kind.take(self.ctx)

    def learn(self, t: int, k: int, ids: np.ndarray, decision: np.ndarray, classes: np.ndarray) -> None:
        self.decisions.append(self.ctx + decision * np.int32(self.n * 32))
        self.classes.append(classes)
        for cells, at, old, guess in zip(self.cells, self.at, self.held, (self.two, self.one), strict=True):
            right = guess == ids
            sure = old & 3
            new = np.minimum(sure, 2)
            new *= right
            new += 1
            right |= sure > 1
            new += np.where(right, guess, ids) << 2
            cells[at] = new
        self.prev[:k] = ids
        if t + 1 in self.STEPS:
            self.share()


#: A range has `_TOP` bits at most and `_LOW` at least between ids; payloads are 16-bit words after `_TOP` bits.
_TOP, _LOW = 56, 40
_REST = (1 << _LOW) - 1


def _share(cell: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and width of the share of each symbol, of ends packed in 16-bit fields."""
    down = symbol.astype(np.uint64) << 4
    start = ((cell << 16) >> down) & 0xFFFF
    return start, ((cell >> down) & 0xFFFF) - start


def _turned(rows: list[np.ndarray], length: int, kind: type) -> np.ndarray:
    """Rows as columns of a matrix, `length` long each, filled up with zeros; some rows at a time, which stay in the caches."""
    out = np.zeros((length, len(rows)), dtype=kind)
    for a in range(0, len(rows), 64):
        some = np.zeros((min(64, len(rows) - a), length), dtype=kind)
        for to, row in zip(some, rows[a : a + 64], strict=False):
            to[: len(row)] = row
        out[:, a : a + 64] = some.T
    return out


def _rows(columns: np.ndarray) -> Iterator[np.ndarray]:
    """The columns of a matrix as rows, some at a time."""
    for a in range(0, columns.shape[1], 64):
        yield np.ascontiguousarray(columns[:, a : a + 64].T)


class _Writer:
    """Words lie by place, then by lane: lanes are at nearly the same place, so writing stays within few pages."""

    def __init__(self, n: int, longest: int):
        self.low, self.span = np.zeros(n, dtype=np.uint64), np.full(n, (1 << _TOP) - 1, dtype=np.uint64)
        self.out, self.at = np.zeros(n * (longest * 4 + 8), dtype=np.uint32), np.arange(n)

    def settle(self, least: int = 1 << _LOW) -> None:
        own = np.flatnonzero(self.span < least)
        while len(own):
            span = self.span.take(own) << 16
            self.shift(own)
            self.span[own] = span
            own = own[span < least]

    def shift(self, own: np.ndarray) -> None:
        low, at = self.low.take(own), self.at.take(own)
        self.out[at] = low >> _LOW  # a carry goes along and is added to the word before at the end
        self.low[own] = (low & _REST) << 16
        self.at[own] = at + len(self.low)

    def finish(self) -> list[bytes]:
        n = len(self.low)
        for _ in range(4):
            self.shift(np.arange(n))
        size, out = (self.at // n).tolist(), []
        for words in _rows(self.out.reshape(-1, n)[: max(size)]):
            while (words >> 16).any():
                carry = words[:, 1:] >> 16
                words &= 0xFFFF
                words[:, :-1] += carry
            out += [row[:k].tobytes()[:-1] for row, k in zip(words.astype(">u2"), size[len(out) :], strict=False)]
        return out


class _Reader:
    def __init__(self, payloads: list[bytes]):
        n, lead = len(payloads), _TOP // 8
        self.seen = np.array([int.from_bytes(p[:lead], "big") for p in payloads], dtype=np.uint64)
        self.span = np.full(n, (1 << _TOP) - 1, dtype=np.uint64)
        words = [np.frombuffer(p, dtype=">u2", offset=lead) for p in payloads]
        self.words, self.at = _turned(words, max(map(len, words)) + 4, np.uint16).ravel(), np.arange(n)

    def settle(self, least: int = 1 << _LOW) -> None:
        own = np.flatnonzero(self.span < least)
        while len(own):
            span, at = self.span.take(own) << 16, self.at.take(own)
            self.seen[own] = (self.seen.take(own) << 16) | self.words.take(at)
            self.at[own] = at + len(self.seen)
            self.span[own] = span
            own = own[span < least]


def _columns(sizes: np.ndarray) -> list[int]:
    """How many lanes are live at each step; lanes are in order of falling size."""
    return (len(sizes) - np.searchsorted(sizes[::-1], np.arange(sizes[0]), side="right")).tolist()


def encode_blocks(blocks: list[np.ndarray], vocabulary: int) -> list[bytes]:
    """Payloads of blocks of ids, all lanes of one call in lockstep."""
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    sizes = np.array([len(blocks[i]) for i in order])
    ids = _turned([blocks[i] for i in order], int(sizes[0]), np.int32)
    model, coder = Lanes(len(blocks), vocabulary), _Writer(len(blocks), int(sizes[0]))
    class_of = np.repeat(np.arange(64, dtype=np.int32), 1 << model.bits.astype(np.int64))[: max(vocabulary, 1)]
    low, span = coder.low, coder.span
    for t, k in enumerate(_columns(sizes)):
        x = ids[t, :k]
        model.look(k)
        other = model.two != x
        decision = other.view(np.int8) + (other & (model.one != x))
        start, width = _share(model.cell, decision)
        step = span[:k] >> 15
        low[:k] += start * step
        np.multiply(width, step, out=span[:k])
        rest = np.flatnonzero(decision == 2)
        v = x.take(rest)
        cls = class_of.take(v)
        classes = (rest << 6) + cls
        part = model.parts.take(classes)
        step = span.take(rest) >> 15
        more, step = (part & 0xFFFF) * step, ((part >> 16) * step) >> model.bits.take(cls)
        low[rest] += more + (v - model.first.take(cls)).astype(np.uint64) * step
        span[rest] = step
        coder.settle()
        model.learn(t, k, x, decision, classes)
    out = [b""] * len(blocks)
    for i, payload in zip(order, coder.finish(), strict=True):
        out[i] = payload
    return out


def decode_blocks(payloads: list[bytes], counts: list[int], vocabulary: int) -> list[np.ndarray]:
    order = sorted(range(len(payloads)), key=lambda i: -counts[i])
    sizes = np.array([counts[i] for i in order])
    ids = np.zeros((int(sizes[0]), len(payloads)), dtype=np.int32)
    model, coder = Lanes(len(payloads), vocabulary), _Reader([payloads[i] for i in order])
    seen, span = coder.seen, coder.span

    for t, k in enumerate(_columns(sizes)):
        model.look(k)
        code, own_span = seen[:k], span[:k]
        step = own_span >> 15
        decision = np.bitwise_count((((code // step) * 0x10001 | 0x80008000) - model.cell) & 0x80008000)
        start, width = _share(model.cell, decision)
        code -= start * step
        np.multiply(width, step, out=own_span)
        x = np.where(decision == 0, model.two, model.one)
        rest = np.flatnonzero(decision == 2)
        code = seen.take(rest)
        step = span.take(rest) >> 15
        number = (code // step) * _EACH | _ABOVE
        classes = rest
        for level in model.levels:
            classes = (classes << 2) - 1 + np.bitwise_count((number - level.take(classes)) & _ABOVE)
        cls = classes & 63
        part = model.parts.take(classes)
        code -= (part & 0xFFFF) * step
        step = ((part >> 16) * step) >> model.bits.take(cls)
        place = code // step
        seen[rest] = code - place * step
        span[rest] = step
        coder.settle()
        x[rest] = model.first.take(cls) + place.astype(np.int32)
        ids[t, :k] = x
        model.learn(t, k, x, decision, classes)
    out = [np.zeros(0, dtype=np.int32)] * len(payloads)
    for i, row in zip(order, chain.from_iterable(_rows(ids)), strict=True):
        out[i] = row[: counts[i]]
    return out


def pack(number: int, before: int, part: int, ids: np.ndarray, docs: list[tuple], payload: bytes) -> bytes:
    body = _HEAD.pack(_MAGIC, number, before, part, len(ids), len(docs)) + b"".join(_DOC.pack(*d) for d in docs) + payload
    body += struct.pack("<I", zlib.crc32(ids.astype("<u4").tobytes()))
    return body + struct.pack("<I", zlib.crc32(body))


def unpack(data: bytes) -> tuple[int, int, int, int, list[tuple], bytes, int]:
    """(block number, ids before, part, ids, document entries, payload, checksum of the ids); raises on damage."""
    if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("a block's bytes don't match their checksum")
    magic, number, before, part, n, count = _HEAD.unpack_from(data)
    if magic != _MAGIC:
        raise ValueError("not a block of token ids")
    end = _HEAD.size + count * _DOC.size
    return number, before, part, n, list(_DOC.iter_unpack(data[_HEAD.size : end])), data[end:-8], struct.unpack("<I", data[-8:-4])[0]


class Tokenized:
    """Texts to ids with the tokenizers library, which sees each distinct word once.

    The tokenizer takes any white space as a border of words and letters apart from punctuation, so Arrow cuts texts at spaces and line
    ends, and a chunk of plain letters from the punctuation behind it. Words of letters, in lower case, go to the library many at a time;
    a word's ids end with the one token that ends a word. All other chunks go as they are.
    """

    _made: dict[str, Tokenized] = {}

    @classmethod
    def of(cls, path: str) -> Tokenized:
        """The one of this worker: tasks that follow know the words of those before."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.plain = Tokenizer(self.tokenizer.model)  # for words that are in lower case and apart
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.last = np.zeros(self.vocabulary, dtype=bool)
        self.last[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.words = pa.array([], pa.string())
        self.flat, self.length = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)

    def apart(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks, one after the other, and how many each has."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
        length = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        return np.fromiter(chain.from_iterable(found), dtype=np.int32, count=int(length.sum())), length

    def together(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """`apart` for words of letters in lower case."""
        begin = pa.array(np.append(np.arange(0, len(words), JOINED), len(words)), pa.int32())
        found = self.plain.encode_batch_fast(pc.binary_join(pa.ListArray.from_arrays(begin, words), " ").to_pylist(), add_special_tokens=False)
        flat = np.concatenate([np.array(e.ids, dtype=np.int32) for e in found])
        ends = np.flatnonzero(self.last[flat]) + 1
        if len(ends) != len(words) or ends[-1] != len(flat):  # not a tokenizer that marks the ends of words
            return self.apart(words.to_pylist())
        return flat, np.diff(ends, prepend=0)

    def known(self, words: pa.Array) -> np.ndarray:
        """Places of distinct words among those that are kept; new ones are encoded and kept."""
        if len(self.words) > KEPT:
            self.forget()
        at = pc.index_in(words, value_set=self.words)
        new = words.filter(at.is_null())
        place = at.fill_null(0).to_numpy().astype(np.int64)
        if len(new):
            place[at.is_null().to_numpy(zero_copy_only=False)] = len(self.words) + np.arange(len(new))
            flat, length = self.together(new)
            self.words = pa.concat_arrays([self.words, new])
            self.flat, self.length = np.concatenate([self.flat, flat]), np.concatenate([self.length, length])
        return place

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of an array of texts, one after the other, and how many each has."""
        split = pc.split_pattern(pc.replace_substring(texts.fill_null(""), "\n", " "), " ")
        coded = split.values.dictionary_encode()
        chunks = coded.dictionary
        stems = pc.utf8_rtrim(chunks, characters=TRAILING)
        plain = pc.match_substring_regex(stems, LETTERS)
        words = pc.utf8_lower(stems.filter(plain)).dictionary_encode()
        tailed = pc.and_(plain, pc.not_equal(pc.binary_length(chunks), pc.binary_length(stems)))
        tails = pc.replace_substring_regex(chunks.filter(tailed), LETTERS[:-1], "").dictionary_encode()
        other = chunks.filter(pc.invert(plain))
        # pieces: the kept words, then the distinct tails, then the other chunks
        place = self.known(words.dictionary)
        more, count = self.apart(tails.dictionary.to_pylist() + other.to_pylist())
        flat, length = np.concatenate([self.flat, more]), np.concatenate([self.length, count])
        offset = np.cumsum(length) - length
        is_plain, is_tailed = (x.to_numpy(zero_copy_only=False) for x in (plain, tailed))
        first = np.empty(len(chunks), dtype=np.int64)
        first[is_plain] = place[words.indices.to_numpy()]
        first[~is_plain] = len(self.length) + len(tails.dictionary) + np.arange(len(other))
        second = len(self.length) + tails.indices.to_numpy()
        # ids of the distinct chunks, then of the texts
        pieces = np.stack([first, np.full(len(chunks), -1)], axis=1)
        pieces[is_tailed, 1] = second
        pieces = pieces[pieces >= 0]
        size = length[first]
        size[is_tailed] += length[second]
        flat = flat[gather(offset[pieces], length[pieces])]
        offset, at = np.cumsum(size) - size, coded.indices.to_numpy()
        ends = np.cumsum(size[at])
        out = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.int32)
        for a in range(0, len(at), 1 << 14):  # some at a time, which stay in the caches
            some = at[a : a + (1 << 14)]
            out[ends[a] - size[some[0]] : ends[a + len(some) - 1]] = flat[gather(offset[some], size[some])]
        begin = split.offsets.to_numpy() - split.offsets[0].as_py()
        return out, np.diff(np.append(0, ends)[begin])

def write(docs: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID) -> None:
    """Encode `docs` and write the blocks under `path`."""
    inputs = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))

    def run(batches):
        part, number, before = TaskContext.get().partitionId(), 0, 0
        tokens, stop = Tokenized.of(tokenizer), np.int32(end_id)
        held: list[tuple[np.ndarray, list[tuple]]] = []  # closed blocks
        ids: list[np.ndarray] = []  # the open block
        docs_here: list[tuple] = []
        room = BLOCK

        def close():
            nonlocal ids, docs_here, room
            if docs_here:
                held.append((np.concatenate(ids), docs_here))
            ids, docs_here, room = [], [], BLOCK

        def flush():
            nonlocal number, before
            rows, most = [], -(-len(held) // max(1, -(-len(held) // LANES))) or 1  # parts of about one size
            for a in range(0, len(held), most):
                some = held[a : a + most]
                for (block, entries), payload in zip(some, encode_blocks([b for b, _ in some], tokens.vocabulary), strict=True):
                    rows.append(pack(number, before, part, block, entries, payload))
                    number, before = number + 1, before + len(block)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([part] * len(rows), pa.int64()), pa.array(range(number - len(rows), number), pa.int64()), pa.array(rows, pa.binary())], ["part", "number", "block"])

        for batch in batches:
            names, column = batch.column(0).to_pylist(), batch.column(1)
            for a, b in groups(pc.binary_length(column).fill_null(0).to_pylist(), TOGETHER):
                flat, length = tokens.texts(column.slice(a, b - a))
                ends = np.cumsum(length)
                for name, e, n in zip(names[a:b], ends.tolist(), length.tolist(), strict=True):
                    mine = np.append(flat[e - n : e], stop)
                    at, crc = 0, 0
                    while at < len(mine):
                        some = mine[at : at + room]
                        last = at + len(some) == len(mine)
                        docs_here.append((name or 0, (name is None) + 2 * last, at, len(some), crc))
                        ids.append(some)
                        crc = zlib.crc32(some.astype("<u4"), crc)
                        at, room = at + len(some), room - len(some)
                        if not room:
                            close()
                if len(held) >= LANES:
                    yield flush()
        close()
        yield flush()
        end = pack(number, before, part, np.zeros(0, dtype=np.int64), [], b"")
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([number], pa.int64()), pa.array([end], pa.binary())], ["part", "number", "block"])

    ordered = inputs.repartitionByRange("doc").sortWithinPartitions("doc")
    ordered.mapInArrow(run, "part long, number long, block binary").write.option("compression", "none").parquet(path)


def read(spark: SparkSession, path: str, vocabulary: int, with_ids: bool = False, with_heads: bool = False) -> DataFrame:
    """(part, doc_id, start_in_part, n_tokens, ids_crc32) of every document under `path`; [(part, number, ids) of blocks with `with_ids`].

    With `with_heads`, rows of blocks too: (part, null, ids before it, ids, null, number); number is null for documents.
    """

    def run(batches):
        chained: dict[tuple, int] = {}
        none = [None] * with_heads
        for batch in batches:
            blobs = batch.column(0)
            for lo in range(0, len(blobs), LANES):
                blocks = list(map(unpack, blobs.slice(lo, LANES).to_pylist()))
                heads = [(part, None, before, n, None, number) for number, before, part, n, *_ in blocks]
                blocks = [b for b in blocks if b[3]]  # end blocks hold nothing
                decoded = decode_blocks([b[5] for b in blocks], [b[3] for b in blocks], vocabulary) if blocks else []
                rows = heads if with_heads else []
                for (number, before, part, n, docs, _, crc), ids in zip(blocks, decoded, strict=True):
                    raw = ids.astype("<u4").tobytes()
                    if zlib.crc32(raw) != crc:
                        raise ValueError(f"ids of block {number} of part {part} don't match their checksum")
                    if with_ids:
                        rows.append((part, number, raw))
                        continue
                    at = 0
                    for name, flags, place, count, earlier in docs:
                        if place and chained.get((part, before + at), earlier) != earlier:
                            raise ValueError(f"document {name} doesn't go on from the block before")
                        total = zlib.crc32(raw[4 * at : 4 * (at + count)], earlier)
                        chained = {(part, before + at + count): total}
                        if flags & 2:
                            rows.append((part, None if flags & 1 else name, before + at - place, place + count, total, *none))
                        at += count
                names = ["part", "number", "ids"] if with_ids else ["part", "doc", "start", "n_tokens", "ids_crc32", "number"][: 5 + with_heads]
                types = [pa.int64(), pa.int64(), pa.binary()] if with_ids else [pa.int64()] * len(names)
                cols = list(zip(*rows, strict=True)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    schema = "part long, number long, ids binary" if with_ids else "part long, doc long, start long, n_tokens long, ids_crc32 long" + (", number long" if with_heads else "")
    return spark.read.schema("part long, number long, block binary").parquet(path).select("block").mapInArrow(run, schema)


def complete(spark: SparkSession, path: str) -> None:
    """Raise if a block under `path` is damaged or lost. Only headers and checksums are read, and one row for each part is looked at."""

    def run(batches):
        for batch in batches:
            heads = [unpack(b)[:4] for b in batch.column(0).to_pylist()]
            cols = [pa.array([h[i] for h in heads], pa.int64()) for i in (2, 0, 1, 3)]
            yield pa.RecordBatch.from_arrays(cols, ["part", "number", "before", "n"])

    heads = spark.read.schema("part long, number long, block binary").parquet(path).select("block").mapInArrow(run, "part long, number long, before long, n long")
    _whole(heads, path)


def _whole(heads: DataFrame, path: str) -> None:
    """Raise if rows (part, number, before, n) of blocks don't make up whole parts."""
    ends = F.count_if(F.col("n") == 0)
    lost = (F.count("*") != F.max("number") + 1) | (F.countDistinct("number") != F.count("*")) | (ends != 1) | (F.max(F.when(F.col("n") == 0, F.col("number"))) != F.max("number")) | (F.max("before") != F.sum("n"))
    bad = heads.groupBy("part").agg(lost.alias("lost"), F.min("part").alias("p")).where("lost").limit(1).collect()
    if bad:
        raise ValueError(f"part {bad[0]['p']} of {path} lacks blocks")


def round_trip(docs: DataFrame, tokenizer: str, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the ids of `docs`, read them back, and give (doc_id, start, n_tokens, ids_crc32) of each document."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    path = path or new_folder(spark, "tokens")
    write(docs, path, tokenizer, doc_id, text)
    rows = cut(read(spark, path, Tokenizer.from_file(tokenizer).get_vocab_size(), with_heads=True))
    _whole(rows.where("number is not null").selectExpr("part", "number", "start as before", "n_tokens as n"), path)
    found = rows.where("number is null").drop("number")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    offset = found.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return found.join(F.broadcast(offset), "part").select(F.col("doc").alias(doc_id), (F.col("offset") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")
