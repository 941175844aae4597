"""Byte-level BPE encoding and decoding with batched numpy merge rounds.

The symbols of many words lie in one flat array. A round packs each neighbouring pair into one key, finds its rank by binary
search over the sorted pair keys, takes the lowest rank of each word and merges its occurrences, left to right, in all words at
once. Words without a mergeable pair leave the array. Texts are cut at single spaces into chunks that tokenize on their own;
each task keeps a bounded cache of chunk -> ids, so merge rounds run once per distinct chunk.

Null texts are empty and give no ids. Special tokens in a text are encoded as their own id. Rows are independent: repeated
rows, ties and extra columns change nothing, and whole texts are encoded whatever their length.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .hashing import window_least

#: Fixed value: the pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Where cutting at single spaces would split a run of white space: a space after white space and before white space or the end.
UNSAFE = regex.compile(r"\s\x20(?:\s|\Z)")
#: Bytes that a cache of chunks may take, about, each entry with its overhead; longer chunks than `CACHED` are not kept.
CACHE, ENTRY = 30_000_000, 160
CACHED = 200
#: Words over so many bytes are merged by neighbourhoods.
LONG = 400
GROUP_CHARS = 2_000_000


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte: itself if printable Latin-1, else the next free one from U+0100."""
    out, free = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out[b] = chr(b)
        else:
            out[b] = chr(free)
            free += 1
    return out


def model(path: str) -> dict:
    """Tables of a byte-level BPE tokenizer file, small enough to go with each task (bounded by the vocabulary)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
    keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], dtype=np.int64)
    made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
    order = np.argsort(keys)
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    symbols = byte_symbols()
    back = {c: b for b, c in symbols.items()}
    size = max([*vocab.values(), *special.values()]) + 1
    latest: dict[int, int] = {}  # the last rank that makes a token
    for rank, token in enumerate(made.tolist()):
        latest[token] = rank
    ordered = all(latest.get(vocab[a], -1) < rank and latest.get(vocab[b], -1) < rank for rank, (a, b) in enumerate(pairs))
    spelled = [b""] * size
    for token, i in vocab.items():
        spelled[i] = bytes(back[c] for c in token)
    for token, i in special.items():
        spelled[i] = token.encode()
    return {
        "keys": keys[order], "ranks": order.astype(np.int32), "made": made, "special": special, "ordered": ordered, "reach": max(len(x) for x in vocab),
        "first": np.array([vocab[symbols[b]] for b in range(256)], dtype=np.int64),
        "bytes": np.frombuffer(b"".join(spelled), dtype=np.uint8), "byte_len": np.array([len(x) for x in spelled], dtype=np.int64),
    }


def gather(offsets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of the ranges [offset, offset + length), one after the other."""
    ends = np.cumsum(lengths)
    if not len(ends):
        return np.zeros(0, dtype=np.int64)
    return np.arange(ends[-1]) + np.repeat(offsets - (ends - lengths), lengths)


NONE = np.int32(2**31 - 1)


def pair_ranks(m: dict, sym: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The rank of the pairs that begin at places `at`, `NONE` for those that don't merge or leave their word."""
    rank = np.full(len(at), NONE, dtype=np.int32)
    inner = np.flatnonzero(at + 1 < len(sym))
    inner = inner[word[at[inner] + 1] == word[at[inner]]]
    key = (sym[at[inner]] << 32) | sym[at[inner] + 1]
    found = np.minimum(np.searchsorted(m["keys"], key), len(m["keys"]) - 1)
    known = m["keys"][found] == key
    rank[inner[known]] = m["ranks"][found[known]]
    return rank


def alternate(spots: np.ndarray) -> np.ndarray:
    """Of neighbouring places (overlapping occurrences: a a a) every second one from the left."""
    new_run = np.r_[True, np.diff(spots) != 1]
    run_start = spots[np.maximum.accumulate(np.where(new_run, np.arange(len(spots)), 0))]
    return spots[(spots - run_start) % 2 == 0]


def merge_words(m: dict, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words, one after the other, and how many each has. Words must not be empty."""
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    if m["ordered"] and len(lengths) and lengths.max() > LONG:
        long = np.flatnonzero(lengths > LONG)
        rest = np.flatnonzero(lengths <= LONG)
        parts = [merge_long(m, [words[i] for i in long]), merge_words(m, [words[i] for i in rest])]
        count = np.zeros(len(words), dtype=np.int64)
        count[long], count[rest] = parts[0][1], parts[1][1]
        out = np.zeros(int(count.sum()), dtype=np.int64)
        begin = np.cumsum(count) - count
        for own, (ids, n) in zip((long, rest), parts, strict=True):
            out[gather(begin[own], n)] = ids
        return out, count
    sym = m["first"][np.frombuffer(b"".join(words), dtype=np.uint8)]
    word = np.repeat(np.arange(len(words)), lengths)
    done_sym, done_word = [], []
    while len(sym):
        start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        rank = pair_ranks(m, sym, word, np.arange(len(sym)))
        least = np.minimum.reduceat(rank, start)
        size = np.diff(np.r_[start, len(sym)])
        live = np.repeat(least < NONE, size)
        done_sym.append(sym[~live])
        done_word.append(word[~live])
        hit = live & (rank == np.repeat(least, size))
        spots = np.flatnonzero(hit)
        if not len(spots):
            break
        spots = alternate(spots)
        sym[spots] = m["made"][rank[spots]]
        live[spots + 1] = False
        sym, word = sym[live], word[live]
    all_word = np.concatenate(done_word) if done_word else np.zeros(0, dtype=np.int64)
    all_sym = np.concatenate(done_sym) if done_sym else np.zeros(0, dtype=np.int64)
    order = np.argsort(all_word, kind="stable")
    return all_sym[order], np.bincount(all_word, minlength=len(words))


def merge_long(m: dict, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """`merge_words` for long words: a round merges wherever a rank is the lowest within `reach` symbols on both sides.

    Ranks are looked up again only beside the merges. Of a run of overlapping equal pairs a round takes its beginning or none, as
    the places from which such pairs are merged count from there.
    """
    sym = m["first"][np.frombuffer(b"".join(words), dtype=np.uint8)]
    word = np.repeat(np.arange(len(words)), [len(w) for w in words])
    rank = pair_ranks(m, sym, word, np.arange(len(sym)))
    reach, edge = m["reach"], np.full(m["reach"], NONE, dtype=np.int32)
    while True:
        least = window_least(np.concatenate([edge, rank, edge]), 2 * reach + 1)
        spots = np.flatnonzero((rank == least) & (rank < NONE))
        if not len(spots):
            return sym, np.bincount(word, minlength=len(words))
        new_run = np.r_[True, np.diff(spots) != 1]
        first = spots[new_run]
        whole = (first == 0) | (rank[first - 1] != rank[first])
        spots = alternate(spots[whole[np.cumsum(new_run) - 1]])
        sym[spots] = m["made"][rank[spots]]
        live = np.ones(len(sym), dtype=bool)
        live[spots + 1] = False
        sym, word, rank = sym[live], word[live], rank[live]
        moved = spots - np.arange(len(spots))  # each merge before takes one place away
        again = np.union1d(moved, np.maximum(moved - 1, 0))
        rank[again] = pair_ranks(m, sym, word, again)


class Chunks:
    """A cache from chunk to ids, bounded in bytes. `encode_new` gets a list of new chunks and returns (flat ids, ids per chunk)."""

    def __init__(self, encode_new, limit: int = CACHE):
        self.encode_new, self.limit = encode_new, limit
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.length, self.held = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64), 0

    def ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks, one after the other, and how many each has."""
        if not chunks:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        if self.held > self.limit:
            self.clear()
        index, base = self.index, len(self.length)
        new = [c for c in dict.fromkeys(chunks) if c not in index]
        flat, length, keep = self.flat, self.length, 0
        if new:
            new.sort(key=lambda c: len(c) > CACHED)  # those to keep come first
            keep = sum(len(c) <= CACHED for c in new)
            index.update(zip(new, range(base, base + len(new)), strict=True))
            more, count = self.encode_new(new)
            flat, length = np.concatenate([flat, more.astype(np.int32)]), np.concatenate([length, count])
            self.offset = np.cumsum(length) - length
        at = np.fromiter(map(index.__getitem__, chunks), dtype=np.int64, count=len(chunks))
        size = length[at]
        out = flat[gather(self.offset[at], size)].astype(np.int64)
        if new:
            for c in new[keep:]:
                del index[c]
            before = len(self.flat)
            self.length = length[: base + keep]
            self.flat = flat[: int(self.length.sum())].copy()
            self.held += 4 * (len(self.flat) - before) + ENTRY * keep + sum(map(len, new[:keep]))
        return out, size


class Encoder:
    def __init__(self, m: dict):
        self.m, self.find = m, regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in m["special"]) + ")") if m["special"] else None
        self.chunks = Chunks(self.encode_new)

    def pieces(self, chunk: str) -> list[str]:
        if self.cut is None:
            return self.find(chunk)
        out = []
        for part in self.cut.split(chunk):
            out += [part] if part in self.m["special"] else self.find(part)
        return out

    def encode_new(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        special = self.m["special"]
        words = list(map(self.pieces if any(s[:2] in c for s in special for c in chunks) else self.find, chunks))
        count = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        index: dict[str, int] = {}
        at = np.array([index.setdefault(w, len(index)) for ws in words for w in ws], dtype=np.int64)
        plain = [w for w in index if w not in special]
        flat, length = merge_words(self.m, [w.encode() for w in plain])
        if len(plain) < len(index):  # put the special tokens among the others
            sizes, ids, k, o = [], [], 0, np.r_[0, np.cumsum(length)]
            for w in index:
                ids.append(np.array([special[w]]) if w in special else flat[o[k] : o[k + 1]])
                sizes.append(len(ids[-1]))
                k += w not in special
            flat, length = np.concatenate(ids), np.array(sizes, dtype=np.int64)
        offset = np.cumsum(length) - length
        per_word = length[at] if len(at) else np.zeros(0, dtype=np.int64)
        owner = np.repeat(np.arange(len(words)), count)
        return flat[gather(offset[at], per_word)], np.bincount(owner, weights=per_word, minlength=len(words)).astype(np.int64)

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has."""
        chunks: list[str] = []
        count = []
        for t in texts:
            before = len(chunks)
            if t:
                if UNSAFE.search(t) or (self.cut is not None and self.cut.search(t)):
                    chunks.append(t)  # one chunk: white space or special tokens reach over single spaces
                else:
                    head, *tail = t.split(" ")
                    chunks += [head] if head else []
                    chunks += [" " + x for x in tail]
            count.append(len(chunks) - before)
        flat, length = self.chunks.ids(chunks)
        owner = np.repeat(np.arange(len(texts)), count)
        return flat, np.bincount(owner, weights=length, minlength=len(texts)).astype(np.int64)


def groups(sizes: list[int], most: int = GROUP_CHARS) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts of these sizes, at most `most` together, one text at least."""
    start, size = 0, 0
    for i, n in enumerate(sizes):
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(sizes):
        yield start, len(sizes)


def decode(m: dict, ids: np.ndarray) -> bytes:
    """Bytes of the ids' tokens."""
    if "byte_at" not in m:
        m["byte_at"] = np.cumsum(m["byte_len"]) - m["byte_len"]
    return m["bytes"][gather(m["byte_at"][ids], m["byte_len"][ids])].tobytes()


def encode_docs(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids binary of little-endian 32-bit ids]) for every row of `docs`."""
    shared = docs.sparkSession.sparkContext.broadcast(model(path))  # bounded by the vocabulary

    def run(batches):
        m = dict(shared.value)
        enc = Encoder(m)
        names = [doc_id, "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 4 + with_ids]
        types = [pa.int64(), pa.string(), pa.string(), pa.binary()]
        for batch in batches:
            column, ids_of = batch.column(1), batch.column(0).cast(pa.int64())
            for a, b in groups(pc.binary_length(column).fill_null(0).to_pylist()):  # a batch is read and goes out in groups: its texts and ids are never held together
                flat, length = enc.texts([t or "" for t in column.slice(a, b - a).to_pylist()])
                ends, rows = np.cumsum(length), []
                for e, n in zip(ends.tolist(), length.tolist(), strict=True):
                    ids = flat[e - n : e]
                    raw = ids.astype("<u4").tobytes()
                    plain = decode(m, ids).decode("utf-8", "replace").encode()
                    rows.append((n, hashlib.sha256(raw).hexdigest(), hashlib.sha256(plain).hexdigest(), *([raw] if with_ids else [])))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([ids_of.slice(a, b - a), *[pa.array(c, t) for c, t in zip(cols, types)]], names)  # noqa: B905

    schema = f"`{doc_id}` long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary" if with_ids else "")
    return docs.selectExpr(f"cast(`{doc_id}` as long) as `{doc_id}`", f"cast(`{text}` as string) as `{text}`").mapInArrow(run, schema)
