"""Word and window hashes of many texts at once, in numpy over the bytes of an Arrow string column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text taken at a time; one text more at least.
GROUP_BYTES = 2_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finalizer of a public 64-bit generator)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD1342543DE82EF95)  # 5 modulo 8: its powers repeat as late as they can
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
_BYTE[_SPACE] = 0
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of the words of the texts data[offsets[i]:offsets[i+1]], bytes between ASCII white space. `fold` lower-cases A-Z."""
    space = _SPACE[data]
    first = ~space
    first[1:] &= space[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    first[edges] = ~space[edges]
    start = np.flatnonzero(first)
    if not len(start):
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none
    last = ~space
    last[:-1] &= space[1:]
    last[edges[edges > 0] - 1] = ~space[edges[edges > 0] - 1]
    end = np.flatnonzero(last) + 1
    span = np.diff(np.append(start, len(data)))
    place = np.arange(start[0], len(data)) - np.repeat(start, span)
    weight = powers(_BASE, int((end - start).max()) + 1)
    part = (_FOLDED if fold else _BYTE)[data[start[0] :]] * weight[np.minimum(place, len(weight) - 1)]
    total = np.add.reduceat(part, start - start[0])
    return mix(total + (end - start).astype(np.uint64) * _STEP), start, end


def window_sums(words: np.ndarray, size: int, base: np.uint64 = _BASE) -> np.ndarray:
    """Sum of words[i + k] * base^k over k < size, from each start i: widths double and the powers of two in `size` are joined."""
    n = len(words) - size + 1
    power, width, done, done_width = words, 1, None, 0
    scale, done_scale = np.uint64(base), np.uint64(1)
    with np.errstate(over="ignore"):
        while True:
            if size & width:
                done = power if done is None else done[: len(power) - done_width] + power[done_width:] * done_scale
                done_width, done_scale = done_width + width, done_scale * scale
            if width * 2 > size:
                return done[:n]
            power = power[: len(power) - width] + power[width:] * scale
            width, scale = width * 2, scale * scale


def window_hashes(words: np.ndarray, size: int, base: np.uint64 = _BASE) -> np.ndarray:
    """Hash of `size` consecutive words from each start; the caller drops windows that leave their text."""
    if len(words) < size:
        return np.zeros(0, dtype=np.uint64)
    return mix(window_sums(words, size, base) + np.array([size], dtype=np.uint64) * _STEP)


def window_least(values: np.ndarray, size: int) -> np.ndarray:
    """Least of `size` consecutive values from each start."""
    least, width = values, 1
    while width * 2 <= size:
        least, width = np.minimum(least[: len(least) - width], least[width:]), width * 2
    return least if width == size else np.minimum(least[: len(values) - size + 1], least[size - width :])


def fingerprint(values: np.ndarray) -> int:
    """A 64-bit hash of a set of hashes."""
    total = mix(values + np.uint64(len(values))).sum(dtype=np.uint64) if len(values) else np.uint64(0)
    return int(mix(np.array([total], dtype=np.uint64)).view(np.int64)[0])


def second_fingerprint(values: np.ndarray) -> int:
    """Another 64-bit hash of a set of hashes, independent of `fingerprint`."""
    total = mix(mix(values ^ _STEP) * _BASE).sum(dtype=np.uint64) if len(values) else np.uint64(0)
    return int(mix(np.array([total ^ _BASE], dtype=np.uint64)).view(np.int64)[0])


def groups(column: pa.Array, most: int = GROUP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows of a string column; nulls are empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer is not None and data_buffer.size else np.zeros(0, dtype=np.uint8)
    start = 0
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1)
        lo, hi = offsets[start], offsets[end]
        yield start, end, data[lo:hi], offsets[start : end + 1] - lo
        start = end


def docs_words(column: pa.Array, fold: bool, most: int = GROUP_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, bytes, word hash, word start, word end, word ranges) of groups of rows; row i's words are ranges[i]:ranges[i+1]."""
    for first, _, data, offsets in groups(column, most):
        h, start, end = word_hashes(data, offsets, fold)
        yield first, data, h, start, end, np.searchsorted(start, offsets)
