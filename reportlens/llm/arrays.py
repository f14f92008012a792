"""Whole Arrow batches of texts as NumPy arrays: word borders, word hashes and shingle hashes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
BASE = 0x9E3779B97F4A7C15                       # odd, so it has an inverse modulo 2^64
INVERSE = pow(BASE, -1, 1 << 64)
WINDOW = 1 << 18                                # bytes hashed at once
SLICE = 512 << 10                               # bytes of text that are worked on at once


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _byte_codes(lower: bool) -> np.ndarray:
    codes = mix(np.arange(1, 257, dtype=U64) * U64(BASE))
    if lower:
        codes[65:91] = codes[97:123]
    return codes


CODES = {False: _byte_codes(False), True: _byte_codes(True)}
_powers: list[np.ndarray] = []


def _tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, kept for the worker."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, WINDOW)
        ones = []
        for b in (BASE, INVERSE):
            p = np.full(size, b, U64)
            p[0] = 1
            ones.append(np.cumprod(p))
        _powers[:] = ones
    return _powers


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the n + 1 borders of its rows; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    borders = np.frombuffer(offsets, np.int64)[column.offset:column.offset + n + 1]
    return np.frombuffer(data, np.uint8)[borders[0]:borders[-1]], borders - borders[0]


def text_slices(column, size: int = SLICE) -> list[tuple[int, int]]:
    """Ranges of rows with at most size bytes of text each, or one longer text."""
    _, borders = text_buffer(column)
    out, at = [], 0
    while at < len(borders) - 1:
        to = max(at + 1, int(np.searchsorted(borders, borders[at] + size, "right")) - 1)
        out.append((at, to))
        at = to
    return out


@dataclass
class Words:
    """Words of a batch: byte borders, 64-bit hashes, and per text the range ptr[i]:ptr[i + 1]."""
    starts: np.ndarray
    ends: np.ndarray
    ptr: np.ndarray
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.ptr)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), self.counts)

    @staticmethod
    def joined(parts: list[Words]) -> Words:
        """One batch of several, without byte borders."""
        none, ends = np.zeros(0, np.int64), np.cumsum([0, *(len(p.hashes) for p in parts)])
        ptr = np.concatenate([[0], *(p.ptr[1:] + e for p, e in zip(parts, ends))]).astype(np.int64)
        return Words(none, none, ptr, np.concatenate([np.zeros(0, U64), *(p.hashes for p in parts)]))

    def part(self, keep: np.ndarray) -> tuple[Words, np.ndarray]:
        """Words of the kept texts, and the numbers of these texts."""
        texts = np.flatnonzero(keep)
        ptr = np.concatenate([[0], np.cumsum(self.counts[texts])])
        at = np.arange(ptr[-1]) + np.repeat(self.ptr[:-1][texts] - ptr[:-1], self.counts[texts])
        return Words(self.starts[at], self.ends[at], ptr, self.hashes[at]), texts


def word_borders(data: np.ndarray, borders: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end byte and text range of the runs of bytes that are no gap."""
    word = ~gap[data]
    first, last = word.copy(), word.copy()
    if len(data):
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        edge = borders[:-1][np.diff(borders) > 0]
        first[edge] = word[edge]
        edge = borders[1:][np.diff(borders) > 0] - 1
        last[edge] = word[edge]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, borders)


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """Polynomial hashes of byte runs, from prefix sums over windows of the buffer."""
    out, at, codes = np.empty(len(starts), U64), 0, CODES[lower]
    while at < len(starts):
        begin = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, begin + WINDOW, "right")))
        part = data[begin:ends[to - 1]]
        power, inverse = _tables(len(part))
        sums = np.zeros(len(part) + 1, U64)
        np.cumsum(codes[part] * power[:len(part)], out=sums[1:])
        s, e = starts[at:to] - begin, ends[at:to] - begin
        out[at:to] = mix((sums[e] - sums[s]) * inverse[s])
        at = to
    return out


def words_of(column, gap: np.ndarray = SPACE, lower: bool = False) -> Words:
    data, borders = text_buffer(column)
    starts, ends, ptr = word_borders(data, borders, gap)
    return Words(starts, ends, ptr, hash_runs(data, starts, ends, lower))


def chain(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n neighbouring values, also those that cross a border."""
    size = max(0, len(hashes) - n + 1)
    acc = hashes[:size] + U64(n)
    for k in range(1, n):
        acc = mix(acc) + hashes[k:k + size]
    return mix(acc)


def inside(words: Words, n: int) -> np.ndarray:
    """Which of these runs lie in one text."""
    size = max(0, len(words.hashes) - n + 1)
    keep = np.ones(size, bool)
    for back in range(1, n):
        edge = words.ptr[1:-1] - back
        edge = edge[(edge >= 0) & (edge < size)]
        keep[edge] = False
    return keep


def shingle_sets(words: Words, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, one after the other, and their n + 1 borders.

    A text with fewer words has one shingle, its whole sequence; one without words has none.
    """
    grams = chain(words.hashes, n)
    sets, sizes = [], np.zeros(len(words.ptr) - 1, np.int64)
    for i, (a, b) in enumerate(zip(words.ptr[:-1].tolist(), words.ptr[1:].tolist())):
        if b - a >= n:
            g = np.sort(grams[a:b - n + 1])
            keep = np.empty(len(g), bool)
            keep[0] = True
            np.not_equal(g[1:], g[:-1], out=keep[1:])
            g = g[keep]
        elif b > a:
            g = chain(words.hashes[a:b], b - a)
        else:
            continue
        sets.append(g)
        sizes[i] = len(g)
    flat = np.concatenate(sets) if sets else np.zeros(0, U64)
    return flat, np.concatenate([[0], np.cumsum(sizes)])
