"""Vectorised words of Arrow text batches: bounds, hashes, windows and minimisers.

Everything works on whole texts. A batch is read in chunks of about ``CHUNK``
bytes (a longer document is a chunk of its own), so memory follows the longest
document, not the table. Null texts are empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

CHUNK = 4 << 20
LONG_WORD = 256

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_LANE = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], np.uint64)

#: Bytes that stand in words: all but the blanks \x20 and \x09-\x0D.
NONBLANK = np.ones(256, bool)
NONBLANK[[0x20, *range(0x09, 0x0E)]] = False
#: Letters, digits and bytes of non-ASCII characters.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * _M2
    h ^= h >> np.uint64(27)
    h *= _M3
    h ^= h >> np.uint64(31)
    return h


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the sequence a then b, from the hashes of its halves."""
    return mix(a * _M1 + (b ^ (b >> np.uint64(29))) + _M2)


class Texts:
    """A chunk of documents as one byte buffer."""

    def __init__(self, column: pa.Array):
        column = pc.fill_null(column, "").cast(pa.large_string())
        n = len(column)
        _, offsets, data = column.buffers()
        offsets = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
        lo, hi = int(offsets[0]), int(offsets[-1])
        self.offsets = offsets - lo
        self.size = hi - lo
        self.raw = np.zeros(self.size + 16, np.uint8)
        if self.size:
            self.raw[: self.size] = np.frombuffer(data, np.uint8, self.size, lo)
        self.n = n

    def doc(self, i: int) -> bytes:
        return self.raw[self.offsets[i] : self.offsets[i + 1]].tobytes()


class Words(Texts):
    """The words of a chunk: runs of bytes that ``inside`` marks, within a document.

    starts, ends: byte bounds of each word. first: number of the first word of each
    document, and the number of all words.
    """

    def __init__(self, column: pa.Array, inside: np.ndarray = NONBLANK, lower: bool = False):
        super().__init__(column)
        if lower:
            self.raw = LOWER[self.raw]
        m = np.zeros(self.size + 1, bool)
        m[: self.size] = inside[self.raw[: self.size]]
        before = np.zeros(self.size + 1, bool)
        before[1:] = m[:-1]
        edges = self.offsets[(self.offsets < self.size)]
        start = m & ~before
        start[edges] = m[edges]
        end = before & ~m
        inner = self.offsets[(self.offsets > 0) & (self.offsets <= self.size)]
        end[inner] = before[inner]
        self.starts, self.ends = np.flatnonzero(start), np.flatnonzero(end)
        self.first = np.searchsorted(self.starts, self.offsets)
        self.count = np.diff(self.first)

    def word(self, i: int) -> bytes:
        return self.raw[self.starts[i] : self.ends[i]].tobytes()

    def owner(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(self.n), self.count)

    def hashes(self) -> np.ndarray:
        """64 bits for each word, a function of its bytes alone."""
        length = self.ends - self.starts
        h = mix(length.astype(np.uint64) * _M1 + _M3)
        at = np.ndarray((max(0, len(self.raw) - 7),), "<u8", self.raw.data, strides=(1,))
        live = np.flatnonzero(length <= LONG_WORD)
        j = 0
        while len(live):
            left = length[live] - j
            lane = at[self.starts[live] + j] & _LANE[np.minimum(left, 8)]
            h[live] = mix((h[live] ^ lane) * _M1)
            j += 8
            live = live[left > 8]
        for i in np.flatnonzero(length > LONG_WORD):
            h[i] = xxhash.xxh64_intdigest(self.word(i), 7)
        return h


def spans(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n consecutive items that start at each place (len(h) - n + 1 of them)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    power, step, out, done = h, 1, None, 0
    while True:
        if n & step:
            out = power if out is None else join(out[: len(h) - done - step + 1], power[done : len(h) - step + 1])
            done += step
        step *= 2
        if step > n:
            return out[: len(h) - n + 1]
        power = join(power[: len(power) - step // 2], power[step // 2 :])


def minimisers(grams: np.ndarray, w: int) -> np.ndarray:
    """For each run of w consecutive grams, the place of the smallest hash; the last of equals.

    Only the upper 32 bits are compared, so the choice depends on the run's content alone.
    """
    if len(grams) < w:
        return np.zeros(0, np.int64)
    low = np.uint64(0xFFFFFFFF)
    v = (grams & ~low) | (low - np.arange(len(grams), dtype=np.uint64))
    step = 1
    while step * 2 <= w:
        v = np.minimum(v[:-step], v[step:])
        step *= 2
    if w > step:
        v = np.minimum(v[: len(v) - (w - step)], v[w - step :])
    return (low - (v & low)).astype(np.int64)


def chunks(batch: pa.RecordBatch | pa.Table, column: str = "text", size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``size`` bytes of text each, at least one row."""
    if isinstance(batch, pa.Table):
        for b in batch.to_batches():
            yield from chunks(b, column, size)
        return
    n = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(n)
    i = 0
    while i < len(n):
        j = int(np.searchsorted(total, (total[i - 1] if i else 0) + size, "right"))
        j = max(j, i + 1)
        yield batch.slice(i, j - i)
        i = j


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values in the order they are first seen, place of the first of each, number of each item's value)."""
    code, values = pd.factorize(h)
    first = np.empty(len(values), np.int64)
    first[code[::-1]] = np.arange(len(h) - 1, -1, -1)
    return values, first, code


def signed(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h).view(np.int64)


def unsigned(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h).view(np.uint64)
