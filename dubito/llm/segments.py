"""Segments of documents around shared seeds, sorted over the cluster into blocks.

A segment is what a document has around a seed (a k-word gram chosen by content, which occurs
twice or more in the corpus): the words of all windows that hold the seed as theirs. Segments
are ordered by seed, then by the words from the seed on, then by those before it, backwards;
range partitioning cuts this order into blocks of about equal size, whatever the seeds'
frequencies. Two equal windows hold the same seed at the same place, so the segments that hold
a window's occurrences stand together as far as they agree to the right.

The operators decide in each block which windows start more than once. Where a block ends
within a seed's list, the windows that may go on in the next block are compared by hash (96
bits) over the cluster. Words are compared by 40 bits each: a chance error needs two windows
that differ in a single word, and then is one in 10^12. Equal segments of a chunk of documents
travel once, with their number; the others are known to repeat and travel as runs of windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .repeats import BATCH, DEALT, Grams, by_doc, deal, documents, find_repeats, known_runs, shared_places, shared_seeds
from .text import chunks, join, mix, signed, unsigned

#: Segments of a block that are looked at together; a single seed may bring four times as many.
ROWS = 1 << 15
_WIDTH = 5
_SEGMENTS = "seed long, right binary, left binary, doc_id long, start long, n long, copies long"
_SALT = np.uint64(0x9AE16A3B2F90404F)


def _binary(words: np.ndarray, begin: np.ndarray, size: np.ndarray, step: int) -> pa.Array:
    """size words from begin on, one after the other (step 1) or backwards (-1)."""
    within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    flat = words[np.repeat(begin, size) + step * within]
    ends = np.r_[0, np.cumsum(size * _WIDTH)].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(flat))])


def _joined(doc: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs that follow each other in a document as one."""
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] != (start + n)[:-1])]) if len(doc) else np.zeros(0, np.int64)
    return doc[new], start[new], np.add.reduceat(n, new) if len(new) else n


def segments(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """A row for each shared seed of each document: the words from the seed on, those before it backwards.

    start, n: the windows that hold this seed as theirs. copies: equal segments of the chunk, for which
    the least by (doc_id, place) stands; 0 for runs of the others' windows, which have no words.
    """
    names = [c.split()[0] for c in _SEGMENTS.split(", ")]

    def batch(seed, right, left, *numbers) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(seed), right, left, *map(pa.array, numbers)], names)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b):
                g = Grams(c.column("text"), window, seed)
                at = shared_places(g, c.column("seeds"))
                if not len(at):
                    continue
                first = np.searchsorted(g.seed_of, at, "left")
                n = np.searchsorted(g.seed_of, at, "right") - first
                lo = g.starts[first]
                a, z = g.windows(lo), g.windows(lo + n - 1)
                key = mix(join(a[0], z[0]) ^ join(a[1], z[1]) + n.astype(np.uint64))
                doc, start = c.column("doc_id").to_numpy()[g.owner[at]], g.place(lo)
                order = np.lexsort((start, doc, key))
                head = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
                copies = np.zeros(len(at), np.int64)
                copies[order[head]] = np.diff(np.r_[head, len(at)])
                words = (g.h >> np.uint64(24)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - _WIDTH :]
                some = np.flatnonzero(copies)
                for i in range(0, len(some), BATCH >> 1):
                    r = some[i : i + (BATCH >> 1)]
                    yield batch(
                        signed(g.grams[at[r]]), _binary(words, at[r], lo[r] + n[r] - 1 + window - at[r], 1), _binary(words, at[r] - 1, at[r] - lo[r], -1), doc[r], start[r], n[r], copies[r],
                    )
                r = np.flatnonzero(copies == 0)
                r = r[np.lexsort((start[r], doc[r]))]
                doc, start, n = _joined(doc[r], start[r], n[r])
                for i in range(0, len(doc), BATCH):
                    d = doc[i : i + BATCH]
                    none = np.zeros(len(d), np.int64)
                    yield batch(by_doc(d), _binary(words, none, none, 1), _binary(words, none, none, 1), d, start[i : i + BATCH], n[i : i + BATCH], none)

    return docs.join(shared_seeds(docs, window, seed), "doc_id").mapInArrow(task, _SEGMENTS)


class Side:
    """The words of a block's segments on one side of the seed."""

    def __init__(self, column: pa.Array):
        ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
        lo, hi = int(ends[0]), int(ends[-1])
        wide = np.zeros(((hi - lo) // _WIDTH + 1, 8), np.uint8)
        if hi > lo:
            wide[:-1, 8 - _WIDTH :] = np.frombuffer(column.buffers()[2], np.uint8, hi - lo, lo).reshape(-1, _WIDTH)
        self.words = wide.view(">u8").ravel().astype(np.uint64)
        self.begin, self.size = (ends[:-1] - lo) // _WIDTH, np.diff(ends) // _WIDTH

    def word(self, rows: np.ndarray, j: int) -> np.ndarray:
        return self.words[self.begin[rows] + j]

    def agreed(self, rows: np.ndarray) -> np.ndarray:
        """How many words each of these rows shares with the next row of the block."""
        out, j = np.zeros(len(rows), np.int64), 0
        size = np.minimum(self.size[rows], self.size[rows + 1])
        live = np.flatnonzero(size > 0)
        while len(live):
            live = live[self.word(rows[live], j) == self.word(rows[live] + 1, j)]
            j += 1
            out[live] = j
            live = live[size[live] > j]
        return out


def prefixes(seed: np.ndarray, left: Side) -> Iterator[tuple[int, np.ndarray]]:
    """For each number of words before the seed: a hash of the seed and of as many words before it."""
    h = mix(unsigned(seed) + _SALT)
    for j in range(int(left.size.max(initial=0)) + 1):
        if j:
            some = np.flatnonzero(left.size >= j)
            h[some] = join(h[some], left.word(some, j - 1))
        yield j, h


def _hashes(rows: np.ndarray, o: np.ndarray, right: Side, left: Side, window: int) -> tuple[np.ndarray, np.ndarray]:
    """96 bits for the window that starts o words before the seed, in two numbers."""
    a, b = np.zeros(len(rows), np.uint64), np.full(len(rows), _SALT)
    for j in range(window):
        inner = j < o
        at = np.where(inner, left.begin[rows] + o - 1 - j, 0)
        w = np.where(inner, left.words[at], right.words[np.where(inner, 0, right.begin[rows] + j - o)])
        a, b = join(a, w), join(b, w)
    return a, b >> np.uint64(32)


def blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Table, tuple[bool, bool]]]:
    """Rows of whole seeds, and whether the first and the last seed may have more rows elsewhere."""
    held, size, opened = [], 0, True
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.num_rows
        if size < most:
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        seed = rows.column("seed").to_numpy()
        cut = int(np.searchsorted(seed, seed[-1], "left"))
        if cut:
            yield rows.slice(0, cut).combine_chunks(), (opened, False)
            held, size, opened = rows.slice(cut).to_batches(), size - cut, False
        elif size >= 4 * most:
            yield rows, (opened, True)
            held, size, opened = [], 0, True
    if held:
        yield pa.Table.from_batches(held).combine_chunks(), (opened, True)


def repeated_runs(docs: DataFrame, window: int, seed: int, decide: Callable, rows: int | None = None) -> DataFrame:
    """(doc_id, start, n, first): runs of n window starts whose windows start elsewhere too.

    decide(seed, right, left, doc_id, place of the seed, copies, open ends) returns three marks for each
    segment of a block and number o of words before the seed, of the window that starts there: it repeats;
    it is known to be the first of its kind; it must be compared over the cluster.
    """
    most = rows or ROWS

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sure: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def told() -> Iterator[pa.RecordBatch]:
            for b in batches:
                known = pc.equal(b.column("copies"), 0)
                yield b.filter(pc.invert(known))
                b = b.filter(known)
                sure.append(tuple(b.column(c).to_numpy() for c in ("doc_id", "start", "n")))

        for block, open_at in blocks(told(), most):
            column = lambda c: block.column(c).chunk(0)  # noqa: B023, E731
            seeds, right, left = column("seed").to_numpy(), Side(column("right")), Side(column("left"))
            doc, copies = column("doc_id").to_numpy(), column("copies").to_numpy()
            place = column("start").to_numpy() + left.size
            found, first, undecided = decide(seeds, right, left, doc, place, copies, open_at)
            for marks, is_first in ((found & ~first, False), (first, True)):
                r, o = np.nonzero(marks[:, ::-1])  # from the left: the first window has most words before the seed
                yield from known_runs(doc[r], place[r] - (marks.shape[1] - 1 - o), is_first)
            r, o = np.nonzero(undecided)
            if len(r):
                yield from deal(*map(signed, _hashes(r, o, right, left, window)), doc[r], place[r] - o, copies[r])
        if sure:
            doc, start, n = (np.concatenate(x) for x in zip(*sure, strict=True))
            yield from known_runs(np.repeat(doc, n), np.repeat(start - np.cumsum(n) + n, n) + np.arange(int(n.sum())))

    order = ("seed", "right", "left", "doc_id", "start")
    index = segments(documents(docs), window, seed).repartitionByRange(*order).sortWithinPartitions(*order)
    return find_repeats(index.mapInArrow(task, DEALT))
