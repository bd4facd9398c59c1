"""Word sequences that start more than once in a corpus, found without pairs.

Shared by the two span deduplicators. Seeds are content-selected k-word grams
(minimisers), so that every window of L words holds its own seed, and equal
windows hold equal seeds. Only seeds that occur twice or more matter further.

Keys (of seeds or windows) are grouped in two steps. Each task first groups its
own keys: all but one of a local group (of windows, all but the smallest
(doc_id, start)) are repeats for certain and travel by document, the seeds of a
document as one list, windows as runs. One member for each key and task goes to
the key's partition, so a passage in a third of all documents sends it as many
rows as there are tasks. There the rows are sorted by Spark and read group by
group, never a whole partition at once.

Documents with a null doc_id are left out. Rows that repeat a doc_id are
documents of their own; what is found in one of them holds for all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import Words, chunks, join, minimisers, mix, signed, spans, unsigned

BATCH = 1 << 16
DEALT = "route long, k2 long, doc_id long, start long, n long, known boolean"
_DEALT = pa.schema([("route", pa.int64()), ("k2", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("known", pa.bool_())])
RUNS = "doc_id long, start long, n long, first boolean"
_RUNS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("first", pa.bool_())])
_SEEDS = "route long, doc_id long, n long, seeds array<long>"
_SALT = np.uint64(0xD6E8FEB86659FD93)


def grouped(batches: Iterator[pa.RecordBatch], *keys: str, most: int = BATCH) -> Iterator[pa.Table]:
    """Sorted rows, so many at once that groups of equal keys stay whole."""
    held, size, due = [], 0, most
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.num_rows
        if size < due:
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        same = np.ones(size, bool)
        for k in keys:
            x = rows.column(k).to_numpy()
            same &= x == x[-1]
        cut = size - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield rows.slice(0, cut).combine_chunks()
            held, size, due = rows.slice(cut).to_batches(), size - cut, most
        else:
            held, due = rows.to_batches(), 2 * size
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def documents(docs: DataFrame) -> DataFrame:
    """Key and text of the documents, whatever else the table holds."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("doc_id is not null")


def emit(schema: pa.Schema, *columns) -> Iterator[pa.RecordBatch]:
    n = len(columns[0])
    for i in range(0, n, BATCH):
        yield pa.RecordBatch.from_arrays([pa.array(c[i : i + BATCH], t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


class Grams:
    """Words, seeds and windows of a chunk of documents."""

    def __init__(self, text: pa.Array, length: int, k: int):
        self.words = w = Words(text)
        self.length, self.k = length, k
        self.h = w.hashes()
        self.owner = w.owner()
        self.grams = spans(self.h, k)
        at = minimisers(self.grams, length - k + 1)
        starts = np.arange(len(at))
        #: starts of windows that lie in one document, and the seed of each
        self.starts = starts[starts + length <= w.first[1:][self.owner[: len(at)]]] if len(at) else starts
        self.seed_of = at[self.starts]

    def seeds(self) -> np.ndarray:
        """Places of the seeds, ascending."""
        s = self.seed_of
        return s[np.r_[True, s[1:] != s[:-1]]] if len(s) else s

    def keys(self, at: np.ndarray) -> np.ndarray:
        """One key for a seed and its document."""
        return mix(self.grams[at] + self.owner[at].astype(np.uint64) * _SALT)

    def windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """96 bits for each window that starts at ``at``, in two numbers."""
        return spans(self.h, self.length)[at], spans(mix(self.h ^ _SALT), self.length)[at] >> np.uint64(32)

    def place(self, at: np.ndarray) -> np.ndarray:
        """Number of the word in its document."""
        return at - self.words.first[self.owner[at]]


def _groups(order_key: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(order_key, kind="stable")
    a, b = order_key[order], second[order]
    return order, np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, np.int64)


def _least(doc: np.ndarray, start: np.ndarray, heads: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Marks the smallest (doc, start) of each group."""
    low = np.repeat(np.minimum.reduceat(doc, heads), sizes)
    at = np.where(doc == low, start, np.iinfo(np.int64).max)
    return (doc == low) & (at == np.repeat(np.minimum.reduceat(at, heads), sizes))


def _one(mark: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """The first marked row of each group (rows may repeat a document)."""
    rows = np.flatnonzero(mark)
    group = np.searchsorted(heads, rows, "right")
    return rows[np.r_[True, group[1:] != group[:-1]]]


def deal(k1: np.ndarray, k2: np.ndarray, doc: np.ndarray, start: np.ndarray, copies: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows that a task sends: one member for each window's key, with the copies it stands for, and runs of what is known to repeat (k2: 1 for first occurrences)."""
    if not len(k1):
        return
    order, heads = _groups(k1, k2)
    k1, k2, doc, start = k1[order], k2[order], doc[order], start[order]
    sizes = np.diff(np.r_[heads, len(k1)])
    head = _one(_least(doc, start, heads, sizes), heads)
    yield from emit(_DEALT, k1[head], k2[head], doc[head], start[head], np.add.reduceat(copies[order], heads), np.zeros(len(head), bool))
    rest = np.ones(len(k1), bool)
    rest[head] = False
    doc, start = doc[rest], start[rest]
    order = np.lexsort((start, doc))
    yield from known_runs(doc[order], start[order])


def by_doc(doc: np.ndarray) -> np.ndarray:
    """Where rows that need no more comparison are dealt."""
    return signed(mix(unsigned(doc) + _SALT))


def known_runs(doc: np.ndarray, start: np.ndarray, first: bool = False) -> Iterator[pa.RecordBatch]:
    """Window starts that repeat for certain, as runs of neighbours; those of a document stand together, ascending.

    first: they are the first of their kind in the corpus.
    """
    if not len(doc):
        return
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)])
    last = np.r_[new[1:], len(doc)] - 1
    route = by_doc(doc[new])
    yield from emit(_DEALT, route, np.full(len(new), first, np.int64), doc[new], start[new], start[last] - start[new] + 1, np.ones(len(new), bool))


def find_repeats(dealt: DataFrame) -> DataFrame:
    """Runs of window starts whose windows repeat. first: the runs hold the smallest (doc_id, start) of their windows."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, "route", "k2"):
            known = t.column("known").to_numpy()
            route, k2, doc, start, n = (t.column(c).to_numpy() for c in ("route", "k2", "doc_id", "start", "n"))
            if known.any():
                yield from emit(_RUNS, doc[known], start[known], n[known], k2[known] == 1)
                route, k2, doc, start, n = (x[~known] for x in (route, k2, doc, start, n))
            if not len(route):
                continue
            heads = np.flatnonzero(np.r_[True, (route[1:] != route[:-1]) | (k2[1:] != k2[:-1])])
            sizes = np.diff(np.r_[heads, len(route)])
            again = np.repeat(np.add.reduceat(n, heads), sizes) > 1
            first = _least(doc, start, heads, sizes)
            yield from emit(_RUNS, doc[again], start[again], np.ones(int(again.sum()), np.int64), first[again])

    return dealt.repartition("route").sortWithinPartitions("route", "k2").mapInArrow(task, RUNS)


def _lists(route: np.ndarray, doc: np.ndarray, n: np.ndarray, seeds: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(route), BATCH):
        e = ends[i : i + BATCH]
        lo = int(ends[i - 1]) if i else 0
        lists = pa.ListArray.from_arrays(pa.array(np.r_[lo, e] - lo, pa.int32()), pa.array(seeds[lo : int(e[-1])]))
        yield pa.RecordBatch.from_arrays([pa.array(route[i : i + BATCH]), pa.array(doc[i : i + BATCH]), pa.array(n[i : i + BATCH]), lists], ["route", "doc_id", "n", "seeds"])


def _by_document(doc: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, all their seeds in a row, and the end of each one's."""
    order = np.argsort(doc, kind="stable")
    doc, seed = doc[order], seed[order]
    head = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
    return doc[head], seed, np.r_[head[1:], len(doc)][: len(head)]


def shared_seeds(docs: DataFrame, length: int, k: int) -> DataFrame:
    """(doc_id, seeds): the seeds of each document that occur twice or more in the corpus."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seed, doc = [], []
        for batch in batches:
            for c in chunks(batch):
                g = Grams(c.column("text"), length, k)
                at = g.seeds()
                seed.append(g.grams[at])
                doc.append(c.column("doc_id").to_numpy()[g.owner[at]])
        if not seed:
            return
        seed, doc = signed(np.concatenate(seed)), np.concatenate(doc)
        order = np.argsort(seed, kind="stable")
        seed, doc = seed[order], doc[order]
        head = np.r_[True, seed[1:] != seed[:-1]] if len(seed) else np.zeros(0, bool)
        at = np.flatnonzero(head)
        yield from _lists(seed[at], doc[at], np.diff(np.r_[at, len(seed)]), seed[:0], np.zeros(len(at), np.int64))
        own, flat, ends = _by_document(doc[~head], seed[~head])
        yield from _lists(by_doc(own), own, np.zeros(len(own), np.int64), flat, ends)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, "route"):
            route, doc, n = (t.column(c).to_numpy() for c in ("route", "doc_id", "n"))
            known = n == 0
            if known.any():
                yield t.filter(pa.array(known)).select(["doc_id", "seeds"]).combine_chunks().to_batches()[0]
                route, doc, n = route[~known], doc[~known], n[~known]
            if not len(route):
                continue
            heads = np.flatnonzero(np.r_[True, route[1:] != route[:-1]])
            again = np.repeat(np.add.reduceat(n, heads), np.diff(np.r_[heads, len(route)])) > 1
            own, flat, ends = _by_document(doc[again], route[again])
            for b in _lists(own, own, own, flat, ends):
                yield b.select(["doc_id", "seeds"])

    found = docs.mapInArrow(send, _SEEDS).repartition("route").sortWithinPartitions("route").mapInArrow(judge, "doc_id long, seeds array<long>")
    return found.groupBy("doc_id").agg(F.flatten(F.collect_list("seeds")).alias("seeds"))


def shared_places(g: Grams, seeds: pa.Array) -> np.ndarray:
    """Places of those of the chunk's seeds that are shared."""
    at = g.seeds()
    owner = np.repeat(np.arange(len(seeds)), seeds.value_lengths().fill_null(0).to_numpy())
    key = np.sort(mix(unsigned(seeds.flatten().to_numpy()) + owner.astype(np.uint64) * _SALT))
    if not len(at) or not len(key):
        return at[:0]
    own = g.keys(at)
    return at[key[np.minimum(np.searchsorted(key, own), len(key) - 1)] == own]


def by_document(runs: DataFrame) -> DataFrame:
    return runs.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n", "first")).alias("runs"))


def covered(n_words: int, starts: np.ndarray, n: np.ndarray, length: int) -> np.ndarray:
    """Marks the words that windows of these runs cover."""
    d = np.zeros(n_words + 1, np.int64)
    # Runs from rows that repeat a doc_id may go beyond a shorter text.
    np.add.at(d, np.minimum(starts, n_words), 1)
    np.add.at(d, np.minimum(starts + n - 1 + length, n_words), -1)
    return np.cumsum(d[:-1]) > 0


__all__ = ["DEALT", "Grams", "by_doc", "by_document", "covered", "deal", "documents", "emit", "find_repeats", "grouped", "join", "known_runs", "shared_places", "shared_seeds"]
