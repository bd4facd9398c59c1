"""Suffix-array deduplication on sparse suffixes.

Suffixes are retained at content-selected minimisers only (``SEED``-word grams; every
window of ``WINDOW`` words holds its own). Those whose minimiser occurs once are dropped;
the rest, as far as a window reaches, are sorted over the whole cluster by range
(``segments``), and neighbours are compared word by word. Suffixes that agree to a window's
end stand side by side; from the minimiser on they are extended to the left, word by word,
and part where they differ. What stays together are the occurrences of one window, so the
result is exact: the windows that start twice or more anywhere, and with them every match of
``WINDOW`` words or more, at full length. Without agreeing neighbours nothing is found.

Defined results: null texts have no words; texts shorter than a window repeat nothing;
windows that repeat within one document count; documents without a repeat have no row;
rows with a null doc_id are left out (cut_repeats keeps them as they are); rows that
repeat a doc_id are read as copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import segments
from .repeats import by_document, covered
from .segments import Side, prefixes
from .shared import unused
from .text import Words, chunks, join

WINDOW = 50
SEED = 10


def agreements(seed: np.ndarray, right: Side) -> np.ndarray:
    """Words from the minimiser on that each sorted suffix but the last shares with the next one."""
    agreed = np.zeros(max(0, len(seed) - 1), np.int64)
    same = np.flatnonzero(seed[1:] == seed[:-1])
    agreed[same] = right.agreed(same)
    return agreed


def occurrences(seed: np.ndarray, right: Side, left: Side, doc: np.ndarray, place: np.ndarray, copies: np.ndarray, window: int, open_at: tuple[bool, bool]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(found, first, undecided) marks of each suffix and number of words before it, of the window that starts there.

    found: it repeats in the block; first: as the least of its occurrences by (doc, place);
    undecided: it may repeat in the block before or after this one too, and isn't judged here.
    copies: equal suffixes, with equal words before them, that a row stands for.
    """
    agreed = agreements(seed, right)
    shape = (len(seed), int(left.size.max(initial=0)) + 1)
    found, first, undecided = (np.zeros(shape, bool) for _ in range(3))
    rank = np.empty(len(seed), np.int64)
    rank[np.lexsort((place, doc))] = np.arange(len(seed))
    for j, h in prefixes(seed, left):
        run = np.cumsum(np.r_[0, agreed < window - j])  # suffixes that agree to the window's end
        able = (left.size >= j) & (right.size >= window - j)
        for edge, end in zip(open_at, (0, -1), strict=True):
            if edge:
                undecided[:, j] |= able & (run == run[end])
        rows = np.flatnonzero(able & (np.bincount(run, copies)[run] > 1) & ~undecided[:, j])
        key = join(h[rows], run[rows].astype(np.uint64))
        order = np.lexsort((rank[rows], key))
        rows, key = rows[order], key[order]
        head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        again = np.add.reduceat(copies[rows], head) > 1 if len(head) else np.zeros(0, bool)
        found[rows[np.repeat(again, np.diff(np.r_[head, len(key)]))], j] = True
        first[rows[head[again]], j] = True
    return found, first, undecided


def repeated_runs(docs: DataFrame, window: int = WINDOW, seed: int = SEED, rows: int | None = None) -> DataFrame:
    """(doc_id, start, n, first): runs of n window starts whose windows start elsewhere too; first: none of them starts earlier."""

    def decide(seeds, right, left, doc, place, copies, open_at):
        return occurrences(seeds, right, left, doc, place, copies, window, open_at)

    return segments.repeated_runs(docs, window, seed, decide, rows)


def find_passages(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """One row for each document with repeated passages.

    spans: the words that repeated windows cover, merged. n_repeated: words in them.
    n_later: those of them that also stand earlier (by doc_id, then place) in the corpus.
    """
    span = pa.list_(pa.struct([("start", pa.int64()), ("n", pa.int64())]))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.column("runs"):
                start, n, first = (x.to_numpy(zero_copy_only=False) for x in r.values.flatten())
                s, e = _merged(start, n, window)
                ls, le = _merged(start[~first], n[~first], window)
                out.append(([{"start": int(x), "n": int(y - x)} for x, y in zip(s, e, strict=True)], len(s), int((e - s).sum()), int((le - ls).sum())))
            spans, count, repeated, later = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(count, pa.int64()), pa.array(repeated, pa.int64()), pa.array(later, pa.int64()), pa.array(spans, span)], ["doc_id", "n_spans", "n_repeated", "n_later", "spans"])

    return by_document(repeated_runs(docs, window, seed)).mapInArrow(merge, "doc_id long, n_spans long, n_repeated long, n_later long, spans array<struct<start:long,n:long>>")


def _merged(start: np.ndarray, n: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the words that runs of windows cover, overlaps joined."""
    if not len(start):
        return start, start
    order = np.argsort(start, kind="stable")
    s, e = start[order], np.maximum.accumulate((start + n - 1 + window)[order])
    new = np.flatnonzero(np.r_[True, s[1:] > e[:-1]])
    return s[new], e[np.r_[new[1:], len(s)] - 1]


def cut_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """The rows of docs, all columns, without the words of repeated windows that stand earlier in the corpus.

    The first occurrence (by doc_id, then place) of each window stays. Blanks go with the word
    before them. n_chars follows where the table has it. Documents that lose their last word go.
    """
    key, found = unused(docs, "key"), unused(docs, "found")
    runs = by_document(repeated_runs(docs, window, seed)).select(F.col("doc_id").alias(key), F.col("runs").alias(found))
    schema = docs.schema

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in chunks(batch):
                text, runs = b.column("text"), b.column(found)
                texts, keep, w = text.to_pylist(), np.ones(b.num_rows, bool), Words(text)
                for i in np.flatnonzero(runs.is_valid().to_numpy(zero_copy_only=False)):
                    start, n, first = (x.to_numpy(zero_copy_only=False) for x in runs[int(i)].values.flatten())
                    gone = covered(int(w.count[i]), start[~first], n[~first], window)
                    if not gone.any():
                        continue
                    keep[i] = not gone.all()
                    lo = w.offsets[i]
                    bounds = np.r_[w.starts[w.first[i] : w.first[i + 1]], w.offsets[i + 1]] - lo
                    stays = np.ones(int(w.offsets[i + 1] - lo), bool)
                    stays[bounds[0] :] = np.repeat(~gone, np.diff(bounds))
                    texts[i] = np.frombuffer(w.doc(i), np.uint8)[stays].tobytes().decode()
                columns = {f: b.column(f) for f in schema.names}
                columns["text"] = pa.array(texts, text.type)
                if "n_chars" in columns:
                    cut = np.array([t != u for t, u in zip(texts, text.to_pylist(), strict=True)], bool)
                    size = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(columns["n_chars"].type)
                    columns["n_chars"] = pa.compute.if_else(pa.array(cut), size, columns["n_chars"])
                yield pa.RecordBatch.from_arrays(list(columns.values()), schema.names).filter(pa.array(keep))

    joined = docs.join(runs, F.col("doc_id").cast("long") == F.col(key), "left").drop(key)
    return joined.mapInArrow(task, schema)
