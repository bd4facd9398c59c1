"""Substring deduplication by relative Lempel-Ziv parsing.

The corpus is its own reference. Its index lists, for each seed (a ``SEED``-word gram chosen
by content) that occurs twice or more, every place it stands at, ordered by the words that
follow the seed and then by those before it, and is cut into blocks (``segments``). What a
document has around a seed stands in the block that can hold a match of it, so each document
meets every such block and no other.

In its block each segment is parsed greedily: from the seed on it takes the source that goes on
longest (in sorted order one of its two neighbours), word by word to the right, then as far to
the left as the same source agrees. Factors of ``WINDOW`` words or more are duplicate spans. A
window that crosses a factor's bound is checked against the other sources that agree as far to
the right. Without a factor nothing is removed.

Defined results: null texts have no words; texts shorter than a window lose nothing; a window
that repeats within one document counts; rows with a null doc_id are left out; rows that repeat
a doc_id are read as copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .repeats import by_document, covered, documents
from .segments import Side, prefixes, repeated_runs
from .text import join

WINDOW = 35
SEED = 12


def factors(seed: np.ndarray, right: Side, left: Side) -> tuple[np.ndarray, np.ndarray]:
    """Greedy factors in a sorted block: words that each segment but the last shares with the next one's.

    From the seed on to the right, and before it; none (zeros) where the seeds differ.
    """
    ahead, back = np.zeros(max(0, len(seed) - 1), np.int64), np.zeros(max(0, len(seed) - 1), np.int64)
    same = np.flatnonzero(seed[1:] == seed[:-1])
    ahead[same], back[same] = right.agreed(same), left.agreed(same)
    return ahead, back


def parse(seed: np.ndarray, right: Side, left: Side, copies: np.ndarray, window: int, open_at: tuple[bool, bool]) -> tuple[np.ndarray, np.ndarray]:
    """(found, undecided): marks for each segment and number o of words before the seed, of the window that starts there.

    copies: equal segments that a row stands for; what has some is a factor of its own. found: it starts elsewhere in the block. undecided: it may start in the block before or after this one too.
    """
    ahead, back = factors(seed, right, left)
    before, after = [np.r_[0, x] for x in (ahead, back)], [np.r_[x, 0] for x in (ahead, back)]
    most = int(left.size.max(initial=0)) + 1
    o = np.arange(most)
    found = (copies > 1)[:, None] & (o >= window - right.size[:, None]) & (o <= left.size[:, None])
    for reach, behind in (before, after):  # windows that lie in a factor
        found |= (o >= window - reach[:, None]) & (o <= behind[:, None])
    # Windows across a factor's bound: enough words agree to the right, those before it don't with the same source.
    crossing = (o >= window - np.maximum(before[0], after[0])[:, None]) & (o <= left.size[:, None]) & ~found
    undecided = np.zeros_like(found)
    for j, h in prefixes(seed, left):
        group = np.cumsum(np.r_[0, ahead < window - j])
        able = (left.size >= j) & (right.size >= window - j)
        if crossing[:, j].any():
            held = np.zeros(group[-1] + 1, bool)
            held[group[crossing[:, j]]] = True
            rows = np.flatnonzero(held[group] & able)
            _, of, n = np.unique(join(h[rows], group[rows].astype(np.uint64)), return_inverse=True, return_counts=True)
            found[rows[n[of] > 1], j] = True
        for edge, end in zip(open_at, (0, -1), strict=True):
            if edge:
                undecided[:, j] |= able & (group == group[end])
    return found, undecided


def duplicate_runs(docs: DataFrame, window: int = WINDOW, seed: int = SEED, rows: int | None = None) -> DataFrame:
    """(doc_id, start, n, first): runs of n window starts whose windows start elsewhere too. first is not told apart here."""

    def decide(seeds, right, left, doc, place, copies, open_at):
        found, undecided = parse(seeds, right, left, copies, window, open_at)
        return found, np.zeros_like(found), undecided

    return repeated_runs(docs, window, seed, decide, rows)


def remove_substrings(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): the words of each document outside all duplicate spans."""
    return _apply(docs, window, seed, "kept binary", pa.binary(), lambda kept: kept)


def digest_substrings(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """As remove_substrings, with the SHA-256 of the kept words in their place."""
    return _apply(docs, window, seed, "kept_sha256 string", pa.string(), lambda kept: hashlib.sha256(kept).hexdigest())


def _apply(docs: DataFrame, window: int, seed: int, column: str, kind: pa.DataType, of) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), (column.split()[0], kind)])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs, out = b.column("runs"), []
            for i, text in enumerate(b.column("text")):
                words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                n = len(words)
                if (r := runs[i]).is_valid and n:
                    f = r.values.flatten()
                    gone = covered(n, f[0].to_numpy(), f[1].to_numpy(), window)
                    words = [words[j] for j in np.flatnonzero(~gone)]
                out.append((n, n - len(words), of(b" ".join(words))))
            n, removed, kept = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, kind)], schema=schema)

    runs = by_document(duplicate_runs(docs, window, seed))
    return documents(docs).join(runs, "doc_id", "left").select("doc_id", "text", "runs").mapInArrow(task, f"doc_id long, n_words long, n_removed long, {column}")
