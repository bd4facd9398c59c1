"""Benchmark decontamination by spaced-seed hashing.

Tokens are runs of letters, digits and non-ASCII characters of the lower-cased text. A
document leaks an item where a window of ``SPAN`` tokens agrees with a window of the item
in all but ``MISSES`` places or fewer (substitutions; both windows lie at their places).

The window is cut into four parts of three tokens. Each mask keeps two parts and ignores
the other two, so the six masks find every window with two substitutions at most: these
fall into two parts, and one mask ignores both. Masked hashes of the benchmark's windows
are held in a Bloom filter of ``MOST`` bits or fewer, the only thing that is broadcast; the
corpus is read once against it, whatever the benchmark's size. Windows that pass (training
hashes) are joined with the benchmark's windows (test hashes) by finer seeds, which ignore
just the two places that may differ, those that a hit mask ignores: what meets there agrees
in ten places, so items made from one template don't all meet all texts. Windows are told
apart by their tokens, not by where they stand, so copies of a passage count once. Each
joined pair of windows is then verified token by token (64 bits a token), and overlapping
windows are merged into spans. A filter that is too full lets more windows pass, not fewer
or others, so the result is the same at every size.

Defined results: items and texts of fewer than ``SPAN`` tokens, null and empty ones leak
nothing; equal items are all named; documents without a leak have no row; rows that repeat
a doc_id share a row; rows with a null doc_id have none (clean() judges them like others);
items with a null item_id are left out; spans lie in the longest text of a doc_id.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import documents
from .shared import cut, unused
from .text import ALNUM, Words, chunks, join, mix, signed, spans

SPAN = 12
MISSES = 2
_PART = SPAN // 4
MASKS = ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3))
#: Bits of the filter by their logarithm, at least and at most, and bits for each hash.
FEWEST, MOST, BITS = 22, 29, 64
#: Places that a finer seed ignores, and for each mask whether it ignores both.
PAIRS = np.array(list(itertools.combinations(range(SPAN), 2)))
_IGNORES = np.array([[p // _PART not in m and q // _PART not in m for p, q in PAIRS] for m in MASKS])
_CHUNK = 1 << 13
_ODD = mix(np.arange(1, SPAN + 1, dtype=np.uint64)) | np.uint64(1)
_WINDOWS, WINDOWS = ["whole", "tokens", "masks"], "whole long, tokens array<long>, masks int"


def tokens(text: pa.Array) -> Words:
    return Words(pc.utf8_lower(text), ALNUM)


def _seeds(h: np.ndarray) -> Iterator[np.ndarray]:
    """Hashes of every window of SPAN tokens under each mask."""
    part = spans(h, _PART)
    n = max(0, len(h) - SPAN + 1)
    for i, (a, b) in enumerate(MASKS):
        yield join(part[a * _PART : a * _PART + n], part[b * _PART : b * _PART + n]) + np.uint64(i * 0x9E3779B97F4A7C15 % 2**64)


def _inner(w: Words) -> np.ndarray:
    """Marks the windows that lie in one document."""
    n = max(0, len(w.starts) - SPAN + 1)
    return np.arange(n) + SPAN <= w.first[1:][w.owner()[:n]]


class Filter:
    """A Bloom filter of two places for each hash."""

    def __init__(self, bits: int, data: np.ndarray | None = None):
        self.bits, self.data = bits, np.zeros(1 << bits - 3, np.uint8) if data is None else data

    def places(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shift = np.uint64(64 - self.bits)
        return (key >> shift).astype(np.int64), (mix(key.copy()) >> shift).astype(np.int64)

    def add(self, key: np.ndarray) -> None:
        for at in self.places(key):
            np.bitwise_or.at(self.data, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def holds(self, key: np.ndarray) -> np.ndarray:
        at = (key >> np.uint64(64 - self.bits)).astype(np.int64)
        out = (self.data[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        some = np.flatnonzero(out)
        at = self.places(key[some])[1]
        out[some] = self.data[at >> 3] >> (at & 7).astype(np.uint8) & 1
        return out


def _matrix(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    return h[at[:, None] + np.arange(SPAN)]


def _rows(h: np.ndarray, at: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Hash and tokens of the windows at these places."""
    flat = signed(_matrix(h, at).ravel())
    return pa.array(signed(spans(h, SPAN)[at])), pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, SPAN, dtype=np.int32), pa.array(flat))


def finer_seeds(matrix: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the window, hash of its tokens but two) for each two places that one of the window's masks (bits) ignores."""
    place = mix(matrix * _ODD)
    total = place.sum(1, dtype=np.uint64)
    use = np.zeros((len(matrix), len(PAIRS)), bool)
    for i in range(len(MASKS)):
        use |= (masks >> i & 1).astype(bool)[:, None] & _IGNORES[i]
    row, pair = np.nonzero(use)
    p, q = PAIRS[pair].T
    return row, mix(total[row] - place[row, p] - place[row, q] + mix((pair + 1).astype(np.uint64)))


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, whole, tokens, masks) of every window of every item; all masks are hit."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b):
                w = tokens(c.column("text"))
                at = np.flatnonzero(_inner(w))
                if len(at):
                    owner = w.owner()[at]
                    yield pa.RecordBatch.from_arrays([c.column("item_id").take(pa.array(owner)), *_rows(w.hashes(), at), pa.array(np.full(len(at), 63, np.int32))], ["item_id", *_WINDOWS])

    return items.mapInArrow(task, "item_id long, " + WINDOWS)


def _list(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy().view(np.uint64).reshape(-1, SPAN)


def build_filter(windows: DataFrame, most: int = MOST) -> Filter:
    """The filter of the windows' masked hashes; its size follows their number up to ``most``, in bits by their logarithm."""
    n = len(MASKS) * windows.count()
    bits = min(most, max(FEWEST, int(n * BITS).bit_length()))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Filter(bits)
        for b in batches:
            flat = _list(b.column("tokens")).ravel()
            for key in _seeds(flat):
                own.add(key[::SPAN])
        parts = own.data.reshape(-1, min(_CHUNK, len(own.data)))
        for i in np.flatnonzero(parts.any(1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([parts[i].tobytes()])], ["chunk", "data"])

    def merge(t: pa.Table) -> pa.Table:
        data = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in t.column("data").to_pylist()])
        return pa.table({"chunk": t.column("chunk")[:1], "data": pa.array([data.tobytes()], pa.binary())})

    out = Filter(bits)
    parts = out.data.reshape(-1, min(_CHUNK, len(out.data)))
    # At most the filter's own size is read to the driver.
    for chunk, data in windows.select("tokens").mapInArrow(task, "chunk long, data binary").groupBy("chunk").applyInArrow(merge, "chunk long, data binary").collect():
        parts[chunk] = np.frombuffer(data, np.uint8)
    return out


def candidates(docs: DataFrame, kind: str, sieve: Filter) -> DataFrame:
    """(key, start, n_tokens, whole, tokens, masks) of the windows of docs (key, text) that hit the filter, and the masks that do, as bits."""
    sent = docs.sparkSession.sparkContext.broadcast(sieve)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = sent.value
        for b in batches:
            for c in chunks(b):
                w = tokens(c.column("text"))
                h = w.hashes()
                if len(h) < SPAN:
                    continue
                masks = np.zeros(len(h) - SPAN + 1, np.int32)
                for i, key in enumerate(_seeds(h)):
                    masks[sieve.holds(key)] |= 1 << i
                at = np.flatnonzero((masks > 0) & _inner(w))
                if len(at):
                    owner = w.owner()[at]
                    yield pa.RecordBatch.from_arrays(
                        [c.column("key").take(pa.array(owner)), pa.array(at - w.first[owner]), pa.array(w.count[owner].astype(np.int64)), *_rows(h, at), pa.array(masks[at])],
                        ["key", "start", "n_tokens", *_WINDOWS],
                    )

    return docs.mapInArrow(task, f"key {kind}, start long, n_tokens long, " + WINDOWS)


def _sown(windows: DataFrame, name: str) -> DataFrame:
    """(seed, name): the finer seeds of distinct windows, each under its hash."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1 << 13):
                c = b.slice(i, 1 << 13)
                row, seed = finer_seeds(_list(c.column("tokens")), c.column("masks").to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(signed(seed)), c.column("whole").take(pa.array(row))], ["seed", name])

    return windows.mapInArrow(task, f"seed long, {name} long")


def leaks(docs: DataFrame, kind: str, benchmark: DataFrame, most: int = MOST) -> DataFrame:
    """(key, start, n_tokens, items): every window of docs (key, text) that leaks, with the item_ids, ascending."""
    test = cut(benchmark_windows(benchmark))
    found = cut(candidates(docs, kind, build_filter(test, most)))
    own, other = (w.groupBy("whole").agg(F.first("tokens").alias("tokens"), F.bit_or("masks").alias("masks")) for w in (found, test))
    pairs = _sown(own, "own").join(_sown(other, "other"), "seed").select("own", "other").distinct()
    pairs = pairs.join(own.select(F.col("whole").alias("own"), F.col("tokens").alias("x")), "own").join(other.select(F.col("whole").alias("other"), F.col("tokens").alias("y")), "other")
    same = F.size(F.filter(F.zip_with("x", "y", lambda a, b: a == b), lambda e: e))
    pairs = pairs.where(same >= SPAN - MISSES).select("own", F.col("other").alias("whole"))
    items = pairs.join(test.select("whole", "item_id").distinct(), "whole").groupBy(F.col("own").alias("whole")).agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    return found.select("key", "start", "n_tokens", "whole").join(items, "whole").select("key", "start", "n_tokens", "items")


def find_leaks(docs: DataFrame, benchmark: DataFrame, most: int = MOST) -> DataFrame:
    """One row for each leaking document: doc_id, items (item_ids, ascending), n_tokens, n_leaked, spans of tokens."""
    hits = leaks(documents(docs).select(F.col("doc_id").alias("key"), "text"), "long", benchmark, most)
    hits = hits.groupBy(F.col("key").alias("doc_id")).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.array_sort(F.collect_set("start")).alias("starts"),
        F.max("n_tokens").alias("n_tokens"),
    )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaked, out = [], []
            for s in b.column("starts"):
                s = s.values.to_numpy()
                new = np.flatnonzero(np.r_[True, s[1:] > s[:-1] + SPAN])
                end = s[np.r_[new[1:], len(s)] - 1] + SPAN
                out.append([{"start": int(x), "n": int(y - x)} for x, y in zip(s[new], end, strict=True)])
                leaked.append(int((end - s[new]).sum()))
            spans_type = pa.list_(pa.struct([("start", pa.int64()), ("n", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("items"), b.column("n_tokens"), pa.array(leaked, pa.int64()), pa.array(out, spans_type)], ["doc_id", "items", "n_tokens", "n_leaked", "spans"])

    return hits.mapInArrow(merge, "doc_id long, items array<long>, n_tokens long, n_leaked long, spans array<struct<start:long,n:long>>")


def clean(docs: DataFrame, benchmark: DataFrame, most: int = MOST) -> DataFrame:
    """The rows of docs, all columns, whose texts leak nothing. Texts are told apart by their MD5, so rows without a doc_id are judged too."""
    digest = F.md5(F.col("text").cast("string").cast("binary"))
    gone, key = unused(docs, "gone"), unused(docs, "digest")
    texts = docs.select(digest.alias("key"), F.col("text").cast("string").alias("text")).where("text is not null")
    bad = leaks(texts, "string", benchmark, most).select(F.col("key").alias(gone)).distinct()
    kept = docs.withColumn(key, digest)
    return kept.join(bad, F.col(key) == F.col(gone), "left_anti").drop(key)
