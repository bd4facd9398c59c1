"""SimHash near-duplicates by anchor points of a covering code.

Each fingerprint x has an anchor (a code word) within the covering radius R. If y lies
within t of x, that anchor lies within R + t of y. So each fingerprint goes home to its
nearest anchor and, as a replica, to every anchor within R + t; home rows are compared
with all rows of their anchor.

On all 64 bits that takes too many replicas. Four differing bits are therefore first
split by place: of six triples of six blocks of bits, one differs in at most one place
(t = 1). Each triple has its own covering code: a perfect Hamming code of radius 1 on its
first 31 bits, with all patterns of the others. Its syndrome gives the home; anchors
within R + t = 2 of a fingerprint are found by table: 102 rows a fingerprint.

Exact: all links between different fingerprints at 4 or fewer bits are found, at any
table. Equal fingerprints are one class, whatever their number. Rows come sorted by anchor
and are read anchor by anchor; home rows are compared with all rows of their anchor. Of an
anchor with more than ``DENSE`` rows only those are compared that agree on four bytes of
eight, as all do that differ in four bits at most. Links are joined per anchor before they
are sent, as stars instead of pairs.

That is op6. The pipeline's stage goes by similarity (``similar_components``): documents whose
sets of five-word shingles have a Jaccard similarity of 0.8 or more, 0.15 of the bits apart and
sometimes 0.3. Hamming codes don't hold such a radius, so the stage's fingerprint has 256 bits, kept
with the sums whose signs they are, and its anchors are code words of a biorthogonal code (32 places,
64 words), the nearest by the sums: the largest of their Hadamard transform, with its sign. An anchor
is ``VIEWS`` code words over different choices of the sums; each set goes home to one in each of
``TABLES`` tables and, as a replica, to that with the second nearest word in the least sure view.
Fingerprints under one anchor within ``WIDE`` bits are candidates; within each component of candidates
the shingle sets themselves are compared, in one task or, beyond ``TOGETHER`` bytes of text, by rounds
of pivots over blocks of the component; only pairs at the similarity or above are linked. By simulation
a pair at exactly 0.8 shares an anchor of one table with a chance of 0.24, of none with one of 2e-5.

Defined results: texts without words (null, empty, blank) have fingerprint zero and are
linked like any other; rows with a null doc_id are left out; rows that repeat a doc_id
get a row each, and link what they hold through the id they share.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from .components import components
from .repeats import documents, emit, grouped
from .shared import cut, unused
from .text import LOWER, Words, chunks, mix, signed, spans, unsigned

DISTANCE = 4
SHINGLE = 4
#: Rows of one anchor from which those that agree on half their bytes are compared, and of such a half from which components are grown.
DENSE = 512
#: The stage's rule, and its anchors: VIEWS code words of PLACES places each, fingerprints of BITS bits that are WIDE apart at most.
SIMILARITY, WORDS = 0.8, 5
BITS, TABLES, VIEWS, PLACES, WIDE = 256, 40, 3, 32, 76
#: Bytes of text of a component that one task verifies; larger ones go by rounds, with blocks of so many rows and at most so many pivots a round.
TOGETHER, BLOCK, PIVOTS = 32 << 20, 4096, 128
_LOW_UPPER = bytes(LOWER)
_SALTS = mix(np.arange(1, BITS // 64, dtype=np.uint64))
_HADAMARD = np.where(np.bitwise_count(np.arange(PLACES)[:, None] & np.arange(PLACES)) % 2, -1, 1).astype(np.float32)
_DRAW = np.random.default_rng(7)
#: The sums that each view looks at, and the signs they take there.
_CHOSEN = np.stack([_DRAW.permutation(BITS)[:PLACES] for _ in range(TABLES * VIEWS)])
_SIGNS = _DRAW.choice(np.array([-1, 1], np.float32), _CHOSEN.shape)


def _blocks(n: int) -> list[list[int]]:
    return [list(b) for b in np.array_split(np.arange(64), n)]


def tables() -> list[tuple[int, list[int]]]:
    """(r, bits): a Hamming code on the first 2^r - 1 of the bits, for each table."""
    b = _blocks(6)
    # However four differing bits fall into six blocks, one of these triples has one of them at most.
    return [(4 if len(x := [i for j in t for i in b[j]]) < 31 else 5, x) for t in ((0, 1, 2), (0, 1, 3), (0, 4, 5), (1, 4, 5), (2, 3, 4), (2, 3, 5))]


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    words = text.translate(_LOW_UPPER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    n = max(1, len(words) - size + 1)
    lo, hi = (end - length)[:n].tolist(), end[min(size, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    set_bits = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(lo[i : i + (1 << 16)], hi[i : i + (1 << 16)], strict=True)], "<u8")
        set_bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text, as a signed long."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b):
                fp = np.array([fingerprint(t.as_buffer().to_pybytes(), size) for t in c.column("text")], np.uint64)
                yield pa.RecordBatch.from_arrays([c.column("doc_id"), pa.array(signed(fp))], ["doc_id", "fp"])

    return documents(docs).mapInArrow(task, "doc_id long, fp long")


def anchors(fp: np.ndarray, r: int, bits: list[int]) -> Iterator[tuple[np.ndarray, bool]]:
    """The anchor of every fingerprint in one table, as (key, home), then those within radius + 1.

    The key is the code word's bits with the other bits of the block behind them.
    """
    n, one = (1 << r) - 1, np.uint64(1)
    x = np.zeros(len(fp), np.uint64)
    for j, bit in enumerate(bits):
        x |= ((fp >> np.uint64(bit)) & one) << np.uint64(j)
    syndrome = np.zeros(len(fp), np.int64)
    for j in range(n):
        syndrome ^= np.where((x >> np.uint64(j)) & one, j + 1, 0)

    def flip(y: np.ndarray, s: np.ndarray) -> np.ndarray:
        """Changes place s - 1; none where s is 0."""
        return np.where(s > 0, y ^ (one << np.maximum(s - 1, 0).astype(np.uint64)), y)

    home = flip(x, syndrome)
    yield home, True
    for j in range(n, len(bits)):  # another bit differs
        yield home ^ (one << np.uint64(j)), False
    for s in range(1, n + 1):  # code words at distance 2: flip s and the place that then mends the syndrome
        mend = syndrome ^ s
        use = (s < mend) & (syndrome > 0)
        if use.any():
            yield np.where(use, flip(flip(x, np.full(len(x), s)), mend), home), False


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints of one word, or of several in the last dimension."""
    bits = np.bitwise_count(x ^ y)
    return bits if bits.ndim == 1 else bits.sum(1, dtype=np.int64)


def _pairs(fp: np.ndarray, heads: np.ndarray, distance: int, home: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of row numbers within the distance among the rows of each group; home: rows that are compared with all of theirs."""
    sizes = np.diff(np.r_[heads, len(fp)])
    begin, group = np.repeat(heads, sizes), np.repeat(sizes, sizes)
    rows = np.flatnonzero((group > 1) if home is None else home & (group > 1))
    i, upto = 0, np.cumsum(group[rows])
    while i < len(rows):  # so many pairs at once
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + (1 << 21), "right")))
        r = rows[i:j]
        g = group[r]
        a = np.repeat(r, g)
        b = np.arange(g.sum()) - np.repeat(np.cumsum(g) - g, g) + np.repeat(begin[r], g)
        near = (_apart(fp[a], fp[b]) <= distance) & (a != b)
        yield a[near], b[near]
        i = j


def _grown(fp: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs that span the links among all rows: a component grows, and what it reaches is not looked at again."""
    rest = np.arange(len(fp))
    while len(rest):
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            x = todo.pop()
            near = _apart(fp[rest], fp[x]) <= distance
            reached = rest[near]
            yield np.full(len(reached), x), reached
            todo += reached.tolist()
            rest = rest[~near]


def _halves(fp: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs that span the links of at most four bits among all rows, from those that agree on four of eight bytes."""
    for kept in itertools.combinations(range(8), 4):
        key = fp & np.uint64(sum(0xFF << 8 * i for i in kept))
        order = np.argsort(key, kind="stable")
        key = key[order]
        heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[heads, len(fp)])
        large = np.repeat(sizes > DENSE, sizes)
        small = order[~large]
        if len(small):
            k = key[~large]
            for a, b in _pairs(fp[small], np.flatnonzero(np.r_[True, k[1:] != k[:-1]]), distance):
                yield small[a], small[b]
        for h, n in zip(heads[sizes > DENSE], sizes[sizes > DENSE], strict=True):
            some = order[h : h + n]
            for a, b in _grown(fp[some], distance):
                yield some[a], some[b]


def _stars(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that span the links a, b, given both ways, among n rows: each row with the least that it reaches."""
    least = np.arange(n)
    while True:
        now = least.copy()
        np.minimum.at(now, a, least[b])
        now = now[now]
        if (now == least).all():
            rows = np.flatnonzero(least < np.arange(n))
            return rows, least[rows]
        least = now


def _links(fp: np.ndarray, home: np.ndarray, heads: np.ndarray, distance: int, grow: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of row numbers that span the links within each anchor's rows. Rows are sorted by anchor. grow: at any distance, as stars."""
    sizes = np.diff(np.r_[heads, len(fp)])
    dense = sizes > DENSE
    found = _pairs(fp, heads, distance, home & ~np.repeat(dense, sizes))
    if grow:
        found = (_stars(np.r_[a, b], np.r_[b, a], len(fp)) for a, b in found if len(a))
    found = list(found)
    for h, n in zip(heads[dense], sizes[dense], strict=True):
        found += [(a + h, b + h) for a, b in (_grown if grow else _halves)(fp[h : h + n], distance)]
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([none, *x]) for x in zip(*found, strict=True)) if found else (none, none)


_PLACED = pa.schema([("anchor", pa.int64()), ("fp", pa.int64()), ("node", pa.int64()), ("home", pa.bool_())])
_FP = ["fp", *(f"fp{i}" for i in range(1, BITS // 64))]
_EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _comparing(placed: DataFrame, distance: int, grow: bool = False) -> DataFrame:
    """Edges (u, v) that span the links within each anchor's rows of (anchor, fp, node, home). grow: fp and the further words of _FP."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, "anchor"):
            # by node within an anchor, so that the anchors of a family choose the same hub
            anchor, node, home = (t.column(c).to_numpy() for c in ("anchor", "node", "home"))
            fp = np.stack([unsigned(t.column(c).to_numpy()) for c in _FP], 1) if grow else unsigned(t.column("fp").to_numpy())
            a, b = _links(fp, home, np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]]), distance, grow)
            if len(a):
                u, v = np.maximum(node[a], node[b]), np.minimum(node[a], node[b])
                order = np.lexsort((v, u))
                u, v = u[order], v[order]
                new = np.r_[True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])] & (u != v)
                yield from emit(_EDGES, u[new], v[new])

    return placed.repartition("anchor").sortWithinPartitions("anchor", "node").mapInArrow(compare, "u long, v long")


def near_links(classes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Edges (u, v) between nodes of classes (node, fp) that join all at ``distance`` bits or fewer."""
    if distance > 4:
        raise ValueError("the tables hold all links of 4 bits at most")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, node = unsigned(b.column("fp").to_numpy()), b.column("node").to_numpy()
            for i, (r, bits) in enumerate(tables()):
                for j, (key, home) in enumerate(anchors(fp, r, bits)):
                    real = slice(None) if j < 1 + len(bits) - (1 << r) + 1 else key != first
                    if home:
                        first = key
                    key = signed(key[real] | np.uint64(i << 58))
                    yield from emit(_PLACED, key, signed(fp[real]), node[real], np.full(len(key), home))

    return _comparing(classes.select("fp", "node").mapInArrow(place, "anchor long, fp long, node long, home boolean"), distance)


def near_components(docs: DataFrame, distance: int = DISTANCE, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id): documents linked through fingerprints at ``distance`` bits or fewer."""
    prints = cut(fingerprints(docs, size))
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("node")))
    edges = near_links(classes, distance)
    # Rows that repeat a doc_id with other texts tie their classes together.
    split = prints.groupBy("doc_id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high").select("doc_id")
    ties = prints.join(split, "doc_id").select("fp", "doc_id").join(classes, "fp").select(F.col("node").alias("u"), F.col("doc_id").alias("v"))
    found = components(edges.union(ties))
    named = classes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def simhash_groups(docs: DataFrame, distance: int = DISTANCE, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id), the fingerprint as 16 lowercase hex digits."""
    return near_components(docs, distance, size).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _keep_first(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs that are the smallest doc_id of their component in found (doc_id, component_id).

    Of rows that repeat a doc_id the first by the hash of its text stays, then by the other columns, in their order.
    """
    gone, turn = unused(docs, "gone"), unused(docs, "turn")
    found = found.where("doc_id <> component_id").select(F.col("doc_id").alias(gone)).distinct()
    left = docs.join(found, F.col("doc_id").cast("long") == F.col(gone), "left_anti")
    # The second key parts the rows without an id; of the others it is null.
    fixed = [f.name for f in docs.schema if not isinstance(f.dataType, MapType | VariantType) and f.name != "text"]
    rows = Window.partitionBy("doc_id", F.when(F.col("doc_id").isNull(), F.xxhash64("text"))).orderBy(F.xxhash64("text"), "text", *fixed)
    return left.withColumn(turn, F.row_number().over(rows)).where((F.col(turn) == 1) | F.col("doc_id").isNull()).drop(turn)


def keep_one(docs: DataFrame, distance: int = DISTANCE, size: int = SHINGLE) -> DataFrame:
    """The rows of docs, all columns, that are the smallest doc_id of their component.

    Of rows that repeat a doc_id one stays, the same in every run. Rows with a null doc_id all stay.
    """
    return _keep_first(docs, near_components(docs, distance, size))


def shingles(words: Words, size: int = WORDS) -> Iterator[np.ndarray]:
    """The set of shingles of each text, as sorted hashes; a text of fewer words is one shingle, none without words."""
    h = words.hashes()
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        yield np.unique(spans(h[a:b], min(size, b - a))) if b > a else np.zeros(0, np.uint64)


def _lower_words(column: pa.Array) -> Words:
    return Words(column, lower=True)


def sums(s: np.ndarray) -> np.ndarray:
    """What SimHash takes the signs of: for each of BITS bits, over a set of hashes, how many set it less how many don't."""
    out = np.zeros(BITS, np.int64)
    for i in range(0, len(s), 1 << 14):
        part = s[i : i + (1 << 14)]
        words = np.stack([part, *(mix(part ^ x) for x in _SALTS)], 1)
        out += np.unpackbits(words.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return 2 * out - len(s)


def soft_anchors(v: np.ndarray) -> np.ndarray:
    """The anchors of each row of sums: those at home, one for each table, then the replicas."""
    x = (v.astype(np.float32)[:, _CHOSEN] * _SIGNS).reshape(-1, PLACES) @ _HADAMARD
    size, rows = np.abs(x), np.arange(len(x))

    def nearest() -> tuple[np.ndarray, np.ndarray]:
        at = size.argmax(1)
        return (at * 2 + (x[rows, at] > 0)).reshape(len(v), TABLES, VIEWS), size[rows, at].reshape(len(v), TABLES, VIEWS)

    first, most = nearest()
    size[rows, first.reshape(-1) // 2] = -1
    second, next_most = nearest()
    unsure = np.arange(VIEWS) == (most - next_most).argmin(2)[..., None]
    words = np.stack([first, np.where(unsure, second, first)], 1)
    key = np.arange(TABLES)
    for i in range(VIEWS):
        key = key * (2 * PLACES) + words[..., i]
    return key.reshape(len(v), 2 * TABLES).astype(np.int32)


def sketches(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """(doc_id, the words of fp, key, anchors): fingerprint, hash of the set of shingles, and anchors of every whole text."""

    def sketch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        v, keys = np.zeros((batch.num_rows, BITS), np.int64), []
        for i, s in enumerate(shingles(_lower_words(batch.column("text")), size)):
            v[i] = sums(s)
            keys.append(int(mix(np.r_[s, np.uint64(len(s))]).sum(dtype=np.uint64)))
        none = ~v.any(1)
        fp = np.packbits(v > 0, axis=1, bitorder="little").view("<i8")
        anchors = pa.ListArray.from_arrays(np.r_[0, np.cumsum(~none) * 2 * TABLES].astype(np.int32), pa.array(soft_anchors(v[~none]).reshape(-1)))
        columns = [batch.column("doc_id"), *map(pa.array, fp.T), pa.array(np.array(keys, np.uint64).view(np.int64)), anchors]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", *_FP, "key", "anchors"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b):
                for i in range(0, c.num_rows, 512):
                    yield from sketch(c.slice(i, 512))

    return documents(docs).mapInArrow(task, f"doc_id long, {', '.join(f'{c} long' for c in _FP)}, key long, anchors array<int>")


def similar(sets: list[np.ndarray], similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Places of pairs that span the links at the similarity or above among the sets."""
    size = np.array([len(s) for s in sets])
    found, rest = [], np.arange(len(sets))
    while len(rest):  # grow a component: what it reaches is not looked at again
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            x = todo.pop()
            near = rest[np.minimum(size[rest], size[x]) >= similarity * np.maximum(size[rest], size[x])]
            if not len(near):
                continue
            items = np.concatenate([sets[i] for i in near])
            at = np.minimum(np.searchsorted(sets[x], items), size[x] - 1)
            both = np.add.reduceat(sets[x][at] == items, np.r_[0, np.cumsum(size[near])[:-1]], dtype=np.int64)
            reached = near[both >= similarity * (size[near] + size[x] - both) - 1e-9]
            found += [(int(x), int(i)) for i in reached]
            todo += reached.tolist()
            rest = np.setdiff1d(rest, reached, assume_unique=True)
    return found


def _verified(candidates: DataFrame, size: int, similarity: float) -> DataFrame:
    """Edges (u, v) among (component, node, text) at the similarity or above, within each component."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, nodes, sets = None, [], []

        def links() -> Iterator[pa.RecordBatch]:
            pairs = [(max(nodes[i], nodes[j]), min(nodes[i], nodes[j])) for i, j in similar(sets, similarity) if nodes[i] != nodes[j]]
            yield from emit(_EDGES, *np.array(pairs, np.int64).reshape(-1, 2).T)

        for b in batches:
            for c in chunks(b):
                for group, node, s in zip(c.column("component").to_pylist(), c.column("node").to_pylist(), shingles(_lower_words(c.column("text")), size), strict=True):
                    if group != at:
                        yield from links()
                        at, nodes, sets = group, [], []
                    if len(s):
                        nodes.append(node)
                        sets.append(s)
        yield from links()

    return candidates.repartition("component").sortWithinPartitions("component").mapInArrow(task, "u long, v long")


def _among(pivots: tuple[list[int], list[np.ndarray]], node: int, s: np.ndarray, kin: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links of a set with the pivots it is similar to, one for each kin of pivots."""
    nodes, sets = pivots
    size = np.array([len(p) for p in sets])
    near = np.flatnonzero(np.minimum(size, len(s)) >= similarity * np.maximum(size, len(s)))
    both = np.array([(s[np.minimum(np.searchsorted(s, sets[i]), len(s) - 1)] == sets[i]).sum() for i in near], np.int64)
    near = near[both >= similarity * (size[near] + len(s) - both) - 1e-9]
    _, one = np.unique(kin[near], return_index=True)
    return [(max(node, nodes[i]), min(node, nodes[i])) for i in near[one] if nodes[i] != node]


def _met(pivots: DataFrame, others: DataFrame, size: int, similarity: float) -> DataFrame:
    """Edges (u, v) between pivots and others, both (block, node, text), within each block. A task holds a block's pivots only."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, nodes, sets, kin = None, [], [], None
        for b in batches:
            for c in chunks(b):
                found = []
                rows = zip(c.column("block").to_pylist(), c.column("turn").to_pylist(), c.column("node").to_pylist(), shingles(_lower_words(c.column("text")), size), strict=True)
                for block, turn, node, s in rows:
                    if block != at:
                        at, nodes, sets, kin = block, [], [], None
                    if not len(s):
                        continue
                    if turn == 0:
                        nodes.append(node)
                        sets.append(s)
                    elif nodes:
                        if kin is None:
                            kin = np.arange(len(sets))
                            for i, j in similar(sets, similarity):
                                kin[kin == kin[j]] = kin[i]
                                found += [(max(nodes[i], nodes[j]), min(nodes[i], nodes[j]))] if nodes[i] != nodes[j] else []
                        found += _among((nodes, sets), node, s, kin, similarity)
                yield from emit(_EDGES, *np.array(found, np.int64).reshape(-1, 2).T)

    rows = pivots.select("block", F.lit(0).alias("turn"), "node", "text").union(others.select("block", F.lit(1).alias("turn"), "node", "text"))
    return rows.repartition("block").sortWithinPartitions("block", "turn").mapInArrow(task, "u long, v long")


def _verified_by_rounds(candidates: DataFrame, size: int, similarity: float) -> DataFrame:
    """As _verified, for components too large for one task.

    In each round some rows of a component are pivots, copied to blocks of its other rows; whoever was
    a pivot has met all others and leaves. What is linked so far forms classes; when no class but the
    largest is left in a component all its links are spanned. Pivots are of the other classes, by hash.
    """
    row = F.xxhash64("node", F.xxhash64("text"))
    texts = cut(candidates.withColumn("row", row).dropDuplicates(["component", "row"]))
    left, edges, most = cut(texts.select("component", "node", "row")), None, 16
    while True:
        if edges is None:
            named = left.withColumn("label", F.col("node"))
        else:
            named = left.join(components(edges).select("node", F.col("component").alias("label")), "node", "left").withColumn("label", F.coalesce("label", "node"))
        named = cut(named)
        classes = named.groupBy("component", "label").agg(F.count("*").alias("n"))
        largest = classes.groupBy("component").agg(F.max_by("label", F.struct("n", "label")).alias("largest"), F.sum("n").alias("total"), F.count("*").alias("classes")).where("classes > 1")
        todo = named.join(largest, "component").where("label <> largest")
        salted = Window.partitionBy("component", F.pmod("row", F.lit(64))).orderBy("row")
        each = Window.partitionBy("component").orderBy("row")
        chosen = todo.withColumn("i", F.row_number().over(salted)).where(F.col("i") <= most).withColumn("i", F.row_number().over(each)).where(F.col("i") <= most)
        chosen = cut(chosen.select("component", "row", "total"))
        if chosen.isEmpty():
            return edges if edges is not None else left.select(F.col("node").alias("u"), F.col("node").alias("v")).where("false")
        blocks = F.ceil(F.col("total") / BLOCK)
        block = lambda i: F.xxhash64("component", i)
        held = texts.join(chosen, ["component", "row"])
        pivots = held.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))).select(block("i").alias("block"), "node", "text")
        live = left.join(largest.select("component", "total"), "component").select("component", "row", F.pmod("row", blocks).alias("i"))
        others = texts.join(live, ["component", "row"]).select(block("i").alias("block"), "node", "text")
        found = _met(pivots, others, size, similarity)
        edges = cut(found if edges is None else edges.union(found).distinct())
        left = cut(left.join(chosen.select("component", "row"), ["component", "row"], "left_anti"))
        most = min(2 * most, PIVOTS)


def similar_components(docs: DataFrame, similarity: float = SIMILARITY, size: int = WORDS) -> DataFrame:
    """(doc_id, component_id): documents linked by shingle sets at the similarity or above; equal sets are one class."""
    prints = cut(sketches(docs, size))
    classes = cut(prints.groupBy("fp", "key").agg(F.min("doc_id").alias("node"), *(F.first(c).alias(c) for c in [*_FP[1:], "anchors"])))
    placed = classes.select(F.posexplode("anchors").alias("i", "anchor"), *_FP, "node").withColumn("home", F.col("i") < TABLES).drop("i")
    loose = components(_comparing(placed, WIDE, grow=True))
    members = cut(loose.union(loose.select("component", "component")).distinct())
    sizes = documents(docs).select(F.col("doc_id").alias("node"), F.octet_length("text").alias("bytes")).join(members, "node")
    large = cut(sizes.groupBy("component").agg(F.sum("bytes").alias("bytes")).where(F.col("bytes") > TOGETHER).select("component"))
    candidates = documents(docs).join(members.hint("merge"), F.col("doc_id") == F.col("node")).select("component", "node", "text")
    if large.isEmpty():
        edges = _verified(candidates, size, similarity)
    else:
        edges = _verified(candidates.join(large, "component", "left_anti"), size, similarity)
        edges = edges.union(_verified_by_rounds(candidates.join(large, "component"), size, similarity))
    ties = prints.join(classes.select("fp", "key", "node"), ["fp", "key"]).where("doc_id <> node").select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
    found = components(edges.union(ties))
    return prints.select("doc_id").distinct().join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("component_id"))


def keep_one_similar(docs: DataFrame, similarity: float = SIMILARITY, size: int = WORDS) -> DataFrame:
    """As keep_one, by components of similar documents."""
    return _keep_first(docs, similar_components(docs, similarity, size))
