"""SentencePiece (BPE) encoding and decoding by suffix-array matching.

The distinct words of a batch are joined into one text, whose suffixes are sorted (to the
first eight bytes; longer pieces are verified behind them). Every piece of the vocabulary
is searched for by bisection; its occurrences are edges of a lattice. Sorted by end, the
edges are relaxed from left to right over all words at once: the last piece of a prefix
is the one edge whose piece may follow the last piece at its start. That is exact for BPE:
a row of pieces is the encoding if and only if no merge crosses a boundary of two
neighbours, and whether one does follows from how the two pieces were merged.

Characters outside the vocabulary stand alone and become byte pieces, so texts are cut at
blanks, tabs and line ends first; runs of the blank mark are merged last, from the left.
Encodings of words are kept over batches, up to ``KEPT`` words a worker.

Defined results: null and empty texts have no ids; the blank mark itself decodes to a blank
(as in the library); rows that repeat a doc_id get a row each; rows with a null doc_id are
left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .repeats import documents
from .text import Words, chunks, distinct, mix

KEPT = 1 << 19
#: Characters from which a word's edges are relaxed by themselves.
DRAWN_OUT = 512
#: Words that are matched at once.
TOGETHER = 1 << 15
MARK = "▁"
_MARK_BYTES = MARK.encode()
#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_IN_WORD = np.ones(256, bool)
_IN_WORD[[0x20, 0x09, 0x0A]] = False


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Fields of a protocol buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        x = shift = 0
        while True:
            b = data[i]
            i += 1
            x |= (b & 127) << shift
            shift += 7
            if b < 128:
                return x

    while i < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 5:
            yield tag >> 3, data[i : i + 4]
            i += 4
        elif kind == 1:
            yield tag >> 3, data[i : i + 8]
            i += 8
        else:
            n = varint()
            yield tag >> 3, data[i : i + n]
            i += n


@dataclass
class Model:
    """Pieces of a model file with their merges."""

    pieces: list[str]
    kinds: np.ndarray
    rank: np.ndarray
    left: np.ndarray
    right: np.ndarray
    usable: np.ndarray
    pairs: np.ndarray
    made: np.ndarray
    bytes_from: int
    kept: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"kept": {}}


def load(path: str) -> Model:
    pieces, scores, kinds, bpe, plain = [], [], [], False, {}
    with open(path, "rb") as f:
        data = f.read()
    for number, value in _fields(data):
        if number == 1:
            p = dict(_fields(value))
            pieces.append(p[1].decode())
            scores.append(float(np.frombuffer(p[2], "<f4")[0]) if 2 in p else 0.0)
            kinds.append(p.get(3, NORMAL))
        elif number == 2:
            bpe = dict(_fields(value)).get(3) == 2
        elif number == 3:
            plain = dict(_fields(value))
    kinds = np.array(kinds)
    if not bpe or plain.get(1) != b"identity" or plain.get(4, 1) or not (kinds == BYTE).sum() == 256:
        raise ValueError("needs a BPE model with byte fallback, without normalisation")
    ids = {p: i for i, p in enumerate(pieces) if kinds[i] == NORMAL}
    order = np.argsort(-np.array(scores), kind="stable")
    rank = np.empty(len(pieces), np.int64)
    rank[order] = np.arange(len(pieces))
    left, right = np.full(len(pieces) + 1, -1), np.full(len(pieces) + 1, -1)
    usable = np.zeros(len(pieces), bool)
    pairs, made = [], []
    for p, i in ids.items():
        if set(p) == {MARK} and len(p) > 1:
            continue  # runs of the blank mark are merged apart
        if MARK in p[1:]:
            raise ValueError("needs a model whose pieces hold the blank mark at their start alone")
        for j in range(1, len(p)):
            if (a := ids.get(p[:j])) is not None and (b := ids.get(p[j:])) is not None:
                pairs.append(a * len(pieces) + b)
                made.append(i)
        parts = list(p)
        last = None
        while len(parts) > 1:
            best = min(((rank[k], j) for j in range(len(parts) - 1) if (k := ids.get(parts[j] + parts[j + 1])) is not None), default=None)
            if best is None:
                break
            j = best[1]
            last = (ids[parts[j]], ids[parts[j + 1]]) if parts[j] in ids and parts[j + 1] in ids else None
            parts[j : j + 2] = [parts[j] + parts[j + 1]]
        if len(parts) == 1 and (len(p) == 1 or last):
            usable[i] = True
            if last:
                left[i], right[i] = last
    pairs, made = np.array(pairs), np.array(made)
    order = np.argsort(pairs)
    rank = np.r_[rank, -1]
    if any((rank[np.maximum(x[:-1], 0)][usable] > rank[:-1][usable])[(x[:-1] >= 0)[usable] & (left[np.maximum(x[:-1], 0)] >= 0)[usable]].any() for x in (left, right)):
        raise ValueError("needs a model whose pieces are merged after their parts")
    return Model(pieces, kinds, rank, left, right, usable, pairs[order], made[order], int(np.flatnonzero(kinds == BYTE)[0]))


def may_follow(m: Model, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether no merge crosses the boundary between pieces a and b (len(pieces): an unknown character).

    Merges are undone from the latest on. While x (at the end of a) and y (at the start of b)
    both stood, their own merge came first if its rank is lower than those that took x and y
    away; of equal ranks the left one came first.
    """
    n = len(m.pieces)
    ok = np.ones(len(a), bool)
    live = np.arange(len(a))
    x, y = a.copy(), b.copy()
    gone_x, gone_y = np.full(len(a), n + 1), np.full(len(a), n + 1)
    while len(live):
        key = x * n + y
        i = np.minimum(np.searchsorted(m.pairs, key), len(m.pairs) - 1)
        met = (m.pairs[i] == key) & (x < n) & (y < n)
        r = m.rank[m.made[i]]
        crossed = met & (r < gone_x) & (r <= gone_y)
        ok[live[crossed]] = False
        rx, ry = np.where(m.left[x] >= 0, m.rank[x], -1), np.where(m.left[y] >= 0, m.rank[y], -1)
        on = ~crossed & ((rx >= 0) | (ry >= 0))
        live, x, y, gone_x, gone_y, rx, ry = (v[on] for v in (live, x, y, gone_x, gone_y, rx, ry))
        undo = rx > ry  # of equal ranks the right one was made later
        gone_x, gone_y = np.where(undo, rx, gone_x), np.where(undo, gone_y, ry)
        x, y = np.where(undo, m.right[x], x), np.where(undo, y, m.left[y])
    return ok


class Follows:
    """may_follow for one pair at a time, from plain lists; answers are kept."""

    def __init__(self, m: Model):
        self.n = len(m.pieces)
        self.merged = dict(zip(m.pairs.tolist(), m.rank[m.made].tolist(), strict=True))
        self.left, self.right, self.rank = m.left.tolist(), m.right.tolist(), m.rank.tolist()
        self.kept: dict[tuple[int, int], bool] = {}

    def __call__(self, a: int, b: int) -> bool:
        ok = self.kept.get((a, b))
        if ok is None:
            if len(self.kept) >= KEPT:
                self.kept.clear()
            ok = self.kept[a, b] = self._parted(a, b)
        return ok

    def _parted(self, x: int, y: int) -> bool:
        n = self.n
        gone_x = gone_y = n + 1
        while True:
            r = self.merged.get(x * n + y) if x < n and y < n else None
            if r is not None and r < gone_x and r <= gone_y:
                return False
            rx = self.rank[x] if self.left[x] >= 0 else -1
            ry = self.rank[y] if self.left[y] >= 0 else -1
            if rx < 0 and ry < 0:
                return True
            if rx > ry:
                gone_x, x = rx, self.right[x]
            else:
                gone_y, y = ry, self.left[y]


class Matcher:
    """The pieces of a model as keys for bisection."""

    def __init__(self, m: Model):
        self.follows = Follows(m)
        self.ids = np.flatnonzero(m.usable)
        coded = [m.pieces[i].encode() for i in self.ids]
        self.size = np.array([len(p) for p in coded])
        self.chars = np.array([len(m.pieces[i]) for i in self.ids])
        self.low = np.array([int.from_bytes(p[:8].ljust(8, b"\0"), "big") for p in coded], np.uint64)
        self.high = np.array([int.from_bytes(p[:8].ljust(8, b"\xff"), "big") for p in coded], np.uint64)
        self.rest = [np.frombuffer(p[8:], np.uint8) for p in coded]

    def edges(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of a suffix in at, piece's number here): all occurrences of all pieces."""
        eight = np.ndarray((len(raw) - 7,), ">u8", raw.data, strides=(1,))[at].astype(np.uint64)
        order = np.argsort(eight, kind="stable")  # the suffix array, to eight bytes
        eight = eight[order]
        lo, hi = np.searchsorted(eight, self.low, "left"), np.searchsorted(eight, self.high, "right")
        n = hi - lo
        piece = np.repeat(np.arange(len(n)), n)
        suffix = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
        long = np.flatnonzero(self.size[piece] > 8)
        good = np.ones(len(piece), bool)
        for j in range(8, int(self.size.max(initial=0))):
            long = long[self.size[piece[long]] > j]
            if not len(long):
                break
            want = np.array([r[j - 8] if len(r) > j - 8 else 0 for r in self.rest], np.uint8)[piece[long]]
            good[long[raw[np.minimum(at[suffix[long]] + j, len(raw) - 1)] != want]] = False
            long = long[good[long]]
        return suffix[good], piece[good]


def _relax_one_by_one(follows: Follows, start: np.ndarray, end: np.ndarray, ids: np.ndarray, step: np.ndarray, last: np.ndarray, back: np.ndarray) -> None:
    """Relaxes edges by their ends, one after the other."""
    order = np.argsort(end, kind="stable")
    reached: dict[int, int] = {}
    for s, e, i, inner in zip(start[order].tolist(), end[order].tolist(), ids[order].tolist(), (step[start[order]] > 1).tolist(), strict=True):
        if inner:
            before = reached.get(s - 1)
            if before is None or not follows(before, i):
                continue
        reached[e] = i
        last[e], back[e] = i, s


def encode_words(m: Model, matcher: Matcher, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words in a row, and the bounds of each word's ids. No word holds a zero byte or is empty."""
    raw = np.frombuffer(b"\0".join(words) + b"\0" * 64, np.uint8)
    sizes = np.array([len(w) for w in words], np.int64)
    begin = np.cumsum(sizes + 1) - sizes - 1
    body = raw[: begin[-1] + sizes[-1] + 1]
    at = np.flatnonzero(((body & 0xC0) != 0x80) & (body != 0))  # characters
    word = np.searchsorted(begin, at, "right") - 1
    first = np.searchsorted(at, begin)
    n_chars = np.diff(np.r_[first, len(at)])
    step = np.arange(len(at)) - first[word] + 1  # characters up to and with this one
    suffix, piece = matcher.edges(raw, at)
    known = np.zeros(len(at), bool)
    known[suffix[matcher.chars[piece] == 1]] = True
    alone = np.flatnonzero(~known)
    start = np.r_[suffix, alone]
    ids = np.r_[matcher.ids[piece], np.full(len(alone), len(m.pieces))]
    end = start + np.r_[matcher.chars[piece], np.ones(len(alone), np.int64)] - 1  # the last character's number
    last, back = np.full(len(at), -1), np.full(len(at), -1)
    drawn = n_chars[word[end]] > DRAWN_OUT  # a step for each character is too dear for a few words alone
    if drawn.any():
        _relax_one_by_one(matcher.follows, start[drawn], end[drawn], ids[drawn], step, last, back)
        start, end, ids = start[~drawn], end[~drawn], ids[~drawn]
    order = np.argsort(step[end], kind="stable")
    start, end, ids = start[order], end[order], ids[order]
    cuts = np.searchsorted(step[end], np.arange(1, min(int(n_chars.max()), DRAWN_OUT) + 2))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        s, e, i = start[lo:hi], end[lo:hi], ids[lo:hi]
        inner = step[s] > 1
        before = last[np.maximum(s - 1, 0)]
        ok = ~inner
        at_inner = np.flatnonzero(inner & (before >= 0))
        ok[at_inner] = may_follow(m, before[at_inner], i[at_inner])
        last[e[ok]], back[e[ok]] = i[ok], s[ok]
    # Walk back from the ends of all words at once.
    ends = first + n_chars - 1
    places, owners, found = [], [], []
    node, own = ends, np.arange(len(words))
    while len(node):
        places.append(back[node])
        owners.append(own)
        found.append(last[node])
        more = step[back[node]] > 1
        node, own = back[node][more] - 1, own[more]
    places, owners, found = (np.concatenate(v) for v in (places, owners, found))
    order = np.lexsort((places, owners))
    places, owners, found = places[order], owners[order], found[order]
    unknown = found == len(m.pieces)
    width = np.where(unknown, np.diff(np.r_[at, len(body)])[places], 1)
    # A character's bytes end where the next begins or at the zero behind the word.
    tail = unknown & (raw[at[places] + np.maximum(width - 1, 0)] == 0)
    width[tail] -= 1
    out = np.repeat(found, width)
    which = np.repeat(np.arange(len(found)), width)
    offset = np.arange(len(out)) - np.repeat(np.cumsum(width) - width, width)
    u = unknown[which]
    out[u] = m.bytes_from + raw[at[places[which[u]]] + offset[u]]
    return out, np.r_[0, np.cumsum(np.bincount(owners, width, len(words)).astype(np.int64))]


def _blank_runs(m: Model) -> dict[int, int]:
    return {len(p): i for i, p in enumerate(m.pieces) if set(p) == {MARK} and m.kinds[i] == NORMAL}


class Encoder:
    """Encodes batches; keeps what words and gaps it has seen."""

    def __init__(self, m: Model):
        self.m, self.matcher, self.runs = m, Matcher(m), _blank_runs(m)
        self.mark = self.runs[1]
        self.clear()

    def clear(self) -> None:
        self.slots: dict[int, int] = {}
        self.parts: list[np.ndarray] = []
        self.bounds: list[np.ndarray] = []
        self.base = self.count = 0
        self.gaps: dict[tuple[bytes, bool], tuple[int, ...]] = {}

    def gap(self, g: bytes) -> tuple[int, ...]:
        """Ids of blanks, tabs and line ends."""
        out: list[int] = []
        i = 0
        while i < len(g):
            if g[i] != 0x20:
                out.append(self.m.bytes_from + g[i])
                i += 1
                continue
            n = len(g[i:]) - len(g[i:].lstrip(b" "))
            i += n
            row: list[int] = []
            for _ in range(n):  # equal ranks: the leftmost two that are a piece are merged first
                k = 1
                while row and row[-1] + k in self.runs:
                    k += row.pop()
                row.append(k)
            out += [self.runs[k] for k in row]
        return tuple(out)

    def _learn(self, keys: np.ndarray, words: Words, at: np.ndarray, marked: np.ndarray) -> None:
        new = [(int(k), int(i), bool(b)) for k, i, b in zip(keys.tolist(), at.tolist(), marked.tolist(), strict=True) if k not in self.slots]
        if not new:
            return
        texts, whole = [], []
        for _, i, b in new:
            w = words.word(i)
            parts = ((_MARK_BYTES if b else b"") + w).split(b"\0")
            texts += [p for p in parts if p]
            whole.append(parts)
        ids, bounds = np.zeros(0, np.int32), np.zeros(1, np.int64)
        for i in range(0, len(texts), TOGETHER):
            more, ends = encode_words(self.m, self.matcher, texts[i : i + TOGETHER])
            ids, bounds = np.concatenate([ids, more.astype(np.int32)]), np.r_[bounds, bounds[-1] + ends[1:]]
        if any(len(p) > 1 for p in whole):  # zero bytes stand between what the lattice holds
            zero, flat, ends, t = np.array([self.m.bytes_from]), [], [0], 0
            for parts in whole:
                row = []
                for j, p in enumerate(parts):
                    if j:
                        row.append(zero)
                    if p:
                        row.append(ids[bounds[t] : bounds[t + 1]])
                        t += 1
                flat += row
                ends.append(ends[-1] + sum(map(len, row)))
            ids, bounds = np.concatenate(flat), np.array(ends)
        for j, (k, _, _) in enumerate(new):
            self.slots[k] = self.count + j
        self.count += len(new)
        self.parts.append(ids.astype(np.int32))
        self.bounds.append(bounds[:-1] + self.base)
        self.base += len(ids)

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the bounds of each text's ids."""
        text = pc.replace_substring(pc.fill_null(text, ""), MARK, " ")
        w = Words(text, _IN_WORD)
        n = len(w.starts)
        if len(self.slots) > KEPT:
            self.clear()
        owner = w.owner()
        is_first = np.zeros(n, bool)
        is_first[w.first[:-1][w.count > 0]] = True
        before = np.where(is_first, w.offsets[:-1][owner], np.r_[0, w.ends[:-1]] if n else 0)
        plain_space = w.raw[np.maximum(w.starts - 1, 0)] == 0x20
        marked = np.where(w.starts == before, is_first, plain_space)  # the mark is added before each text
        key = mix(w.hashes() + marked.astype(np.uint64)).view(np.int64)
        unique, at, slot = distinct(key)
        self._learn(unique, w, at, marked[at])
        table, bounds = np.concatenate(self.parts) if self.parts else np.zeros(0, np.int32), np.r_[np.concatenate(self.bounds), self.base] if self.bounds else np.zeros(1, np.int64)
        self.parts, self.bounds = [table], [bounds[:-1]]
        slot = np.array([self.slots[k] for k in unique.tolist()], np.int64)[slot] if n else np.zeros(0, np.int64)
        begin, size = bounds[slot], bounds[slot + 1] - bounds[slot] if n else np.zeros(0, np.int64)
        bare = marked & (table[begin] == self.mark) if n else marked
        # The gap before each word: its blanks but the word's own, unless that stayed alone.
        gap_of = np.zeros(n, np.int64)
        simple = (w.starts - before == 1) & plain_space & ~is_first & ~bare
        gaps, gap_ids = [()], {(): 0}

        def known(ids: tuple[int, ...]) -> int:
            if ids not in gap_ids:
                gap_ids[ids] = len(gaps)
                gaps.append(ids)
            return gap_ids[ids]

        def coded(g: bytes, drop: bool) -> int:
            ids = self.gaps.get((g, drop))
            if ids is None:
                ids = self.gap(g[:-1] if drop else g)
                if len(self.gaps) < KEPT and len(g) < 64:
                    self.gaps[g, drop] = ids
            return known(ids)

        first_plain = is_first & (w.starts == before) & ~bare
        for i in np.flatnonzero(~(simple | first_plain)).tolist():
            g = w.raw[before[i] : w.starts[i]].tobytes()
            gap_of[i] = coded(b" " + g if is_first[i] else g, bool(marked[i] and not bare[i]))
        begin, size = begin + bare, size - bare
        # Behind the last word of each text, or all of a text without words.
        tail_from = np.where(w.count > 0, np.r_[w.ends, 0][np.maximum(w.first[1:] - 1, 0)], w.offsets[:-1])
        tail_of = np.zeros(w.n, np.int64)
        for i in np.flatnonzero(tail_from < w.offsets[1:]).tolist():
            g = w.raw[tail_from[i] : w.offsets[i + 1]].tobytes()
            tail_of[i] = coded(g if w.count[i] else b" " + g, False)
        gap_table = np.array([x for g in gaps for x in g], np.int32)
        gap_bounds = np.r_[0, np.cumsum([len(g) for g in gaps])].astype(np.int64)
        shift = len(gap_table)
        # Units in order: gap and word for each word, the tail for each text.
        place = np.arange(n) * 2 + owner
        u_begin, u_size = np.zeros(2 * n + w.n, np.int64), np.zeros(2 * n + w.n, np.int64)
        u_begin[place], u_size[place] = gap_bounds[gap_of], np.diff(gap_bounds)[gap_of]
        u_begin[place + 1], u_size[place + 1] = begin + shift, size
        tail = w.first[1:] * 2 + np.arange(w.n)
        u_begin[tail], u_size[tail] = gap_bounds[tail_of], np.diff(gap_bounds)[tail_of]
        total = np.cumsum(u_size)
        ids = np.concatenate([gap_table, table])[np.arange(int(u_size.sum())) - np.repeat(total - u_size, u_size) + np.repeat(u_begin, u_size)]
        return ids, np.r_[0, total[tail]]


class Decoder:
    """Pieces to text: marks become blanks, byte pieces bytes; the blank added before each text goes."""

    def __init__(self, m: Model):
        coded = []
        for i, p in enumerate(m.pieces):
            kind = m.kinds[i]
            coded.append(bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else p.replace(MARK, " ").encode())
        self.table = np.frombuffer(b"".join(coded), np.uint8)
        self.size = np.array([len(c) for c in coded], np.int64)
        self.begin = np.cumsum(self.size) - self.size

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        size = self.size[ids]
        total = np.cumsum(size)
        out = self.table[np.arange(int(size.sum())) - np.repeat(total - size, size) + np.repeat(self.begin[ids], size)].tobytes()
        ends = np.r_[0, total][bounds]
        return [(t := out[a:b])[t.startswith(b" ") :] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


_encoder: Encoder | None = None


def _worker(sent) -> Encoder:
    """One encoder for each Python worker and model."""
    global _encoder
    m = sent.value
    if _encoder is None or _encoder.m is not m:
        _encoder = Encoder(m)
    return _encoder


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, text): ids of every whole text, and what they decode to."""
    docs = documents(docs)
    sent = docs.sparkSession.sparkContext.broadcast(load(path))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _worker(sent)
        decoder = Decoder(encoder.m)
        for b in batches:
            for c in chunks(b):
                ids, bounds = encoder.encode(c.column("text"))
                texts = decoder.decode(ids, bounds)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([c.column("doc_id"), lists, pa.array([t.decode("utf-8", "replace") for t in texts])], ["doc_id", "ids", "text"])

    return docs.mapInArrow(task, "doc_id long, ids array<int>, text string")


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, n_bytes, round_trip): round_trip tells that the ids decode to the text."""
    docs = documents(docs)
    sent = docs.sparkSession.sparkContext.broadcast(load(path))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _worker(sent)
        decoder = Decoder(encoder.m)
        for b in batches:
            for c in chunks(b):
                ids, bounds = encoder.encode(c.column("text"))
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                texts = decoder.decode(ids, bounds)
                same = [t == s.as_buffer().to_pybytes().replace(_MARK_BYTES, b" ") for t, s in zip(texts, c.column("text"), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [c.column("doc_id"), pa.array(np.diff(bounds)), pa.array(crc, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(same)],
                    ["doc_id", "n_tokens", "ids_crc32", "n_bytes", "round_trip"],
                )

    return docs.mapInArrow(task, "doc_id long, n_tokens long, ids_crc32 long, n_bytes long, round_trip boolean")
