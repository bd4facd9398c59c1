"""Token-ID output compressed by Re-Pair grammars.

Texts are dealt by ranges of doc_id and encoded with a public vocabulary; each document ends
with ``END``. A shard holds the ids of consecutive documents, ``SHARD`` ids or so. Within a
shard frequent pairs of neighbouring symbols are replaced by nonterminals again and again, until
none stands ``LEAST`` times (less in short shards) or no symbol is left. A round counts the pairs
of the whole shard, takes the ``RULES`` most frequent at once and replaces them from left to
right; classic Re-Pair takes one a round, which would be thousands of passes. Ids, rules and symbols fit 16 bits, or 32 if the vocabulary asks for it.

A shard's bytes (little-endian):

    "RPG1", flags uint32 (bytes a symbol)
    n_rules, n_docs, n_ids, n_symbols, terminals: uint64 each
    rules: left and right symbol of each nonterminal, numbered from ``terminals`` on
    lengths: uint32, the ids that each rule expands to
    doc_ids: int64
    ends: uint64, ids up to the end of each document
    marks: uint64, ids before each block of ``MARKS`` symbols, for random access
    symbols
    crc32 of all before: uint32

The files are Parquet with one shard a row, so any store that Spark writes to will do.

Defined results: null texts are empty and hold END alone; rows that repeat a doc_id stand one
after the other by text; rows with a null doc_id are left out; a document of more than
``SHARD`` ids has a shard of its own.
"""

from __future__ import annotations

import itertools
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import documents
from .shared import scratch
from .text import Words, chunks, distinct

END = 2
SHARD = 1 << 22
MARKS = 1024
#: Positions counted at once, the least count of a pair, rules a round may add.
STRETCH, LEAST, RULES = 1 << 17, 24, 2600
KEPT = 1 << 20
_SLOTS = 19
_HEAD = struct.Struct("<4sIQQQQQ")


def _pairs(s: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place, pairs, their slots) of all neighbours, a stretch at a time, so that little is held besides the symbols."""
    kind, bits = (np.uint32, 16) if s.dtype == np.uint16 else (np.uint64, 32)
    for i in range(0, len(s) - 1, STRETCH):
        part = s[i : i + STRETCH + 1]
        pair = part[:-1].astype(kind)
        pair <<= bits
        pair |= part[1:]
        yield i, pair, _slot(pair)


def _counted(s: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(pairs, counts) of all pairs of neighbours that stand ``least`` times or more."""
    size = np.zeros(1 << _SLOTS, np.int64)  # what falls into one slot is an upper bound of each of its pairs
    for _, _, slot in _pairs(s):
        size += np.bincount(slot, minlength=len(size))
    often = size >= least
    parts = [np.unique(pair[often[slot]], return_counts=True) for _, pair, slot in _pairs(s)]
    seen, of = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
    n = np.bincount(of, np.concatenate([c for _, c in parts]), len(seen)).astype(np.int64)
    return seen[n >= least], n[n >= least]


def _places(s: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, numbers of the pairs) of chosen pairs, which fall into a slot each."""
    of = np.full(1 << _SLOTS, -1, np.int32)
    of[_slot(chosen)] = np.arange(len(chosen))
    places, numbers = [], []
    for i, pair, slot in _pairs(s):
        rule = of[slot]
        at = np.flatnonzero(rule >= 0)
        at = at[chosen[rule[at]] == pair[at]]
        places.append(at + i)
        numbers.append(rule[at])
    return np.concatenate(places), np.concatenate(numbers)


def compress(ids: np.ndarray, terminals: int, rounds: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, rules): the ids with frequent pairs replaced, until none is frequent or no symbol is left (or for so many rounds)."""
    bits, kind = (16, np.uint16) if terminals < 1 << 16 else (32, np.uint32)
    room = (1 << 16 if bits == 16 else 1 << 31) - terminals
    s, rules, n_rules = ids.astype(kind), [np.zeros((0, 2), np.int64)], 0
    near, before = None, 0
    for _ in itertools.count() if rounds is None else range(rounds):
        most, least = min(RULES, room - n_rules), min(LEAST, max(2, len(s) >> 12))
        if len(s) < 2 or not most:
            break
        if near is None or least < before:
            seen, n = _counted(s, least)
        else:  # every frequent pair was replaced: what is frequent now holds a symbol of the last round
            near = np.unique(near[(near >= 0) & (near < len(s) - 1)])
            pair = s[near].astype(np.int64) << bits | s[near + 1]
            seen, n = np.unique(pair, return_counts=True)
            seen, n = seen[n >= least], n[n >= least]
        if not len(seen):
            break
        take = np.sort(np.argsort(-n, kind="stable")[:most])
        if near is None or least < before:
            # One pair of a slot at most, the most frequent; others wait for the next round.
            own = _slot(seen[take])
            order = np.lexsort((-n[take], own))
            chosen = seen[take][np.sort(order[np.r_[True, own[order][1:] != own[order][:-1]]])]
            at, rule = _places(s, chosen)
        else:
            chosen = seen[take]
            rule = np.minimum(np.searchsorted(chosen, pair), len(chosen) - 1)
            hit = chosen[rule] == pair
            at, rule = near[hit], rule[hit]
        # Of overlapping places every other one is replaced, from the left.
        run = np.flatnonzero(np.r_[True, np.diff(at) > 1])
        odd = (np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))) & 1
        at, rule = at[odd == 0], rule[odd == 0]
        s[at] = terminals + n_rules + rule
        keep = np.ones(len(s), bool)
        keep[at + 1] = False
        s = s[keep]
        fresh = at - np.arange(len(at))
        near, before = (np.r_[fresh - 1, fresh] if len(chosen) == len(seen) else None), least
        chosen = chosen.astype(np.int64)
        rules.append(np.stack([chosen >> bits, chosen & ((1 << bits) - 1)], 1))
        n_rules += len(chosen)
    return s, np.concatenate(rules)


def _slot(pair: np.ndarray) -> np.ndarray:
    if pair.dtype == np.uint32:
        return (pair * np.uint32(0x9E3779B1) >> np.uint32(32 - _SLOTS)).view(np.int32)
    return (pair * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _SLOTS)).view(np.int64)


def _lengths(rules: np.ndarray, terminals: int) -> np.ndarray:
    n = np.ones(len(rules), np.int64)
    for i, (a, b) in enumerate(rules.tolist()):
        n[i] = (n[a - terminals] if a >= terminals else 1) + (n[b - terminals] if b >= terminals else 1)
    return n


def pack(doc_ids: np.ndarray, ends: np.ndarray, ids: np.ndarray, terminals: int) -> bytes:
    symbols, rules = compress(ids, terminals)
    width = "<u2" if terminals + len(rules) <= 1 << 16 else "<u4"
    lengths = _lengths(rules, terminals)
    blocks = np.add.reduceat(_sizes(symbols, lengths, terminals), np.arange(0, len(symbols), MARKS), dtype=np.int64) if len(symbols) else np.zeros(0, np.int64)
    marks = np.cumsum(blocks) - blocks
    body = b"".join(
        [
            _HEAD.pack(b"RPG1", int(width[-1]), len(rules), len(doc_ids), len(ids), len(symbols), terminals),
            rules.astype(width).tobytes(), lengths.astype("<u4").tobytes(), doc_ids.astype("<i8").tobytes(),
            ends.astype("<u8").tobytes(), marks.astype("<u8").tobytes(), symbols.astype(width).tobytes(),
        ]
    )
    return body + struct.pack("<I", zlib.crc32(body))


def _sizes(symbols: np.ndarray, lengths: np.ndarray, terminals: int) -> np.ndarray:
    """The ids that each symbol stands for."""
    return np.r_[np.ones(terminals, np.uint32), lengths.astype(np.uint32)][symbols]


def _gather(table: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Pieces of the table one after the other, so many at once that little is held besides the result."""
    parts = [table[:0]]
    for i in range(0, len(begin), STRETCH):
        n = size[i : i + STRETCH].astype(np.int64)
        at = np.repeat(begin[i : i + STRETCH] - np.cumsum(n) + n, n)
        at += np.arange(len(at))
        parts.append(table[at])
    return np.concatenate(parts)


class Shard:
    """A shard's bytes, opened for reading."""

    def __init__(self, data: bytes):
        if zlib.crc32(memoryview(data)[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("a shard's checksum doesn't hold")
        magic, width, n_rules, n_docs, self.n_ids, n_symbols, self.terminals = _HEAD.unpack_from(data)
        if magic != b"RPG1":
            raise ValueError("not a shard")
        at = _HEAD.size

        def read(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.rules = read(f"<u{width}", 2 * n_rules).reshape(-1, 2).astype(np.int64)
        self.lengths = read("<u4", n_rules).astype(np.int64)
        self.doc_ids = read("<i8", n_docs)
        self.ends = read("<u8", n_docs).astype(np.int64)
        self.marks = read("<u8", -(-n_symbols // MARKS)).astype(np.int64)
        self.symbols = read(f"<u{width}", n_symbols)
        #: what each nonterminal expands to, one after the other
        parts: list[np.ndarray] = []
        for a, b in self.rules.tolist():
            parts.append(np.concatenate([parts[x - self.terminals] if x >= self.terminals else np.array([x]) for x in (a, b)]))
        self.table = np.concatenate([*parts, np.arange(self.terminals)]).astype(np.uint32)
        self.begin = np.r_[np.cumsum(self.lengths) - self.lengths, len(self.table) - self.terminals + np.arange(self.terminals)]

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        rule = symbols.astype(np.int32) - self.terminals
        rule[rule < 0] += self.terminals + len(self.rules)
        return _gather(self.table, self.begin[rule], _sizes(symbols, self.lengths, self.terminals)).astype(np.int32)

    def ids(self) -> np.ndarray:
        return self._expand(self.symbols)

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document alone, from the blocks that hold them."""
        lo, hi = (int(self.ends[i - 1]) if i else 0), int(self.ends[i])
        first, last = np.searchsorted(self.marks, [lo, hi - 1], "right") - 1
        out = self._expand(self.symbols[first * MARKS : (last + 1) * MARKS])
        return out[lo - self.marks[first] : hi - self.marks[first]]


_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = 3
_KIND[0x30:0x3A] = 2
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1


class _Units(Words):
    """Words, in lower case if all ASCII, cut between ASCII letters, digits and marks.

    Words with an apostrophe (of a contraction) or a < (of a special token) stay whole.
    """

    def __init__(self, text: pa.Array):
        super().__init__(text)
        if not len(self.starts):
            return
        glued = self._holding((self.raw == 0x27) | (self.raw == 0x3C))
        # Other than ASCII is composed before it is lower-cased.
        as_is = glued | self._holding(self.raw >= 0x80)
        upper = np.flatnonzero((self.raw - np.uint8(0x41)) < 26)
        upper = upper[~as_is[np.searchsorted(self.starts, upper, "right") - 1]]
        self.raw[upper] += 32
        kind = _KIND[self.raw[: self.size]]
        cut = (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
        cut[self.starts[self.starts > 0] - 1] = False  # words of neighbouring texts
        if glued.any():
            cut &= ~self._bytes(glued)[1 : self.size]
        cut = np.flatnonzero(cut) + 1
        for name in ("starts", "ends"):
            mark = np.zeros(self.size + 1, bool)
            mark[getattr(self, name)] = mark[cut] = True
            setattr(self, name, np.flatnonzero(mark))
        self.first = np.searchsorted(self.starts, self.offsets)
        self.count = np.diff(self.first)

    def _holding(self, marked: np.ndarray) -> np.ndarray:
        """Marks the words that hold a marked byte. The bytes stand in words."""
        out = np.zeros(len(self.starts), bool)
        out[np.searchsorted(self.starts, np.flatnonzero(marked), "right") - 1] = True
        return out

    def _bytes(self, words: np.ndarray) -> np.ndarray:
        """Marks the bytes of the marked words."""
        step = np.zeros(len(self.raw), np.int8)
        step[self.starts[words]] = 1
        step[self.ends[words]] -= 1
        return np.cumsum(step, dtype=np.int8) > 0


class WordEncoder:
    """Encodes texts by words and marks with the tokenizers library; keeps what it has seen.

    Exact for vocabularies that lower-case, drop white space and part letters, digits and marks
    before they merge, as the one this is for: no piece crosses a cut.
    """

    def __init__(self, spec: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        special = sorted((i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not (t.lstrip or t.rstrip or t.single_word))
        #: a special token, to set between words that are encoded at once
        self.between = special[-1] if special else None
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.slots: dict[int, int] = {}
        self.table = np.array([END], np.int32)  # then the ids of each word
        self.bounds = np.ones(1, np.int64)

    def _coded(self, words: list[str], together: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each has."""
        code = lambda texts: [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        joined = "\n".join(words)
        if self.between is None or any(t in joined for t in self.specials):
            rows = code(words)
            return np.array([x for r in rows for x in r], np.int32), np.fromiter(map(len, rows), np.int64, len(rows))
        number, mark = self.between
        ids = np.array([x for r in code([mark.join(words[i : i + together]) + mark for i in range(0, len(words), together)]) for x in r], np.int32)
        at = np.flatnonzero(ids == number)
        return ids[ids != number], np.diff(np.r_[-1, at]) - 1

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, END behind each, and the end of each text's ids."""
        w = _Units(text)
        if len(self.slots) > KEPT:
            self.clear()
        unique, at, slot = distinct(w.hashes())
        own = np.fromiter(map(self.slots.get, unique.tolist(), itertools.repeat(-1)), np.int32, len(unique))
        if len(new := np.flatnonzero(own < 0)):
            raw = w.raw.tobytes()
            table, sizes = self._coded([raw[a:b].decode("utf-8", "replace") for a, b in zip(w.starts[at[new]].tolist(), w.ends[at[new]].tolist(), strict=True)])
            own[new] = np.arange(len(self.slots), len(self.slots) + len(new))
            self.slots.update(zip(unique[new].tolist(), own[new].tolist(), strict=True))
            self.table = np.concatenate([self.table, table])
            self.bounds = np.r_[self.bounds, self.bounds[-1] + np.cumsum(sizes)]
        slot = own[slot]
        begin, size = self.bounds[slot], self.bounds[slot + 1] - self.bounds[slot]
        # a unit for each word, and one behind each text for END
        place = np.arange(len(slot)) + w.owner()
        u_begin, u_size = np.zeros(len(slot) + w.n, np.int64), np.ones(len(slot) + w.n, np.int64)
        u_begin[place], u_size[place] = begin, size
        total = np.cumsum(u_size)
        return _gather(self.table, u_begin, u_size), total[w.first[1:] + np.arange(w.n)] if w.n else np.zeros(0, np.int64)


_worker: WordEncoder | None = None


def _encoder(sent) -> WordEncoder:
    global _worker
    if _worker is None or _worker.spec is not sent.value:
        _worker = WordEncoder(sent.value)
        _worker.spec = sent.value
    return _worker


def write_ids(docs: DataFrame, vocabulary: str, folder: str, shard: int = SHARD) -> None:
    """Writes the ids of all documents, by ascending doc_id, as shards to a folder that Spark reaches."""
    with open(vocabulary, encoding="utf-8") as f:
        spec = f.read()
    from tokenizers import Tokenizer

    terminals = Tokenizer.from_str(spec).get_vocab_size(with_added_tokens=True)
    sent = docs.sparkSession.sparkContext.broadcast(spec)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = _encoder(sent), TaskContext.get().partitionId()
        before = seq = held = 0
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            nonlocal before, seq, held
            ids = np.concatenate([k[1] for k in kept])
            shift = np.cumsum([0, *(len(k[1]) for k in kept[:-1])])
            data = pack(np.concatenate([k[0] for k in kept]), np.concatenate([k[2] + s for k, s in zip(kept, shift, strict=True)]), ids, terminals)
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "before": [before], "n_ids": [len(ids)], "data": pa.array([data], pa.binary())})
            before, seq, held = before + len(ids), seq + 1, 0
            kept.clear()
            return row

        for b in batches:
            for c in chunks(b):
                ids, ends = encoder.encode(c.column("text"))
                if held and held + len(ids) > shard:
                    yield flush()
                kept.append((c.column("doc_id").to_numpy(), ids, ends))
                held += len(ids)
        if kept:
            yield flush()

    rows = documents(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(task, "part int, seq int, before long, n_ids long, data binary").write.mode("errorifexists").parquet(folder)


def read_ids(spark, folder: str) -> DataFrame:
    """(doc_id, start, ids) from the shards; start counts the ids of all documents before."""
    return _read(spark, folder, False)


def read_digests(spark, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), each from the ids that the shards decode to."""
    return _read(spark, folder, True)


def _read(spark, folder: str, digest: bool) -> DataFrame:
    shards = spark.read.parquet(folder)
    # One number for each partition that was written.
    totals = sorted(map(tuple, shards.groupBy("part").agg(F.sum("n_ids")).collect()))
    first, base = {}, 0
    for part, n in totals:
        first[part], base = base, base + n

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, before, data in zip(b.column("part").to_pylist(), b.column("before").to_pylist(), b.column("data"), strict=True):
                s = Shard(data.as_buffer().to_pybytes())
                ids, begin = s.ids(), np.r_[0, s.ends[:-1]]
                start = pa.array(begin + first[part] + before)
                if digest:
                    raw = ids.astype("<u4").tobytes()
                    crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(begin.tolist(), s.ends.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(s.doc_ids), start, pa.array(s.ends - begin), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                else:
                    lists = pa.ListArray.from_arrays(pa.array(np.r_[begin, len(ids)], pa.int32()), pa.array(ids, pa.int32()))
                    yield pa.RecordBatch.from_arrays([pa.array(s.doc_ids), start, lists], ["doc_id", "start", "ids"])

    return shards.mapInArrow(task, "doc_id long, start long, " + ("n_tokens long, ids_crc32 long" if digest else "ids array<int>"))


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Writes the ids of docs to the shared folder and reads their digests back."""
    spark = docs.sparkSession
    folder = f"{scratch(spark, 'ids')}/shards"
    write_ids(docs, vocabulary, folder)
    return read_digests(spark, folder)
