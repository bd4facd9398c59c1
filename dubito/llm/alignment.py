"""Alignment of two tokenizers' tokens over the bytes they cover.

A (byte-level BPE) encodes a blank and the text, B (SentencePiece BPE) the text, before which it puts a
blank itself, so both cover the same bytes. Each byte gets a label: no token ends there, one of A does, one
of B does, or both do. A regular expression scans the label string and takes spans up to each label of
both; the labels counted in a span tell how many tokens of A and of B the group has. Every byte with a
label ends one stretch that lies in one token of A and one of B: these are the links.

Texts are cut before a blank that stands between characters that aren't blank. No token of either
crosses such a place (``load`` checks what that rests on), so the distinct stretches of a chunk of documents
(``CHUNK`` bytes of text, or one longer document) are encoded and scanned once each, and what is known
of them is put together by document. Stretches are told apart by 64 bits.

How often an id pair is linked in the corpus: a chunk sends its distinct pairs with their counts, these
are summed by pair, and the sums, with the mark of those that are their B id's highest, go back to
the chunks that hold the pair. Rows sent follow the chunks' distinct pairs, so they grow in proportion to
the input; the highest of each B id are as many as the vocabulary at most and are broadcast. What
waits in between is written to the shared folder, and a chunk's number is part of what is written, so
that a task run again can't change it.

Defined results: null and empty texts have no tokens, nor have texts whose tokens don't give back the
bytes (with U+2581 in them, which B reads as a blank): zeros and the empty string; they count for no pair. A text of
any length is one chunk at least, in memory by itself. Equal counts are all highest. Repeated rows are
documents of their own; rows with a null doc_id get a row too. An empty table gives an empty one; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain
from operator import methodcaller

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pieces
from .shared import cut, scratch
from .text import Words, chunks, distinct

CHUNK = 4 << 20
#: Stretches encoded at once.
TOGETHER = 1 << 14
#: Labels of a byte: neither, A, B, both.
LABELS = np.frombuffer(b".ab+", np.uint8)
_GROUP = re.compile(rb"[^+]*\+")
_MARK = "▁"
#: Bytes before which, and after which, a blank may be cut: no white space of ASCII, no lead byte of other white space.
_BEFORE = np.ones(256, bool)
_BEFORE[[*range(0x21), 0x7F]] = False
_AFTER = _BEFORE.copy()
_AFTER[[*range(0x80, 0xC3), 0xE1, 0xE2, 0xE3]] = False


def _plain_bytes() -> dict[str, int]:
    """The byte for each character of a byte-level vocabulary: printable ones stand for themselves, the others for 256 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Vocabularies:
    """The two vocabulary files, as they are sent to the tasks."""

    a: str
    b: bytes
    kept: list = field(default_factory=list, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"kept": []}

    def aligner(self) -> Aligner:
        """One for each Python worker."""
        if not self.kept:
            self.kept.append(Aligner(self))
        return self.kept[0]


def load(path_a: str, path_b: str) -> Vocabularies:
    """Reads the files and checks that tokens cover bytes as they stand and don't cross a blank between other characters."""
    pieces.load(path_b)  # BPE with byte fallback, no normalisation
    with open(path_a, encoding="utf-8") as f:
        a = f.read()
    with open(path_b, "rb") as f:
        b = f.read()
    spec = json.loads(a)
    split = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or spec["model"].get("type") != "BPE":
        raise ValueError("A must be a byte-level BPE without normalisation, split by the usual pattern")
    found = Vocabularies(a, b)
    if any(_MARK in p.lstrip(_MARK) for p in found.aligner().pieces):
        raise ValueError("B must have no piece with a blank after another character")
    return found


class Aligner:
    def __init__(self, vocabularies: Vocabularies):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(vocabularies.a)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_proto=vocabularies.b)
        plain, named = _plain_bytes(), self.a.get_vocab(with_added_tokens=True)
        self.of_a = [b""] * (max(named.values()) + 1)
        for token, i in named.items():
            self.of_a[i] = bytes(plain[c] for c in token) if all(c in plain for c in token) else token.encode()
        n = self.b.get_piece_size()
        self.pieces = [self.b.id_to_piece(i) for i in range(n)]
        self.of_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_MARK, " ").encode() for i, p in enumerate(self.pieces)]
        self.length_a, self.length_b = (np.array([len(t) for t in x]) for x in (self.of_a, self.of_b))
        #: An id in decimal before a comma, before the other tokenizer's ids, at the end of its group.
        self.told = [f"{i}{end}".encode() for i in range(max(len(self.of_a), n)) for end in ",|;"]
        self.told_length = np.array([len(t) for t in self.told])

    def codes(self, texts: list[bytes]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and of B of stretches, each of which begins with a blank."""
        a, b = [], []
        for i in range(0, len(texts), TOGETHER):
            own = [t.decode() for t in texts[i : i + TOGETHER]]
            a += [e.ids for e in self.a.encode_batch_fast(own, add_special_tokens=False)]
            b += self.b.encode([t[1:] for t in own], num_threads=1)
        return a, b

    def aligned(self, texts: list[bytes]) -> Stretches:
        a, b = self.codes(texts)
        ok = np.ones(len(texts), bool)
        length = np.fromiter(map(len, texts), np.int64, len(texts))
        for ids, of, lengths in ((a, self.of_a, self.length_a), (b, self.of_b, self.length_b)):
            flat, n = _flat(ids)
            covered = np.r_[0, np.cumsum(lengths[flat])][np.cumsum(n)]
            if not np.array_equal(np.diff(covered, prepend=0), length) or b"".join(map(of.__getitem__, flat.tolist())) != b"".join(texts):
                ok &= [b"".join(map(of.__getitem__, x)) == t for t, x in zip(texts, ids, strict=True)]
        at = np.flatnonzero(ok)
        return Stretches(ok, at, [a[i] for i in at], [b[i] for i in at], self)


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids in a row, and how many each list has."""
    n = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum())), n


class Stretches:
    """What is known of stretches: n_a, n_b, n_groups, n_links and the groups as text for each (zeros and none where it isn't ok), links of all in a row."""

    def __init__(self, ok: np.ndarray, at: np.ndarray, a: list[list[int]], b: list[list[int]], by: Aligner):
        self.ok = ok
        self.n_a, self.n_b, self.n_groups, self.n_links = (np.zeros(len(ok), np.int64) for _ in range(4))
        (ids_a, self.n_a[at]), (ids_b, self.n_b[at]) = _flat(a), _flat(b)
        ends_a, ends_b = np.cumsum(by.length_a[ids_a]), np.cumsum(by.length_b[ids_b])
        label = np.zeros(int(ends_a[-1]) if len(ends_a) else 0, np.uint8)
        label[ends_a - 1] |= 1
        label[ends_b - 1] |= 2
        spans = _GROUP.findall(LABELS[label].tobytes())
        end, in_a, in_b = (np.fromiter(map(f, spans), np.int64, len(spans)) for f in (len, methodcaller("count", b"a"), methodcaller("count", b"b")))
        end, in_a, in_b = np.cumsum(end), in_a + 1, in_b + 1  # the label that ends a span counts for both
        place = np.flatnonzero(label)
        ends = label[place] & 1, label[place] >> 1
        self.links = ids_a[np.cumsum(ends[0]) - ends[0]] << 32 | ids_b[np.cumsum(ends[1]) - ends[1]] if len(place) else np.zeros(0, np.int64)
        # A stretch is as long as its tokens of A.
        size = np.r_[0, ends_a][np.r_[0, np.cumsum(self.n_a[at])]]
        self.n_links[at] = np.diff(np.searchsorted(place, size))
        self.n_groups[at] = np.diff(np.searchsorted(end, size, "right"))
        # Groups as text: each id with what follows it, in the order of groups, A's before B's.
        upto_a, upto_b = np.cumsum(in_a), np.cumsum(in_b)
        token = np.empty(len(ids_a) + len(ids_b), np.int64)
        token[np.arange(len(ids_a)) + np.repeat(upto_b - in_b, in_a)] = 3 * ids_a
        token[np.arange(len(ids_b)) + np.repeat(upto_a, in_b)] = 3 * ids_b
        token[upto_a + upto_b - in_b - 1] += 1
        token[upto_a + upto_b - 1] += 2
        size = np.r_[0, np.cumsum(by.told_length[token])][np.r_[0, np.cumsum(self.n_a[at] + self.n_b[at])]]
        told = b"".join(map(by.told.__getitem__, token.tolist()))
        self.text: list[bytes] = [b""] * len(ok)
        for k, i, j in zip(at.tolist(), size[:-1].tolist(), size[1:].tolist(), strict=True):
            self.text[k] = told[i : j - 1]


class _Cut(Words):
    """A chunk's documents, a blank before each, cut into stretches."""

    def __init__(self, column: pa.Array):
        text = pc.fill_null(column, "").cast(pa.large_string())
        super().__init__(pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), text, pa.scalar("", pa.large_string())))
        raw, n = self.raw, self.size
        inner = np.flatnonzero(raw[:n] == 0x20)
        inner = inner[(inner > 0) & (inner < n - 1)]
        inner = inner[_BEFORE[raw[inner - 1]] & _AFTER[raw[inner + 1]]]
        # A document begins with its own blank, so what follows one's end is no blank's neighbour.
        self.starts = np.union1d(self.offsets[:-1], inner)
        self.ends = np.r_[self.starts[1:], n]
        self.first = np.searchsorted(self.starts, self.offsets)
        self.count = np.diff(self.first)


def packed(codes: np.ndarray) -> bytes:
    """Sorted numbers as differences, one plane of bytes after the other, as many as there must be."""
    step = np.diff(codes, prepend=0).astype("<u4")
    planes = step.view(np.uint8).reshape(-1, 4).T
    n = next((4 - i for i in range(4) if planes[3 - i].any()), 1)
    return bytes([n]) + planes[:n].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.int64)
    n = data[0]
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(n, -1)
    return np.cumsum(sum(p.astype(np.int64) << 8 * i for i, p in enumerate(planes)))


_PLAN = "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, units binary, pairs array<long>, counts array<long>, of_unit binary"
_FIELDS = ["chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "units", "pairs", "counts", "of_unit"]
_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _chunk_rows(c: pa.RecordBatch, number: int, by: Aligner) -> Iterator[pa.RecordBatch]:
    """A row for each document of the chunk, and one for the chunk: its distinct pairs, their counts, and which of them each stretch holds."""
    w = _Cut(c.column("text"))
    _, first, code = distinct(w.hashes())
    known = by.aligned([w.word(i) for i in first.tolist()])
    begin = w.first[:-1]
    ok = (np.diff(w.offsets) > 1) & np.logical_and.reduceat(known.ok[code], begin)
    counted = code[np.repeat(ok, w.count)]
    often = np.bincount(counted, minlength=len(first))
    # The most frequent stretches get the lowest numbers.
    order = np.argsort(-often, kind="stable")[: int((often > 0).sum())]
    rank = np.full(len(first), -1)
    rank[order] = np.arange(len(order))
    at = np.cumsum(known.n_links) - known.n_links
    n = known.n_links[order]
    take = np.repeat(at[order] - np.cumsum(n) + n, n) + np.arange(n.sum())
    pairs, pair = np.unique(known.links[take], return_inverse=True)
    counts = np.zeros(len(pairs), np.int64)
    np.add.at(counts, pair, np.repeat(often[order], n))
    facts = [np.where(ok, np.add.reduceat(x[code], begin), 0) for x in (known.n_a, known.n_b, known.n_groups, known.n_links)]
    digests, units = [], []
    for good, i, j in zip(ok.tolist(), begin.tolist(), w.first[1:].tolist(), strict=True):
        own = code[i:j]
        digests.append(hashlib.sha256(b";".join(map(known.text.__getitem__, own.tolist()))).hexdigest() if good else "")
        units.append(packed(np.sort(rank[own])) if good else b"")
    docs, none = len(ok), pa.nulls(len(ok), pa.list_(pa.int64()))
    chunk = pa.array(np.full(docs, number))
    yield pa.RecordBatch.from_arrays([chunk, c.column("doc_id"), *map(pa.array, facts), pa.array(digests, pa.string()), pa.array(units, pa.binary()), none, none, pa.nulls(docs, pa.binary())], _FIELDS)
    held = np.r_[len(n), n, pair].astype("<u4").tobytes()
    lists = [pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), pa.array(x, pa.int64())) for x in (pairs, counts)]
    yield pa.RecordBatch.from_arrays([chunk[:1], *(pa.nulls(1, pa.int64()) for _ in range(5)), pa.nulls(1, pa.string()), pa.nulls(1, pa.binary()), *lists, pa.array([held], pa.binary())], _FIELDS)


def _answered(held: pa.Table, totals: pa.Table) -> pa.Table:
    """The documents of one chunk with what the corpus says of their links."""
    whole = pc.is_valid(held.column("of_unit"))
    docs, facts = held.filter(pc.invert(whole)), held.filter(whole)
    packed_, (n_units, *_) = (x := np.frombuffer(facts.column("of_unit")[0].as_py(), "<u4").astype(np.int64)), x[:1]
    n, pair = packed_[1 : 1 + n_units], packed_[1 + n_units :]
    order = np.argsort(totals.column("pair").to_numpy())
    total, best = totals.column("total").to_numpy()[order], totals.column("best").to_numpy()[order].astype(np.int64)
    begin = np.cumsum(n) - n
    sums = np.array([np.add.reduceat(x[pair], begin) if len(n) else x[:0] for x in (total, best)])
    units = [unpacked(x) for x in docs.column("units").to_pylist()]
    found = np.array([sums[:, u].sum(1) for u in units], np.int64).reshape(-1, 2)
    out = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"]).append_column("n_best", pa.array(found[:, 1]))
    return out.append_column("count_sum", pa.array(found[:, 0])).append_column("groups_sha256", docs.column("groups_sha256"))


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document.

    n_best: links whose pair is its B id's most frequent in the corpus; count_sum: the pairs' counts summed
    over links; groups_sha256: of the ids by group, ``a1,a2|b1;a3|b2,b3``.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(load(path_a, path_b))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
        by, number = sent.value.aligner(), TaskContext.get().partitionId() << 32
        for b in batches:
            for c in chunks(b, size=CHUNK):
                yield from _chunk_rows(c, number, by)
                number += 1

    folder = scratch(spark, "alignment")
    texts.mapInArrow(encode, _PLAN).write.option("compression", "zstd").parquet(f"{folder}/held")
    held = spark.read.parquet(f"{folder}/held")
    pairs = held.where("pairs is not null").select("chunk", F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("counts").alias("count"))))
    totals = cut(pairs.groupBy("pair").agg(F.sum("count").alias("total")))
    b_id = F.col("pair").bitwiseAND(0xFFFFFFFF)
    highest = totals.groupBy(b_id.alias("b")).agg(F.max("total").alias("most"))  # no more rows than B has ids
    known = totals.join(F.broadcast(highest), b_id == F.col("b")).select("pair", "total", (F.col("total") == F.col("most")).alias("best"))
    back = pairs.select(F.col("chunk").alias("owner"), "pair").join(known.hint("merge"), "pair")
    schema = pa.schema([("owner", pa.int64()), ("pair", pa.int64()), ("total", pa.int64()), ("best", pa.bool_())])

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        return _answered(left, right if right.num_columns else schema.empty_table())

    return held.drop("pairs", "counts").groupBy("chunk").cogroup(back.groupBy("owner")).applyInArrow(answer, _RESULT)
