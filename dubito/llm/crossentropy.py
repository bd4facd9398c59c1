"""Language-model scores by cross-entropy difference (Moore and Lewis, 2010).

Two bigram models, of target documents and of all documents (the background), share one
vocabulary (all words of the corpus and one sign for the start of a text), all pairs of
neighbours, one discount and one smoothing; the background's counts are scaled to the
target's size, so neither is smoothed more than the other. A document's score is the mean
over its words of the target's loss less the background's: the lower, the more it is like
the target.

    P(b | a) = max(c(a b) - D, 0) / n(a) + rest(a) * (c(b) + s) / (N + s * words)

Words and pairs are counted over all documents and none is left out. The counts live in a
table dealt by ranges of the key's hash (buckets), which grows with the corpus; documents are
dealt by doc_id into groups of ``GROUP`` bytes of text or so. A group sends each bucket its own
distinct keys, sorted, with their counts, and gets the corpus's totals back in the same order,
so answers carry no keys. That happens twice: for words and pairs, then for the words before
(how many words follow each, and what the discount leaves), where one group of those that hold
a pair answers for it. The text is dealt out once and read three times; no model, and nothing
but the number of bytes, reaches the driver. A key has one row for each group at most, whatever
its frequency.

Defined results: null and empty texts have n_tokens 0 and null scores; without target words
every score is 0; rows with a null doc_id are left out; rows that repeat a doc_id get a row
each, and are all target if one of that id is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import documents
from .text import ALNUM, Words, chunks, join

DISCOUNT, SMOOTH = 0.7, 0.1
#: Bytes of text of a group of documents; groups grow with the root of the input from LARGE on, to four times as much.
GROUP, LARGE = 8 << 20, 1 << 36
#: Stands before the first word of a text.
START = np.uint64(1)
_WORD, _CONTEXT, _TOTAL, _WORDS = (np.uint64(x) for x in (0x5851F42D4C957F2D, 0x14057B7EF767814F, 3, 5))
_KINDS = [("kind", pa.int32()), ("bucket", pa.int64()), ("group", pa.int64()), ("first", pa.int64()), ("keys", pa.binary()), ("values", pa.list_(pa.binary()))]
_MESSAGES, MESSAGE = pa.schema(_KINDS), "kind int, bucket long, group long, first long, keys binary, values array<binary>"
_SCORES = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), *((c, pa.float64()) for c in ("target_loss", "background_loss"))])


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers by planes of bytes, the lowest first, as many as the largest needs, packed by zstd."""
    width = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
    planes = np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return bytes([width]) + len(x).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    width, n = data[0], int.from_bytes(data[1:9], "little")
    planes = np.zeros((n, 8), np.uint8)
    planes[:, :width] = np.frombuffer(pa.decompress(data[9:], width * n, "zstd"), np.uint8).reshape(width, n).T
    return planes.view("<u8").ravel()


class Group:
    """The words of a group of documents: rows, and for each word the one before it, its document, and the places of both keys."""

    def __init__(self, docs: pa.Table):
        word, before, owner, doc, count, rows = [], [], [], [], [], 0
        for c in chunks(docs):
            w = Words(pc.utf8_lower(pc.fill_null(c.column("text"), "")), ALNUM)
            h = w.hashes()
            b = np.r_[START, h[:-1]] if len(h) else h
            b[w.first[:-1][w.count > 0]] = START
            word.append(h)
            before.append(b)
            owner.append(w.owner() + rows)
            doc.append(c.column("doc_id").to_numpy())
            count.append(w.count)
            rows += w.n
        gather = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.doc, self.count = gather(doc, np.int64), gather(count, np.int64)
        self.owner, self.before = gather(owner, np.int64).astype(np.int32), gather(before, np.uint64)
        word, n = gather(word, np.uint64), len(self.owner)
        #: distinct keys of pairs, of words and of the total, ascending, and the place of each word's
        pairs, pair = np.unique(join(self.before, word), return_inverse=True)
        words, word = np.unique(join(word, np.broadcast_to(_WORD, n)), return_inverse=True)
        keys = np.r_[pairs, words, _TOTAL][: len(pairs) + len(words) + (n > 0)]
        order = np.argsort(keys)
        self.keys, place = keys[order], np.empty(len(keys), np.int32)
        place[order] = np.arange(len(keys), dtype=np.int32)
        self.pair, self.word, self.total = place[: len(pairs)][pair], place[len(pairs) :][word], place[-1:]

    def contexts(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys of the words before and of the vocabulary's size, ascending, and the place of each word's; the size's is the last."""
        n = len(self.before)
        return np.unique(np.r_[join(self.before, np.broadcast_to(_CONTEXT, n)), _WORDS][: n + (n > 0)], return_inverse=True)


def _messages(kind: int, group: int, buckets: int, keys: np.ndarray, values: list[np.ndarray]) -> pa.Table:
    """A row for each bucket: the first key, the steps to the others, and their values."""
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    head = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(keys) else np.zeros(0, np.int64)
    rows = [(int(bucket[a]), int(keys[a : a + 1].view(np.int64)[0]), _packed(np.diff(keys[a:z])), [_packed(v[a:z]) for v in values]) for a, z in zip(head.tolist(), np.r_[head[1:], len(keys)][: len(head)].tolist(), strict=True)]
    b, first, steps, values = zip(*rows, strict=True) if rows else ((),) * 4
    n = len(rows)
    return pa.Table.from_arrays([pa.array([kind] * n, pa.int32()), pa.array(b, pa.int64()), pa.array([group] * n, pa.int64()), pa.array(first, pa.int64()), pa.array(steps, pa.binary()), pa.array(values, pa.list_(pa.binary()))], schema=_MESSAGES)


def _total(sent: pa.Table) -> pa.Table:
    """Answers to a bucket's messages: sums over the corpus in the order of each message's keys, then whose key it is (1 for one group of all)."""
    sent = sent.sort_by("group")
    keys, values = [], []
    for first, steps, v in zip(sent.column("first").to_pylist(), sent.column("keys").to_pylist(), sent.column("values").to_pylist(), strict=True):
        step = _unpacked(steps)
        keys.append(np.cumsum(np.r_[np.array([first]).view(np.uint64), step], dtype=np.uint64))
        values.append([_unpacked(x) for x in v])
    size = np.array([len(k) for k in keys])
    unique, place, of = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    own = np.zeros(len(of), np.uint64)
    own[place] = 1
    del keys
    sums = [np.bincount(of, np.concatenate(v), len(unique))[of] for v in zip(*values, strict=True)]
    ends = np.cumsum(size)
    answers = [[_packed(x[z - n : z]) for x in (*sums, own)] for n, z in zip(size.tolist(), ends.tolist(), strict=True)]
    none = [b""] * len(size)
    return pa.Table.from_arrays([sent.column("kind"), sent.column("bucket"), sent.column("group"), sent.column("first"), pa.array(none, pa.binary()), pa.array(answers, pa.list_(pa.binary()))], schema=_MESSAGES)


def totals(messages: DataFrame) -> DataFrame:
    return messages.groupBy("bucket").applyInArrow(_total, MESSAGE)


def _answers(got: pa.Table, kind: int) -> list[np.ndarray]:
    """The values of all answers of one kind, in the order of the group's keys."""
    got = got.filter(pc.equal(got.column("kind"), kind)).sort_by("bucket")
    rows = [[_unpacked(x) for x in v] for v in got.column("values").to_pylist()]
    return [np.concatenate(x).astype(float) for x in zip(*rows, strict=True)]


class Counts:
    """What a group knows of the corpus after the first exchange: (target, background) counts of its words and distinct pairs."""

    def __init__(self, group: Group, got: pa.Table):
        total, target, self.own = _answers(got, 0)
        at = group.total[0]
        self.n_target = target[at]
        self.scale = target[at] / max(total[at], 1)
        #: by place of the key
        self.raw = np.stack([target, total])
        self.counts = np.stack([target, total * self.scale])


def _counted(docs: pa.Table, target: pa.Table, group: int, buckets: int) -> pa.Table:
    g = Group(docs)
    if not len(g.keys):
        return _messages(0, group, buckets, g.keys, [])
    is_target = np.isin(g.doc, target.column("doc_id").to_numpy())[g.owner]
    n, t = np.zeros(len(g.keys)), np.zeros(len(g.keys))
    for at in (g.pair, g.word):
        n += np.bincount(at, minlength=len(n))
        t += np.bincount(at, is_target, len(n))
    n[g.total], t[g.total] = len(g.owner), is_target.sum()
    return _messages(0, group, buckets, g.keys, [n, t])


def _followed(docs: pa.Table, got: pa.Table, group: int, buckets: int) -> pa.Table:
    g = Group(docs)
    if not len(g.keys):
        return _messages(1, group, buckets, g.keys, [])
    c = Counts(g, got)
    keys, at = g.contexts()
    # Each distinct pair that is this group's to answer for, with the place of the word before.
    pair, first = np.unique(g.pair, return_index=True)
    mine = c.own[pair] > 0
    pair, of = pair[mine], at[first[mine]]
    # What the discount takes: from a scaled count of one or more the whole of it, else in proportion to the count.
    full = c.counts >= 1
    values = [np.bincount(of, x[pair], len(keys)) for x in (*c.raw, full[0], full[1], np.where(full[1], 0, c.raw[1]))]
    values[0][at[-1]] = c.own[np.unique(g.word)].sum()  # words of the vocabulary
    return _messages(1, group, buckets, keys, values)


def _scored(docs: pa.Table, got: pa.Table) -> pa.Table:
    g = Group(docs)
    if not len(g.keys):
        none = pa.nulls(len(g.doc), pa.float64())
        return pa.Table.from_arrays([pa.array(g.doc), pa.array(g.count), none, none], schema=_SCORES)
    c = Counts(g, got)
    _, at = g.contexts()
    n_target, n_all, full_target, full_all, part = _answers(got, 1)[:5]
    words, at = n_target[at[-1]], at[:-1]
    means = []
    for k, (n, off) in enumerate(((n_target, full_target), (n_all * c.scale, full_all + part * c.scale))):
        count, n = c.counts[k], n[at]
        stored = np.maximum(count - DISCOUNT * np.minimum(count, 1), 0)[g.pair] / np.maximum(n, 1e-12)
        left = np.where(n > 0, np.maximum(DISCOUNT * off[at] / np.maximum(n, 1e-300), 1e-9), 1.0)
        loss = -np.log(stored + left * (count[g.word] + SMOOTH) / (c.n_target + SMOOTH * words))
        means.append(np.bincount(g.owner, loss, len(g.doc)) / np.maximum(g.count, 1))
    empty = g.count == 0
    return pa.Table.from_arrays([pa.array(g.doc), pa.array(g.count), *(pa.array(m, mask=empty) for m in means)], schema=_SCORES)


def score_documents(docs: DataFrame, target: DataFrame, size: int | None = None) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score): mean losses of each whole text and their difference.

    target: doc_id of the target documents. size: bytes of a group (GROUP).
    """
    docs = documents(docs)
    n = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    size = size or int(GROUP * min(4.0, max(1.0, (n / LARGE) ** 0.5)))
    groups = max(1, -(-n // size))
    buckets = -(-groups // 2)
    of = F.pmod(F.xxhash64("doc_id"), F.lit(groups)).alias("group")
    docs = docs.select(of, "doc_id", "text")
    wanted = target.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().select(of, "doc_id")

    def number(x: pa.Table, y: pa.Table) -> int:
        return next(int(t.column("group")[0].as_py()) for t in (x, y) if t.num_rows)

    def counted(left: pa.Table, right: pa.Table) -> pa.Table:
        return _counted(left, right, number(left, right), buckets)

    def followed(left: pa.Table, right: pa.Table) -> pa.Table:
        return _followed(left, right, number(left, right), buckets)

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        return _scored(left, right)

    by_group = docs.groupBy("group")
    counts = totals(by_group.cogroup(wanted.groupBy("group")).applyInArrow(counted, MESSAGE))
    contexts = totals(by_group.cogroup(counts.groupBy("group")).applyInArrow(followed, MESSAGE))
    rows = by_group.cogroup(counts.union(contexts).groupBy("group")).applyInArrow(scored, "doc_id long, n_tokens long, target_loss double, background_loss double")
    return rows.withColumn("score", F.col("target_loss") - F.col("background_loss"))
