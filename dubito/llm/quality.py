"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are grown in numpy on the driver, on the statistics of at most ``SAMPLE`` labelled
documents (a bounded sample, by the hash of doc_id), and scored as flat arrays over the
statistics of every whole text.

Defined results: null and empty texts have the statistics of an empty text; where
labels hold no two classes, every score is the share of label 1, or 0.5 without
labels; rows with a null doc_id are left out; rows that repeat a doc_id get a row each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import documents
from .shared import bounded_sample, held_out, one_text, sample_labels
from .text import Words, chunks, mix

#: Labelled rows to learn from, at most.
SAMPLE = 20_000

STATISTICS = (
    "log_bytes", "log_words", "log_lines", "word_length", "word_length_sd", "long_words", "one_letter_words",
    "upper", "lower", "digits", "marks", "other_bytes", "newlines", "exclamations", "bars", "hash_signs",
    "dollar_signs", "ampersands", "percents", "stars", "full_stops", "commas", "distinct_words",
    "commonest_word", "repeated_lines", "words_a_line", "capital_words", "byte_entropy", "repeated_pairs",
)


def _class(*ranges) -> np.ndarray:
    m = np.zeros(256, bool)
    for lo, hi in ranges:
        m[lo : hi + 1] = True
    return m


_UPPER, _LOWER, _DIGIT, _OTHER = _class((65, 90)), _class((97, 122)), _class((48, 57)), _class((128, 255))
_MARK = _class((33, 47), (58, 64), (91, 96), (123, 126))


def _repeat_share(owner: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each document's items: the share that are first of their kind, the share of the commonest."""
    total = np.bincount(owner, minlength=n)
    distinct, commonest = np.ones(n), np.zeros(n)
    if len(h):
        key = mix(h + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        k, o = key[order], owner[order]
        heads = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        sizes, own = np.diff(np.r_[heads, len(k)]), o[heads]
        many = total > 0
        distinct[many] = np.bincount(own, minlength=n)[many] / total[many]
        np.maximum.at(commonest, own, sizes)
        commonest[many] /= total[many]
    return distinct, commonest


_NOT_NEWLINE = np.ones(256, bool)
_NOT_NEWLINE[10] = False


def statistics(text: pa.Array) -> np.ndarray:
    """One row of STATISTICS for each text."""
    w = Words(text)
    n, raw, size = w.n, w.raw[: w.size], np.diff(w.offsets).astype(float)
    per_byte = np.maximum(size, 1)
    doc_of_byte = np.repeat(np.arange(n, dtype=np.int64), np.diff(w.offsets))
    counts = np.bincount(doc_of_byte * 256 + raw, minlength=n * 256).reshape(n, 256).astype(float)
    share = counts / per_byte[:, None]
    owner, words = w.owner(), w.count.astype(float)
    per_word = np.maximum(words, 1)
    length = (w.ends - w.starts).astype(float)
    mean = np.bincount(owner, length, n) / per_word
    square = np.bincount(owner, length**2, n) / per_word
    h = w.hashes()
    distinct, commonest = _repeat_share(owner, h, n)
    pair = owner[1:] == owner[:-1] if len(owner) else np.zeros(0, bool)
    pairs, _ = _repeat_share(owner[:-1][pair], mix(h[:-1] * np.uint64(3) + h[1:])[pair], n)
    lines = Words(text, _NOT_NEWLINE)
    line_owner = lines.owner()
    whole_lines, _ = _repeat_share(line_owner, lines.hashes(), n)
    per_line = np.maximum(lines.count, 1)
    capital = np.bincount(owner, _UPPER[w.raw[w.starts]], n) / per_word
    with np.errstate(divide="ignore", invalid="ignore"):
        entropy = -np.where(share > 0, share * np.log(share), 0).sum(1)
    at = lambda c: counts[:, ord(c)] / per_word
    columns = [
        np.log1p(size), np.log1p(words), np.log1p(lines.count), mean, np.sqrt(np.maximum(square - mean**2, 0)),
        np.bincount(owner, length > 15, n) / per_word, np.bincount(owner, length == 1, n) / per_word,
        share[:, _UPPER].sum(1), share[:, _LOWER].sum(1), share[:, _DIGIT].sum(1), share[:, _MARK].sum(1),
        share[:, _OTHER].sum(1), share[:, 10], at("!"), at("|"), at("#"), at("$"), at("&"), at("%"), at("*"),
        at("."), at(","), distinct, commonest, 1 - whole_lines, words / per_line, capital, entropy, 1 - pairs,
    ]
    return np.stack(columns, 1).astype(np.float32)


@dataclass
class Trees:
    """Boosted trees as flat arrays. A leaf points at itself."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int

    def logit(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            out += self.value[at]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logit(x)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 2.0, least: int = 8) -> Trees:
    """Boosts regression trees on the logistic loss, with gradients summed in histograms of quantile bins."""
    share = y.mean() if len(y) else 0.5
    empty = np.zeros(0, np.int64)
    if not len(y) or not 0 < share < 1:
        return Trees(float(np.log(np.clip(share, 1e-3, 0.999) / (1 - np.clip(share, 1e-3, 0.999)))) if len(y) else 0.0, empty, np.zeros(0, np.float32), empty, empty, np.zeros(0), empty, depth)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])).astype(np.float32) for c in x.T]
    binned = np.stack([np.searchsorted(q, c, "left") for q, c in zip(cuts, x.T, strict=True)], 1)
    n, m = binned.shape
    base = float(np.log(share / (1 - share)))
    logit = np.full(n, base)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node() -> int:
        i = len(feature)
        for a, v in ((feature, 0), (threshold, np.inf), (left, i), (right, i), (value, 0.0)):
            a.append(v)
        return i

    shift = np.arange(m) * bins
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-logit))
        g, h = p - y, p * (1 - p)
        roots.append(node())
        open_nodes = [(roots[-1], np.arange(n))]
        for level in range(depth + 1):
            following = []
            for i, rows in open_nodes:
                gs, hs = g[rows].sum(), h[rows].sum()
                value[i] = -rate * gs / (hs + ridge)
                if level == depth or len(rows) < 2 * least:
                    logit[rows] += value[i]
                    continue
                flat = (binned[rows] + shift).ravel()
                gh, hh, ch = (np.cumsum(np.bincount(flat, np.repeat(v, m), m * bins).reshape(m, bins), 1)[:, :-1] for v in (g[rows], h[rows], np.ones(len(rows))))
                gain = gh**2 / (hh + ridge) + (gs - gh) ** 2 / (hs - hh + ridge) - gs**2 / (hs + ridge)
                gain[(ch < least) | (len(rows) - ch < least)] = -1
                f, b = divmod(int(gain.argmax()), bins - 1)
                if gain[f, b] <= 1e-6 or b >= len(cuts[f]):
                    logit[rows] += value[i]
                    continue
                feature[i], threshold[i] = f, cuts[f][b]
                left[i], right[i] = node(), node()
                low = binned[rows, f] <= b
                following += [(left[i], rows[low]), (right[i], rows[~low])]
            open_nodes = following
    return Trees(base, np.array(feature), np.array(threshold, np.float32), np.array(left), np.array(right), np.array(value), np.array(roots), depth)


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, stats): the statistics of every whole text."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b):
                x = statistics(c.column("text"))
                stats = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([c.column("doc_id"), stats], ["doc_id", "stats"])

    return documents(docs).mapInArrow(task, "doc_id long, stats array<float>")


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Fits on at most ``sample`` labelled documents that are not held out."""
    ids = bounded_sample(sample_labels(labels, "quality"), sample)
    # ids has ``sample`` rows at most, and a doc_id gives one row, however many hold it.
    chosen = documents(docs).join(F.broadcast(ids.select("doc_id")), "doc_id", "left_semi")
    rows = document_statistics(one_text(chosen)).toPandas().merge(ids.toPandas(), on="doc_id")
    rows = rows.assign(first=rows["stats"].map(lambda x: x[0] if len(x) else 0)).sort_values(["doc_id", "first"])
    x = np.stack(rows["stats"].to_numpy()).astype(np.float32) if len(rows) else np.zeros((0, len(STATISTICS)), np.float32)
    return fit(x, rows["label"].to_numpy().astype(float))


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; predicted is 1 from 0.5 on."""
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, sample))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b):
                yield pa.RecordBatch.from_arrays([c.column("doc_id"), pa.array(sent.value.score(statistics(c.column("text"))).astype(float))], ["doc_id", "score"])

    scored = documents(docs).mapInArrow(task, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs, all columns, that the classifier doesn't reject. No text is shuffled.

    Rows with a null doc_id are judged like others.
    """
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, sample))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b):
                yield c.filter(pa.array(sent.value.score(statistics(c.column("text"))) >= 0.5))

    return docs.mapInArrow(task, docs.schema)
