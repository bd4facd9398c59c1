"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as its own embedding (by hash) beside the mean of its character trigrams'
embeddings, so that unseen words are known by their spelling. Two gated recurrent passes
read a window of ``WINDOW`` words; attention pools their states to one logit. A document's
score is that of its worst window: windows start every ``STRIDE`` words, the last ends with
the text, and all are scored, whatever the text's length.

The network learns on the driver from at most ``SAMPLE`` labelled texts (a bounded sample by
the hash of doc_id, toxic and clean ones apart). Of texts of more than ``TEXT`` bytes it sees
windows of that size in sum, chosen by hash over the whole text. For each text the gradient
runs through its worst window.

Defined results: texts without words score 0; without labels of both kinds every score is 0;
rows with a null doc_id are left out; rows that repeat a doc_id get a row each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import documents
from .shared import bounded_sample, held_out, one_text, sample_labels
from .text import ALNUM, Words, chunks, distinct, mix

WINDOW, STRIDE = 32, 16
#: Labelled texts to learn from, (toxic, clean), and bytes of each, at most.
SAMPLE, TEXT = (1200, 4000), 1 << 16
THRESHOLD = 0.7
#: Texts of the sample that a word must stand in to have an embedding of its own; buckets of trigrams.
FREQUENT, GRAMS = 5, 1 << 12
EMBED, HIDDEN, ATTEND = 10, 10, 10
BATCH = 4096
LEAST_STEPS = 150
DECAY = 0.01
HIDE, HIDE_RARE = 0.25, 0.8
ODDS = 0.5


class Inputs:
    """Distinct words of a chunk with their buckets and trigrams, and the windows of its texts."""

    def __init__(self, text: pa.Array):
        w = Words(pc.utf8_lower(pc.fill_null(text, "")), ALNUM)
        self.n = w.n
        unique, at, self.word = distinct(w.hashes())
        self.unique = unique
        # trigrams of the word with a blank at either end
        size = (w.ends - w.starts)[at]
        total = np.cumsum(size)
        within = np.arange(int(size.sum())) - np.repeat(total - size, size)
        place = np.repeat(w.starts[at], size) + within
        first, last = within == 0, within == np.repeat(size, size) - 1
        byte = w.raw.astype(np.uint64)
        before = np.where(first, 32, byte[np.maximum(place - 1, 0)])
        after = np.where(last, 32, byte[place + 1])
        code = before | byte[place] << np.uint64(8) | after << np.uint64(16)
        self.gram = (mix(code) >> np.uint64(64 - 12)).astype(np.int64)
        self.gram_at, self.gram_n = total - size, size
        # windows: (text, first word); the last one of a text ends with it
        count = w.count
        many = np.where(count > WINDOW, -(-(count - WINDOW) // STRIDE) + 1, (count > 0).astype(np.int64))
        self.text_of = np.repeat(np.arange(w.n), many)
        step = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        self.start = w.first[:-1][self.text_of] + np.minimum(step * STRIDE, np.maximum(count - WINDOW, 0)[self.text_of])
        self.length = np.minimum(count, WINDOW)[self.text_of]

    def windows(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word numbers, which of them are there) of some windows."""
        at = np.arange(WINDOW)
        there = at < self.length[rows][:, None]
        return self.word[np.where(there, self.start[rows][:, None] + at, 0)], there


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Network:
    def __init__(self, words: np.ndarray, seed: int = 7):
        """words: sorted hashes of the words with an embedding of their own."""
        self.words, g = words, np.random.default_rng(seed)
        new = lambda *s, by=0.3: g.normal(0, by, s).astype(np.float32)
        d, h = 2 * EMBED, HIDDEN
        self.p = {"word": new(len(words) + 1, EMBED, by=0.05), "gram": new(GRAMS, EMBED, by=0.3), "attend": new(2 * h, ATTEND), "attend_b": np.zeros(ATTEND, np.float32), "query": new(ATTEND), "out": new(2 * h), "out_b": np.array([-1], np.float32)}
        for way in "fb":
            self.p |= {f"in_{way}": new(d, 3 * h), f"rec_{way}": new(h, 3 * h), f"bias_{way}": np.zeros(3 * h, np.float32)}

    def number(self, x: Inputs) -> np.ndarray:
        """Number of the embedding of each distinct word of the chunk; the last one is for all others."""
        if not len(self.words):
            return np.zeros(len(x.unique), np.int64)
        i = np.minimum(np.searchsorted(self.words, x.unique), len(self.words) - 1)
        return np.where(self.words[i] == x.unique, i, len(self.words))

    def embed(self, x: Inputs) -> np.ndarray:
        """Inputs of the chunk's distinct words."""
        sums = np.add.reduceat(self.p["gram"][x.gram], x.gram_at, axis=0) if len(x.gram) else np.zeros((0, EMBED), np.float32)
        return np.concatenate([self.p["word"][self.number(x)], sums / x.gram_n[:, None].astype(np.float32)], 1)

    def _pass(self, way: str, projected: np.ndarray, there: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States after each word, in the order of the text. projected: (windows, words, 3 gates)."""
        n, t, h = len(projected), projected.shape[1], HIDDEN
        rec, state = self.p[f"rec_{way}"], np.zeros((n, h), np.float32)
        out = np.empty((t, n, h), np.float32)
        full = there.all()
        for i in range(t) if way == "f" else range(t - 1, -1, -1):
            a, g = projected[:, i], state @ rec
            zr = _sigmoid(a[:, : 2 * h] + g[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            c = np.tanh(a[:, 2 * h :] + r * g[:, 2 * h :])
            new = c + z * (state - c)
            if not full:
                new = np.where(there[:, i, None], new, state)
            if keep is not None:
                keep.append((i, state, z, r, c, g[:, 2 * h :]))
            out[i] = state = new
        return out

    def logits(self, tables: tuple[np.ndarray, np.ndarray], words: np.ndarray, there: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """One logit for each window, from the projected inputs of distinct words."""
        states = []
        for way, table in zip("fb", tables, strict=True):
            steps = [] if keep is not None else None
            states.append(self._pass(way, table[words], there, steps))
            if keep is not None:
                keep[way] = steps
        s = np.concatenate(states, 2)
        hidden = np.tanh(s @ self.p["attend"] + self.p["attend_b"])
        e = np.where(there.T, hidden @ self.p["query"], np.float32(-1e9))
        e = np.exp(e - e.max(0))
        weight = e / e.sum(0)
        pooled = np.einsum("tn,tnd->nd", weight, s)
        if keep is not None:
            keep |= {"s": s, "hidden": hidden, "weight": weight, "pooled": pooled}
        return pooled @ self.p["out"] + self.p["out_b"][0]

    def tables(self, inputs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(inputs @ self.p[f"in_{w}"] + self.p[f"bias_{w}"] for w in "fb")

    def scores(self, x: Inputs) -> np.ndarray:
        """The logit of each text's worst window; minus infinity for texts without words."""
        out = np.full(x.n, -np.inf)
        if not len(x.start):
            return out
        tables = self.tables(self.embed(x))
        for i in range(0, len(x.start), BATCH):
            rows = np.arange(i, min(i + BATCH, len(x.start)))
            np.maximum.at(out, x.text_of[rows], self.logits(tables, *x.windows(rows)))
        return out

    def gradients(self, x: Inputs, rows: np.ndarray, y: np.ndarray, weight: np.ndarray, drop: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted logistic loss of some windows. drop: what is hidden of each distinct word's input."""
        p, h = self.p, HIDDEN
        words, there = x.windows(rows)
        inputs = self.embed(x)
        inputs[drop] = 0
        keep: dict = {}
        logit = self.logits(self.tables(inputs), words, there, keep)
        d = ((1 / (1 + np.exp(-logit)) - y) * weight / weight.sum()).astype(np.float32)
        g = {"out": keep["pooled"].T @ d, "out_b": np.array([d.sum()])}
        d_pooled = d[:, None] * p["out"]
        s, w, hidden = keep["s"], keep["weight"], keep["hidden"]
        d_w = np.einsum("tnd,nd->tn", s, d_pooled)
        d_e = w * (d_w - (w * d_w).sum(0))
        g["query"] = np.einsum("tna,tn->a", hidden, d_e)
        d_hidden = d_e[..., None] * p["query"] * (1 - hidden**2)
        g["attend"], g["attend_b"] = np.einsum("tnd,tna->da", s, d_hidden), d_hidden.sum((0, 1))
        d_s = w[..., None] * d_pooled + d_hidden @ p["attend"].T
        d_inputs = np.zeros_like(inputs)
        for half, way in enumerate("fb"):
            rec, d_rec, d_state = p[f"rec_{way}"], np.zeros_like(p[f"rec_{way}"]), np.zeros((len(rows), h), np.float32)
            d_in, d_bias = np.zeros_like(p[f"in_{way}"]), np.zeros_like(p[f"bias_{way}"])
            for i, before, z, r, c, g_c in reversed(keep[way]):
                d_new = d_state + d_s[i, :, half * h : half * h + h]
                on = there[:, i, None]
                d_stay = np.where(on, 0, d_new)
                d_new = np.where(on, d_new, 0)
                d_c = d_new * (1 - z) * (1 - c**2)
                d_z = d_new * (before - c) * z * (1 - z)
                d_r = d_c * g_c * r * (1 - r)
                d_a = np.concatenate([d_z, d_r, d_c], 1)
                d_g = np.concatenate([d_z, d_r, d_c * r], 1)
                d_rec += before.T @ d_g
                d_state = d_stay + d_new * z + d_g @ rec.T
                d_in += inputs[words[:, i]].T @ d_a
                d_bias += d_a.sum(0)
                np.add.at(d_inputs, words[:, i], d_a @ p[f"in_{way}"].T)
            g |= {f"rec_{way}": d_rec, f"in_{way}": d_in, f"bias_{way}": d_bias}
        d_inputs[drop] = 0
        g["word"], g["gram"] = np.zeros_like(p["word"]), np.zeros_like(p["gram"])
        np.add.at(g["word"], self.number(x), d_inputs[:, :EMBED])
        used = np.flatnonzero(np.repeat(np.abs(d_inputs[:, EMBED:]).sum(1) > 0, x.gram_n))
        of = np.repeat(np.arange(len(x.gram_n)), x.gram_n)[used]
        np.add.at(g["gram"], x.gram[used], d_inputs[of, EMBED:] / x.gram_n[of][:, None].astype(np.float32))
        return g


def fit(texts: list[str], y: np.ndarray, epochs: int = 8, batch: int = 48, rate: float = 0.01, seed: int = 7) -> Network | None:
    """Learns from labelled texts; None without labels of both kinds."""
    if not 0 < y.mean() < 1 if len(y) else True:
        return None
    seen = [np.unique(Inputs(pa.array([t], pa.string())).unique) for t in texts]
    words, n = np.unique(np.concatenate(seen), return_counts=True)
    net, g = Network(words[n >= FREQUENT], seed), np.random.default_rng(seed)
    # A frequent word starts from its log odds between toxic and clean texts, as if it stood in two more of each.
    toxic, clean = (np.bincount(np.searchsorted(words, np.concatenate([*(s for s, v in zip(seen, y, strict=True) if v == k), words])), minlength=len(words)) + 1 for k in (1, 0))
    odds = np.log(toxic / ((y == 1).sum() + 4)) - np.log(clean / ((y == 0).sum() + 4))
    net.p["word"][:-1, 0] = ODDS * odds[n >= FREQUENT]
    first, second = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    weight = np.where(y == 1, max(1.0, 0.2 / y.mean()), 1.0)
    groups = max(1, len(texts) // batch)
    epochs = max(epochs, -(-LEAST_STEPS // groups))
    steps, turn = epochs * groups, 0
    for _ in range(epochs):
        for part in np.array_split(g.permutation(len(texts)), groups):
            x = Inputs(pa.array([texts[i] for i in part], pa.string()))
            if not len(x.start):
                continue
            tables, scores = net.tables(net.embed(x)), []
            for i in range(0, len(x.start), BATCH):
                scores.append(net.logits(tables, *x.windows(np.arange(i, min(i + BATCH, len(x.start))))))
            order = np.lexsort((-np.concatenate(scores), x.text_of))
            worst = order[np.r_[True, np.diff(x.text_of[order]) > 0]]
            own = part[x.text_of[worst]]
            # What is rare is hidden mostly, else a small sample is learnt by heart.
            hide = np.where(net.number(x) == len(net.words), HIDE_RARE, HIDE)
            drop = np.repeat(g.random((len(x.unique), 2)) < hide[:, None], EMBED, axis=1)
            grads = net.gradients(x, worst, y[own], weight[own], drop)
            turn += 1
            pace = rate * min(1, 4 * (1 - turn / (steps + 1)))
            for k, d in grads.items():
                first[k] += 0.1 * (d - first[k])
                second[k] += 0.01 * (d * d - second[k])
                net.p[k] -= (pace * ((first[k] / (1 - 0.9**turn)) / (np.sqrt(second[k] / (1 - 0.99**turn)) + 1e-6) + DECAY * net.p[k])).astype(np.float32)
    return net


def some_windows(text: str, most: int = TEXT) -> str:
    """The text, or if it has more bytes than that, windows of its words, chosen by hash, that have no more in sum."""
    if len(text.encode()) <= most:
        return text
    words = text.split()
    windows = [" ".join(words[i : i + WINDOW]) for i in range(0, len(words), WINDOW)]
    order = np.argsort(mix(np.arange(len(windows), dtype=np.uint64) + np.uint64(zlib.crc32(text.encode()))))
    size = np.cumsum([len(windows[i].encode()) + 1 for i in order])
    return "\n".join(windows[i] for i in sorted(order[size <= most].tolist()))


def _shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for c in chunks(b):
            yield c.set_column(1, "text", pa.array([some_windows(t) for t in c.column("text").to_pylist()], pa.string()))


def learn(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE) -> Network | None:
    """Fits on a bounded sample of labelled rows that are not held out."""
    rows = sample_labels(labels, "toxic")
    ids = bounded_sample(rows.where("label = 1"), sample[0]).union(bounded_sample(rows.where("label = 0"), sample[1]))
    # ids has sum(sample) rows at most, and a doc_id gives one row, however many hold it.
    found = one_text(documents(docs).join(F.broadcast(ids), "doc_id").select("doc_id", "text", "label"), "label")
    found = found.mapInArrow(_shortened, "doc_id long, text string, label int").toPandas().sort_values(["doc_id", "text"])
    return fit(found["text"].tolist(), found["label"].to_numpy().astype(np.float32))


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; predicted is 1 from THRESHOLD on."""
    net = learn(docs, labels, sample)
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for b in batches:
            for c in chunks(b):
                score = np.zeros(c.num_rows)
                if net is not None:
                    score = 1 / (1 + np.exp(-net.scores(Inputs(c.column("text")))))
                yield pa.RecordBatch.from_arrays([c.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    scored = documents(docs).mapInArrow(task, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
