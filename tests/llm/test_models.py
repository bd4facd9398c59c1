"""Trained scores: held-out accuracy, gradients, sums to one, defined cases."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from dubito.llm import crossentropy, quality, toxicity
from dubito.llm.queries import table

BIG = "/root/testdata/sf0.01"


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def auc(rows):
    pos, neg = [r[0] for r in rows if r[1] == 1], [r[0] for r in rows if r[1] == 0]
    return sum((p > q) + (p == q) / 2 for p in pos for q in neg) / len(pos) / len(neg)


def scored(spark, f, label, folder=BIG):
    got = f(table(spark, folder, "documents"), table(spark, folder, "labels"))
    rows = got.join(table(spark, folder, "labels"), "doc_id").select("doc_id", "held_out", "score", "predicted", label).collect()
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    return [(r.score, r[label], r.predicted) for r in rows if r.held_out]


def test_quality_held_out(spark):
    rows = scored(spark, quality.score_quality, "quality")
    assert auc(rows) > 0.97 and np.mean([p == y for _, y, p in rows]) > 0.95 and all(p == (s >= 0.5) for s, _, p in rows)


def test_toxicity_held_out(spark):
    # 32 toxic texts to learn from here, in four languages.
    assert auc(scored(spark, toxicity.score_toxicity, "toxic")) > 0.8


def test_toxicity_held_out_of_more(spark):
    # 305 toxic texts to learn from, 144 held out.
    rows = scored(spark, toxicity.score_toxicity, "toxic", "/root/testdata/sf0.1")
    toxic, clean = [r for r in rows if r[1] == 1], [r for r in rows if r[1] == 0]
    assert sum(r[2] for r in toxic) >= 0.9 * len(toxic) and sum(r[2] for r in clean) <= 0.02 * len(clean) and auc(rows) > 0.95


def test_toxicity_learns_from_windows_of_long_texts():
    long = " ".join(f"word{i}" for i in range(20_000))
    short = toxicity.some_windows(long, 4000)
    assert len(short.encode()) <= 4000 and set(short.split()) < set(long.split()) and toxicity.some_windows("a b") == "a b"
    places = [int(w[4:]) for w in short.split()]
    assert places == sorted(places) and max(places) > 15_000 and min(places) < 5_000 and toxicity.some_windows("x" * 5000, 4000) == ""


def test_toxicity_scores_against_plain_loops():
    texts = ["You absolute Walnut!", "", "one two three " * 30, "Ünï 日本 x"]
    x = toxicity.Inputs(pa.array(texts))
    net = toxicity.Network(np.sort(x.unique)[::2])
    p, h = {k: v.astype(float) for k, v in net.p.items()}, toxicity.HIDDEN
    sigmoid = lambda v: 1 / (1 + math.exp(-v))

    def embedded(word):
        raw = word.encode()
        hashed = toxicity.Words(pa.array([word])).hashes()[0]
        own = p["word"][net.words.tolist().index(hashed) if hashed in net.words else len(net.words)]
        padded, grams = b" " + raw + b" ", []
        for i in range(len(raw)):
            a, b, c = padded[i : i + 3]
            grams.append(p["gram"][int(toxicity.mix(np.array([a | b << 8 | c << 16], np.uint64))[0] >> np.uint64(52))])
        return [*own, *(sum(g[d] for g in grams) / len(grams) for d in range(toxicity.EMBED))]

    def run(way, inputs):
        state, out = [0.0] * h, []
        for v in inputs:
            a = [sum(v[i] * p[f"in_{way}"][i, j] for i in range(len(v))) + p[f"bias_{way}"][j] for j in range(3 * h)]
            g = [sum(state[i] * p[f"rec_{way}"][i, j] for i in range(h)) for j in range(3 * h)]
            new = []
            for j in range(h):
                z, r = sigmoid(a[j] + g[j]), sigmoid(a[h + j] + g[h + j])
                c = math.tanh(a[2 * h + j] + r * g[2 * h + j])
                new.append(z * state[j] + (1 - z) * c)
            state = new
            out.append(state)
        return out

    def logit(words):
        v = [embedded(w) for w in words]
        states = [a + b for a, b in zip(run("f", v), run("b", v[::-1])[::-1], strict=True)]
        e = []
        for s in states:
            hidden = [math.tanh(sum(s[i] * p["attend"][i, j] for i in range(2 * h)) + p["attend_b"][j]) for j in range(toxicity.ATTEND)]
            e.append(math.exp(sum(q * y for q, y in zip(p["query"], hidden, strict=True))))
        pooled = [sum(w * s[i] for w, s in zip(e, states, strict=True)) / sum(e) for i in range(2 * h)]
        return sum(o * v for o, v in zip(p["out"], pooled, strict=True)) + p["out_b"][0]

    want = []
    for t in texts:
        w = re.findall(r"[^\W_]+", t.lower())
        starts = [*range(0, max(1, len(w) - 31), 16), max(0, len(w) - 32)] if w else []
        want.append(max((logit(w[s : s + 32]) for s in starts), default=-math.inf))
    assert np.allclose(net.scores(x), want, atol=1e-4)


def test_toxicity_learns_words():
    rng = np.random.default_rng(5)
    vocabulary = [f"word{i}" for i in range(200)]
    def text(bad):
        w = rng.choice(vocabulary, rng.integers(5, 120)).tolist()
        for _ in range(bad * 3):
            w[rng.integers(len(w))] = rng.choice(["awful", "nasty", "vile"])
        return " ".join(w)

    y = np.array([i % 3 == 0 for i in range(360)], np.float32)
    net = toxicity.fit([text(int(v)) for v in y], y, epochs=6)
    score = lambda t: 1 / (1 + np.exp(-net.scores(toxicity.Inputs(pa.array(t)))))
    fresh = np.array([i % 2 for i in range(100)])
    assert ((score([text(int(v)) for v in fresh]) >= 0.7) == fresh).mean() > 0.95
    # a word at the very end of a long text counts: all windows are scored
    clean = " ".join(rng.choice(vocabulary, 3000))
    a, b, none = score([clean, clean + " vile nasty vile", ""])
    assert a < 0.7 <= b and none == 0


def test_toxicity_gradients():
    x = toxicity.Inputs(pa.array(["a bb ccc dd e idiot zz", "the cat sat on the mat " * 9]))
    net = toxicity.Network(np.sort(x.unique)[:9])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rows, y, w = np.array([0, 1]), np.array([1.0, 0.0]), np.array([1.0, 2.0])
    drop = np.zeros((len(x.unique), 2 * toxicity.EMBED), bool)
    drop[1, :5] = True

    def loss():
        inputs = net.embed(x)
        inputs[drop] = 0
        p = 1 / (1 + np.exp(-net.logits(net.tables(inputs), *x.windows(rows))))
        return -(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / w.sum()

    g = net.gradients(x, rows, y, w, drop)
    for k, p in net.p.items():
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        old, ends = p[at], []
        for e in (1e-3, -1e-3):
            p[at] = old + e
            ends.append(loss())
        p[at] = old
        assert math.isclose((ends[0] - ends[1]) / 2e-3, g[k][at], rel_tol=2e-3, abs_tol=1e-6)


def test_windows_cover_texts():
    for n in (1, 31, 32, 33, 48, 49, 1000):
        x = toxicity.Inputs(pa.array([" ".join(["w"] * n)]))
        seen = np.zeros(n, bool)
        for s, m in zip(x.start, x.length, strict=True):
            seen[s : s + m] = True
        assert seen.all() and len(x.start) == (1 if n <= 32 else -(-(n - 32) // 16) + 1)


@pytest.mark.parametrize("f", [quality.score_quality, toxicity.score_toxicity])
def test_edges(spark, edge, edge_rows, nothing, labels, f):
    got = f(edge, labels).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in edge_rows if i is not None)
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in got)
    if f is toxicity.score_toxicity:
        assert all(r.score == 0 for r in got if r.doc_id in (1, 2, 3))
    assert f(nothing, labels).count() == 0
    for none in (labels.where("false"), labels.where("quality = 1 and toxic = 0")):
        assert len({r.score for r in f(edge, none).collect()}) == 1


def test_quality_keeps_columns(spark, edge, nothing, labels):
    kept = quality.keep_good(edge, labels)
    assert kept.schema == edge.schema and quality.keep_good(nothing, labels).count() == 0
    assert quality.keep_good(edge, labels.where("false")).count() == edge.count()


def plain_statistics(t):
    raw = (t or "").encode()
    w = re.findall(rb"[^\x20\x09-\x0d]+", raw)
    lines, n, m = [x for x in raw.split(b"\n") if x], max(1, len(w)), max(1, len(raw))
    share = lambda f: sum(map(f, raw)) / m
    mean = sum(map(len, w)) / n
    count = Counter(w)
    first = lambda items: len(set(items)) / len(items) if items else 1.0
    is_mark = lambda c: 33 <= c <= 47 or 58 <= c <= 64 or 91 <= c <= 96 or 123 <= c <= 126
    per_byte = Counter(raw)
    return [
        math.log1p(len(raw)), math.log1p(len(w)), math.log1p(len(lines)), mean, math.sqrt(max(0, sum(len(x) ** 2 for x in w) / n - mean**2)),
        sum(len(x) > 15 for x in w) / n, sum(len(x) == 1 for x in w) / n, share(lambda c: 65 <= c <= 90), share(lambda c: 97 <= c <= 122), share(lambda c: 48 <= c <= 57),
        share(is_mark), share(lambda c: c >= 128), share(lambda c: c == 10), *(raw.count(c) / n for c in (b"!", b"|", b"#", b"$", b"&", b"%", b"*", b".", b",")),
        first(w), max(count.values(), default=0) / n, 1 - first(lines), len(w) / max(1, len(lines)), sum(65 <= x[0] <= 90 for x in w) / n,
        -sum(v / m * math.log(v / m) for v in per_byte.values()), 1 - first(list(zip(w, w[1:]))),
    ]


def test_statistics_against_plain_ones(edge_rows):
    texts = [t for _, t in edge_rows] + ["Ab ab AB 12 a!\n\nAb ab\nAb ab", "x" * 40 + " $#&%*|.,\tq", "É é\n"]
    got = quality.statistics(pa.array(texts, pa.string()))
    assert got.shape == (len(texts), len(quality.STATISTICS))
    for t, row in zip(texts, got, strict=True):
        assert np.allclose(row, plain_statistics(t), rtol=1e-4, atol=1e-4), (t or "")[:30]


def test_trees():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 4)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > -0.2)).astype(float)
    t = quality.fit(x, y)
    fresh = rng.normal(size=(1000, 4)).astype(np.float32)
    assert ((t.score(fresh) > 0.5) == ((fresh[:, 0] > 0.3) ^ (fresh[:, 1] > -0.2))).mean() > 0.97
    slow = []
    for row in fresh[:50]:
        v = t.base
        for at in t.roots:
            while t.left[at] != at:
                at = t.left[at] if row[t.feature[at]] <= t.threshold[at] else t.right[at]
            v += t.value[at]
        slow.append(v)
    assert np.allclose(t.logit(fresh[:50]), slow)


def plain_models(rows, is_target):
    """(loss of word b after a under the target and the background, vocabulary), from counts in plain dictionaries."""
    pairs = [Counter(), Counter()]
    for i, t in rows:
        w = t.split()
        for k in range(2):
            pairs[k].update(zip(["^", *w[:-1]], w, strict=True) if k or is_target(i) else [])
    scale = [1.0, pairs[0].total() / pairs[1].total()]
    vocabulary = {b for _, b in pairs[1]}

    def loss(k):
        n, off, w = Counter(), Counter(), Counter()
        for (a, b), x in pairs[1].items():
            x = pairs[k][a, b] * scale[k]
            n[a] += x
            off[a] += 0.7 * min(x, 1)
            w[b] += x

        def one(a, b):
            single, x = (w[b] + 0.1) / (w.total() + 0.1 * len(vocabulary)), pairs[k][a, b] * scale[k]
            return -math.log((x - 0.7 * min(x, 1)) / n[a] + off[a] / n[a] * single if n[a] else single)

        return one

    return (loss(0), loss(1)), vocabulary


def test_crossentropy_matches_plain_models_of_any_groups(spark):
    rows = [(i, " ".join(f"w{(i * j) % 7}" for j in range(1, 40))) for i in range(30)] + [(30, "w1"), (31, "w9 w9")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    losses, vocabulary = plain_models(rows, lambda i: i % 3 == 0)
    for f in losses:
        for a in ("^", "w1", "w9"):
            assert math.isclose(sum(math.exp(-f(a, b)) for b in vocabulary), 1)
    for size in (None, 2000, 100):
        got = {r.doc_id: r for r in crossentropy.score_documents(df, df.where("doc_id % 3 = 0").select("doc_id"), size).collect()}
        for i, t in rows:
            w = t.split()
            want = [sum(f(a, b) for a, b in zip(["^", *w[:-1]], w, strict=True)) / len(w) for f in losses]
            assert got[i].n_tokens == len(w) and math.isclose(got[i].target_loss, want[0], rel_tol=1e-9) and math.isclose(got[i].background_loss, want[1], rel_tol=1e-9)


def test_crossentropy_numbers_by_planes():
    rng = np.random.default_rng(2)
    for x in (np.zeros(0, np.uint64), np.array([0]), rng.integers(0, 1 << 40, 100), rng.integers(0, 1 << 63, 9, dtype=np.uint64) * np.uint64(2), np.arange(5.0)):
        back = crossentropy._unpacked(crossentropy._packed(x))
        assert len(back) == len(x) and (back == x).all()


def test_crossentropy_edges(spark, edge, edge_rows, nothing, labels):
    good = labels.where("quality = 1")
    got = crossentropy.score_documents(edge, good).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in edge_rows if i is not None)
    for r in got:
        assert (r.n_tokens == 0) == (r.score is None) and (r.score is None or math.isclose(r.score, r.target_loss - r.background_loss, abs_tol=1e-9))
    assert crossentropy.score_documents(nothing, good).count() == 0
    assert all(abs(r.score or 0) < 1e-9 for r in crossentropy.score_documents(edge, good.where("false")).collect())
    every = edge.select("doc_id")
    assert all(abs(r.score or 0) < 1e-9 for r in crossentropy.score_documents(edge.where("doc_id is not null"), every).collect())


def test_crossentropy_keeps_all_words_and_pairs(spark):
    # More words than a bounded vocabulary of 8,192 holds; pairs seen once count like all others.
    rng = np.random.default_rng(11)
    common = [f"c{i}" for i in range(40)]
    rows = [(i, " ".join(x for j in range(300) for x in (f"r{i}x{j}", common[rng.integers(40)]))) for i in range(32)] + [(32, "c1 c2 r0x0")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in crossentropy.score_documents(df, df.where("doc_id % 3 = 0").select("doc_id")).collect()}
    pairs = [Counter(), Counter()]
    for i, t in rows:
        w = t.split()
        for k in range(2):
            pairs[k].update(zip(["^", *w[:-1]], w, strict=True) if k or i % 3 == 0 else [])
    scale = [1.0, pairs[0].total() / pairs[1].total()]
    words = len({b for _, b in pairs[1]})
    assert words > 8192

    def loss(k):
        c = {p: pairs[k][p] * scale[k] for p in pairs[1]}
        n, off, w = Counter(), Counter(), Counter()
        for (a, b), x in c.items():
            n[a] += x
            off[a] += 0.7 * min(x, 1)
            w[b] += x

        def one(a, b):
            single, x = (w[b] + 0.1) / (w.total() + 0.1 * words), c[a, b]
            return -math.log((x - 0.7 * min(x, 1)) / n[a] + off[a] / n[a] * single if n[a] else single)

        return one

    losses = [loss(0), loss(1)]
    for i, t in rows:
        w = t.split()
        want = [sum(f(a, b) for a, b in zip(["^", *w[:-1]], w, strict=True)) / len(w) for f in losses]
        assert got[i].n_tokens == len(w) and math.isclose(got[i].target_loss, want[0], rel_tol=1e-9) and math.isclose(got[i].background_loss, want[1], rel_tol=1e-9)


@pytest.mark.parametrize("learner", ["quality", "toxicity"])
def test_sample_is_bounded_by_rows(spark, learner, monkeypatch):
    """A doc_id that many rows hold gives one row to learn from, the same in any order of the rows."""
    module, seen = {"quality": quality, "toxicity": toxicity}[learner], []
    monkeypatch.setattr(module, "fit", lambda x, y, *a, **b: seen.append((len(x), len(y), [str(r) for r in x])))
    one, other = [i for i in range(1, 20) if zlib.crc32(str(i).encode()) % 3 != 1][:2]
    docs = spark.createDataFrame([(one, f"text number {i % 50} of many") for i in range(3000)] + [(other, "other text")], "doc_id long, text string")
    labels = spark.createDataFrame([(one, 1, 1), (other, 0, 0)], "doc_id long, quality int, toxic int")
    for n in (2, 5):
        module.learn(docs.repartition(n), labels)
    assert seen[0] == seen[1] and seen[0][:2] == (2, 2)
