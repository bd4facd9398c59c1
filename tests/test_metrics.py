"""Metrics against their definitions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from dubito.functions import entropy as E
from dubito.operators import metrics as M


def frame(spark, n=200, seed=1):
    rng = random.Random(seed)
    return spark.createDataFrame([(i, rng.random() < 0.4, float(rng.randrange(12)) / 7) for i in range(n)], "k long, y boolean, s double")


def brute_auroc(rows):
    pos, neg = [r.s for r in rows if r.y], [r.s for r in rows if not r.y]
    return sum((p > q) + (p == q) / 2 for p in pos for q in neg) / len(pos) / len(neg)


def test_auroc(spark):
    df = frame(spark)
    a = M.auroc(df, F.col("y"), F.col("s")).first().auroc
    assert math.isclose(a, brute_auroc(df.collect()), abs_tol=1e-12)
    assert math.isclose(M.auroc(df, ~F.col("y"), F.col("s")).first().auroc, 1 - a, abs_tol=1e-12)
    assert M.auroc(df.where("y"), F.col("y"), F.col("s")).first().auroc is None


@pytest.mark.parametrize("places,each", [(None, 40), (None, 1 << 16), (6, 40)])
def test_fine_scores(spark, places, each, monkeypatch):
    """Scores as many as rows: running sums by ranges, many or one, give what one window gives."""
    monkeypatch.setattr(M, "EACH", each)
    rng = random.Random(3)
    rows = [(i, rng.choice("ab"), rng.random() < 0.4, rng.random(), rng.random() < 0.3) for i in range(1500)] + [(i, None, i % 2 == 0, 0.5, False) for i in range(1500, 1600)]
    df = spark.createDataFrame(rows, "k long, g string, y boolean, s double, bad boolean")
    got = {r.g: r for r in M.auroc_without(df, F.col("y"), F.col("s"), F.col("bad"), "g", places=places).collect()}
    assert set(got) == {"a", "b", None}
    for g, r in got.items():
        own = [x for x in df.collect() if x.g == g]
        clean = [x for x in own if not x.bad]
        assert r.n == len(own) and r.n_clean == len(clean) and math.isclose(r.auroc, brute_auroc(own), abs_tol=1e-4 if places else 1e-9) and math.isclose(r.auroc_clean, brute_auroc(clean), abs_tol=1e-4 if places else 1e-9)
        assert math.isclose(r.delta, r.auroc_clean - r.auroc, abs_tol=1e-12)
    one = {r.g: r.auroc for r in M.auroc(df, F.col("y"), F.col("s"), "g", places=places).collect()}
    assert all(math.isclose(one[g], got[g].auroc, abs_tol=1e-12) for g in got)
    ordered = sorted(df.collect(), key=lambda r: (r.s if places is None else round(r.s, 6), r.k))
    for r in M.rejection_curve(df, F.col("y"), F.col("s"), "k", places=places).collect():
        assert r.kept == max(1, math.floor(r.fraction * len(ordered) + 1e-9)) and math.isclose(r.accuracy, sum(x.y for x in ordered[: r.kept]) / r.kept)
    same = df.withColumn("s", F.lit(0.25))
    for r in M.rejection_curve(same, F.col("y"), F.col("s"), "k").collect():
        assert math.isclose(r.accuracy, sum(x[2] for x in rows[: r.kept]) / r.kept)


@pytest.mark.parametrize("each,step", [(7, 5), (7, 64), (1000, 5), (1 << 16, 5)])
def test_ranges_of_a_table(spark, each, step, monkeypatch):
    """Ranges follow the order, hold whole ties and about as many rows each, whatever the keys; sums over them are those of one window."""
    monkeypatch.setattr(M, "EACH", each)
    monkeypatch.setattr(M, "STEP", step)
    rng = random.Random(5)
    keys = [rng.choice([i, i * i, 10**15 + i, 7]) for i in range(3000)] + [None] * 3
    df = spark.createDataFrame([(k, i % 4) for i, k in enumerate(keys)], "k long, n long")
    rows = sorted(((r.part, r.k) for r in M.parted(df, "k", []).collect() if r.k is not None), key=lambda r: (r[1], r[0]))
    assert rows == sorted(rows) and len({p for p, _ in rows}) == len({(p, k == 7) for p, k in rows if k != 7})
    assert all(len({p for p, x in rows if x == k}) == 1 for k in (7, rows[0][1], rows[-1][1]))
    sizes = [sum(p == q and k != 7 for q, k in rows) for p in {p for p, _ in rows}]
    assert max(sizes) <= 4 * each and (len(sizes) > 200 if each == 7 else len(sizes) <= 4)
    want, upto = {}, sum(i % 4 for i, k in enumerate(keys) if k is None)
    for k in sorted({k for k in keys if k is not None}):
        upto += sum(i % 4 for i, x in enumerate(keys) if x == k)
        want[k] = upto
    assert {r.k: r.upto for r in M.running(df, {"n": "upto"}, [], "k").where("k is not null").collect()} == want
    assert M.parted(df.where("false"), "k", []).count() == 0


@pytest.mark.parametrize("each", [7, 1 << 16])
def test_positional_split_of_sparse_keys(spark, each, monkeypatch):
    from dubito.operators import targets

    monkeypatch.setattr(M, "EACH", each)
    keys = [random.Random(i).randrange(2**62) for i in range(1000)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    train = {r.k for r in targets.positional_split(df, "k").where("part = 'train'").collect()}
    assert train == set(sorted(keys)[:900])
    assert targets.positional_split(df.limit(1), "k").first().part == "test" and targets.positional_split(df.where("false"), "k").count() == 0


def test_jackknife():
    import numpy as np

    p, q = np.array([3.0, 0, 2, 1]), np.array([1.0, 2, 0, 4])
    value, weight = M._jackknife(p + q, p)
    want = []
    for cells, of in ((p, 0), (q, 1)):
        for i in np.flatnonzero(cells):
            a, b = p.copy(), q.copy()
            (a, b)[of][i] -= 1
            want.append((M._areas(a + b, a), cells[i]))
    assert np.allclose(value, [v for v, _ in want]) and weight.tolist() == [w for _, w in want]


def test_bootstrap(spark):
    df = frame(spark, 400)
    r = M.bootstrap_auroc(df, F.col("y"), F.col("s")).first()
    assert math.isclose(r.auroc, brute_auroc(df.collect()), abs_tol=1e-9) and r.low < r.auroc < r.high and 0.01 < r.std_err < 0.06
    assert r == M.bootstrap_auroc(df, F.col("y"), F.col("s")).first()
    assert M.bootstrap_auroc(df.where("y"), F.col("y"), F.col("s")).first().low is None


@pytest.mark.parametrize("x,y", [(0, 0), (0, 1), (3, 3), (5, 17), (100, 101), (400, 520)])
def test_mcnemar(spark, x, y):
    rows = [(True, False)] * x + [(False, True)] * y + [(True, True)] * 5
    r = M.mcnemar(spark.createDataFrame(rows, "x boolean, y boolean"), F.col("x"), F.col("y")).first()
    n = x + y
    want = 1.0 if not n else min(1.0, 2 * sum(math.comb(n, i) for i in range(min(x, y) + 1)) / 2**n)
    assert (r.x_win, r.y_win, r.n_discordant) == (x, y, n) and math.isclose(r.p_value, want, rel_tol=1e-9)


def test_quantiles_and_area(spark):
    df = frame(spark)
    rows = sorted(df.collect(), key=lambda r: r.s)
    got = {r.q: r for r in M.at_quantiles(df, F.col("y"), F.col("s"), [0.5, 0.8, 0.9]).collect()}
    for q, r in got.items():
        at = q * (len(rows) - 1)
        lo, hi = rows[math.floor(at)].s, rows[math.ceil(at)].s
        cut = lo + (hi - lo) * (at - math.floor(at))
        kept = [x.y for x in rows if x.s <= cut + 1e-6]
        assert math.isclose(r.cutoff, cut, abs_tol=1e-5) and math.isclose(r.accuracy, sum(kept) / len(kept))
    assert round(M.aurac(df, F.lit(True), F.col("s")).first().aurac, 3) == 0.947


def test_choices(spark):
    df = spark.createDataFrame([(i,) for i in range(4000)], "i long").withColumns({"p": F.array(F.lit(0.2), F.lit(0.5), F.lit(0.3)), "l": F.array(*map(F.lit, "abc"))})
    n = {r.x: r["count"] for r in df.select(E.draw(F.col("p"), F.col("l"), E.uniform(3, F.col("i"))).alias("x")).groupBy("x").count().collect()}
    assert abs(n["a"] - 800) < 120 and abs(n["b"] - 2000) < 150
    r = df.limit(1).select(E.choice_distribution(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit("a"), F.lit("b"))).alias("d"), E.forced(F.col("p"), F.col("l"), F.lit("c")).alias("f"), E.top_k(F.col("p"), 2).alias("t")).first()
    assert r.d.probs == [0.5, 0.5] and r.d.argmax == "a" and r.f.prob == 0.3 and [x["index"] for x in r.t] == [1, 2]
    with pytest.raises(Exception, match="not a choice"):
        df.limit(1).select(E.forced(F.col("p"), F.col("l"), F.lit("z"))).collect()
