"""Replicates by hash against their definition, number by number."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from dubito.operators import bootstrap as S


def weight(seed, key, replicate):
    u = hashlib.md5(f"{seed}:{replicate // 8}:{key}".encode()).hexdigest()[4 * (replicate % 8) :][:4]
    return sum(u >= x for x in S.limits())


def area(score, y):
    pos, neg = score[y == 1], score[y == 0]
    if not len(pos) or not len(neg):
        return None
    return float(((pos[:, None] > neg).sum() + (pos[:, None] == neg).sum() / 2) / (len(pos) * len(neg)))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    return [("ab"[i % 2], i, round(float(rng.normal() + (i % 3 == 0)), 1), int(i % 3 == 0)) for i in range(120)] + [("none", 500, 1.0, 1), ("none", 501, None, 1)]


def test_limits():
    n = np.arange(len(S.limits()) + 1)
    p = -np.diff([1.0, *(1 - int(x, 16) / 65536 for x in S.limits()), 0.0])
    assert np.allclose(p, [math.exp(-1) / math.factorial(k) for k in n], atol=2e-5) and abs((p * n).sum() - 1) < 1e-3


def test_intervals(spark, rows):
    df = spark.createDataFrame(rows, "g string, k long, score double, y int").repartition(5)
    best = lambda table, keys: table.groupBy(*keys).agg(F.max("score").cast("double").alias("value"))  # noqa: E731  a user's own metric
    measured = {"auroc": S.auroc, "accuracy": S.accuracy_at(0.7), "best": best}
    out = {(r.g, r.metric): r for r in S.bootstrap(df, F.col("y") == 1, F.col("score"), F.col("k"), measured, "g", n=60).collect()}
    assert ("none", "auroc") not in out  # one class alone
    for g in "ab":
        own = [(k, s, y) for h, k, s, y in rows if h == g]
        score, y = (np.array([r[i] for r in own], float) for i in (1, 2))
        found = {"auroc": [], "accuracy": [], "best": []}
        for r in range(60):
            w = np.array([weight(42, k, r) for k, _, _ in own])
            s, z = np.repeat(score, w), np.repeat(y, w)
            found["auroc"].append(area(s, z))
            found["accuracy"].append(1 - z[s <= np.quantile(s, 0.7) + 1e-12].mean())
            found["best"].append(s.max())
        whole = {"auroc": area(score, y), "accuracy": 1 - y[score <= np.quantile(score, 0.7) + 1e-12].mean(), "best": score.max()}
        for m, values in found.items():
            r = out[g, m]
            want = [whole[m], np.std(values, ddof=1), np.quantile(values, 0.05), np.quantile(values, 0.95), 60]
            assert np.allclose([r.value, r.std_err, r.low, r.high, r.n], want, atol=1e-9), (g, m)


def test_without_groups_and_empty(spark, rows):
    df = spark.createDataFrame(rows[:40], "g string, k long, score double, y int")
    a, b = (S.bootstrap(x, F.col("y") == 1, F.col("score"), F.col("k"), {"auroc": S.auroc}, n=20).collect() for x in (df, df.repartition(7)))
    assert a == b and len(a) == 1 and a[0].n <= 20
    assert S.bootstrap(df.where("false"), F.col("y") == 1, F.col("score"), F.col("k"), {"auroc": S.auroc}, "g", n=20).count() == 0
