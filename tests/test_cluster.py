"""Clusters against a walk in Python, on verdicts that aren't transitive."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from dubito.operators import cluster as C


def walk(n, equivalent):
    """Later leaders take members over from earlier ones."""
    owner = [None] * n
    for i in range(n):
        if owner[i] is None:
            owner[i] = i
            for j in range(i + 1, n):
                if equivalent(i, j):
                    owner[j] = i
    return owner


def test_verdict_tables(spark):
    rng = random.Random(3)
    rows = []
    for q in range(60):
        answers = [rng.choice("abcdef") + str(rng.randrange(3)) for _ in range(8)]
        verdicts = {f"{i},{j}": rng.choice([0, 1, 1, 2, 2]) for i in range(8) for j in range(8) if i != j}
        rows.append((q, answers, verdicts))
    df = spark.createDataFrame(rows, "q long, a array<string>, v map<string,int>")
    for strict in (True, False):
        got = {r.q: r.o for r in df.select("q", C.leaders_by_verdicts(F.col("a"), F.col("v"), strict).alias("o")).collect()}
        for q, a, v in rows:
            def same(i, j):
                x, y = v[f"{i},{j}"], v[f"{j},{i}"]
                rule = (x == 2 and y == 2) if strict else (x != 0 and y != 0 and not (x == 1 and y == 1))
                return a[i].strip() == a[j].strip() or rule

            assert got[q] == walk(8, same)


def test_merged_representatives(spark):
    df = spark.createDataFrame([(1, ["a", "b", "a", "c"])], "q long, raw_responses array<string>")
    groups = F.array(F.array(F.lit(0), F.lit(1)), F.array(F.lit(2)), F.array(F.lit(3)))
    d = df.select(C.distribution(F.col("raw_responses"), groups).alias("d")).first().d
    assert {s.rep: s.p for s in d.cluster_probs} == {"a": 0.75, "c": 0.25} and d.predicted == "a" and d.n_clusters == 3
    assert math.isclose(d.semantic_entropy, -(0.75 * math.log(0.75) + 0.25 * math.log(0.25)))


def test_goldens(spark):
    rows = [(1, ["x"] * 4), (2, ["x", "x", "y", "z"]), (3, list("abcdefghij")), (4, [])]
    got = {r.q: r for r in C.with_entropy(spark.createDataFrame(rows, "q long, a array<string>"), "a").collect()}
    assert got[1].semantic_entropy == 0 and got[1].n_clusters == 1
    assert round(got[2].semantic_entropy, 4) == 1.0397
    assert round(got[3].semantic_entropy, 6) == round(math.log(10), 6)
    assert got[4].n_clusters == 0


def test_realisable_values(spark):
    """No partition of ten lies between 0 and 0.3251, nor between a level's neighbours."""
    def parts(n, most):
        if n == 0:
            yield []
        for k in range(min(n, most), 0, -1):
            for rest in parts(n - k, k):
                yield [k, *rest]

    rows = [(i, [str(j) for j, k in enumerate(p) for _ in range(k)]) for i, p in enumerate(parts(10, 10))]
    got = C.with_entropy(spark.createDataFrame(rows, "q long, a array<string>"), "a").collect()
    values = sorted({round(r.semantic_entropy, 4) for r in got})
    assert len(rows) == 42 and len(values) == 39 and values[1] == 0.3251
    for low, cut, high in ((2.1640, 2.2333, 2.3026), (1.9730, 1.9992, 2.0253), (1.6957, 1.7219, 1.7481)):
        assert [v for v in values if low - 1e-4 <= v <= high + 1e-4] == [low, high] and low < cut < high


def test_judges_and_fixed(spark):
    df = spark.createDataFrame([(1, ["Paris.", "paris", "Lyon"], "PARIS")], "q long, raw_responses array<string>, f string")
    r = C.with_entropy(df, "raw_responses", C.same_words, fixed="f").first()
    assert r.n_clusters == 2 and r.fixed_response_cluster == "PARIS" and Counter(map(len, r.clusters)) == Counter([3, 1])
    assert C.rejudge(df, C.token_jaccard(0.9)).first().n_clusters == 3
    assert C.with_entropy(df, "raw_responses", C.contained).first().n_clusters == 2
    assert df.select(C.locate_fixed(F.col("raw_responses"), F.lit("paris"))).first()[0] == 1
