"""Mixing against its SQL at small ranges, its targets against shares given out step by step, and the defined cases."""

import re
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from dubito.llm import mixing, queries


def shared_out(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Targets by giving the excess to the others, again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), {}
    while True:
        rest = {s for s in names if s not in full}
        left = total - sum(full.values())
        given = {s: left * w[s] / sum(w[r] for r in rest) for s in rest}
        over = [s for s in rest if given[s] > most * sizes[s]]
        if not over:
            return full | given
        full |= {s: most * sizes[s] for s in over}


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def by_source(rows):
    taken, target = defaultdict(int), {}
    for r in rows:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
    return taken, target


def test_edges(spark, edge, edge_rows):
    df = edge.withColumn("source", F.when(F.col("doc_id") % 4 == 0, "b").when(F.col("doc_id") % 4 == 1, "ä").when(F.col("doc_id") % 4 == 2, "a"))
    rows = mixing.mix(df).collect()
    assert sorted((r.doc_id, r.size) for r in rows if r.doc_id is not None) == sorted((i, words(t)) for i, t in edge_rows if i is not None)
    assert len(rows) == len(edge_rows)
    taken, target = by_source(rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
    want = shared_out(sizes)
    assert set(want) == set(target) and all(abs(want[s] - target[s]) < 1e-6 for s in want)
    assert all(r.source_size == sizes[r.source] for r in rows)
    assert mixing.mix(df.repartition(7)).exceptAll(mixing.mix(df)).count() == 0


def test_empty(nothing):
    assert mixing.mix(nothing).count() == 0


def test_no_words(spark):
    rows = mixing.mix(spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")).collect()
    assert [(r.size, r.target, r.taken) for r in rows] == [(0, 0.0, 0)] * 2


@pytest.fixture(scope="module")
def some(spark):
    rows = [(i, "w " * (1 + (i * i) % 97) + ("x " * 5000 if i % 500 == 0 else ""), f"s{i % 5 if i % 3 else 0}" if i % 11 else None) for i in range(3000)]
    rows += [(None, "same text of six words here", "s0")] * 400 + [(9, "again", "s1")] * 3
    return spark.createDataFrame(rows, "doc_id long, text string, source string").cache()


@pytest.mark.parametrize("each", [16, 1 << 15])
def test_ranges_match_sql(spark, some, each, monkeypatch):
    """Many ranges a source, or one; of rows that are alike any may be taken."""
    monkeypatch.setattr(mixing, "EACH", each)
    got = mixing.mix(some)
    rows = got.collect()
    taken, target = by_source(rows)
    assert all(abs(taken[s] - target[s]) <= 60 for s in target)  # words, of 30,000 and more
    documents = some.toArrow()  # noqa: F841
    sql = queries._mixing()
    want = duckdb.sql("WITH " + sql)
    at = [want.columns.index(c) for c in ("size", "source_size", "taken")]
    lone = lambda rows: sorted(r for r in rows)
    assert lone((r.size, r.source_size, r.taken) for r in rows) == lone(tuple(r[i] for i in at) for r in want.fetchall())


def test_preference(spark, some):
    """Liked documents are taken more often, and the words still come near the target."""
    rows = mixing.mix(some, preference=F.when(F.col("doc_id") % 2 == 0, 8.0).otherwise(1.0)).where("doc_id is not null").collect()
    taken, target = by_source(rows)
    half = lambda even: [r.copies for r in rows if (r.doc_id % 2 == 0) == even and r.size < 200 and r.target < 2 * r.source_size]
    assert sum(half(True)) / len(half(True)) > sum(half(False)) / len(half(False)) + 0.05


def test_inclusion_is_fair(spark, some):
    """Over many seeds documents of a source are taken as often as its fraction says."""
    mean = defaultdict(list)
    for seed in range(4):
        for r in mixing.mix(some.where("doc_id is not null"), seed=seed).collect():
            if 0 < r.size < 200 and r.target < 2 * r.source_size:
                mean[r.source].append((r.copies, r.target / r.source_size))
    for pairs in mean.values():
        assert abs(sum(c for c, _ in pairs) / len(pairs) - sum(f for _, f in pairs) / len(pairs)) < 0.08


def test_many_sources(spark):
    rows = [(i, "w " * (i % 50), f"source {i}") for i in range(700)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    want = shared_out({s: words(t) for _, t, s in rows})
    assert all(abs(want[r.source] - r.target) < 1e-6 for r in out)


def test_native(some, monkeypatch):
    plan = mixing.mix(some)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|CartesianProduct", plan)
