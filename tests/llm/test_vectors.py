"""Vector codes against plain Python, and the cases that the docstring defines."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from dubito.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, entries=16, rounds=6, scale=4096, parts=8):
    """(vec_id, code, error, label) of each kept row, and the digest of the codebooks, one number at a time."""
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v], y) for i, v, y in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [(i, x + [0] * (-len(x) % parts), y) for i, x, y in kept if len(x) == len(kept[0][1])]
    w = len(kept[0][1]) // parts
    cutter = lambda x: [x[p * w : (p + 1) * w] for p in range(parts)]
    books = [[cutter(x)[p] for _, x, _ in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda part, book: min(range(len(book)), key=lambda e: (far(part, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            own = [near(cutter(x)[p], books[p]) for _, x, _ in kept]
            for e in range(len(books[p])):
                of = [cutter(x)[p] for (_, x, _), o in zip(kept, own, strict=True) if o == e]
                if of:
                    books[p][e] = [sum(c) // len(of) for c in zip(*of, strict=True)]
    out = []
    for i, x, y in kept:
        codes = [near(part, books[p]) for p, part in enumerate(cutter(x))]
        out.append((i, "".join(f"{e:02x}" for e in codes), sum(far(part, books[p][e]) for p, (part, e) in enumerate(zip(cutter(x), codes, strict=True))), y))
    return out, hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


def same(df, rows, **how):
    want, digest = plain(rows, **how)
    total = {}
    for _, _, error, y in want:
        total[y] = total.get(y, 0) + error
    got = sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect()), key=repr)
    assert got == sorted(((i, code, error, total[y], digest) for i, code, error, y in want), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=12)], i % 3 if i % 7 else None) for i in range(60)]
    rows += [(None, rows[3][1], 1), (7, rows[7][1], 1), (7, rows[7][1], 1), (7, rows[9][1], None), (-2, rows[5][1], 2)]
    rows += [(100, None, 1), (101, [None] * 12, 1), (102, [float("nan")] * 12, 1), (103, [float("inf")] + [0.0] * 11, 0), (104, [1.0] * 5, 0), (105, [], 0), (106, [0.0] * 11 + [None], 0)]
    return rows + [(200 + i, [0.5, -0.5, 0.25] * 4, 9) for i in range(40)]  # copies, and distances that tie


def test_plain_python(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    same(vectors.compress(df), rows)


def test_other_parameters_and_types(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("embedding", F.col("embedding").cast("array<double>"))
    same(vectors.compress(df, entries=5, rounds=2, scale=100, parts=5), rows, entries=5, rounds=2, scale=100, parts=5)


def test_clashing_columns_and_few_rows(spark, rows):
    df = spark.createDataFrame(rows[:5], SCHEMA)
    for c in ("vector", "x", "code", "error", "label_error", "size", "slot", "total", "n", "__key", "__hash", "__hot"):
        df = df.withColumn(c, F.lit("x"))
    same(vectors.compress(df), rows[:5])


def test_nothing_kept(spark, rows):
    want = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    for some in ([], [r for r in rows if r[0] in (100, 101, 102, 103, 105)]):
        out = vectors.compress(spark.createDataFrame(some, SCHEMA))
        assert out.columns == want and out.count() == 0


def test_large_components_are_held(spark):
    df = spark.createDataFrame([(1, [3e38] * 64, 1), (2, [-3e38] * 64, 1), (3, [0.0] * 64, None)], SCHEMA)
    assert [r.error for r in vectors.compress(df).collect()] == [0, 0, 0]


def test_hot_label(spark, monkeypatch):
    """Labels by broadcast and by a join give the same."""
    monkeypatch.setattr("dubito.llm.shared.HOT", 2)
    rng = np.random.default_rng(6)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8)], None if i % 3 == 0 else 1 if i % 3 == 1 else i) for i in range(400)]
    same(vectors.compress(spark.createDataFrame(rows, SCHEMA)), rows)
