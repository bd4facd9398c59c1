"""Running contexts: as text, as places in the answer's text, and as digests."""

import hashlib
import random
import time

from pyspark.sql import functions as F

from dubito.operators import longform

SCHEMA = "question_idx long, claim_idx long, claim string, is_true boolean"


def brute(rows):
    """context by (key, order, text) of rows."""
    out = {}
    for key in {r[0] for r in rows}:
        before = []
        for r in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2] is not None, r[2] or "")):
            out[r] = " ".join(t for t in before if t is not None) or None
            before.append(r[2])
    return out


def test_contexts(spark):
    rng = random.Random(3)
    words = ["", None, "a", "häuser", "zwei Wörter", "😀", " "]
    rows = [(k, i, rng.choice(words), bool(i % 2)) for k in (None, 1, 2, 3) for i in range(k or 5)] + [(9, i, rng.choice(words), True) for i in range(300)]
    rng.shuffle(rows)
    claims = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = brute(rows)
    got = longform.running_context(claims).collect()
    assert {tuple(r)[:4]: r.context for r in got} == want and len(got) == len(rows)
    ends = longform.context_ends(claims).collect()
    assert {tuple(r)[:4]: r.context_end for r in ends} == {r: len(c or "") for r, c in want.items()}
    digests = {(r[0], r[1]): r.context_md5 for r in longform.context_digests(claims).collect()}
    assert digests == {r[:2]: hashlib.md5(c.encode()).hexdigest() if c else None for r, c in want.items()}


def test_empty_table_and_other_columns(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert longform.running_context(none).collect() == longform.context_ends(none).collect() == longform.context_digests(none).collect() == []
    claims = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "q long, n long, t string").withColumn("m", F.create_map(F.lit("k"), F.lit(1)))
    assert sorted((r.n, r.context, r.m["k"]) for r in longform.running_context(claims, "q", "n", "t").collect()) == [(0, None, 1), (1, "a", 1)]


def test_a_text_of_100_000_sentences(spark):
    claims = spark.range(100_000).select(F.lit(1).alias("question_idx"), F.col("id").alias("claim_idx"), F.concat(F.lit("Sentence of a long answer, number "), F.col("id").cast("string")).alias("claim"))
    start = time.monotonic()
    got = longform.context_digests(claims).where("claim_idx in (0, 1, 99999)").orderBy("claim_idx").collect()
    last = " ".join(f"Sentence of a long answer, number {i}" for i in range(99_999))
    assert [r.context_md5 for r in got] == [None, *(hashlib.md5(x.encode()).hexdigest() for x in ("Sentence of a long answer, number 0", last))]
    assert longform.context_ends(claims).agg(F.max("context_end")).first()[0] == len(last)
    assert longform.running_context(claims).where("claim_idx % 25000 = 24999").agg(F.max(F.length("context"))).first()[0] == len(last)
    assert time.monotonic() - start < 120
