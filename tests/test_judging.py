"""Judges and graders as user code: asked once for each distinct question, and the same clusters as a judge in columns."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dubito.operators import cluster as C
from dubito.operators import judging as J


@pytest.fixture(scope="module")
def records(spark):
    words = ["ab", "abc", "bc", "c", "x", " ab ", "", None]
    rows = [(i, [words[(i * 3 + k * (1 + i % 4)) % len(words)] for k in range(i % 9)]) for i in range(60)]
    return spark.createDataFrame(rows + [(60, None)], "question_idx long, raw_responses array<string>").repartition(4)


def counting(spark, reply):
    calls = spark.sparkContext.accumulator(0)

    def judge(a, b):
        calls.add(len(a))
        return pa.array([reply(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.int64())

    return judge, calls


@pytest.mark.parametrize("strict", [True, False])
def test_same_as_a_judge_in_columns(spark, records, strict):
    """Labels that aren't the same both ways, clusters that steal members."""
    reply = lambda x, y: 2 if y in x else 1 if x[:1] == y[:1] else 0
    judge, calls = counting(spark, reply)
    got = {r.question_idx: r.owners for r in J.leaders_by_judge(records, "question_idx", "raw_responses", judge, strict).collect()}
    n = J.distinct_pairs(J.answer_pairs(records, "question_idx", "raw_responses")).count()
    assert calls.value == 2 * n and n == 5 * 6 // 2 + 0  # six texts that differ: five and the empty one
    label = lambda a, b: F.when(F.contains(a, b), 2).when(F.substring(a, 1, 1) == F.substring(b, 1, 1), 1).otherwise(0)
    rule = C.strict_equivalence if strict else C.loose_equivalence
    plain = records.select("question_idx", C.leaders_by(F.col("raw_responses"), lambda a, b: F.coalesce(rule(label(F.trim(a), F.trim(b)), label(F.trim(b), F.trim(a))), F.lit(False))).alias("owners"))
    assert got == {r.question_idx: r.owners for r in plain.collect()}


def test_symmetric_judge_is_asked_once(spark, records):
    judge, calls = counting(spark, lambda x, y: 2 if len(x) == len(y) else 0)
    J.leaders_by_judge(records, "question_idx", "raw_responses", judge, symmetric=True).collect()
    assert calls.value == J.distinct_pairs(J.answer_pairs(records, "question_idx", "raw_responses")).count()


def test_labels_must_match(spark, records):
    with pytest.raises(Exception, match="a label for each pair"):
        J.leaders_by_judge(records, "question_idx", "raw_responses", lambda a, b: pa.array([0] * (len(a) + 1))).collect()


def test_no_label_is_no_verdict(spark):
    df = spark.createDataFrame([(1, ["a", "b", "a"])], "k long, t array<string>")
    out = J.leaders_by_judge(df, "k", "t", lambda a, b: pa.nulls(len(a), pa.int32()))
    assert out.first().owners == [0, 1, 0]


def test_empty_table(spark, records):
    judge, calls = counting(spark, lambda x, y: 2)
    assert J.leaders_by_judge(records.where("false"), "question_idx", "raw_responses", judge).count() == 0 and calls.value == 0


def test_grader(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else "ab"[i % 2], 1.5) for i in range(30)], "k long, said string, x double").repartition(3)
    seen = spark.sparkContext.accumulator(0)

    def grader(said, x):
        seen.add(len(said))
        return pa.array([f"{a}{b}" for a, b in zip(said.to_pylist(), x.to_pylist(), strict=True)])

    out = {r.k: r.grade for r in J.graded(df, grader, "said", "x").collect()}
    assert out == {i: f"{None if i % 3 == 0 else 'ab'[i % 2]}1.5" for i in range(30)} and seen.value == 3
