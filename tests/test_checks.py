"""Checks inside the plan: building starts no job, and running it fails as the early check does."""

import uuid

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from dubito.operators import sampling, select, targets


@pytest.fixture
def jobs(spark):
    """Jobs that a call starts, with what it gives."""

    def run(call):
        group = uuid.uuid4().hex
        spark.sparkContext.setJobGroup(group, "built")
        out = call()
        spark.sparkContext.setJobGroup("", "")
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)), out

    return run


def frames(spark):
    ids = spark.createDataFrame([(1,), (2,), (2,)], "question_idx long")
    df = spark.createDataFrame([(1, "x"), (1, "y"), (2, None), (3, "z")], "question_idx long, t string")
    return ids, df


def test_members(spark, jobs):
    ids, df = frames(spark)
    n, rows = jobs(lambda: select.require_members(df, ids, early=False))
    assert n == 0 and rows.columns == select.require_members(df, ids).columns
    assert sorted(map(str, rows.collect())) == sorted(map(str, select.require_members(df, ids).collect()))


@pytest.mark.parametrize("extra", [7, None])
@pytest.mark.parametrize("action", ["collect", "count"])
def test_missing_member(spark, extra, action):
    ids, df = frames(spark)
    more = ids.union(spark.createDataFrame([(extra,)], "question_idx long"))
    for rows in (df, df.limit(0), df.where("t = 'z' and question_idx = 0")):
        with pytest.raises(PySparkException, match="no record for question_idx" if rows is not df else "no record for question_idx " + ("null" if extra is None else "7")):
            getattr(select.require_members(rows, more, early=False), action)()


def test_pairs(spark, jobs):
    j = spark.createDataFrame([(1, "p", "CORRECT", "a"), (2, "p", "INCORRECT", "b")], "question_idx long, prompt string, grade string, low_temp_response string")
    ids = spark.createDataFrame([(2,)], "question_idx long")
    n, rows = jobs(lambda: targets.build_pairs(j, ids=ids, early=False))
    assert n == 0 and [r.response for r in rows.collect()] == ["b"]
    answers = spark.createDataFrame([(2, "x"), (9, "y")], "question_idx long, teacher_response string")
    n, rows = jobs(lambda: targets.longform_pairs(answers, j.select("question_idx", "prompt"), early=False))
    assert n == 0
    with pytest.raises(PySparkException, match="no record for question_idx 9"):
        rows.count()


def test_samples(spark, jobs):
    pool = spark.range(50).withColumnRenamed("id", "question_idx")
    n, rows = jobs(lambda: sampling.sample_ids(pool, 10, 44, reserved_tail=5, early=False))
    assert n == 0 and rows.collect() == sampling.sample_ids(pool, 10, 44, reserved_tail=5).collect() and rows.count() == 10
    for few in (pool, pool.limit(0)):
        for action in ("collect", "count"):
            with pytest.raises(PySparkException, match=f"60 asked for, there are {few.count()}"):
                getattr(sampling.sample_ids(few, 60, 1, early=False), action)()


def test_reuse(spark, jobs):
    ids, df = frames(spark)
    seen = spark.sparkContext.accumulator(0)

    def rescan(i):
        return i.distinct().mapInPandas(lambda parts: (seen.add(len(p)) or p.assign(t="new") for p in parts), "question_idx long, t string")

    n, rows = jobs(lambda: select.reuse_or_rescan(df, ids, rescan, early=False))
    assert n == 0 and sorted(map(str, rows.collect())) == sorted(map(str, select.keep_members(df, ids).collect()))
    assert seen.value == 0  # nothing was scanned again
    more = ids.union(spark.createDataFrame([(8,)], "question_idx long"))
    assert sorted(map(tuple, select.reuse_or_rescan(df, more, rescan, early=False).collect())) == [(1, "new"), (2, "new"), (8, "new")]


def test_plan_stays_outer(spark):
    ids, df = frames(spark)
    rows = select.require_members(df, ids, early=False).select("question_idx").where(F.col("question_idx") > 0)
    assert "LeftOuter" in rows._jdf.queryExecution().optimizedPlan().toString()
