"""Plans: filters and columns reach the scan, nothing is a Cartesian product."""

import re

import pytest

from dubito.plans import records, sources, texts  # noqa: F401
from dubito.plans.registry import QUERIES


def plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


#: Queries with a window that isn't parted by a key, and so runs in one task: it holds distinct rounded scores, or a row for each of some ranges of keys.
BARE_WINDOWS = {"auroc", "accuracy_at_quantile", "aurac", "rejection_curve", "cut_table", "key_gaps", "open_keys", "positional_split", "live_table", "live_appends"}

#: Queries whose Python is their subject: resampling by numpy, judges and graders as user code, and digests of running contexts, which no function of Spark continues.
IN_PYTHON = {"bootstrap_auroc", "judge_as_code", "grader_as_code", "running_context"}


def bare_windows(p):
    """Windows of the plan without keys: behind their expressions stands an order alone, or nothing."""
    found = re.findall(r"\(\d+\) Window\nInput[^\n]*\nArguments: (.*)", p)
    lists = [re.split(r"\], \[", x.rstrip().removesuffix("]"))[1:] for x in found]
    return [x for x, behind in zip(found, lists, strict=True) if not behind or len(behind) == 1 and " NULLS " in behind[0]]


def test_scan_is_pruned(spark, data):
    p = plan(QUERIES["index_range"](spark, data))
    assert "GreaterThanOrEqual(o_orderkey,100)" in p and "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in p and "Exchange" not in p
    p = plan(QUERIES["keep_members"](spark, data))
    assert "EqualTo(c_mktsegment,BUILDING)" in p and "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in p


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_and_no_product(spark, data, name):
    p = plan(QUERIES[name](spark, data))
    assert "CartesianProduct" not in p
    if name not in IN_PYTHON:
        assert not re.search("Python|Pandas|Arrow", p)
    assert name in BARE_WINDOWS or not bare_windows(p)


def test_running_context_covers_every_claim(spark, data):
    from dubito.plans import binding

    assert QUERIES["running_context"](spark, data).count() == binding.claims(spark, data).count()


def test_entity_names_keep_ids_without_a_record(spark):
    from dubito.operators import longform

    records = spark.createDataFrame([(1, "old", 0), (1, "new", 5), (2, "two", 1)], "question_idx long, entity string, line long")
    got = longform.entity_names(spark.createDataFrame([(1,), (2,), (3,)], "question_idx long"), records).collect()
    assert sorted(map(tuple, got)) == [(1, "new"), (2, "two"), (3, None)]

