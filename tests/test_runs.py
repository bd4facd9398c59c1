"""Run files read in one scan, some absent."""

import json

import pytest
from pyspark.sql import functions as F

from dubito.operators import metrics
from dubito.sources import runs

SCHEMA = "question_idx long, grade string, semantic_entropy double"


def test_runs_some_absent(spark, tmp_path):
    rows = [{"question_idx": i, "grade": g, "semantic_entropy": s} for i, (g, s) in enumerate([("CORRECT", 0.1), ("INCORRECT", 0.9), ("NOT_ATTEMPTED", 0.5)])]
    (tmp_path / "a b+%.jsonl").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "empty.jsonl").write_text("")
    (tmp_path / "skipped.jsonl").write_text(json.dumps(rows[2]))
    spark.createDataFrame(rows[:2], SCHEMA).repartition(2).write.json(str(tmp_path / "parts.jsonl"))
    names = ["a b+%.jsonl", "gone.jsonl", "parts.jsonl", "empty.jsonl", "skipped.jsonl"]
    records, found = runs.read_runs(spark, [f"{tmp_path}/{n}" for n in names], SCHEMA)
    assert {r.run: r["count"] for r in records.groupBy("run").count().collect()} == {"a b+%.jsonl": 3, "parts.jsonl": 2, "skipped.jsonl": 1}
    report = runs.with_absent(found, metrics.sweep_report(metrics.answered(records), F.lit(False), "run")).collect()
    assert {r.run: (r.present, r.n, r.auroc) for r in report} == {
        "a b+%.jsonl": (True, 2, 1.0), "gone.jsonl": (False, None, None), "parts.jsonl": (True, 2, 1.0),
        "empty.jsonl": (True, None, None), "skipped.jsonl": (True, None, None),
    }


def test_no_run_is_there(spark, tmp_path):
    records, found = runs.read_runs(spark, [f"{tmp_path}/x.jsonl", f"{tmp_path}/y.jsonl"], SCHEMA)
    assert records.columns == ["question_idx", "grade", "semantic_entropy", "run"] and records.count() == 0
    assert [tuple(r) for r in found.orderBy("run").collect()] == [("x.jsonl", False), ("y.jsonl", False)]
    assert runs.with_absent(found, metrics.sweep_report(records, F.lit(False), "run")).where("n is null").count() == 2


def test_names_must_differ(spark, tmp_path):
    for paths in (["a/x.jsonl", "b/x.jsonl"], ["a/x.json"]):
        with pytest.raises(ValueError, match="names of their own"):
            runs.read_runs(spark, [f"{tmp_path}/{p}" for p in paths], SCHEMA)
