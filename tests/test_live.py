"""A live table that is continued: snapshots over appends, broken and repeated runs."""

import os

import pytest

from dubito.streaming import live


def keys(df):
    return sorted(r.k for r in df.collect())


def files(path):
    return [f for _, _, names in os.walk(path) for f in names if f.endswith(".parquet")]


def test_appends(spark, tmp_path):
    path = str(tmp_path / "live")
    rows = spark.range(1000).withColumnRenamed("id", "k")
    lasts = [live.append_live(rows.where(f"k >= {lo} and k < {hi}").repartition(5), path, "k", 10) for lo, hi in ((0, 333), (333, 333), (333, 335), (335, 1000))]
    assert lasts == [333, 333, 335, 1000] and live.snapshots(spark, path) == 100
    for number in (1, 33, 34, 50, 100, 400):
        assert keys(live.snapshot(spark, path, number)) == list(range(min(10 * number, 1000)))
    assert keys(live.snapshot(spark, path, 0)) == []
    assert len(files(path)) < 50  # of the appends' tasks, not one for each of 100 snapshots
    with pytest.raises(ValueError, match="every 10"):
        live.append_live(rows, path, "k", 11)
    with pytest.raises(ValueError, match="holds a live table"):
        live.write_live(rows, path, "k", 10)


def test_a_batch_again_and_a_broken_one(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "live")
    rows = spark.range(30).withColumnRenamed("id", "k")
    live.append_live(rows.where("k < 15"), path, "k", 5, batch="a")
    with monkeypatch.context() as m:
        m.setattr(live, "_commit", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            live.append_live(rows.where("k >= 15"), path, "k", 5, batch="b")
    assert live.snapshots(spark, path) == 3 and keys(live.snapshot(spark, path, 9)) == list(range(15))
    for _ in range(2):
        assert live.append_live(rows.where("k >= 15"), path, "k", 5, batch="b") == 30
    assert keys(live.snapshot(spark, path, 9)) == list(range(30))


def test_two_runs_at_once(spark, tmp_path):
    path = str(tmp_path / "live")
    rows = spark.range(10).withColumnRenamed("id", "k")
    live.append_live(rows, path, "k", 5)
    taken = {"part": "other", "first": 1, "last": 10, "every": 5, "batch": None}
    with pytest.raises(Exception, match="exist"):
        live._commit(spark, path, 0, taken)
    assert [e["part"] for e in live._log(spark, path)] != ["other"] and keys(live.snapshot(spark, path, 2)) == list(range(10))


def test_empty(spark, tmp_path):
    path = str(tmp_path / "live")
    with pytest.raises(ValueError, match="no live table"):
        live.snapshot(spark, path, 1)
    none = spark.range(0).withColumnRenamed("id", "k")
    assert live.append_live(none, path, "k", 5) == 0 and live.snapshots(spark, path) == 0 and keys(live.snapshot(spark, path, 3)) == []


def test_row_numbers_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "live")
    live.write_live(spark.range(100).withColumnRenamed("id", "k"), path, "k", 10)
    assert "PushedFilters: [IsNotNull(__row), LessThanOrEqual(__row,30)]" in live.snapshot(spark, path, 3)._jdf.queryExecution().executedPlan().toString()
