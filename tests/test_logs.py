"""Logs as files: read in splits, .out and .err as one."""

import os
import re

import pytest
from pyspark.sql import functions as F

from dubito.functions import phrases as P
from dubito.operators import inventory as I
from dubito.sources import files

FILES = {
    "run_1.out": "start host=oat7\n" + "x" * 500 + "\nKeyError: y\nCANCELLED\n", "run_1.err": "host=oat9\nOutOfMemoryError\n",
    "run_2.out": "KeyError: early\n" + "\n" * 50 + "judging done", "run_2.err": "CANCELLED",
    "run_3.out": "", "run_3.err": "", "run_4.out": "\n", "run_5.err": "CANCELLED",
    "run_6.out": "no KeyError here\nhost=elsewhere\n", "run_6.err": "ValueError",
    "array_9_1.out": "job=77 job=7\nstill going", "array_9_2.out": "job=77\n", "array_9_2.err": "a\r\nPermissionError: b", "odd name+%.out": "DUE TO TIME LIMIT",
    "notes.log": "CANCELLED", "plain.txt": "CANCELLED",
}


def by_text(text):
    """The outcome of a whole text, as the rule is stated."""
    if re.search("|".join(P.SUCCESS), text):
        return "done"
    return next((reason for pattern, reason in P.FAILURES if re.search(pattern, text, re.M)), "running or unknown")


def expected():
    logs = {}
    for name in sorted(FILES, key=lambda n: n.endswith(".err")):
        if name.endswith((".out", ".err")):
            logs.setdefault(name[:-4], []).append(FILES[name])
    texts = {k: "\n".join(v) for k, v in logs.items()}
    return {k: (by_text(t), m[1] if (m := re.search(P.NODE, t)) else None) for k, t in texts.items()}


@pytest.fixture
def logs(tmp_path):
    for i, (name, text) in enumerate(FILES.items()):
        (tmp_path / name).write_bytes(text.encode())
        os.utime(tmp_path / name, (1_700_000_000 + i, 1_700_000_000 + i))
    return str(tmp_path)


@pytest.mark.parametrize("most", ["16b", "128m"])
def test_status_of_split_logs(spark, logs, most):
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")
        lines = files.log_lines(spark, logs)
        status = I.log_status(files.log_files(spark, logs), lines).collect()
        if most == "16b":
            assert lines.rdd.getNumPartitions() > 20
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert {r.log: (P.OUTCOMES[r["rank"]], r.node) for r in status} == expected()
    assert {r.log for r in status if not r.out} == {"run_5"} and {r.log: r.bytes for r in status}["run_3"] == 0


def test_tally_and_failures(spark, logs):
    status = I.log_status(files.log_files(spark, logs), files.log_lines(spark, logs))
    want = {k: v for k, v in expected().items() if k != "run_5"}
    failed = {(k, node or "", reason) for k, (reason, node) in want.items() if reason not in ("done", "running or unknown")}
    assert {tuple(r) for r in I.failures(status).collect()} == failed and ("run_1", "oat7", P.FAILURES[0][1]) in failed
    unknown = sum(reason == "running or unknown" for reason, _ in want.values())
    assert {tuple(r) for r in I.tally(status).collect()} == {("done", 1), ("failed", len(failed)), ("running or unknown", unknown)}
    assert {tuple(r)[0] for r in I.failures(status, last=2).collect()} == {"odd name+%"}
    assert {tuple(r)[0] for r in I.failures(status, last=3).collect()} == {"odd name+%", "array_9_2"}  # an empty log is the latest
    assert sum(r.n for r in I.tally(status, last=3).collect()) == 3


def test_jobs_by_name_then_by_mention(spark, logs):
    """77 is mentioned in two logs, the later name counts with its .err; 3's logs are empty, so nothing is known of it; 9 is an array."""
    lines = files.log_lines(spark, logs)
    jobs = spark.createDataFrame([("1",), ("2",), ("3",), ("5",), ("7",), ("9",), ("77",), ("8",), (None,)], "job string")
    got = {r.job: r.outcome for r in I.with_log_outcome(jobs, I.log_status(files.log_files(spark, logs), lines), lines).collect()}
    reasons = dict(P.FAILURES)
    assert got == {
        "1": reasons["OutOfMemoryError"], "2": "done", "3": P.NO_LOG, "5": reasons["CANCELLED"], "7": "running or unknown",
        "9": reasons["PermissionError"], "77": reasons["PermissionError"], "8": P.NO_LOG, None: P.NO_LOG,
    }


def test_no_logs(spark, tmp_path):
    (tmp_path / "readme.txt").write_text("CANCELLED")
    status = I.log_status(files.log_files(spark, str(tmp_path)), files.log_lines(spark, str(tmp_path)))
    assert status.count() == 0 and I.tally(status).count() == 0 and I.failures(status).count() == 0


def test_logs_in_parts(spark, tmp_path):
    """A log that Spark wrote is a folder of parts."""
    spark.createDataFrame([("run_1.out", "host=oat3"), ("run_1.err", "CANCELLED"), ("run_2.out", "going")], "name string, value string").write.partitionBy("name").text(str(tmp_path / "logs"))
    path = str(tmp_path / "logs")
    status = I.log_status(files.log_files(spark, path), files.log_lines(spark, path))
    assert {tuple(r) for r in status.select("log", "node", F.col("rank") == P.OUTCOMES.index("cancelled")).collect()} == {("run_1", "oat3", True), ("run_2", None, False)}


def test_packed_logs(spark, tmp_path):
    """Many logs in a file tell what a file for each tells; the number of files is that of partitions, not of logs."""
    rows = [(name, i, x) for name, text in FILES.items() for i, x in enumerate(re.split("\r?\n", text.removesuffix("\n"))) if text]
    rows += [(f"more_{i}.out", 0, "a\tb\tCANCELLED") for i in range(40)]
    path = str(tmp_path / "packed")
    files.pack_logs(spark.createDataFrame(rows, "name string, i long, value string").repartition(3, "i"), path, "i")
    assert len([f for f in os.listdir(path) if f.startswith("part-")]) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    found, lines = files.packed_logs(spark, path)
    got = {r.log: (P.OUTCOMES[r["rank"]], r.node) for r in I.log_status(found, lines).collect()}
    want = {k: v for k, v in expected().items() if k != "run_3"}  # both its files are empty
    assert got == want | {f"more_{i}": ("cancelled", None) for i in range(40)}
    assert "a\tb\tCANCELLED" in {r.value for r in lines.collect()}
