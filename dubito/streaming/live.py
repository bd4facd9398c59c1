"""A live table: what a long run has so far, seen in snapshots, and continued by later runs.

A snapshot holds all rows before it, so writing each one whole would write a row as often as
there are snapshots. Here every row is written once, with its number, and a snapshot is the
rows up to a number. An append is a folder of data and one entry of a log that names it: the
entry is the commit, so a run that breaks off before it leaves nothing to be seen. Files and
entries grow with the appends, not with the snapshots.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import running


def numbered(df: DataFrame, order: str, base: int = 0) -> DataFrame:
    """Df with __row, its number by the order from base + 1 on.

    order: a numeric column without ties or nulls. Ranges of it are counted first, so no task orders all rows.
    """
    rows = running(df.withColumn("__one", F.lit(1)), {"__one": "__row"}, [], order)
    return rows.withColumn("__row", (F.col("__row") + base).cast("long")).drop("__one")


def write_live(df: DataFrame, path: str, order: str, every: int = 500) -> None:
    """A new live table of the rows, shown every so many; an error where there is one."""
    if _log(df.sparkSession, path):
        raise ValueError(f"{path} holds a live table")
    append_live(df, path, order, every)


def append_live(df: DataFrame, path: str, order: str, every: int = 500, batch: str | None = None) -> int:
    """Adds the rows behind those there are and gives the number of the last row.

    Within an append rows go by the order. A batch that the log names already is not added again. The
    snapshots' size is the first run's; another is refused. Of two appends at once the later one
    to commit fails, and its data are never seen.
    """
    spark = df.sparkSession
    log = _log(spark, path)
    if log and log[-1]["every"] != every:
        raise ValueError(f"{path} is shown every {log[-1]['every']} rows, not every {every}")
    base = log[-1]["last"] if log else 0
    if batch is not None and any(entry["batch"] == batch for entry in log):
        return base
    seen, part = Observation(), uuid.uuid4().hex
    numbered(df, order, base).observe(seen, F.max("__row").alias("last")).write.parquet(f"{path}/data/{part}")
    last = seen.get["last"] or base
    _commit(spark, path, len(log), {"part": part, "first": base + 1, "last": last, "every": every, "batch": batch})
    return last


def snapshots(spark: SparkSession, path: str) -> int:
    """How many snapshots are full; rows behind the last one wait for more."""
    log = _log(spark, path)
    return log[-1]["last"] // log[-1]["every"] if log else 0


def snapshot(spark: SparkSession, path: str, number: int) -> DataFrame:
    """The rows that a snapshot shows, the last full one if there are fewer; an error where there is no table.

    Only appends that began before it are read, and the scan is given the row number.
    """
    log = _log(spark, path)
    if not log:
        raise ValueError(f"{path} holds no live table")
    limit = min(number, log[-1]["last"] // log[-1]["every"]) * log[-1]["every"]
    parts = [e["part"] for e in log if e["first"] <= max(limit, 1)]
    return spark.read.parquet(*(f"{path}/data/{p}" for p in parts)).where(F.col("__row") <= limit).drop("__row")


def _store(spark: SparkSession, path: str):
    """The file system of a path, and paths in it."""
    new = spark._jvm.org.apache.hadoop.fs.Path
    return new(path).getFileSystem(spark._jsc.hadoopConfiguration()), new


def _log(spark: SparkSession, path: str) -> list[dict]:
    """Entries of the log, one for each append, by number."""
    store, new = _store(spark, path)
    if not store.exists(new(f"{path}/log")):
        return []
    found = spark.read.text(f"{path}/log", pathGlobFilter="*.json").collect()  # a line for each append
    return sorted((json.loads(r[0]) for r in found), key=lambda e: e["number"])


def _commit(spark: SparkSession, path: str, number: int, entry: dict) -> None:
    """Adds an entry under its number, whole or not at all; an error if another run has taken the number."""
    store, new = _store(spark, path)
    held = new(f"{path}/log/_{entry['part']}")  # Spark reads no names like this
    out = store.create(held, False)
    out.write(bytearray(json.dumps({"number": number} | entry).encode()))
    out.close()
    files = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(held.toUri(), spark._jsc.hadoopConfiguration())
    kind = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    files.rename(files.makeQualified(held), files.makeQualified(new(f"{path}/log/{number:012d}.json")), spark.sparkContext._gateway.new_array(kind, 0))
