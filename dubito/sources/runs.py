"""Many runs' record files in one scan, some of which may be absent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import literal_rows, matched

END = ".jsonl"


def find_runs(spark: SparkSession, paths: list[str]) -> dict[str, bool]:
    """The qualified paths of runs, in order, and whether something is there. One question to the store for each run."""
    found, fs = {}, spark._jvm.org.apache.hadoop.fs
    for path in map(fs.Path, paths):
        store = path.getFileSystem(spark._jsc.hadoopConfiguration())
        found[store.makeQualified(path).toString()] = store.exists(path)
    return found


def read_runs(spark: SparkSession, paths: list[str], schema: str) -> tuple[DataFrame, DataFrame]:
    """(records with run, (run, present) of all paths): JSON lines of those there, in one scan.

    A path is a file or a folder of parts and ends in .jsonl; run is its last part. Paths that are absent give no records
    and no error; two paths with one last part are refused, as are paths of another ending.
    """
    found = find_runs(spark, paths)
    names = [p.rsplit("/", 1)[1] for p in found]
    if len(set(names)) < len(names) or not all(n.endswith(END) for n in names):
        raise ValueError(f"runs need names of their own that end in {END}: {names}")
    there = [p for p, present in found.items() if present]
    run = F.regexp_extract(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), r"([^/]*\.jsonl)(?:/[^/]*)?$", 1)
    if there:
        records = spark.read.schema(schema).option("mode", "FAILFAST").json(there).select("*", run.alias("run"))
    else:
        records = spark.range(0).select(F.from_json(F.lit(None).cast("string"), schema).alias("r"), F.lit("").alias("run")).select("r.*", "run")
    return records, literal_rows(spark, [{"run": n, "present": p} for n, p in zip(names, found.values())], "run", "present")


def with_absent(runs: DataFrame, report: DataFrame) -> DataFrame:
    """A row for each run: the report's, or nulls where the run is absent or has no records that count. Both: by run."""
    return matched(runs, report, ["run"], "left")
