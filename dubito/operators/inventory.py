"""Run inventory: completeness, pending work, logs and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import tag_of
from ..functions.phrases import COMPLETE_SHORT, NO_LOG, NODE, OUTCOMES, SETTINGS
from ..functions.text import manifest_fields, outcome, printable


def completeness(counts: DataFrame, by: str, complete: int = COMPLETE_SHORT) -> DataFrame:
    """Complete, partial and all files of each line; empty files are neither. counts: (by, n)."""
    return counts.groupBy(by).agg(F.count_if(F.col("n") == complete).alias("complete"), F.count_if((F.col("n") > 0) & (F.col("n") < complete)).alias("partial"), F.count("*").alias("total"))


def pending(generated: DataFrame, judged: DataFrame, complete: int = COMPLETE_SHORT) -> DataFrame:
    """Complete generations whose tag has no complete judgement. Both: (path, n)."""
    done = judged.where(F.col("n") == complete).select(tag_of(F.col("path")).alias("tag")).distinct()
    return generated.where(F.col("n") == complete).withColumn("tag", tag_of(F.col("path"))).join(done, "tag", "left_anti")


def require_complete(n: Column, complete: int = COMPLETE_SHORT) -> Column:
    """A file with fewer lines is refused."""
    return F.when(n >= complete, n).otherwise(F.raise_error(F.concat(F.lit("incomplete: "), n.cast("string"))))


def outcomes(logs: DataFrame) -> DataFrame:
    """How logs ended. logs: (name, text)."""
    kind = outcome(F.col("text"))
    return logs.groupBy(F.when(kind == "done", "done").when(kind == "running or unknown", kind).otherwise("failed").alias("outcome")).count().withColumnRenamed("count", "n")


def _rank(text: Column) -> Column:
    """The place of a text's outcome in OUTCOMES: of several lines the least counts, as if they were one text."""
    return F.map_from_arrays(F.array(*map(F.lit, OUTCOMES)), F.array(*map(F.lit, range(len(OUTCOMES)))))[outcome(text)]


def _outcome_at(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, OUTCOMES)), rank + 1)


def log_status(files: DataFrame, lines: DataFrame, node: str = NODE) -> DataFrame:
    """(log, out, modified, bytes, rank, node): a row for each log, its .out and .err as one.

    Each line is classified where it is read, so a log may be of any size and cut into splits; only lines
    that tell an outcome or a node are shuffled. The first outcome in order counts, the first node named, .out
    before .err. out: whether there is an .out; modified is that file's time, null if it is empty. Logs that tell nothing are
    "running or unknown". files: (log, kind, modified, bytes), lines: (log, kind, at, value).
    """
    told = lines.select("log", "at", _rank(F.col("value")).alias("rank"), F.nullif(F.regexp_extract("value", node, 1), F.lit("")).alias("node"))
    told = told.where((F.col("rank") < len(OUTCOMES) - 1) | F.col("node").isNotNull())
    told = told.groupBy("log").agg(F.min("rank").alias("rank"), F.min_by("node", F.when(F.col("node").isNotNull(), F.col("at"))).alias("node"))
    out = F.col("kind") == "out"
    logs = files.groupBy("log").agg(F.max(out).alias("out"), F.max(F.when(out, F.col("modified"))).alias("modified"), F.sum("bytes").alias("bytes"))
    return logs.join(told, "log", "left").withColumn("rank", F.coalesce("rank", F.lit(len(OUTCOMES) - 1)))


def _latest(status: DataFrame, last: int | None) -> DataFrame:
    logs = status.where("out")
    return logs if last is None else logs.orderBy(F.desc_nulls_first("modified"), F.desc("log")).limit(last)


def tally(status: DataFrame, last: int | None = None) -> DataFrame:
    """(outcome, n) of the logs with an .out, or of the last ones changed: done, failed, running or unknown."""
    rank = F.col("rank")
    kind = F.when((rank == 0) | (rank == len(OUTCOMES) - 1), _outcome_at(rank)).otherwise("failed")
    return _latest(status, last).groupBy(kind.alias("outcome")).agg(F.count("*").alias("n"))


def failures(status: DataFrame, last: int | None = None) -> DataFrame:
    """(log, node, reason) of those that failed; an unknown node is empty."""
    failed = _latest(status, last).where((F.col("rank") > 0) & (F.col("rank") < len(OUTCOMES) - 1))
    return failed.select(printable(F.col("log")).alias("log"), F.coalesce("node", F.lit("")).alias("node"), _outcome_at(F.col("rank")).alias("reason"))


def manifest(lines: DataFrame, since: Column | None = None) -> DataFrame:
    """(line, time, job, stage, node, description) of well-formed lines with a job. lines: (line, value); line may be anything that orders them."""
    rows = lines.select("line", manifest_fields(F.col("value")).alias("m")).where("m is not null").select("line", "m.time", "m.fields")
    job = F.col("fields")["job"]
    rows = rows.where(job.isNotNull() & ~job.isin("", "none"))
    if since is not None:
        rows = rows.where(F.col("time") >= since)
    bits = F.array_compact(F.array(*[F.when(F.col("fields")[k].isNotNull(), F.concat(F.lit(f"{k}="), F.col("fields")[k])) for k in SETTINGS]))
    node = F.substring_index(F.col("fields")["node"], ".", 1)
    return rows.select("line", "time", job.alias("job"), F.nullif(F.col("fields")["stage"], F.lit("")).alias("stage"), F.nullif(node, F.lit("")).alias("node"), F.array_join(bits, " ").alias("description"))


def history(rows: DataFrame) -> DataFrame:
    """First and last time, stages in order, last node, longest description of each job."""
    return rows.groupBy("job").agg(
        F.min_by("time", "line").alias("first"), F.max_by("time", "line").alias("last"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("stage").isNotNull(), F.struct("line", "stage")))), lambda s: s["stage"]).alias("stages"),
        F.max_by("node", F.when(F.col("node").isNotNull(), F.col("line"))).alias("node"),
        F.min_by("description", F.struct(-F.length("description"), "line")).alias("description"),
    )


def with_outcome(jobs: DataFrame, logs: DataFrame) -> DataFrame:
    """The outcome of each job from the logs named after it, else from the latest output that mentions it.

    Each log is classified by itself; of a job's outcomes the first in order counts (done, then
    the failures as listed), as if its logs were one text. Mentions ("job=<id>") are taken out of
    each log once, so both ways are equi-joins, and no text is shuffled. logs: (name, text).
    """
    read = logs.select("name", _rank(F.col("text")).alias("rank"), F.array_distinct(F.regexp_extract_all("text", F.lit(r"job=(\w+)"), F.lit(1))).alias("mentions"))
    by_name = read.select(F.regexp_extract("name", r"_(\d+)(?:_\d+)?\.(out|err)$", 1).alias("job"), "rank").where("job <> ''").groupBy("job").agg(F.min("rank").alias("named"))
    by_text = read.where(F.endswith("name", F.lit(".out"))).select(F.explode("mentions").alias("job"), "name", "rank").groupBy("job").agg(F.max_by("rank", "name").alias("mentioned"))
    return _with_ranks(jobs, by_name, by_text)


def _with_ranks(jobs: DataFrame, by_name: DataFrame, by_text: DataFrame) -> DataFrame:
    rank = F.coalesce("named", "mentioned")
    label = F.when(rank.isNull() | (rank < 0), NO_LOG).otherwise(_outcome_at(rank))
    return jobs.join(by_name, "job", "left").join(by_text, "job", "left").withColumn("outcome", label).drop("named", "mentioned")


def with_log_outcome(jobs: DataFrame, status: DataFrame, lines: DataFrame) -> DataFrame:
    """As with_outcome, from log files: a log named after the job, else the .out of the greatest name with a line that mentions it, with its .err.

    Where these are empty the job has no outcome. status: log_status of the same lines.
    """
    logs = status.select("log", F.when(F.col("bytes") > 0, F.col("rank")).alias("rank"))
    by_name = logs.select(F.regexp_extract("log", r"_(\d+)(?:_\d+)?$", 1).alias("job"), "rank").where("job <> ''").groupBy("job").agg(F.coalesce(F.min("rank"), F.lit(-1)).alias("named"))
    said = lines.where((F.col("kind") == "out") & F.contains("value", F.lit("job="))).select("log", F.explode(F.regexp_extract_all("value", F.lit(r"job=(\w+)"), F.lit(1))).alias("job"))
    latest = said.groupBy("job").agg(F.max(F.concat("log", F.lit(".out"))).alias("name"))
    by_text = latest.select("job", F.left("name", F.length("name") - 4).alias("log")).join(logs, "log").select("job", F.col("rank").alias("mentioned"))
    return _with_ranks(jobs, by_name, by_text)


def recent(df: DataFrame, order: str, k: int, *ties: str) -> DataFrame:
    """O5."""
    return df.orderBy(F.desc(order), *map(F.desc, ties)).limit(k)
