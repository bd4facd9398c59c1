"""Reading and writing record files by Spark's own readers and writers, so any store will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .schemas import REQUIRED, SUBSET


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Blank lines are skipped; a malformed line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_tolerant(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(records, malformed lines)."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return parsed.where("r._bad is null").select("r.*").drop("_bad"), parsed.where("r._bad is not null").select("value")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): lines with their number from 1 on, by file, however many tasks a file is split over.

    A task reads its blocks' lines in order, so a line's place in its block is its running number in the
    task less the block's first one. A first scan counts the lines of each block; summed over the blocks
    before, that is what the places of a block start from. No line is shuffled: a table of blocks, a row
    for each split, is joined to them. Both scans deal blocks to tasks alike; should they not, places
    fall out of their block and the job fails.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    blocks = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    at = F.col("id") - F.col("first")
    placed = F.when(at.between(0, F.col("n") - 1), at + F.col("base") + 1).otherwise(F.raise_error(F.lit("the scans of a file differ")).cast("long"))
    return lines.join(blocks, ["file", "block"]).select("file", placed.alias("line"), "value")


def validate(spark: SparkSession, path: str, required: list[str] = REQUIRED, key: str = "question_idx") -> DataFrame:
    """S3: (file, line, value, question_idx, problem): problem is null, malformed, missing field or duplicate.

    A field is there if its key is, whatever its value. Of equal keys the first line counts.
    """
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    there = F.json_object_keys("value")
    lines = lines.withColumns({"keys": there, key: F.get_json_object("value", f"$.{key}").cast("long")})
    missing = F.size(F.array_except(F.array(*map(F.lit, required)), F.col("keys"))) > 0
    problem = F.when(F.col("keys").isNull(), "malformed").when(missing, "missing field")
    lines = lines.withColumn("problem", problem)
    first = lines.where("problem is null").groupBy("file", key).agg(F.min("line").alias("first"))
    out = lines.join(first, ["file", key], "left")
    return out.select("file", "line", "value", key, F.when(F.col("problem").isNull() & (F.col("line") > F.col("first")), "duplicate").otherwise(F.col("problem")).alias("problem"))


def done_keys(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """Keys of well-formed lines; one or several."""
    value = [F.get_json_object("value", f"$.{k}").cast("long").alias(k) for k in keys]
    return spark.read.text(path).select(*value).dropna().distinct()


def todo(items: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Items without a done key."""
    return items.join(done, list(keys), "left_anti")


def append_resumed(items: DataFrame, path: str, *keys: str) -> None:
    """Appends the items whose keys the folder doesn't hold yet, as JSON lines."""
    spark = items.sparkSession
    try:
        items = todo(items, done_keys(spark, path, *keys), *keys)
    except Exception as e:  # the folder doesn't exist before the first run
        if "PATH_NOT_FOUND" not in str(e):
            raise
    items.write.mode("append").json(path)


def rewrite(spark: SparkSession, path: str, new: DataFrame, format: str = "json") -> str:
    """Writes beside the folder, keeps what was there as a backup (never over an older one), then swaps."""
    fs = spark._jvm.org.apache.hadoop.fs
    p = fs.Path(path)
    store = p.getFileSystem(spark._jsc.hadoopConfiguration())
    fresh, n = fs.Path(path + ".new"), 0
    new.write.mode("overwrite").format(format).save(fresh.toString())
    while store.exists(backup := fs.Path(f"{path}.backup{n or ''}")):
        n += 1
    if not store.rename(p, backup):
        raise OSError(f"{path} can't be kept as {backup.toString()}; nothing was changed")
    if not store.rename(fresh, p):
        if not store.rename(backup, p):
            raise OSError(f"{path} stands at {backup.toString()}, its new rows at {fresh.toString()}")
        raise OSError(f"{fresh.toString()} can't take the place of {path}, which is as it was")
    return backup.toString()


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document a file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_subset(spark: SparkSession, path: str) -> DataFrame:
    """The keys of a subset file, in rows."""
    return read_document(spark, path, SUBSET).select(F.explode("question_indices").alias("question_idx"))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """With a header; quoted fields may hold line ends."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed lines that aren't blank."""
    return spark.read.text(path).select(F.trim("value").alias("value")).where("value <> ''")


def write_document(df: DataFrame, path: str) -> None:
    """Each row as a JSON document in a text file."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("errorifexists").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    """S20."""
    df.write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def line_counts(spark: SparkSession, path: str) -> DataFrame:
    """(path, n) of each file."""
    return spark.read.text(path).groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("n"))


def line_count(spark: SparkSession, path: str) -> int:
    """Lines of a file or folder, -1 if it can't be read."""
    try:
        return spark.read.text(path).count()
    except Exception:
        return -1


def _log_of(path: Column) -> tuple[Column, Column]:
    """(log, kind): the name without its end, out or err; "" for other files. A log may also be a folder of parts, as Spark writes it."""
    plain = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    name = F.coalesce(F.nullif(F.regexp_extract(plain, r"([^/]*\.(?:out|err))$", 1), F.lit("")), F.regexp_extract(plain, r"/(?:\w+=)?([^/]+\.(?:out|err))/[^/]*$", 1))
    return F.left(name, F.greatest(F.length(name) - 4, F.lit(0))), F.right(name, F.lit(3))


def _log_scan(spark: SparkSession, path: str, format: str) -> DataFrame:
    return _logs_of(spark.read.format(format).option("recursiveFileLookup", True).load(path).withColumn("file", F.col("_metadata.file_path")))


def _logs_of(df: DataFrame) -> DataFrame:
    log, kind = _log_of(F.col("file"))
    df = df.withColumn("file", F.regexp_replace("file", "^file:/+", "file:/"))  # one file, two spellings
    return df.withColumns({"log": log, "kind": kind}).where("log <> ''")


def log_files(spark: SparkSession, path: str) -> DataFrame:
    """(log, kind, modified, bytes) of the .out and .err files below a folder; none is opened.

    Spark's scans leave empty files out, so the names come from the list of files that the driver holds for any scan; an empty file's
    time is null, which counts as the latest, as its job has just begun.
    """
    found = _log_scan(spark, path, "binaryFile").select("file", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).inputFiles()
    names = _logs_of(spark.range(1).select(F.explode(F.split(F.lit("\n".join(listed)), "\n")).alias("file")))  # encoded, so without line ends
    return names.join(found, "file", "left").select("log", "kind", "modified", F.coalesce("bytes", F.lit(0)).alias("bytes"))


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(log, kind, at, value): the lines of all logs, read in splits; at orders those of one log, .out before .err."""
    at = F.struct(F.col("kind") == "err", F.col("file"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return _log_scan(spark, path, "text").select("log", "kind", at.alias("at"), "value")


def pack_logs(lines: DataFrame, path: str, *order: str) -> None:
    """Logs of (name, value), many in a file: each line behind its log's name and a tab, a log's lines together, by order.

    A file for each log costs a folder's worth of work for a few lines. Names have no tab or line end, values no line end.
    """
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = lines.repartition(n, "name").sortWithinPartitions("name", *order)
    rows.select(F.concat("name", F.lit("\t"), F.coalesce("value", F.lit(""))).alias("value")).write.mode("errorifexists").text(path)


def packed_logs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """What log_files and log_lines give, from files of pack_logs, read in splits. modified is the time of a log's file; logs without lines aren't there."""
    at = F.struct(F.col("kind") == "err", F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    name = F.substring_index("line", "\t", 1)
    df = spark.read.text(path).withColumnRenamed("value", "line").where(name.rlike(r"\.(?:out|err)$"))
    df = df.withColumns({"log": F.left(name, F.length(name) - 4), "kind": F.right(name, F.lit(3)), "value": F.substring("line", F.length(name) + 2, F.length("line"))})
    found = df.groupBy("log", "kind").agg(F.max("_metadata.file_modification_time").alias("modified"), F.sum(F.octet_length("value") + 1).alias("bytes"))
    return found, df.select("log", "kind", at.alias("at"), "value")


def write_store(df: DataFrame, path: str) -> None:
    """A document store as Parquet; an existing one is left alone. SQLite files: sources/sqlite.py."""
    df.write.mode("errorifexists").parquet(path)


def lookup(store: DataFrame, keys: DataFrame, key: str = "title") -> tuple[DataFrame, DataFrame]:
    """(documents of the keys, keys without a document)."""
    return store.join(keys.select(key).distinct(), key, "left_semi"), keys.select(key).distinct().join(store, key, "left_anti")
