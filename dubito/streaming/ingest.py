"""Incremental ingest of record files: each key once, however often a run is resumed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def ingest_once(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, *keys: str) -> StreamingQuery:
    """Takes new JSON-lines files of a folder to a Parquet folder; rows whose keys came before are left out.

    The keys seen are the stream's state, dealt over the cluster, so a micro-batch costs what it
    brings and the target is never read. The sink's log names the files that count: a batch that
    is run again after a failure adds none twice. Of rows with one key in a batch one is kept.
    """
    stream = spark.readStream.schema(schema).option("mode", "PERMISSIVE").json(source)
    rows = stream.where(" and ".join(f"{k} is not null" for k in keys)).dropDuplicates(list(keys))
    return rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


BUCKETS = 256


def take_batch(batch: DataFrame, number: int, target: str, *keys: str, buckets: int = BUCKETS) -> None:
    """Adds the batch's rows whose keys no earlier batch holds, the first row of each key by file and place in it.

    The target is a folder for each batch, in it one for each bucket of keys. Of what is held only the
    keys of the batch's own buckets are read, and only those of earlier batches: a batch that
    is run again finds what it found before and takes its own folder's place. No state is kept elsewhere.
    """
    spark, where = batch.sparkSession, ("__file", "__block", "__at")
    rows = batch.where(" and ".join(f"`{k}` is not null" for k in keys)).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    others = [c for c in rows.columns if c not in (*keys, *where, "bucket")]
    first = rows.groupBy(*keys, "bucket").agg(F.min_by(F.struct(*others), F.struct(*where)).alias("__row")) if others else rows.select(*keys, "bucket").distinct()
    fresh = first.select(*keys, *(F.col("__row")[c].alias(c) for c in others), "bucket")
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        touched = [r[0] for r in rows.select("bucket").distinct().collect()]  # so many buckets at most
        kinds = dict(fresh.dtypes)
        schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", batch bigint, bucket int"
        held = spark.read.schema(schema).parquet(target).where(F.col("bucket").isin(touched) & (F.col("batch") < number))
        fresh = fresh.join(held.select("bucket", *keys), ["bucket", *keys], "left_anti")
    fresh.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/batch={number}")


def ingest_buckets(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, *keys: str, buckets: int = BUCKETS) -> StreamingQuery:
    """§2.11: takes new JSON-lines files of a folder to a Parquet folder; rows whose keys came before are left out.

    The stream keeps no keys: memory doesn't grow with them, and a batch reads the keys of its own buckets
    alone. The first row of a key wins, by batch, then by file and place. The settings of the first run hold: another key
    or number of buckets for the same target is refused.
    """
    settings = f"{','.join(keys)} in {buckets}"
    fs = spark._jvm.org.apache.hadoop.fs
    note = fs.Path(f"{target}/_keys")
    store = note.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(note):
        spark.range(1).select(F.lit(settings)).coalesce(1).write.text(note.toString())
    elif (was := spark.read.text(note.toString()).first()[0]) != settings:
        raise ValueError(f"{target} holds keys by {was}, not by {settings}")
    stream = spark.readStream.schema(schema).option("mode", "PERMISSIVE").json(source)
    stream = stream.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"))
    take = lambda batch, number: take_batch(batch.withColumn("__at", F.monotonically_increasing_id()), number, target, *keys, buckets=buckets)
    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(spark: SparkSession, target: str) -> DataFrame:
    """Rows held so far."""
    return spark.read.parquet(target).agg(F.count("*").alias("n"))
