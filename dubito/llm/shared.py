"""Cutting lineage, labelled samples and checksums shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.folders import scratch, shared_folder


#: A key is hot beyond one row in so many.
HOT = 1000


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read from the shared folder from here on."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from: crc32 of the id as text is 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample_labels(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label) of the labelled rows that may be learnt from; one for each doc_id."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    rows = rows.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return rows.groupBy("doc_id").agg(F.max("label").alias("label"))


def bounded_sample(rows: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows of (doc_id, label), the least by the hash of doc_id: all if there are no more.

    A threshold on the hash comes first, so that no task sends much more than it keeps. The
    order makes the sample the same whenever it is read again.
    """
    n, place = rows.count(), F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    if n > most:
        rows = rows.where(place < int(min(1.0, (most + 4 * most**0.5) / n) * (1 << 30)))
    return rows.orderBy(place, "doc_id").limit(most)


def one_text(docs: DataFrame, *columns: str) -> DataFrame:
    """A row for each doc_id of (doc_id, text): of those that repeat it the least by the hash of its text, and the least of the other columns."""
    least = F.min_by("text", F.struct(F.xxhash64("text"), F.col("text")))
    return docs.groupBy("doc_id").agg(least.alias("text"), *(F.min(c).alias(c) for c in columns))


def attach(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """rows with the columns of facts, which has a row for each key of theirs, nulls included, and n, how many rows it stands for.

    Keys with more than one row in ``HOT`` of all, fewer than HOT of them, are broadcast, so no task reads a
    hot key's rows; the others meet by an equi-join. facts is read three times: cut it before.
    """
    facts = facts.withColumns({"__hash": F.xxhash64(key, F.col(key).isNull()), "__key": F.col(key)}).drop(key)
    many = max(64, (facts.agg(F.sum("n")).first()[0] or 0) // HOT)
    meets = F.col(key).eqNullSafe(F.col("__key"))
    hot, others = facts.where(F.col("n") > many).drop("n", "__hash"), facts.where(F.col("n") <= many).drop("n")
    found = rows.withColumn("__here", F.xxhash64(key, F.col(key).isNull())).join(F.broadcast(hot.withColumn("__hot", F.lit(True))), meets, "left")
    own = [c for c in hot.columns if c != "__key"]
    rest = found.where("__hot is null").drop("__key", "__hot", *own).join(others, (F.col("__here") == F.col("__hash")) & meets)
    return found.where("__hot").select(*rows.columns, *own).union(rest.select(*rows.columns, *own))


def unused(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have, whatever it has."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


__all__ = ["attach", "bounded_sample", "cut", "held_out", "one_text", "sample_labels", "scratch", "shared_folder", "unused"]
