"""Selection by keys, thresholds and entropies, and set algebra on keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.phrases import CANONICAL
from ..functions.text import is_abstained, short_abstention
from .metrics import parted


def keep_members(df: DataFrame, ids: DataFrame, key: str = "question_idx") -> DataFrame:
    """rows whose key is listed; duplicates stay. Spark broadcasts ids where they are small."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def missing_members(df: DataFrame, ids: DataFrame, key: str = "question_idx") -> DataFrame:
    """Listed keys without a row."""
    return ids.select(key).distinct().join(df, key, "left_anti")


def require_members(df: DataFrame, ids: DataFrame, key: str = "question_idx", early: bool = True) -> DataFrame:
    """The rows of all listed keys; a missing key is an error.

    early: a job of its own looks for missing keys before the plan is built, and the error (KeyError) names up
    to five. Otherwise the plan checks as it runs, in the one join that gives the rows: nothing runs twice, and
    the job fails at a missing key, which it names. A null among the keys is missing.
    """
    if not early:
        rows = ids.select(key).distinct().join(df.withColumn("__held", F.lit(True)), key, "left")
        none = F.raise_error(F.concat(F.lit(f"no record for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
        return rows.where(F.coalesce("__held", none.cast("boolean"))).drop("__held")  # of both sides, so the join stays an outer one
    missing = missing_members(df, ids, key)
    if found := missing.take(5):
        raise KeyError(f"no record for {[r[0] for r in found]}")
    return df.join(ids.select(key).distinct(), key)


def reuse_or_rescan(stored: DataFrame, ids: DataFrame, rescan, key: str = "question_idx", early: bool = True) -> DataFrame:
    """Stored records if all listed keys have one, else rescan(ids) of all.

    early: a job of its own decides which while the plan is built. Otherwise the plan decides as it runs: rescan
    gets all ids or none, and gives stored's columns.
    """
    if early:
        return keep_members(stored, ids, key) if missing_members(stored, ids, key).isEmpty() else rescan(ids)
    found = missing_members(stored, ids, key).limit(1).agg(F.count("*").alias("__missing"))  # one row
    given = lambda df, where: df.crossJoin(F.broadcast(found.where(where))).drop("__missing")
    return given(keep_members(stored, ids, key), "__missing = 0").unionByName(rescan(given(ids, "__missing > 0")))


def uncertain_then_wrong(df: DataFrame, threshold: float, wrong: Column) -> DataFrame:
    """wrong and at or above the threshold."""
    return df.where(wrong & (F.col("semantic_entropy") >= threshold))


def confidently_wrong(df: DataFrame, threshold: float, wrong: Column) -> DataFrame:
    """wrong and below the threshold."""
    return df.where(wrong & (F.col("semantic_entropy") < threshold))


def keep_answered(df: DataFrame, response: str) -> DataFrame:
    """F6."""
    return df.where(~is_abstained(F.col(response)))


def blank_abstained(df: DataFrame, flag: str, response: str) -> DataFrame:
    """the row stays, its text goes."""
    return df.withColumn(response, F.when(F.col(flag), "").otherwise(F.col(response)))


def canonicalise(df: DataFrame, scalar: str, array: str) -> DataFrame:
    """F8: abstentions of a text and of an array's texts, with their number."""
    rows = df.withColumns({"n_scalar": short_abstention(F.col(scalar)).cast("int"), "__marks": F.transform(array, short_abstention)})  # once for both uses
    own = F.zip_with(array, "__marks", lambda x, gone: F.when(gone, F.lit(CANONICAL)).otherwise(x))
    rows = rows.withColumns({"n_array": F.size(F.filter("__marks", lambda m: m)), scalar: F.when(F.col("n_scalar") == 1, F.lit(CANONICAL)).otherwise(F.col(scalar)), array: own})
    return rows.drop("__marks")


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """F10."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    return df.select(*names)


def role_column(df: DataFrame, role: str) -> DataFrame:
    """{role}_response as response."""
    return require_columns(df, "question_idx", f"{role}_response").withColumnRenamed(f"{role}_response", "response")


def index_range(df: DataFrame, lo: int, hi: int, key: str = "question_idx") -> DataFrame:
    """lo <= key < hi."""
    return df.where((F.col(key) >= lo) & (F.col(key) < hi))


def resolve_ids(spark, explicit: list[int] | None = None, thresholds: DataFrame | None = None, threshold: float | None = None, items: DataFrame | None = None, first: int | None = None) -> DataFrame:
    """ids given, else of a threshold's row, else of the first items."""
    if explicit is not None:
        return spark.range(1).select(F.explode(F.array(*map(F.lit, explicit)).cast("array<bigint>")).alias("question_idx"))
    if threshold is not None:
        return threshold_row(thresholds, threshold).select(F.explode("question_indices").alias("question_idx"))
    return items.select("question_idx").orderBy("question_idx").limit(first)


def threshold_row(thresholds: DataFrame, threshold: float) -> DataFrame:
    """the row of exactly this threshold; an error that lists those there are if there is none."""
    row = thresholds.where(F.col("threshold") == F.lit(float(threshold)))
    if row.isEmpty():
        raise KeyError(f"no threshold {threshold}; there are {sorted(r[0] for r in thresholds.select('threshold').limit(100).collect())}")
    return row


def both_high(teacher: DataFrame, student: DataFrame, thresholds: list[float], key: str = "question_idx") -> DataFrame:
    """For each threshold the keys at or above it in either table and in both.

    One row a key is kept (the table's greatest entropy), so one join serves all thresholds.
    """
    t, s = (d.groupBy(key).agg(F.max("semantic_entropy").alias(n)) for d, n in ((teacher, "t"), (student, "s")))
    cuts = F.array(*[F.lit(float(x)) for x in sorted(set(thresholds))])
    rows = t.join(s, key, "full").select(key, "t", "s", F.explode(cuts).alias("threshold"))
    high = lambda c: F.coalesce(F.col(c) >= F.col("threshold"), F.lit(False))
    g = rows.groupBy("threshold").agg(
        F.count_if(high("t")).alias("teacher_high"), F.count_if(high("s")).alias("student_high"), F.count_if(high("t") & high("s")).alias("both_high"),
        F.count_if(F.col("t").isNotNull() & F.col("s").isNotNull()).alias("n_common"),
    )
    return g.withColumn("both_high_pct", F.when(F.col("n_common") > 0, 100 * F.col("both_high") / F.col("n_common")).otherwise(0.0))


def both_high_ids(teacher: DataFrame, student: DataFrame, threshold: float, key: str = "question_idx") -> DataFrame:
    """The keys themselves, as rows."""
    high = lambda d: d.where(F.col("semantic_entropy") >= threshold).select(key).distinct()
    return high(teacher).join(high(student), key, "left_semi")


def coverage(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of either table alone and of both."""
    x, y = (d.select(key).distinct().withColumn(n, F.lit(True)) for d, n in ((a, "in_a"), (b, "in_b")))
    j = x.join(y, key, "full")
    return j.agg(F.count_if(F.col("in_b").isNull()).alias("only_a"), F.count_if(F.col("in_a").isNull()).alias("only_b"), F.count_if(F.col("in_a") & F.col("in_b")).alias("both"))


def symmetric_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of one table alone, with the side."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.join(y, key, "left_anti").withColumn("side", F.lit("a")).union(y.join(x, key, "left_anti").withColumn("side", F.lit("b")))


def gaps(df: DataFrame, key: str) -> DataFrame:
    """Numbers between the least and the greatest key that are missing.

    From the distances of neighbouring keys. A window holds one range of keys, of many with
    about as many keys each; the greatest key of the ranges before is the first one's neighbour.
    """
    k = parted(df.select(F.col(key).cast("long").alias("k")).where("k is not null").distinct(), "k", [])
    ends = k.groupBy("part").agg(F.max("k").alias("last"))
    ends = ends.select("part", F.max("last").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("left"))  # a row for each range
    k = k.join(F.broadcast(ends), "part").select("k", F.coalesce(F.lag("k").over(Window.partitionBy("part").orderBy("k")), "left").alias("before"))
    width = 1 << 16  # numbers written out at once
    holes = k.where("k - before > 1").select(F.explode(F.sequence(F.col("before") + 1, F.col("k") - 1, F.lit(width).cast("long"))).alias("lo"), F.col("k").alias("end"))
    return holes.select(F.explode(F.sequence("lo", F.least(F.col("lo") + width - 1, F.col("end") - 1))).alias(key))
