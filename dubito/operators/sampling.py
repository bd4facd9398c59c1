"""Seeded samples without replacement. Order is by the MD5 of the seed and the key, the same on every cluster and in every engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_hash(seed: int, key: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))


def sample_ids(pool: DataFrame, n: int, seed: int, reserved_tail: int = 0, key: str = "question_idx", early: bool = True) -> DataFrame:
    """N keys, ascending, not among the reserved greatest ones; an error if there are too few.

    early: they are counted before the plan is built (ValueError). Otherwise within it, by a part that gives no row or fails.
    """
    if reserved_tail:
        tail = pool.select(key).orderBy(F.desc(key)).limit(reserved_tail)
        pool = pool.join(F.broadcast(tail), key, "left_anti")  # reserved_tail rows
    drawn = pool.select(key).orderBy(by_hash(seed, key), key).limit(n)
    if not early:
        few = F.raise_error(F.concat(F.lit(f"{n} asked for, there are "), F.col("__n").cast("string"))).cast("boolean")
        none = pool.agg(F.count("*").alias("__n")).where(F.when(F.col("__n") < n, few).otherwise(F.lit(False)))
        drawn = drawn.union(none.select(F.col("__n").cast(pool.schema[key].dataType)))
    elif pool.count() < n:
        raise ValueError(f"{n} asked for, fewer there")
    return drawn.orderBy(key)


def seed_samples(pool: DataFrame, n: int, seeds: list[int], key: str = "question_idx", early: bool = True) -> DataFrame:
    """A sample for each seed, from one pool."""
    out = None
    for s in seeds:
        one = sample_ids(pool, n, s, key=key, early=early).withColumn("seed", F.lit(s))
        out = one if out is None else out.union(one)
    return out


def sample_or_all(pool: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """N rows, or all if there are no more."""
    return pool.orderBy(by_hash(seed, key), key).limit(n)
