"""Bootstrap intervals of any metric that counts by score decide, dealt by replicate.

A replicate gives each row a Poisson(1) weight (the limit of drawing as many rows with replacement), read
from the MD5 of seed, key and replicate: eight replicates from one digest, four hex digits each,
against the limits of the distribution. Nothing is drawn in a task's own order, so a run repeats, and
SQL can do the same. What merges is the state, rows and positives at each score and replicate; it is
summed before it is shuffled, and a metric works on all replicates at once, by columns. No task
holds a group or a replicate: windows hold a replicate's distinct scores.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import metrics as M

#: Takes (keys, score, n, p), counts at each score, and the keys; returns (keys, value).
Metric = Callable[[DataFrame, list[str]], DataFrame]
#: The replicate that holds every row once.
WHOLE = -1


def limits() -> list[str]:
    """Hex digits from which on a weight is one more: the distribution function of Poisson(1) in 1/65536."""
    p, total, out = math.exp(-1), 0.0, []
    while (total := total + p) * 65536 < 65535.5:
        out.append(f"{round(total * 65536):04x}")
        p /= len(out)
    return out


def auroc(table: DataFrame, keys: list[str]) -> DataFrame:
    """Of positives over the others."""
    return M.auroc_of(table, *keys).select(*keys, F.col("auroc").alias("value"))


def _negatives(table: DataFrame) -> DataFrame:
    return table.withColumn("p", F.col("n") - F.col("p"))


def accuracy_at(quantile: float) -> Metric:
    """M5: share of those that aren't positive among the rows up to the quantile of the score."""
    return lambda table, keys: M.at_quantiles_of(_negatives(table), [quantile], *keys).select(*keys, F.col("accuracy").alias("value"))


def aurac(table: DataFrame, keys: list[str]) -> DataFrame:
    """M6, of those that aren't positive."""
    return M.aurac_of(_negatives(table), *keys).select(*keys, F.col("aurac").alias("value"))


def replicates(df: DataFrame, label: Column, score: Column, key: Column, *by: str, n: int = 200, seed: int = 42, places: int | None = None) -> DataFrame:
    """(by, replicate, score, n, p): rows and positives at each score, as often as each replicate draws them, and once in WHOLE.

    key names a row; rows with equal keys are drawn together. A null label isn't positive, as in score_table.
    """
    score = score if places is None else F.round(score, places)
    rows = df.select(*by, score.alias("score"), label.cast("long").alias("y"), key.cast("string").alias("__key"))
    drawn = rows.withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit((n - 1) // 8))))
    drawn = drawn.withColumn("__md5", F.md5(F.concat(F.lit(f"{seed}:"), F.col("__i").cast("string"), F.lit(":"), F.coalesce("__key", F.lit(""))).cast("binary")))
    digits = lambda j: F.substring("__md5", 4 * j + 1, 4)
    weight = lambda j: reduce(lambda a, b: a + b, ((digits(j) >= x).cast("long") for x in limits()))
    each = F.array(*[F.struct((F.col("__i") * 8 + j).alias("replicate"), weight(j).alias("w")) for j in range(8)])
    drawn = drawn.select(*by, "score", "y", F.inline(each)).where((F.col("w") > 0) & (F.col("replicate") < n))
    every = drawn.union(rows.select(*by, "score", "y", F.lit(WHOLE), F.lit(1).cast("long")))
    return every.groupBy(*by, "replicate", "score").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.coalesce("y", F.lit(0))).alias("p"))


def bootstrap(df: DataFrame, label: Column, score: Column, key: Column, metrics: dict[str, Metric], *by: str, n: int = 200, level: float = 0.9, seed: int = 42, places: int | None = None) -> DataFrame:
    """M7: (by, metric, value, std_err, low, high, n): each metric of the rows, its deviation over the replicates, and the interval between their quantiles.

    n: replicates in which the metric is defined. A metric without a value for all rows has no row.
    """
    table, keys = replicates(df, label, score, key, *by, n=n, seed=seed, places=places), [*by, "replicate"]
    found = reduce(DataFrame.union, (f(table, keys).select(*keys, F.lit(name).alias("metric"), "value") for name, f in metrics.items()))
    drawn = F.when(F.col("replicate") != WHOLE, F.col("value"))
    out = found.where(F.col("value").isNotNull()).groupBy(*by, "metric").agg(
        F.max(F.when(F.col("replicate") == WHOLE, F.col("value"))).alias("value"), F.stddev_samp(drawn).alias("std_err"),
        F.percentile(drawn, F.lit((1 - level) / 2)).alias("low"), F.percentile(drawn, F.lit((1 + level) / 2)).alias("high"), F.count(drawn).alias("n"),
    )
    return out.where(F.col("value").isNotNull())
