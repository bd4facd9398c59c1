"""Connected components of a graph that lives in a DataFrame.

Alternates the large-star and small-star steps (Kiveris et al., 2014) until no edge
changes. Every step is a grouped minimum, pre-aggregated, and an equi-join on the node. A
hub's rows don't meet in one task: the minima of the nodes with most rows, ``HUBS`` of them at
most, are broadcast, and only the other nodes' rows are dealt by node. A step has as many tasks
as its rows need, ``ROWS`` for each, however many partitions are set: their files would fill the
disk before the rows do. Nothing but counts and a checksum reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

#: Hubs have more than HUB rows, and more than one in HUBS of all.
HUB, HUBS = 64, 1000
#: Rows of a task.
ROWS = 1 << 16


def _with_least(rows: DataFrame, low: DataFrame, many: int) -> DataFrame:
    """The rows (u, v) with m of their node u in low (u, m, n); n: the node's rows."""
    hubs = F.broadcast(low.where(F.col("n") > many).select("u", F.col("m").alias("top")))
    rows = rows.join(hubs, "u", "left")
    others = rows.where("top is null").drop("top").join(low.where(F.col("n") <= many).drop("n"), "u")
    return rows.where("top is not null").withColumnRenamed("top", "m").union(others)


def _large(edges: DataFrame, many: int) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    return _with_least(both, low, many).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame, many: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    linked = _with_least(down, low, many).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.union(low.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for each node of edges (u, v) that isn't its own."""
    edges = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    n, state = edges.count(), None
    while True:
        many, tasks = max(HUB, 2 * n // HUBS), 1 + n // ROWS  # rows of a step are twice the edges at most
        large = _large(edges.coalesce(tasks), many).coalesce(2 * tasks)
        edges = cut(_small(large, many).coalesce(2 * tasks).where("u <> v").distinct().coalesce(tasks))
        now = edges.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")).first()
        if state == now:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        n, state = now.n, now
