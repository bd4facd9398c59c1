"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions alone.

Each source has a target of words. Of target / size of the source the whole part are copies that every
document gets for certain; the rest is a fraction f, the inclusion probability of one more copy. Documents
are ranked by random odds divided by inclusion odds, (u / (1 - u)) / (f / (1 - f)), u a uniform number from
a hash of key and text, and taken in that order until the words that are left are used up: a sample of
fixed size in words. ``preference`` multiplies a document's inclusion odds, so that samples of unequal
probabilities are drawn within a source as well. No document gets more than floor(target / size) + 1 copies,
and none more than ``MOST``.

What the first document that doesn't fit leaves open is filled by later ones of its range that fit, in order,
``PASSES`` times; last comes the shortest one of the range, if the source is nearer to its target with it.

Nothing gathers a source in one task: a source's documents are dealt to ranges of their rank, ``EACH`` to a
range or so; ranges are summed first, and only the range where the words run out is looked at row by row.
Sources with many documents are joined by broadcast, less than a thousand of them; sources are
ranked over range partitions, however many there are. Rows alike in key, source, size and draw are
one row with a count until the end.

Targets: sources by code point, null last, weigh by the given numbers in turn and share ``SHARE`` times all
words; a target stops at MOST times its source's size, and the excess goes to the others by weight. That
is the level t with sum(min(t * weight, MOST * size)) = SHARE * all, found from running sums.

Defined results: null and empty texts have size 0 and take none; rows with a null doc_id are mixed like
any other; repeated rows are documents of their own; sources without words have target 0. The hash
makes every run the same. An empty table gives an empty one, other columns aren't read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import attach, cut

WEIGHTS, SHARE, MOST, SEED = (3, 1, 2), 1.5, 2, 42
#: Documents of a range of ranks, about; times that a range's open words are filled.
EACH, PASSES = 1 << 11, 6
WORD = r"[^\x20\x09-\x0D]+"


def uniform(seed: int, *of: Column) -> Column:
    """A number from 2^-53 to 1 - 2^-53, from 52 bits of MD5."""
    key = F.concat(F.lit(f"{seed}"), *(x for c in of for x in (F.lit(":"), F.coalesce(c.cast("string"), F.lit("")))))
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("long") + 0.5) / F.lit(float(1 << 52))


def in_order(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """df with running sums in the order: sums maps a column to the name of its sum up to and with the row.

    Rows are dealt to ranges of the order and kept so; a window holds one partition of them, and one the partitions' sums.
    """
    held = cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    total = held.groupBy("__part").agg(*(F.sum(c).alias(f"__{c}") for c in sums))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    total = total.select(F.col("__part"), *(F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)).alias(f"__{c}") for c in sums))
    here = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = held.join(total, "__part")
    return rows.withColumns({name: F.sum(c).over(here) + F.col(f"__{c}") for c, name in sums.items()}).drop("__part", *(f"__{c}" for c in sums))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """sizes (source, source_size, ...) with target, a double, and what those given of it make."""
    numbered = in_order(sizes.withColumn("__one", F.lit(1)), [F.col("source").asc_nulls_last()], {"__one": "__place"})
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.col("__place") - 1) % len(weights) + 1).cast("int"))
    cap = most * F.col("source_size").cast("double")
    held = cut(numbered.withColumns({"__w": weight, "__cap": cap}).drop("__one", "__place"))
    # By the level at which a source is full: what the full ones take, and the weight of those that aren't.
    filling = in_order(held.select("__w", "__cap", "source"), [F.col("__cap") / F.col("__w"), F.col("source").asc_nulls_last()], {"__cap": "full", "__w": "used"})
    total = held.agg((F.sum("source_size") * F.lit(float(share))).alias("all"), F.sum("__w").alias("weights")).first()
    left = F.lit(total["weights"]) - F.col("used") + F.col("__w")
    level = (F.lit(total["all"]) - F.col("full") + F.col("__cap")) / left
    found = filling.where(F.col("full") + F.col("__cap") / F.col("__w") * (F.lit(total["weights"]) - F.col("used")) >= F.lit(total["all"])) if total["all"] is not None else filling
    low = found.agg(F.min_by(level, F.struct(F.col("__cap") / F.col("__w"), F.col("full")))).first()[0]
    level = F.lit(float("inf") if low is None else low)  # all are full: the shares ask for more than there may be
    return held.withColumn("target", F.least(F.col("__cap"), level * F.col("__w"))).drop("__w", "__cap")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED, preference: Column | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of every document: its words, those of its source and the source's target, how often the mix takes it, and how many words that makes.

    preference: positive, a factor of the document's inclusion odds.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    liked = F.lit(1.0) if preference is None else preference.cast("double")
    draw = uniform(seed, F.col("doc_id"), text)
    rows = docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), (draw / (1 - draw) / liked).alias("odds"))
    items = cut(rows.groupBy("doc_id", "source", "size", "odds").agg(F.count("*").alias("m")))
    sizes = items.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count("*").alias("n"))
    copies = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("long")
    facts = targets(sizes, weights, share, most).withColumn("whole", copies)
    facts = facts.withColumn("open", F.when(F.col("whole") < most, F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size"))).otherwise(0.0))
    f = F.when(F.col("open") > 0, F.col("open") / F.col("source_size"))
    facts = cut(facts.withColumns({"inclusion": F.coalesce(f / (1 - f), F.lit(1.0)), "parts": F.ceil(F.col("n") / EACH)}))
    ranked = attach(items, facts, "source").withColumn("rank", F.col("odds") / F.col("inclusion"))
    ranked = ranked.withColumn("part", F.floor(F.col("odds") / (1 + F.col("odds")) * F.col("parts")).cast("long"))

    ranges = ranked.groupBy("source", "part").agg(F.sum(F.col("size") * F.col("m")).alias("words"), F.first("open").alias("open"), F.count("*").alias("n"))
    upto = Window.partitionBy("source").orderBy("part")
    ranges = ranges.withColumns({"upto": F.sum("words").over(upto), "n": F.sum("n").over(Window.partitionBy("source"))})
    border = cut(ranges.where("open >= upto - words and open < upto").select("source", F.col("part").alias("border"), (F.col("open") - F.col("upto") + F.col("words")).alias("gap"), "n"))
    # A source of sizes 0 has no such range, and takes nothing.
    none = cut(facts.select("source", "n").join(border.select(F.col("source").alias("other")), F.col("source").eqNullSafe(F.col("other")), "left_anti"))
    border = cut(border.union(none.select("source", F.lit(-1).cast("long"), F.lit(0.0), "n")))
    placed = attach(ranked, border, "source")
    kept = ["doc_id", "source", "size", "source_size", "target", "whole", "m"]
    away = placed.where(F.col("part") != F.col("border")).select(*kept, F.when(F.col("part") < F.col("border"), F.col("m")).otherwise(0).alias("k"))
    near = _filled(placed.where(F.col("part") == F.col("border"))).select(*kept, "k")

    one = F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))).alias("i")
    out = away.union(near).select(*kept, "k", one).withColumn("copies", F.col("whole") + F.when(F.col("i") <= F.col("k"), 1).otherwise(0))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _filled(rows: DataFrame) -> DataFrame:
    """rows with k, how many of m are taken for the gap of their source, in the order of rank."""
    every = Window.partitionBy("source")
    before = every.orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("k", F.lit(0).cast("long"))
    for _ in range(PASSES):
        rows = rows.withColumn("free", F.when((F.col("size") > 0) & (F.col("size") <= F.col("gap")), F.col("m") - F.col("k")).otherwise(0))
        rows = rows.withColumn("ahead", F.coalesce(F.sum(F.col("free") * F.col("size")).over(before), F.lit(0)))
        fits = F.floor((F.col("gap") - F.col("ahead")) / F.col("size")).cast("long")
        rows = rows.withColumn("more", F.when(F.col("free") > 0, F.greatest(F.lit(0).cast("long"), F.least(F.col("free"), fits))).otherwise(0))
        rows = rows.withColumns({"k": F.col("k") + F.col("more"), "gap": F.col("gap") - F.sum(F.col("more") * F.col("size")).over(every)})
    open_ = (F.col("k") < F.col("m")) & (F.col("size") > 0)
    first = every.orderBy(F.when(open_, F.col("size")).asc_nulls_last(), "rank", "doc_id")
    nearer = open_ & (F.row_number().over(first) == 1) & (F.col("size") - F.col("gap") < F.col("gap"))
    return rows.withColumn("k", F.col("k") + F.when(nearer, 1).otherwise(0))
