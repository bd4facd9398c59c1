"""Ranking metrics, rates and tests, each one grouped aggregation.

Scores may be rounded (``places``) before they are grouped, so that the last bits of equal
entropies don't split ties; windows then run over the few distinct scores. Without places a
score may be as fine as a row, and running sums go over ranges of scores first (``running``).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import let

#: Ranges of running sums at most, within groups and over a whole table, and rows of each at least; bounds compared at a time; resampled numbers held at once.
PARTS, WIDE, EACH = 256, 4096, 1 << 16
STEP = 64
DRAWN = 1 << 22


def answered(df: DataFrame, exclude: bool = True) -> DataFrame:
    """Without NOT_ATTEMPTED; a missing grade stays."""
    return df.where(~F.col("grade").eqNullSafe("NOT_ATTEMPTED")) if exclude else df


def score_table(df: DataFrame, label: Column, score: Column, *by: str, places: int | None = None) -> DataFrame:
    """(by, score, n, p): rows and positives at each distinct score."""
    score = score if places is None else F.round(score, places)
    return df.groupBy(*by, score.alias("score")).agg(F.count("*").alias("n"), F.sum(label.cast("long")).alias("p"))


def matched(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """A join on columns that may be null; right has a row for each. Without columns right has one row."""
    if not by:
        return left.crossJoin(F.broadcast(right))
    other = right.withColumnsRenamed({c: f"__{c}" for c in by})
    return left.join(other, reduce(lambda x, y: x & y, (left[c].eqNullSafe(other[f"__{c}"]) for c in by)), how).drop(*(f"__{c}" for c in by))


def literal_rows(spark: SparkSession, rows: list, *columns: str) -> DataFrame:
    """A few rows that the driver holds, as a table of constants."""
    if not rows:
        raise ValueError("no rows")
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in columns]) for r in rows])))


def _range_of(value: Column, bounds: list) -> Column:
    """How many of the ascending bounds lie below the value: every STEP-th one is compared first, then those of one step."""
    below = lambda some: F.size(F.filter(some, lambda x: x < value))
    if len(bounds) <= STEP:
        return below(F.array(*map(F.lit, bounds))) if bounds else F.lit(0)
    whole = below(F.array(*map(F.lit, bounds[STEP - 1 :: STEP]))) * STEP
    return let(whole, lambda n: n + below(F.slice(F.array(*map(F.lit, bounds)), n + 1, F.lit(STEP))))


def parted(df: DataFrame, order: str, by: list[str], parts: int | None = None) -> DataFrame:
    """df with part: the number of its range of the order column within by: one for every EACH rows or so, with about as many rows each, so many at most.

    Without by the bounds, one number for each range, are read to the driver, and there may be more of them. Rows with an equal
    order share a range, and a null order is in the first one.
    """
    parts = parts or (PARTS if by else WIDE)
    share = F.expr(f"array({', '.join(f'{i / parts}D' for i in range(1, parts))})")  # one call, not one for each
    step = F.ceil(parts / F.least(F.lit(parts), F.ceil(F.count("*") / EACH)))
    bounds = df.groupBy(*by).agg(F.percentile_approx(order, share, F.lit(10 * parts)).alias("__all"), step.alias("__step"))
    bounds = bounds.select(*by, F.array_distinct(F.filter("__all", lambda _, i: (i + 1) % F.col("__step") == 0)).alias("__bounds"))
    if by:
        return matched(df, bounds, by).withColumn("part", F.size(F.filter("__bounds", lambda x: x < F.col(order)))).drop("__bounds")
    return df.withColumn("part", F.coalesce(_range_of(F.col(order), bounds.first()[0] or []), F.lit(0)))


def running(table: DataFrame, values: dict[str, str], by: list[str], order: str = "score", fine: bool = True, totals: dict[str, str] | None = None) -> DataFrame:
    """table with running sums within by, in the order: values maps a column to the name of its sum up to and with the row, totals to that over all rows.

    fine: the order column may have as many values as rows. Ranges are summed first, and a window holds one range.
    """
    totals = totals or {}
    if not fine:
        w, every = Window.partitionBy(*by).orderBy(order), Window.partitionBy(*by)
        return table.withColumns({name: F.sum(c).over(w) for c, name in values.items()} | {name: F.sum(c).over(every) for c, name in totals.items()})
    rows = parted(table, order, by)
    before, every = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by)  # a row for each range
    sums = rows.groupBy(*by, "part").agg(*(F.sum(c).alias(f"__{c}") for c in {**values, **totals}))
    sums = sums.select(*by, "part", *(F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)).alias(f"__{c}") for c in values), *(F.sum(f"__{c}").over(every).alias(name) for c, name in totals.items()))
    rows, inner = matched(rows, sums, [*by, "part"]), Window.partitionBy(*by, "part").orderBy(order)
    return rows.withColumns({name: F.sum(c).over(inner) + F.col(f"__{c}") for c, name in values.items()}).drop("part", *(f"__{c}" for c in values))


def _area(n: Column, p: Column, s: Column) -> Column:
    """AUROC from rows, positives and the positives' sum of ranks."""
    return F.when((p > 0) & (n > p), (s - p * (p + 1) / 2) / (p * (n - p)))


def auroc(df: DataFrame, label: Column, score: Column, *by: str, places: int | None = None) -> DataFrame:
    """M1 to M3: (by, n, n_pos, auroc): ranks averaged over ties; null if one class is missing."""
    return auroc_of(score_table(df, label, score, *by, places=places), *by, fine=places is None)


def auroc_of(table: DataFrame, *by: str, fine: bool = False) -> DataFrame:
    """auroc from (by, score, n, p), counts of rows and of positives at each score."""
    ranked = running(table, {"n": "upto"}, list(by), fine=fine)
    rank = F.col("upto") - F.col("n") + (F.col("n") + 1) / 2
    g = ranked.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("p").alias("n_pos"), F.sum(F.col("p") * rank).alias("s"))
    return g.select(*by, "n", "n_pos", _area(F.col("n"), F.col("n_pos"), F.col("s")).alias("auroc"))


def auroc_without(df: DataFrame, label: Column, score: Column, corrupt: Column, *by: str, places: int | None = None) -> DataFrame:
    """M4: (by, n, auroc, n_clean, auroc_clean, delta): of all rows and of those that aren't corrupt, from one table of scores."""
    label, clean = label.cast("long"), (~corrupt).cast("long")
    score = score if places is None else F.round(score, places)
    table = df.groupBy(*by, score.alias("score")).agg(F.count("*").alias("n"), F.sum(label).alias("p"), F.sum(clean).alias("n_clean"), F.sum(label * clean).alias("p_clean"))
    ranked = running(table, {"n": "upto", "n_clean": "upto_clean"}, list(by), fine=places is None)
    sums = []
    for end in ("", "_clean"):
        rank = F.col(f"upto{end}") - F.col(f"n{end}") + (F.col(f"n{end}") + 1) / 2
        sums += [F.sum(f"n{end}").alias(f"n{end}"), F.sum(f"p{end}").alias(f"p{end}"), F.sum(F.col(f"p{end}") * rank).alias(f"s{end}")]
    g = ranked.groupBy(*by).agg(*sums)
    both = [_area(F.col(f"n{end}"), F.col(f"p{end}"), F.col(f"s{end}")) for end in ("", "_clean")]
    return g.select(*by, "n", both[0].alias("auroc"), "n_clean", both[1].alias("auroc_clean"), (both[1] - both[0]).alias("delta"))


def sweep_report(df: DataFrame, corrupt: Column, *by: str, places: int | None = None) -> DataFrame:
    """A row for each run that has records, say tag by style: accuracy, entropies of right and wrong answers, AUROC of all and of clean records.

    df: (by, grade, semantic_entropy), the union of the runs that are there; a run without records has no row.
    """
    right, se = F.col("grade") == "CORRECT", F.col("semantic_entropy")
    rates = df.groupBy(*by).agg(
        F.avg(right.cast("double")).alias("accuracy"), F.count_if(right).alias("n_correct"), F.avg(F.when(right, se)).alias("entropy_correct"), F.avg(F.when(~right, se)).alias("entropy_wrong"), F.count_if(corrupt & ~right).alias("n_corrupt_wrong"),
    )
    return matched(rates, auroc_without(df, ~right, se, corrupt, *by, places=places), list(by))


def grade_rates(df: DataFrame, *by: str) -> DataFrame:
    """A1, A2: shares of abstentions and of correct answers, of all and of the answered."""
    n, c, a = F.count("*"), F.count_if(F.col("grade") == "CORRECT"), F.count_if(F.col("grade") == "NOT_ATTEMPTED")
    return df.groupBy(*by).agg(n.alias("n"), c.alias("n_correct"), a.alias("n_abstained")).select(
        *by, "n", "n_correct", "n_abstained", (F.col("n_abstained") / F.col("n")).alias("abstain_rate"), (F.col("n_correct") / F.col("n")).alias("accuracy_all"),
        F.when(F.col("n") > F.col("n_abstained"), F.col("n_correct") / (F.col("n") - F.col("n_abstained"))).otherwise(0.0).alias("accuracy_answered"),
    )


def entropy_summary(df: DataFrame, *by: str) -> DataFrame:
    """A3: mean, population deviation, share of zero."""
    se = F.col("semantic_entropy")
    return answered(df).groupBy(*by).agg(F.avg(se).alias("mean_se"), F.stddev_pop(se).alias("sd_se"), F.avg((F.round(se, 6) == 0).cast("double")).alias("single_cluster"), F.count("*").alias("n"))


def split_by_correct(df: DataFrame, *by: str) -> DataFrame:
    """A5: mean and median entropy of correct and other answers."""
    return df.groupBy(*by, (F.col("grade") == "CORRECT").alias("is_correct")).agg(F.avg("semantic_entropy").alias("mean_se"), F.median("semantic_entropy").alias("median_se"), F.count("*").alias("n"))


def at_quantiles(df: DataFrame, accuracy: Column, uncertainty: Column, quantiles: list[float], *by: str, places: int | None = None) -> DataFrame:
    """M5: (by, i, q, cutoff, accuracy): mean accuracy where the uncertainty is at most its quantile, linearly interpolated.

    Each distinct score says which quantiles' lower and upper places fall into it; scores within
    1e-12 of the cutoff count as equal. Equal cutoffs stay apart.
    """
    return at_quantiles_of(score_table(df, accuracy, uncertainty, *by, places=places), quantiles, *by, fine=places is None)


def at_quantiles_of(table: DataFrame, quantiles: list[float], *by: str, fine: bool = False) -> DataFrame:
    """at_quantiles from (by, score, n, p), counts of rows and of right ones at each score."""
    table = running(table, {"n": "upto", "p": "right"}, list(by), fine=fine, totals={"n": "total"})
    inside = lambda k: (k >= F.col("upto") - F.col("n")) & (k < F.col("upto"))
    place = lambda z: z["q"] * (F.col("total") - 1)
    grid = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(x)).alias("q")) for i, x in enumerate(quantiles)])
    hits = table.select(*by, "score", "upto", "right", "total", F.explode(F.filter(grid, lambda z: inside(F.floor(place(z))) | inside(F.ceil(place(z))))).alias("z"))
    ends = hits.groupBy(*by, "z").agg(*(f(F.struct("score", "upto", "right")).alias(n) for n, f in (("low", F.min), ("high", F.max))), F.first("total").alias("total"))
    at = place(F.col("z"))
    cutoff = F.col("low.score") + (F.col("high.score") - F.col("low.score")) * (at - F.floor(at))
    last = F.when(F.col("high.score") <= F.col("cutoff") + 1e-12, F.col("high")).otherwise(F.col("low"))
    return ends.withColumn("cutoff", cutoff).select(*by, F.col("z.i").alias("i"), F.col("z.q").alias("q"), "cutoff", (last["right"] / last["upto"]).alias("accuracy"))


def aurac(df: DataFrame, accuracy: Column, uncertainty: Column, *by: str, places: int | None = None) -> DataFrame:
    """M6: the sum of M5 over 20 quantiles from 0.1 to 1, times their distance."""
    return aurac_of(score_table(df, accuracy, uncertainty, *by, places=places), *by, fine=places is None)


def aurac_of(table: DataFrame, *by: str, fine: bool = False) -> DataFrame:
    """aurac from (by, score, n, p)."""
    grid = [0.1 + 0.9 / 19 * i for i in range(19)] + [1.0]
    return at_quantiles_of(table, grid, *by, fine=fine).groupBy(*by).agg((F.sum("accuracy") * F.lit(0.9 / 19)).alias("aurac"))


def rejection_curve(df: DataFrame, label: Column, score: Column, key: str, points: int = 50, places: int | None = None) -> DataFrame:
    """M8: (fraction, kept, accuracy): mean accuracy of the surest max(1, int(f n)) rows; ties by key.

    Whole scores below a point come from the table of distinct scores. Within the score that a
    point cuts, ranges of keys are counted first and only the range that holds the point is
    numbered, so no task sorts all rows of a score, however common.
    """
    rows = df.select((score if places is None else F.round(score, places)).alias("score"), F.col(key).alias("key"), label.cast("long").alias("y"))
    table = rows.groupBy("score").agg(F.count("*").alias("n"), F.sum("y").alias("p"))
    table = running(table, {"n": "upto", "p": "right"}, [], fine=places is None, totals={"n": "total"})
    fractions = F.array(*[F.lit(0.02 + i * 0.98 / (points - 1)) for i in range(points)])
    kept = lambda f: F.greatest(F.lit(1), F.floor(f * F.col("total") + 1e-9))
    inside = F.filter(fractions, lambda f: (kept(f) > F.col("upto") - F.col("n")) & (kept(f) <= F.col("upto")))
    cuts = table.select("score", (F.col("upto") - F.col("n")).alias("below"), (F.col("right") - F.col("p")).alias("right"), "total", F.explode(inside).alias("fraction"))
    cuts = cuts.select("score", "right", "fraction", kept(F.col("fraction")).alias("kept"), (kept(F.col("fraction")) - F.col("below")).alias("rn"))
    spark, names = df.sparkSession, ["score", "right", "fraction", "kept", "rn"]
    if not (found := cuts.collect()):  # a row for each point
        return cuts.select("fraction", "kept", F.lit(None).cast("double").alias("accuracy"))
    cuts = literal_rows(spark, found, *names)
    ranged = parted(rows.join(F.broadcast(cuts.select("score").distinct()), "score", "left_semi"), "key", ["score"])
    upto = Window.partitionBy("score").orderBy("part")
    counts = ranged.groupBy("score", "part").agg(F.count("*").alias("m"), F.sum("y").alias("t"))
    counts = counts.select("score", "part", "m", F.sum("m").over(upto).alias("m_upto"), (F.sum("t").over(upto) - F.col("t")).alias("t_before"))
    held = counts.join(F.broadcast(cuts), "score").where("rn > m_upto - m and rn <= m_upto").withColumn("rn", F.col("rn") - F.col("m_upto") + F.col("m"))
    held = F.broadcast(literal_rows(spark, held.collect(), *names, "part", "t_before"))  # a row for each point
    inner = Window.partitionBy("score", "part").orderBy("key")
    numbered = ranged.join(F.broadcast(held.select("score", "part").distinct()), ["score", "part"], "left_semi").select("score", "part", F.row_number().over(inner).alias("rn"), F.sum("y").over(inner.rowsBetween(Window.unboundedPreceding, 0)).alias("run"))
    return numbered.join(held, ["score", "part", "rn"]).select("fraction", F.col("kept").cast("long").alias("kept"), ((F.col("right") + F.col("t_before") + F.col("run")) / F.col("kept")).alias("accuracy"))


def cut_table(df: DataFrame) -> DataFrame:
    """For each distinct entropy (4 places): what a cut there keeps, of all and of the correct."""
    g = df.groupBy(F.round("semantic_entropy", 4).alias("se")).agg(F.count("*").alias("n"), F.count_if(F.col("grade") == "CORRECT").alias("c"))
    run, all_rows = Window.orderBy("se"), Window.partitionBy()
    kept, right = F.sum("n").over(run), F.sum("c").over(run)
    return g.select(
        "se", kept.alias("kept"), (kept / F.sum("n").over(all_rows)).alias("kept_frac"), right.alias("correct_kept"),
        F.when(F.sum("c").over(all_rows) > 0, right / F.sum("c").over(all_rows)).otherwise(0.0).alias("recall"), (right / kept).alias("acc_kept"),
    )


def histogram(df: DataFrame, value: Column, top: float, bins: int, *by: str) -> DataFrame:
    """Counts in equal bins from 0 to top, the right edge in the last."""
    b = F.least(F.floor(value / F.lit(top) * bins + F.lit(1e-9)), F.lit(bins - 1)).cast("long")
    return df.groupBy(*by, b.alias("bin")).agg(F.count("*").alias("n"))


def mcnemar(df: DataFrame, x: Column, y: Column, *by: str) -> DataFrame:
    """M9: discordant counts of paired booleans and the exact two-sided p, 1 if there are none.

    The binomial tail is summed from its largest term downwards in logarithms, over k + 1 terms.
    """
    g = df.groupBy(*by).agg(F.count_if(x & ~y).alias("x_win"), F.count_if(y & ~x).alias("y_win"))
    n, k = F.col("x_win") + F.col("y_win"), F.least("x_win", "y_win")
    # ln C(n, k) by sums of logarithms, then terms by their ratio from i = k down to 0.
    top = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1))), F.lit(0.0), lambda a, i: a + F.when(k > 0, F.ln(n - k + i) - F.ln(i)).otherwise(0.0))
    tail = F.aggregate(
        F.sequence(F.lit(0).cast("long"), k),
        F.struct(F.lit(0.0).alias("s"), F.lit(1.0).alias("t")),
        lambda a, i: F.struct((a["s"] + a["t"]).alias("s"), (a["t"] * (k - i) / (n - k + i + 1)).alias("t")),
        lambda a: a["s"],
    )
    p = F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), F.exp(top - n * F.ln(F.lit(2.0))) * tail * 2))
    return g.select(*by, "x_win", "y_win", n.alias("n_discordant"), p.alias("p_value"))


def seed_summary(df: DataFrame, *by: str) -> DataFrame:
    """A10: accuracies of seeds: mean, sample deviation, least and greatest. df: (by, seed, grade)."""
    per = df.groupBy(*by, "seed").agg(F.avg((F.col("grade") == "CORRECT").cast("double")).alias("acc"))
    return per.groupBy(*by).agg(F.avg("acc").alias("mean_acc"), F.stddev_samp("acc").alias("sd_acc"), F.min("acc").alias("min_acc"), F.max("acc").alias("max_acc"), F.count("*").alias("n_seeds"))


def _areas(n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """AUROC of rows of counts at ascending scores."""
    q = n - p
    below = np.cumsum(q, -1) - q
    with np.errstate(invalid="ignore", divide="ignore"):
        return (p * (below + q / 2)).sum(-1) / (p.sum(-1) * q.sum(-1))


def _jackknife(n: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(AUROC without one row, how many rows give it), for each score and class, from running sums."""
    q = n - p
    below, above = np.cumsum(q) - q + q / 2, p.sum() - np.cumsum(p) + p / 2
    whole, pos, neg = (p * below).sum(), p.sum(), q.sum()
    with np.errstate(invalid="ignore", divide="ignore"):
        value = np.r_[(whole - below) / ((pos - 1) * neg), (whole - above) / (pos * (neg - 1))]
    weight = np.r_[p, q]
    return value[weight > 0], weight[weight > 0]


def bootstrap_auroc(df: DataFrame, label: Column, score: Column, *by: str, resamples: int = 1000, level: float = 0.9, seed: int = 42, places: int | None = None) -> DataFrame:
    """M7: (by, auroc, std_err, low, high) from resamples with replacement.

    Only counts at distinct scores reach a task: resampling n rows with replacement is one
    multinomial draw over the cells (score, class), so a group's size doesn't matter; draws are
    made ``DRAWN`` numbers at a time. The interval is bias-corrected and accelerated; the
    acceleration is from the jackknife, in one pass over the cells. A group's distinct scores
    must fit a task: round them by places where they are as many as the rows.
    """
    table = score_table(df, label, score, *by, places=places)
    table = table if by else table.withColumn("all", F.lit(0))
    keys = list(by) or ["all"]
    schema = ", ".join(f"{k} {t}" for k, t in table.dtypes if k in keys) + ", auroc double, std_err double, low double, high double"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        from statistics import NormalDist

        pdf = pdf.sort_values("score")
        n, p = pdf["n"].to_numpy(float), pdf["p"].to_numpy(float)
        cells = np.r_[p, n - p].astype(np.int64)
        full, rng, at, got = _areas(n, p), np.random.default_rng(seed), len(n), []
        for i in range(0, resamples, step := max(1, DRAWN // len(cells))):
            draws = rng.multinomial(cells.sum(), cells / cells.sum(), min(step, resamples - i)).astype(float)
            got.append(_areas(draws[:, :at] + draws[:, at:], draws[:, :at]))
        got = np.concatenate(got)
        got = np.sort(got[np.isfinite(got)])
        row = {k: [pdf[k].iloc[0]] for k in keys}
        if not np.isfinite(full) or len(got) < 2:
            return pd.DataFrame(row | {"auroc": [None], "std_err": [None], "low": [None], "high": [None]})
        z = NormalDist()
        less = np.clip(((got < full).sum() + (got == full).sum() / 2) / len(got), 1e-6, 1 - 1e-6)
        bias = z.inv_cdf(float(less))
        value, weight = _jackknife(n, p)
        ok = np.isfinite(value)
        d = np.average(value[ok], weights=weight[ok]) - value[ok]
        down = (weight[ok] * d**2).sum() ** 1.5
        speed = (weight[ok] * d**3).sum() / (6 * down) if down > 0 else 0.0
        ends = []
        for a in ((1 - level) / 2, (1 + level) / 2):
            t = bias + z.inv_cdf(a)
            ends.append(float(np.quantile(got, z.cdf(bias + t / (1 - speed * t)))))
        return pd.DataFrame(row | {"auroc": [full], "std_err": [got.std(ddof=1)], "low": [ends[0]], "high": [ends[1]]})

    out = table.groupBy(*keys).applyInPandas(one, schema)
    return out if by else out.drop("all")
