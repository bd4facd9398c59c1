"""Judges and prompt variants compared. Verdicts are wide (one boolean column a judge)."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import mcnemar


def long_verdicts(wide: DataFrame, judges: list[str], key: str) -> DataFrame:
    """(key, judge, verdict)."""
    return wide.select(key, F.explode(F.array(*[F.struct(F.lit(j).alias("judge"), F.col(j).alias("verdict")) for j in judges])).alias("v")).select(key, "v.judge", "v.verdict")


def judge_accuracy(wide: DataFrame, judges: list[str], key: str) -> DataFrame:
    """A12."""
    return long_verdicts(wide, judges, key).groupBy("judge").agg(F.avg(F.col("verdict").cast("double")).alias("accuracy"), F.count("*").alias("n"))


def agreement(wide: DataFrame, judges: list[str]) -> DataFrame:
    """Share of equal verdicts of each pair; one pass over the rows."""
    pairs = list(combinations(judges, 2))
    one = wide.agg(*[F.avg((F.col(a) == F.col(b)).cast("double")).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("judge_a"), F.lit(b).alias("judge_b"), F.col(f"p{i}").alias("agreement")) for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def disagreements(wide: DataFrame, judges: list[str]) -> DataFrame:
    """Rows on which the judges don't all agree."""
    return wide.where(F.size(F.array_distinct(F.array(*judges))) > 1)


def pairwise_mcnemar(wide: DataFrame, judges: list[str]) -> DataFrame:
    """M9 for each pair, with a label at 0.05."""
    pairs = F.array(*[F.struct(F.lit(a).alias("judge_a"), F.lit(b).alias("judge_b"), F.col(a).alias("x"), F.col(b).alias("y")) for a, b in combinations(judges, 2)])
    rows = wide.select(F.explode(pairs).alias("r")).select("r.*")
    out = mcnemar(rows, F.col("x"), F.col("y"), "judge_a", "judge_b")
    return out.withColumn("label", F.when(F.col("p_value") < 0.05, "significant").otherwise("not significant"))


def rule_comparison(df: DataFrame, a: str, b: str) -> DataFrame:
    """How often two rules fire, together and alone."""
    x, y = F.col(a), F.col(b)
    return df.agg(F.count_if(x).alias("n_a"), F.count_if(y).alias("n_b"), F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("only_a"), F.count_if(y & ~x).alias("only_b"), F.count_if(x != y).alias("differ"))


def compliance_summary(df: DataFrame, flags: str = "f") -> DataFrame:
    """Rates of the format flags and the mean number of words; 0 for no rows."""
    names = ["too_long", "has_hedge", "has_explanation", "has_bad_starter", "has_refusal", "looks_like_sentence", "compliant"]
    return df.agg(F.count("*").alias("n"), *[F.coalesce(F.avg(F.col(f"{flags}.{n}").cast("double")), F.lit(0.0)).alias(n) for n in names], F.coalesce(F.avg(f"{flags}.word_count"), F.lit(0.0)).alias("avg_words"))
