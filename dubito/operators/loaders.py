"""Question sets: options, prompts, few-shot prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import phrases as P
from ..functions.text import choice_prompt, fill, option_labels, strict_prompt


def first_items(df: DataFrame, n: int, key: str = "question_idx") -> DataFrame:
    """S11, O3."""
    return df.orderBy(key).limit(n)


def with_options(df: DataFrame, question: str, options: str) -> DataFrame:
    """Prompt and labels of options in their order; the first one is right."""
    return df.withColumns({"prompt": choice_prompt(F.col(question), F.col(options)), "choices": option_labels(F.col(options)), "answer": F.lit("A")})


def shuffled_options(correct: Column, wrong: Column, key: Column, seed: int = 42) -> Column:
    """All options in an order by hash."""
    return F.transform(F.array_sort(F.transform(F.concat(F.array(correct), wrong), lambda o: F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), o).cast("binary")).alias("h"), o.alias("o")))), lambda s: s["o"])


def answer_label(options: Column, correct: Column) -> Column:
    """The letter that the right option has."""
    return F.char(F.lit(64) + F.array_position(options, correct).cast("int"))


def of_category(df: DataFrame, category: str | None, options: str = "options") -> DataFrame:
    """Rows of a category (any case), options without N/A."""
    if category is not None:
        df = df.where(F.lower("category") == category.lower())
    return df.withColumn(options, F.filter(options, lambda o: F.trim(o) != "N/A"))


def top_categories(df: DataFrame, k: int = 5) -> DataFrame:
    """S14, O4."""
    return df.groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(k)


def fewshot_examples(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The last n rows."""
    return df.orderBy(F.desc(key)).limit(n)


def fewshot_prefix(df: DataFrame, key: str, question: str, answer: str, n: int = 5) -> DataFrame:
    """One row with the prefix of the last n rows, in their order."""
    rows = fewshot_examples(df, key, n).select(key, fill(P.FEWSHOT_PAIR, question=F.col(question), answer=F.col(answer)).alias("pair"))
    pairs = F.transform(F.array_sort(F.collect_list(F.struct(key, "pair"))), lambda s: s["pair"])
    return rows.agg(F.concat(F.lit(P.FEWSHOT_HEAD), F.array_join(pairs, "")).alias("prefix"))


def usable(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The rows that aren't few-shot examples."""
    return df.join(F.broadcast(fewshot_examples(df, key, n).select(key)), key, "left_anti")  # n rows


def prompts(df: DataFrame, style: str, key: str = "question_idx", question: str = "question", answer: str = "answer") -> DataFrame:
    """Prompts in the strict or the fewshot style."""
    if style == "strict":
        return df.withColumn("prompt", strict_prompt(F.col(question)))
    if style != "fewshot":
        raise ValueError(f"unknown style {style!r}: strict or fewshot")
    prefix = F.broadcast(fewshot_prefix(df, key, question, answer))  # one row
    return usable(df, key).join(prefix).withColumn("prompt", F.concat("prefix", fill(P.FEWSHOT_TAIL, question=F.col(question)))).drop("prefix")
