"""Entropies and choice distributions as column expressions over arrays. Natural logarithms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def total(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda a, x: a + x)


def shannon(p: Column) -> Column:
    """Of the probabilities above zero; never minus zero."""
    return F.abs(F.aggregate(F.filter(p, lambda x: x > 0), F.lit(0.0), lambda a, x: a - x * F.ln(x)))


def normalise(p: Column) -> Column:
    """Shares of the sum; equal shares where it is zero."""
    return let(total(p), lambda s: F.when(s > 0, F.transform(p, lambda x: x / s)).otherwise(F.transform(p, lambda _: F.lit(1.0) / F.size(p))))


def choice_distribution(raw: Column, labels: Column) -> Column:
    """(probs, argmax, entropy): the argmax is of the raw values, the first of equals."""
    argmax = F.element_at(labels, F.array_position(raw, F.array_max(raw)).cast("int"))
    return let(normalise(raw), lambda p: F.struct(p.alias("probs"), argmax.alias("argmax"), shannon(p).alias("entropy")))


def temperature(raw: Column, t: float) -> Column:
    """P to the power 1/t, normalised."""
    return normalise(F.transform(raw, lambda x: F.pow(x, F.lit(1.0 / t))))


def draw(probs: Column, labels: Column, uniform: Column) -> Column:
    """The label whose cumulative share first exceeds a uniform number; the last if rounding leaves none. One pass over the shares."""

    def step(a: Column, x: Column) -> Column:
        s, n = a["s"] + x, a["n"] + 1
        return F.struct(s.alias("s"), n.alias("n"), F.when((a["at"] == 0) & (s > uniform), n).otherwise(a["at"]).alias("at"))

    start = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n"), F.lit(0).alias("at"))
    at = F.aggregate(probs, start, step, lambda a: F.when(a["at"] > 0, a["at"]).otherwise(F.size(labels)))
    return F.element_at(labels, at)


def forced(probs: Column, labels: Column, answer: Column) -> Column:
    """E12 with a forced answer: (label, prob); an answer that isn't a label is an error."""
    at = F.array_position(labels, answer).cast("int")
    return F.struct(F.when(at > 0, answer).otherwise(F.raise_error(F.concat(F.lit("not a choice: "), answer))).alias("label"), F.when(at > 0, F.element_at(probs, at)).alias("prob"))


def uniform(seed: int, *key: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5: the same in every run, on every cluster and in every engine."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in key)).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def top_k(probs: Column, k: int) -> Column:
    """(index, prob) of the k largest, the lower index first among equals."""
    pairs = F.transform(probs, lambda p, i: F.struct((-p).alias("minus"), i.alias("index")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda s: F.struct(s["index"].alias("index"), (-s["minus"]).alias("prob")))


def shown_token(c: Column) -> Column:
    """Blanks made visible."""
    return F.replace(F.replace(F.replace(c, F.lit(" "), F.lit("·")), F.lit("\n"), F.lit("↵")), F.lit("\t"), F.lit("→"))
