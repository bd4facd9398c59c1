"""Claims of long answers: flattening, running context, entropies."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import refusal_vote


def flatten_claims(df: DataFrame) -> DataFrame:
    """One row for each claim with its number; answers without claims give none."""
    return df.select("question_idx", "entity", F.posexplode("claims").alias("claim_idx", "c")).select("question_idx", "entity", F.col("claim_idx").cast("long").alias("claim_idx"), F.col("c.atom").alias("claim"), F.col("c.is_supported").alias("is_true"))


def entity_names(ids: DataFrame, records: DataFrame, line: str = "line") -> DataFrame:
    """(question_idx, entity) of every id; the last record of an id names it, null where there is none."""
    names = records.groupBy("question_idx").agg(F.max_by("entity", line).alias("entity"))
    return ids.select("question_idx").join(names, "question_idx", "left")


def running_context(claims: DataFrame, key: str = "question_idx", order: str = "claim_idx", text: str = "claim") -> DataFrame:
    """The claims before each one, joined by blanks; null for the first and where that is empty; a null claim adds nothing.

    An answer's text is joined once, and a context is cut from it as its row is given out: memory holds one
    answer (of 2 GB at most), not the sum of its contexts. What keeps or shuffles the contexts pays for all of
    them; context_ends and context_digests don't.
    """
    ends = context_ends(claims, key, order, text)
    rows = ends.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order, text)))
    whole = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*rows.columns)), lambda a, b: a["__n"] - b["__n"]).alias("__rows"))
    whole = whole.select(F.array_join(F.transform("__rows", lambda r: r[text]), " ").alias("__text"), F.explode("__rows").alias("__row"))
    cut = F.nullif(F.substring("__text", F.lit(1), F.col("__row.context_end")), F.lit(""))
    return whole.select(*(F.col("__row")[c].alias(c) for c in claims.columns), cut.alias("context"))


def context_ends(claims: DataFrame, key: str = "question_idx", order: str = "claim_idx", text: str = "claim") -> DataFrame:
    """Claims with context_end: how many characters of the answer (its claims by order, joined by blanks) are the context of each one.

    Rows grow with the claims alone. Claims of equal order go by their text.
    """
    w = Window.partitionBy(key).orderBy(order, text).rowsBetween(Window.unboundedPreceding, -1)
    size = F.when(F.col(text).isNotNull(), F.length(text) + 1).otherwise(0)
    return claims.withColumn("context_end", F.greatest(F.coalesce(F.sum(size).over(w), F.lit(0)) - 1, F.lit(0)).cast("int"))


def context_digests(claims: DataFrame, key: str = "question_idx", order: str = "claim_idx", text: str = "claim") -> DataFrame:
    """(key, order, context_md5): the MD5 of each claim's running context, null where there is none.

    One pass over the sorted claims, with the state of one digest: an answer may be of any length. MD5 goes
    from left to right, so one answer is one task's; its claims pass through it in batches.
    """
    rows = claims.select(key, order, text).repartition(F.col(key)).sortWithinPartitions(key, order, text)
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(_fold, f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, context_md5 string")


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of what stands before each row of its key; rows come sorted by key and order."""
    current, state, length, begun = (), md5(), 0, False
    for batch in batches:
        out = []
        for key, claim in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if (key,) != current:
                current, state, length, begun = (key,), md5(), 0, False
            out.append(state.hexdigest() if length else None)
            if claim is not None:
                add = (" " if begun else "") + claim
                state.update(add.encode())
                length, begun = length + len(add), True
        digests = pa.array(out, pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), digests], names=[*batch.schema.names[:2], "context_md5"])


def vote_entropy(answers: Column, entropy: Column) -> Column:
    """ln(n) if half of the n answers refuse, else the entropy."""
    return F.when(refusal_vote(answers), F.ln(F.size(answers).cast("double"))).otherwise(entropy)


def claim_entropy(questions: DataFrame) -> DataFrame:
    """The mean over a claim's questions; null if there are none. questions: (question_idx, claim_idx, answers, semantic_entropy)."""
    return questions.groupBy("question_idx", "claim_idx").agg(F.avg(vote_entropy(F.col("answers"), F.col("semantic_entropy"))).alias("semantic_entropy"))


def claim_counts(claims: DataFrame) -> DataFrame:
    """True and false claims of each answer."""
    return claims.groupBy("question_idx").agg(F.count_if("is_true").alias("n_true"), F.count_if(~F.col("is_true")).alias("n_false"))


def scored_totals(df: DataFrame) -> DataFrame:
    """Entities with claims, and all claims."""
    return df.agg(F.count_if(F.size("claims") > 0).alias("n_scored"), F.coalesce(F.sum(F.greatest(F.size("claims"), F.lit(0))), F.lit(0)).alias("n_claims"))


def remove_first(answers: Column, value: Column) -> Column:
    """The array without the first occurrence of a value."""
    at = F.array_position(answers, value).cast("int")
    return F.when(at > 0, F.concat(F.slice(answers, F.lit(1), at - 1), F.slice(answers, at + 1, F.size(answers)))).otherwise(answers)


def zip_positions(*relations: DataFrame) -> DataFrame:
    """Relations aligned by a column pos, joined on it."""
    out = relations[0]
    for r in relations[1:]:
        out = out.join(r, "pos")
    return out


def entropy_gap(a: DataFrame, b: DataFrame, key: str = "question_idx") -> DataFrame:
    """Entropies of two models side by side, their difference and which is higher."""
    j = a.select(key, F.col("semantic_entropy").alias("a")).join(b.select(key, F.col("semantic_entropy").alias("b")), key)
    gap = F.round(F.col("b") - F.col("a"), 6)
    return j.select(key, "a", "b", gap.alias("gap"), F.when(gap > 0, "higher").when(gap < 0, "lower").otherwise("same").alias("label"))
