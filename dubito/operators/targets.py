"""Training pairs from judged records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.phrases import CANONICAL, LEVELS
from .metrics import parted
from .select import require_members


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with one key the last by order. A grouped maximum: a hot key is pre-aggregated."""
    rest = [c for c in df.columns if c not in (key, order)]
    g = df.groupBy(key).agg(F.max_by(F.struct(*rest, order), order).alias("r"))
    return g.select(key, "r.*")


def first_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with one key the first by order."""
    rest = [c for c in df.columns if c not in (key, order)]
    g = df.groupBy(key).agg(F.min_by(F.struct(*rest, order), order).alias("r"))
    return g.select(key, "r.*")


def check_modes(se_threshold: float | None, se_mode: str, raw_samples: int) -> None:
    """The entropy intervention and several samples exclude each other."""
    if se_mode not in ("filter", "replace"):
        raise ValueError(f"unknown mode {se_mode!r}: filter or replace")
    if se_threshold is not None and raw_samples > 0:
        raise ValueError("an entropy threshold and raw samples exclude each other")


def build_pairs(judged: DataFrame, ids: DataFrame | None = None, skip_not_attempted: bool = True, se_threshold: float | str | None = None, se_mode: str = "filter", abstain: str = CANONICAL, raw_samples: int = 0, line: str | None = None, early: bool = True) -> DataFrame:
    """(question_idx, sample, prompt, response).

    Where a resumed file holds a key more than once, its last record by the column line counts.
    A threshold may be a level's name. Above it, filter drops the record and replace gives it
    the abstaining answer. With raw_samples = k each record gives its first k samples, and one
    with fewer is an error. early: when listed ids are checked, as in require_members.
    """
    if isinstance(se_threshold, str):
        se_threshold = LEVELS[se_threshold]
    check_modes(se_threshold, se_mode, raw_samples)
    df = judged if line is None else last_wins(judged, "question_idx", line)
    df = df if ids is None else require_members(df, ids, early=early)
    if skip_not_attempted:
        df = df.where(~F.col("grade").eqNullSafe("NOT_ATTEMPTED"))
    if raw_samples:
        enough = F.when(F.size("raw_responses") >= raw_samples, F.slice("raw_responses", 1, raw_samples)).otherwise(F.raise_error(F.concat(F.lit("too few samples: "), F.col("question_idx").cast("string"))))
        return df.select("question_idx", "prompt", F.posexplode(enough).alias("sample", "response")).select("question_idx", "sample", "prompt", "response")
    response = F.col("low_temp_response")
    if se_threshold is not None:
        above = F.coalesce(F.col("semantic_entropy") > se_threshold, F.lit(False))
        if se_mode == "filter":
            df = df.where(~above)
        else:
            response = F.when(above, F.lit(abstain)).otherwise(response)
    return df.select("question_idx", F.lit(0).alias("sample"), "prompt", response.alias("response"))


def repeat_pairs(pairs: DataFrame, n: int) -> DataFrame:
    """Each pair n times."""
    return pairs.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def longform_pairs(targets: DataFrame, prompts: DataFrame, early: bool = True) -> DataFrame:
    """Answers with their prompts; an answer without a prompt is an error, before or while the plan runs as in require_members."""
    ids = targets.select("question_idx")
    return targets.join(require_members(prompts, ids, early=early).select("question_idx", "prompt"), "question_idx").select("question_idx", "prompt", F.col("teacher_response").alias("response"))


def mask_labels(input_ids: Column, prompt_length: Column) -> Column:
    """-100 on the prompt, the ids themselves behind it."""
    return F.transform(input_ids, lambda x, i: F.when(i < prompt_length, F.lit(-100)).otherwise(x))


def training_rows(df: DataFrame, max_length: int) -> DataFrame:
    """Df (.., full_ids, prompt_ids) with input_ids, cut to max_length, and labels; rows whose prompt leaves no room for an answer go."""
    out = df.withColumn("input_ids", F.slice("full_ids", 1, max_length)).where(F.size("prompt_ids") < F.size("input_ids"))
    return out.withColumn("labels", mask_labels(F.col("input_ids"), F.size("prompt_ids")))


def masks_agree(input_ids: Column, labels: Column, prompt_length: Column) -> Column:
    """Labels are -100 on the prompt and the ids behind it."""
    return mask_labels(input_ids, prompt_length) == labels


def training_steps(n_pairs: Column, epochs: int, batch: int, accumulation: int) -> Column:
    """Optimizer steps: epochs times the pairs over the effective batch, rounded up."""
    return F.lit(epochs) * F.ceil(n_pairs / F.lit(batch * accumulation))


def last_settings(log: DataFrame, tag: str) -> DataFrame:
    """The settings logged last for a tag. log: (line, run_tag, hyperparameters)."""
    return log.where(F.col("run_tag") == tag).agg(F.max_by("hyperparameters", "line").alias("hyperparameters"))


def reuse_guard(last: Column, current: Column) -> Column:
    """Absent, match or mismatch."""
    return F.when(last.isNull(), "absent").when(last == current, "match").otherwise("mismatch")


def reproduction(generated: DataFrame, targets: DataFrame) -> DataFrame:
    """How many answers repeat their target, exactly or but for case and a final stop.

    Answers without a target count in n alone. generated: (question_idx, response), targets: (question_idx, target).
    """
    norm = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"\.+$", "")
    exact = F.coalesce(F.trim("response") == F.trim("target"), F.lit(False))
    near = F.coalesce(norm(F.col("response")) == norm(F.col("target")), F.lit(False)) & ~exact
    g = generated.join(targets, "question_idx", "left").agg(F.count("*").alias("n"), F.count_if(exact).alias("exact"), F.count_if(near).alias("near"))
    return g.select("n", "exact", "near", (F.col("exact") / F.col("n")).alias("exact_rate"), (F.col("near") / F.col("n")).alias("near_rate"))


def positional_split(df: DataFrame, order: str, share: float = 0.9) -> DataFrame:
    """The first share of the rows by an integer key is the training part.

    The last key of that part is found from counts in ranges that hold about as many rows each, whatever
    the keys, and by rank within one range, so no task sorts all rows.
    """
    rows = parted(df.select(F.col(order).cast("long").alias("v")), "v", [])
    counts = rows.groupBy("part").agg(F.count("*").alias("n"))
    upto, total = F.sum("n").over(Window.orderBy("part")), F.sum("n").over(Window.partitionBy())  # a row for each range
    counts = counts.select("part", "n", upto.alias("upto"), F.floor(F.lit(share) * total + 1e-9).alias("first"))
    inside = counts.where("upto >= first and upto - n < first").select("part", (F.col("first") - F.col("upto") + F.col("n")).alias("k"))
    ranked = rows.join(F.broadcast(inside), "part").withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy("v")))  # one row
    edge = ranked.where("r = k").select(F.col("v").alias("__edge"))
    out = df.join(F.broadcast(edge), F.lit(True), "left")  # one row, or none for an empty part
    return out.withColumn("part", F.when(F.col(order) <= F.col("__edge"), "train").otherwise("test")).drop("__edge")
