"""Names of models, files and experiments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Heads, marks and doubled segments of file names, and families with sampling parameters.
MARK = "seed44_"
HEAD = "^(gen|judged)_simpleqa_(simpleqa_)?"
DOUBLED = r"^(judged_)([a-z0-9]+)_\2_"
ROLE = "_student_(strict|fewshot)_"
FAMILIES = {"qwen": (0.8, 20), "llama": (0.9, None)}


def short_model_name(c: Column) -> Column:
    """org/name gives name; of a path the last part."""
    one = (F.regexp_count(c, F.lit("/")) == 1) & ~F.startswith(c, F.lit("/"))
    return F.when(~F.contains(c, F.lit("/")), c).when(one, F.substring_index(c, "/", -1)).otherwise(F.regexp_extract(c, "([^/]*)/*$", 1))


def pair_name(teacher: Column, student: Column) -> Column:
    """32Bto4B where both share all up to the size, else both short names."""
    t, s = short_model_name(teacher), short_model_name(student)
    size = r"^(.*?-)([\w.]+)$"
    same = t.rlike(size) & s.rlike(size) & (F.regexp_extract(t, size, 1) == F.regexp_extract(s, size, 1))
    return F.when(same, F.concat(F.regexp_extract(t, size, 2), F.lit("to"), F.regexp_extract(s, size, 2))).otherwise(F.concat(t, F.lit("to"), s))


def judged_name(path: Column) -> Column:
    """F16: gen_x becomes judged_x; doubled segments go."""
    base = F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), "^gen_", "")
    base = F.regexp_replace(F.concat(F.lit("judged_"), base), DOUBLED, "$1$2_")
    return F.regexp_replace(base, ROLE, "_")


def tag_of(path: Column) -> Column:
    """what follows the mark, else the name without its usual head."""
    base = F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), r"\.jsonl$", "")
    return F.when(F.contains(base, F.lit(MARK)), F.regexp_extract(base, f"{MARK}(.*)$", 1)).otherwise(F.regexp_replace(base, HEAD, ""))


def sampling_parameters(name: Column) -> Column:
    """(top_p, top_k) by the model's family."""
    low = F.lower(name)
    p = k = F.lit(None)
    for family, (top_p, top_k) in reversed(FAMILIES.items()):
        p = F.when(F.contains(low, F.lit(family)), top_p).otherwise(p)
        k = F.when(F.contains(low, F.lit(family)), top_k).otherwise(k)
    return F.struct(p.cast("double").alias("top_p"), k.cast("int").alias("top_k"))
