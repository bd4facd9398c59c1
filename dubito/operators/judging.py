"""Judges, graders and other models as user code over Arrow columns, each question asked once.

A judge takes two columns of texts and returns their labels; it sees batches, on the executors, and
may load what it needs once a worker. Before it, the pairs of all records are brought down to the
distinct ones of the whole table, so that a pair which many records share is judged once; its
labels then go back to the records by a join and are gathered as a map, as many as a record's own pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from .cluster import leaders_by_verdicts

#: Labels (0 contradiction, 1 neutral, 2 entailment) of premises against hypotheses.
Judge = Callable[[pa.Array, pa.Array], pa.Array]


def _places(answers: Column) -> Column:
    """(i, j, a, b), i < j, of a record's answers that differ, stripped."""
    at = F.transform(answers, lambda x, i: F.struct(i.alias("i"), strip(x).alias("x")))
    pairs = F.transform(at, lambda u: F.transform(F.filter(at, lambda v: (v["i"] > u["i"]) & (v["x"] != u["x"])), lambda v: F.struct(u["i"].alias("i"), v["i"].alias("j"), u["x"].alias("a"), v["x"].alias("b"))))
    return F.flatten(pairs)


def answer_pairs(records: DataFrame, key: str, answers: str) -> DataFrame:
    """(key, i, j, a, b): J13: pairs of each record's answers; those that are identical (E1) or null need no judge and have none."""
    return records.select(key, F.inline(_places(F.col(answers))))


def distinct_pairs(pairs: DataFrame) -> DataFrame:
    """(low, high): the unordered pairs of texts, each once, whatever the number of records that hold it."""
    return pairs.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).distinct()


def judged(pairs: DataFrame, judge: Judge, symmetric: bool = False) -> DataFrame:
    """(low, high, there, back): the labels of low against high, and of high against low.

    symmetric: the judge is asked once for both. A null label is no verdict.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            low, high = b.column("low"), b.column("high")
            there = judge(low, high).cast(pa.int32())
            back = there if symmetric else judge(high, low).cast(pa.int32())
            if len(there) != len(low) or len(back) != len(low):
                raise ValueError("a judge returns a label for each pair")
            yield pa.RecordBatch.from_arrays([low, high, there, back], ["low", "high", "there", "back"])

    # A shuffle has dealt the pairs already: as many tasks judge as there are partitions.
    return pairs.mapInArrow(task, "low string, high string, there int, back int")


def verdicts(pairs: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """(key, verdicts): a map from "i,j" to the label of answer i against answer j, both ways, for each record with a pair."""
    asked = pairs.select(key, "i", "j", F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"), (F.col("a") < F.col("b")).alias("up"))
    met = asked.join(labels, ["low", "high"])
    entry = lambda i, j, label: F.struct(F.concat_ws(",", i, j).alias("key"), label.alias("value"))
    both = F.array(entry("i", "j", F.when(F.col("up"), F.col("there")).otherwise(F.col("back"))), entry("j", "i", F.when(F.col("up"), F.col("back")).otherwise(F.col("there"))))
    return met.groupBy(key).agg(F.map_from_entries(F.flatten(F.collect_list(both))).alias("verdicts"))


def leaders_by_judge(records: DataFrame, key: str, answers: str, judge: Judge, strict: bool = True, symmetric: bool = False) -> DataFrame:
    """§2.14, E1, E4: records with owners, for each answer the place of its cluster's leader under a judge written in Python.

    key is unique. A pair that the judge has no label for isn't equivalent.
    """
    pairs = answer_pairs(records, key, answers)
    found = verdicts(pairs, judged(distinct_pairs(pairs), judge, symmetric), key)
    none = F.create_map().cast("map<string,int>")
    owners = leaders_by_verdicts(F.col(answers), F.coalesce("__verdicts", none), strict)
    return records.join(found.withColumnRenamed("verdicts", "__verdicts"), key, "left").withColumn("owners", owners).drop("__verdicts")


def graded(records: DataFrame, grader: Callable[..., pa.Array], *columns: str, name: str = "grade") -> DataFrame:
    """§2.14: records with the grader's reply to the given columns, a string; equal inputs are asked once, nulls are inputs like others."""
    asked = records.select(*columns).distinct()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, grader(*b.columns).cast(pa.string())], [*(f"__{c}" for c in columns), name])

    schema = ", ".join([*(f"`__{c}` {t}" for c, t in asked.dtypes), f"`{name}` string"])
    replies = asked.mapInArrow(task, schema)
    meets = [records[c].eqNullSafe(replies[f"__{c}"]) for c in columns]
    return records.join(replies, meets).drop(*(f"__{c}" for c in columns))
