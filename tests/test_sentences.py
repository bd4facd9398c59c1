"""The learnt splitter against sentences marked by hand, and its counts against plain code."""

import re

import pytest
from pyspark.sql import functions as F

from dubito.functions.text import sentences as by_pattern
from dubito.operators import sentences as S

#: Texts with their sentences, as a reader marks them.
MARKED = [
    ["Dr. Hall met Mr. Stone in the town.", "They spoke about the bridge."],
    ["The bridge was built by Mr. Gray in spring.", "It still stands today."],
    ["Mrs. Lane asked Dr. Wood about the cost.", "The cost was high, e.g. for the steel.", "They paid it."],
    ["Was it late?", "The train came at noon.", "It carried coal, e.g. from the north, and wood."],
    ["J. P. Moor wrote the book.", "It sold well!", "The second one did not."],
    ["Dr. Wood said no.", "Mr. Stone said yes.", "They agreed to wait."],
    ["He lived on Mill St. near the river.", "The house is gone.", "They took it down."],
    ["The firm Gray Ltd. made glass.", "It closed in winter."],
    ["Mrs. Hall saw the town from St. Mary church.", "It was small then."],
    ["See the map, e.g. Lane County, for the road.", "The road is steep."],
    ["A letter came from Mr. Moor.", "It was short.", "They read it twice."],
    ["The town has a mill, a church, etc. and a school.", "It grew slowly."],
    ["They sold bread, milk, etc. The shop was full.".split(" The")[0], "The shop was full."],
    ["Gray Ltd. and Stone Ltd. were rivals.", "They shared the river."],
    ["Mr. A. Wood taught there.", "The pupils liked him."],
    ["It was sold to Dr. Lane.", "They moved to St. Mary road.", "The garden was large."],
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, " ".join(s)) for i, s in enumerate(MARKED)], "doc_id long, text string").repartition(3).cache()


def cuts(found):
    """Where sentences end, as numbers of words."""
    out, n = set(), 0
    for s in found:
        out.add(n := n + len(s.split()))
    return out


def agreement(given):
    """F1 of ends that stand within texts."""
    right = wrong = missed = 0
    for i, want in enumerate(MARKED):
        w, g = cuts(want), cuts(given[i])
        right, wrong, missed = right + len(w & g) - 1, wrong + len(g - w), missed + len(w - g)
    return 2 * right / (2 * right + wrong + missed)


def test_agreement(spark, docs):
    corpus = docs
    for _ in range(3):
        corpus = corpus.union(docs)
    model = S.learn(corpus).cache()
    short = {r.word for r in model.where("abbreviation").collect()}
    assert {"dr", "mr", "mrs", "e.g", "st", "ltd"} <= short and not short & {"town", "bridge", "it", "then"}
    assert {"it", "they"} <= {r.word for r in model.where("starter").collect()}
    learnt = {r.doc_id: r.sentences for r in S.split(docs, model, "doc_id", least=1).collect()}
    plain = {r.doc_id: r.s for r in docs.select("doc_id", by_pattern(F.col("text"), 1).alias("s")).collect()}
    print("F1 of the learnt splitter and of the pattern:", agreement(learnt), agreement(plain))
    assert agreement(learnt) > 0.9 > 0.7 > agreement(plain)


def test_rows_and_edges(spark, docs):
    model = S.learn(docs)
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "One. "), (4, "no end"), (4, "no end"), (5, 'He said "go." Then he\x01left!\n\nWhy not?  ... Ends here'), (None, "Two words. Three more words.")], "doc_id long, text string").withColumns({"word": F.lit(1), "last": F.lit("x"), "starter": F.lit(0)})
    got = sorted(((r.doc_id, r.sentences) for r in S.split(rows, model, "doc_id").collect()), key=str)
    assert got == sorted([(1, []), (2, []), (3, []), (4, ["no end"]), (4, ["no end"]), (5, ['He said "go."', "Then he left!", "Why not?", "Ends here"]), (None, ["Two words.", "Three more words."])], key=str)
    assert S.split(rows.limit(0), model, "doc_id").collect() == [] == S.learn(rows.limit(0)).collect()
    assert S.learn(rows.where("text is null or text = ''")).collect() == []


def test_long_text(spark):
    long = "It was Mr. Gray there. They saw there Gray and came. They came there and saw. " * 7_000 + "-" * 100_000 + "a" + "." * 100_000
    docs = spark.createDataFrame([(1, long)], "doc_id long, text string")
    model = S.learn(docs)
    assert {r.word for r in model.where("abbreviation").collect()} == {"mr"}
    n = S.split(docs, model, "doc_id").select(F.size("sentences")).first()[0]
    assert n == 21_000


def test_pieces_are_not_shuffled(spark, docs):
    """Only places behind full stops go to the model; texts go once to the places that don't end."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = S.split(docs, S.learn(docs), "doc_id")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        sent = re.findall(r"\(\d+\) Exchange\s*\nInput \[\d+\]: \[(.*)\]", plan)
        assert len(sent) >= 4 and not any("piece#" in x for x in sent) and sum("__text#" in x for x in sent) == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
