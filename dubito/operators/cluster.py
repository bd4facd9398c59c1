"""Clusters of equivalent answers and the distribution over them.

Answers of a record are few (ten or so), so clustering is a fold over a record's own array,
inside one row; nothing is shuffled. Verdicts come as an array in pair order or as a
function of two answers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.entropy import shannon
from ..functions.text import let, strip


def identical(a: Column, b: Column) -> Column:
    """Answers that are the same after strip() are equivalent without a judge."""
    return strip(a) == strip(b)


def strict_equivalence(ab: Column, ba: Column) -> Column:
    """Both directions entail (2)."""
    return (ab == 2) & (ba == 2)


def loose_equivalence(ab: Column, ba: Column) -> Column:
    """No contradiction (0), and not both neutral (1)."""
    return (ab != 0) & (ba != 0) & ~((ab == 1) & (ba == 1))


def same_text(a: Column, b: Column) -> Column:
    return a == b


def same_words(a: Column, b: Column) -> Column:
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))
    return norm(a) == norm(b)


def token_jaccard(least: float) -> Callable[[Column, Column], Column]:
    """A built-in judge: the word sets' intersection over their union."""

    def judge(a: Column, b: Column) -> Column:
        x, y = (F.array_distinct(F.split(F.lower(strip(c)), r"\s+")) for c in (a, b))
        return F.size(F.array_intersect(x, y)) >= F.lit(least) * F.size(F.array_union(x, y))

    return judge


def contained(a: Column, b: Column) -> Column:
    x, y = F.lower(strip(a)), F.lower(strip(b))
    return F.contains(x, y) | F.contains(y, x)


def leaders(answers: Column, equivalent: Callable[[Column, Column, Column, Column], Column]) -> Column:
    """For each answer the place of its cluster's leader.

    equivalent(i, j, answer i, answer j), i < j. An answer leads if no earlier leader is
    equivalent to it; any other belongs to the latest leader before it that is (a later
    leader takes members over from an earlier one).
    """
    at = lambda i: F.element_at(answers, (i + 1).cast("int"))
    places = F.sequence(F.lit(0), F.size(answers) - 1)

    def step(lead: Column, j: Column) -> Column:
        near = F.exists(lead, lambda i: equivalent(i, j, at(i), at(j)))
        return F.when(near, lead).otherwise(F.array_append(lead, j))

    def owner(lead: Column, j: Column) -> Column:
        mine = F.filter(lead, lambda i: (i < j) & equivalent(i, j, at(i), at(j)))
        return F.when(F.array_contains(lead, j), j).otherwise(F.array_max(mine))

    none = F.array().cast("array<int>")
    owners = let(F.aggregate(places, none, step), lambda lead: F.transform(places, lambda j: owner(lead, j)))
    return F.when(F.size(answers) > 0, owners).otherwise(none)


def leaders_by(answers: Column, judge: Callable[[Column, Column], Column]) -> Column:
    """E4 with a judge of two texts; identical answers need none."""
    return leaders(answers, lambda i, j, a, b: identical(a, b) | judge(a, b))


def leaders_by_verdicts(answers: Column, verdicts: Column, strict: bool = True) -> Column:
    """E4 with verdicts: map from "i,j" to the label (0, 1, 2) of answer i against answer j."""
    rule = strict_equivalence if strict else loose_equivalence
    key = lambda i, j: F.concat_ws(",", i, j)
    return leaders(answers, lambda i, j, a, b: identical(a, b) | F.coalesce(rule(verdicts[key(i, j)], verdicts[key(j, i)]), F.lit(False)))


def clusters(owners: Column) -> Column:
    """Members of each cluster, clusters by their first member."""
    places = F.sequence(F.lit(0), F.size(owners) - 1)
    members = lambda o: F.filter(places, lambda j: F.element_at(owners, (j + 1).cast("int")) == o)
    return F.when(F.size(owners) > 0, F.array_sort(F.transform(F.array_distinct(owners), members))).otherwise(F.array().cast("array<array<int>>"))


def representative(answers: Column) -> Column:
    """The most common string, the first seen among equals."""
    counted = lambda a: F.struct((-F.size(F.filter(answers, lambda x: x == a))).alias("n"), F.array_position(answers, a).alias("at"), a.alias("a"))
    return F.array_min(F.transform(F.array_distinct(answers), counted))["a"]


def distribution(answers: Column, groups: Column) -> Column:
    """E5: (clusters, cluster_probs, predicted, semantic_entropy, n_clusters) of clusters as lists of places.

    Clusters whose representatives are the same string are merged before the entropy.
    """
    texts = lambda m: F.transform(m, lambda j: F.element_at(answers, (j + 1).cast("int")))
    named = F.transform(groups, lambda m: let(texts(m), lambda g: F.struct(representative(g).alias("rep"), F.size(g).alias("n"))))

    def shares(named: Column) -> Column:
        size = lambda r: F.aggregate(F.filter(named, lambda s: s["rep"] == r), F.lit(0), lambda a, s: a + s["n"])
        return F.transform(F.array_distinct(F.transform(named, lambda s: s["rep"])), lambda r: F.struct(r.alias("rep"), (size(r) / F.size(answers)).alias("p")))

    def finish(share: Column) -> Column:
        # the first of those with the largest share
        best = F.array_min(F.transform(share, lambda s, i: F.struct((-s["p"]).alias("p"), i.alias("i"), s["rep"].alias("rep"))))
        return F.struct(groups.alias("clusters"), share.alias("cluster_probs"), best["rep"].alias("predicted"), shannon(F.transform(share, lambda s: s["p"])).alias("semantic_entropy"), F.size(groups).alias("n_clusters"))

    return let(let(named, shares), finish)


def with_entropy(df: DataFrame, answers: str, judge: Callable[[Column, Column], Column] = same_text, fixed: str | None = None) -> DataFrame:
    """Clusters, probabilities and entropy of an array of answers, a fixed answer before them if named."""
    all_answers = F.concat(F.array(fixed), F.col(answers)) if fixed else F.col(answers)

    def judged(a: Column) -> Column:
        def named(owners: Column) -> Column:
            d = let(clusters(owners), lambda g: distribution(a, g))
            if not fixed:
                return F.struct(d.alias("d"))
            own = F.filter(a, lambda _, j: F.element_at(owners, (j + 1).cast("int")) == F.element_at(owners, 1))
            return F.struct(d.alias("d"), let(own, representative).alias("fixed"))

        return let(leaders_by(a, judge), named)

    df = df.withColumn("__d", let(all_answers, judged))
    out = {"clusters": "d.clusters", "cluster_probs": "d.cluster_probs", "predicted_response": "d.predicted", "semantic_entropy": "d.semantic_entropy", "n_clusters": "d.n_clusters"}
    if fixed:
        out["fixed_response_cluster"] = "fixed"
    return df.withColumns({k: F.col(f"__d.{v}") for k, v in out.items()}).drop("__d")


def rejudge(records: DataFrame, judge: Callable[[Column, Column], Column]) -> DataFrame:
    """Entropies of stored samples under another judge; other columns stay."""
    kept = [c for c in records.columns if c not in ("clusters", "cluster_probs", "predicted_response", "semantic_entropy", "n_clusters")]
    return with_entropy(records.select(*kept), "raw_responses", judge)


def locate_fixed(raw: Column, fixed: Column) -> Column:
    """Place of a fixed answer among the samples, -1 if it isn't one."""
    return F.array_position(raw, fixed) - 1


def sample_pairs(samples: DataFrame, key: str = "question_idx", place: str = "pos") -> DataFrame:
    """Pairs i < j of one record's samples; records have a bounded number of samples."""
    a, b = samples.alias("a"), samples.alias("b")
    return a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col(f"a.{place}") < F.col(f"b.{place}")))
