"""Queries over judged records: metrics, selection, clusters, targets."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import entropy as E
from ..functions.phrases import LEVELS
from ..operators import bootstrap as S
from ..operators import cluster as C
from ..operators import compare, judging, longform, metrics, sampling, select, targets
from . import binding as B
from .binding import ANSWERS, CLAIMS, JUDGED, VERDICTS, table
from .registry import query

_AUROC = """t AS (SELECT {by} round(semantic_entropy, 6) AS score, count(*) AS n, sum((grade <> 'CORRECT')::INT) AS p FROM j WHERE grade <> 'NOT_ATTEMPTED' GROUP BY ALL),
w AS (SELECT *, coalesce(sum(n) OVER ({part} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2.0::DOUBLE AS rk FROM t)
SELECT {by} sum(n)::BIGINT AS n, sum(p)::BIGINT AS n_pos, round(CASE WHEN sum(p) > 0 AND sum(n) > sum(p) THEN (sum(p * rk) - sum(p) * (sum(p) + 1) / 2.0::DOUBLE) / (sum(p) * (sum(n) - sum(p))) END, 6) AS auroc FROM w{group}"""


def _wrong():
    return F.col("grade") != "CORRECT"


def _judged(spark, sf_dir):
    return metrics.answered(B.entropies(spark, sf_dir))


@query("WITH " + JUDGED + ", " + _AUROC.format(by="", part="", group=""))
def auroc(spark, sf_dir):
    """Does entropy rank wrong answers above right ones?"""
    return metrics.auroc(_judged(spark, sf_dir), _wrong(), F.col("semantic_entropy"), places=6).withColumn("auroc", F.round("auroc", 6))


@query("WITH " + JUDGED + ", " + _AUROC.format(by="role,", part="PARTITION BY role", group=" GROUP BY role"))
def auroc_by_role(spark, sf_dir):
    """M3, U4: per role."""
    return metrics.auroc(_judged(spark, sf_dir), _wrong(), F.col("semantic_entropy"), "role", places=6).withColumn("auroc", F.round("auroc", 6))


_SWEEP = """, bad AS (SELECT question_idx, sum((response IN ('click', 'view'))::INT) >= 6 AS is_corrupt FROM s WHERE pos > 0 GROUP BY ALL),
jj AS (SELECT j.*, is_corrupt, concat('t', question_idx % 3) AS tag, round(semantic_entropy, 6) AS se FROM j JOIN bad USING (question_idx) WHERE grade <> 'NOT_ATTEMPTED'),
rk AS (SELECT tag, role, grade <> 'CORRECT' AS y, is_corrupt, se, rank() OVER (PARTITION BY tag, role ORDER BY se) + (count(*) OVER (PARTITION BY tag, role, se) - 1) / 2.0::DOUBLE AS r,
  rank() OVER (PARTITION BY tag, role, is_corrupt ORDER BY se) + (count(*) OVER (PARTITION BY tag, role, is_corrupt, se) - 1) / 2.0::DOUBLE AS rc FROM jj),
g AS (SELECT tag, role, count(*) AS n, sum(y::INT) AS p, sum(CASE WHEN y THEN r END) AS s, sum((NOT is_corrupt)::INT) AS n_clean, sum((y AND NOT is_corrupt)::INT) AS pc, sum(CASE WHEN y AND NOT is_corrupt THEN rc END) AS sc FROM rk GROUP BY ALL),
h AS (SELECT tag, role, n, n_clean::BIGINT AS n_clean, CASE WHEN p > 0 AND n > p THEN (s - p * (p + 1) / 2.0::DOUBLE) / (p * (n - p)) END AS auroc, CASE WHEN pc > 0 AND n_clean > pc THEN (sc - pc * (pc + 1) / 2.0::DOUBLE) / (pc * (n_clean - pc)) END AS auroc_clean FROM g),
m AS (SELECT tag, role, avg((grade = 'CORRECT')::INT) AS accuracy, sum((grade = 'CORRECT')::INT)::BIGINT AS n_correct, avg(semantic_entropy) FILTER (grade = 'CORRECT') AS entropy_correct, avg(semantic_entropy) FILTER (grade <> 'CORRECT') AS entropy_wrong, sum((is_corrupt AND grade <> 'CORRECT')::INT)::BIGINT AS n_corrupt_wrong FROM jj GROUP BY ALL)
SELECT tag, role, round(accuracy, 6) AS accuracy, n_correct, round(entropy_correct, 6) AS entropy_correct, round(entropy_wrong, 6) AS entropy_wrong, n_corrupt_wrong, n, round(auroc, 6) AS auroc, n_clean, round(auroc_clean, 6) AS auroc_clean, round(auroc_clean - auroc, 6) AS delta FROM h JOIN m USING (tag, role)"""


@query("WITH " + JUDGED + _SWEEP)
def sweep_report(spark, sf_dir):
    """A row for each tag and role: AUROC of all and of clean records (a sample counts as bad by its type here)."""
    bad = B.answers(spark, sf_dir).where("pos > 0").groupBy("question_idx").agg((F.count_if(F.col("response").isin("click", "view")) >= 6).alias("is_corrupt"))
    runs = _judged(spark, sf_dir).join(bad, "question_idx").withColumn("tag", F.concat(F.lit("t"), (F.col("question_idx") % 3).cast("string")))
    r = metrics.sweep_report(runs, F.col("is_corrupt"), "tag", "role", places=6)
    return r.withColumns({c: F.round(c, 6) for c in ("accuracy", "entropy_correct", "entropy_wrong", "auroc", "auroc_clean", "delta")})


@query("WITH " + JUDGED + " SELECT role, count(*) AS n, sum((grade='CORRECT')::INT)::BIGINT AS n_correct, sum((grade='NOT_ATTEMPTED')::INT)::BIGINT AS n_abstained, round(avg((grade='NOT_ATTEMPTED')::INT), 6) AS abstain_rate, "
       "round(avg((grade='CORRECT')::INT), 6) AS accuracy_all, round(CASE WHEN sum((grade<>'NOT_ATTEMPTED')::INT) > 0 THEN sum((grade='CORRECT')::INT) / sum((grade<>'NOT_ATTEMPTED')::INT) ELSE 0 END, 6) AS accuracy_answered FROM j GROUP BY role")  # fmt: skip
def grade_rates(spark, sf_dir):
    """A1, A2, A4, M11."""
    r = metrics.grade_rates(B.entropies(spark, sf_dir), "role")
    return r.withColumns({c: F.round(c, 6) for c in ("abstain_rate", "accuracy_all", "accuracy_answered")})


@query("WITH " + JUDGED + " SELECT role, round(avg(semantic_entropy), 6) AS mean_se, round(stddev_pop(semantic_entropy), 6) AS sd_se, round(avg((round(semantic_entropy, 6) = 0)::INT), 6) AS single_cluster, count(*) AS n FROM j WHERE grade <> 'NOT_ATTEMPTED' GROUP BY role")
def entropy_summary(spark, sf_dir):
    """A3."""
    return metrics.entropy_summary(B.entropies(spark, sf_dir), "role").withColumns({c: F.round(c, 6) for c in ("mean_se", "sd_se", "single_cluster")})


@query("WITH " + JUDGED + " SELECT grade = 'CORRECT' AS is_correct, round(avg(semantic_entropy), 6) AS mean_se, round(median(semantic_entropy), 6) AS median_se, count(*) AS n FROM j GROUP BY ALL")
def split_by_correct(spark, sf_dir):
    """A5."""
    return metrics.split_by_correct(B.entropies(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("mean_se", "median_se")})


@query("WITH " + JUDGED + " SELECT grade, round(avg(semantic_entropy), 6) AS mean_se, count(*) AS n FROM j GROUP BY grade")
def entropy_by_grade(spark, sf_dir):
    """A23."""
    return B.entropies(spark, sf_dir).groupBy("grade").agg(F.round(F.avg("semantic_entropy"), 6).alias("mean_se"), F.count("*").alias("n"))


@query("WITH " + JUDGED + " SELECT question_idx, round(semantic_entropy, 6) AS semantic_entropy FROM j WHERE grade <> 'CORRECT' AND semantic_entropy >= 1.3 ORDER BY round(semantic_entropy, 6) DESC, question_idx LIMIT 10")
def uncertain_then_wrong(spark, sf_dir):
    """The ten most uncertain wrong answers (a report of the top ten)."""
    hit = select.uncertain_then_wrong(B.entropies(spark, sf_dir), 1.3, _wrong())
    return hit.select("question_idx", F.round("semantic_entropy", 6).alias("semantic_entropy")).orderBy(F.desc("semantic_entropy"), "question_idx").limit(10)


@query("WITH " + JUDGED + " SELECT role, count(*) AS n FROM j WHERE grade <> 'CORRECT' AND semantic_entropy < 1.3 GROUP BY role")
def confidently_wrong(spark, sf_dir):
    """F5."""
    return select.confidently_wrong(B.entropies(spark, sf_dir), 1.3, _wrong()).groupBy("role").agg(F.count("*").alias("n"))


def _pair_tables(spark, sf_dir):
    e = B.entropies(spark, sf_dir).select(F.col("pair_idx").alias("question_idx"), "role", F.round("semantic_entropy", 6).alias("semantic_entropy"))
    return e.where("role = 'teacher'"), e.where("role = 'student'")


_TS = JUDGED + ", t AS (SELECT pair_idx AS q, max(round(semantic_entropy, 6)) AS se FROM j WHERE role = 'teacher' GROUP BY 1), u AS (SELECT pair_idx AS q, max(round(semantic_entropy, 6)) AS se FROM j WHERE role = 'student' GROUP BY 1)"


@query("WITH " + _TS + ", x AS (SELECT t.se AS a, u.se AS b, th AS threshold FROM t FULL JOIN u USING (q), (SELECT unnest([0.5::DOUBLE, 1.0, 1.2, 1.4, 1.5]) AS th)) "
       "SELECT threshold, sum((a >= threshold)::INT)::BIGINT AS teacher_high, sum((b >= threshold)::INT)::BIGINT AS student_high, sum((a >= threshold AND b >= threshold)::INT)::BIGINT AS both_high, "
       "sum((a IS NOT NULL AND b IS NOT NULL)::INT)::BIGINT AS n_common, round(100.0 * both_high / n_common, 6) AS both_high_pct FROM x GROUP BY threshold")  # fmt: skip
def both_high(spark, sf_dir):
    """A15, U1."""
    return select.both_high(*_pair_tables(spark, sf_dir), [0.5, 1.0, 1.2, 1.4, 1.5]).withColumn("both_high_pct", F.round("both_high_pct", 6))


@query("WITH " + _TS + " SELECT q AS question_idx FROM t JOIN u USING (q) WHERE t.se >= 1.4 AND u.se >= 1.4")
def both_high_ids(spark, sf_dir):
    """The keys at one threshold."""
    return select.both_high_ids(*_pair_tables(spark, sf_dir), 1.4)


@query("WITH " + _TS + " SELECT sum((u.se IS NULL)::INT)::BIGINT AS only_a, sum((t.se IS NULL)::INT)::BIGINT AS only_b, sum((t.se IS NOT NULL AND u.se IS NOT NULL)::INT)::BIGINT AS both FROM t FULL JOIN u USING (q)")
def coverage(spark, sf_dir):
    """A16."""
    return select.coverage(*_pair_tables(spark, sf_dir), "question_idx")


@query("WITH " + _TS + " SELECT q AS question_idx, round(t.se, 6) AS a, round(u.se, 6) AS b, round(u.se - t.se, 6) AS gap, CASE WHEN round(u.se - t.se, 6) > 0 THEN 'higher' WHEN round(u.se - t.se, 6) < 0 THEN 'lower' ELSE 'same' END AS label FROM t JOIN u USING (q)")
def entropy_gap(spark, sf_dir):
    """E15."""
    return longform.entropy_gap(*_pair_tables(spark, sf_dir))


@query("WITH " + _TS + " SELECT round(avg(t.se), 6) AS mean_a, round(avg(u.se), 6) AS mean_b, round(avg(u.se - t.se), 6) AS mean_gap FROM t JOIN u USING (q)")
def mean_gap(spark, sf_dir):
    """A22."""
    g = longform.entropy_gap(*_pair_tables(spark, sf_dir))
    return g.agg(F.round(F.avg("a"), 6).alias("mean_a"), F.round(F.avg("b"), 6).alias("mean_b"), F.round(F.avg(F.col("b") - F.col("a")), 6).alias("mean_gap"))


@query("WITH " + JUDGED + ", g AS (SELECT round(semantic_entropy, 4) AS se, count(*) AS n, sum((grade = 'CORRECT')::INT) AS c FROM j GROUP BY 1) "
       "SELECT se, sum(n) OVER (ORDER BY se)::BIGINT AS kept, round(sum(n) OVER (ORDER BY se) / sum(n) OVER (), 6) AS kept_frac, sum(c) OVER (ORDER BY se)::BIGINT AS correct_kept, "
       "round(sum(c) OVER (ORDER BY se) / sum(c) OVER (), 6) AS recall, round(sum(c) OVER (ORDER BY se) / sum(n) OVER (ORDER BY se), 6) AS acc_kept FROM g")  # fmt: skip
def cut_table(spark, sf_dir):
    """A17, W3."""
    return metrics.cut_table(B.entropies(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("kept_frac", "recall", "acc_kept")})


@query("WITH " + JUDGED + " SELECT grade, least(floor(semantic_entropy / ln(10.0::DOUBLE) * 20 + 1e-9)::BIGINT, 19) AS bin, count(*) AS n FROM j GROUP BY ALL")
def entropy_histogram(spark, sf_dir):
    """A18."""
    import math

    return metrics.histogram(B.entropies(spark, sf_dir), F.col("semantic_entropy"), math.log(10), 20, "grade")


_Q = "(SELECT question_idx, round(semantic_entropy, 6) AS u, (grade = 'CORRECT')::INT AS a FROM j WHERE grade <> 'NOT_ATTEMPTED')"


@query("WITH " + JUDGED + f", x AS {_Q}, q AS (SELECT unnest([0.5::DOUBLE, 0.8, 0.9]) AS q), z AS (SELECT q, (SELECT quantile_cont(u, [0.5, 0.8, 0.9]) FROM x)[CASE q WHEN 0.5 THEN 1 WHEN 0.8 THEN 2 ELSE 3 END] AS cutoff FROM q) "
       "SELECT q, round(cutoff, 6) AS cutoff, round(avg(a), 6) AS accuracy FROM z JOIN x ON u <= cutoff + 1e-12 GROUP BY q, cutoff")  # fmt: skip
def accuracy_at_quantile(spark, sf_dir):
    """M5."""
    r = metrics.at_quantiles(_judged(spark, sf_dir), F.col("grade") == "CORRECT", F.col("semantic_entropy"), [0.5, 0.8, 0.9], places=6)
    return r.select("q", F.round("cutoff", 6).alias("cutoff"), F.round("accuracy", 6).alias("accuracy"))


_GRID = ", ".join(f"{0.1 + 0.9 / 19 * i if i < 19 else 1.0}::DOUBLE" for i in range(20))


@query("WITH " + JUDGED + f", x AS {_Q}, q AS (SELECT quantile_cont(u, [{_GRID}]) AS c FROM x), z AS (SELECT unnest(range(20)) AS i, unnest(c) AS cutoff FROM q), "
       "y AS (SELECT i, avg(a) AS acc FROM z JOIN x ON u <= cutoff + 1e-12 GROUP BY i) SELECT round(sum(acc) * 0.9 / 19, 6) AS aurac FROM y")  # fmt: skip
def aurac(spark, sf_dir):
    """M6."""
    return metrics.aurac(_judged(spark, sf_dir), F.col("grade") == "CORRECT", F.col("semantic_entropy"), places=6).withColumn("aurac", F.round("aurac", 6))


@query("WITH " + JUDGED + f", x AS (SELECT *, row_number() OVER (ORDER BY u, question_idx) AS rn, sum(a) OVER (ORDER BY u, question_idx ROWS UNBOUNDED PRECEDING) AS run FROM {_Q}), f AS (SELECT 0.02 + i * 0.98 / 49 AS fraction, greatest(1, floor((0.02 + i * 0.98 / 49) * (SELECT count(*) FROM x) + 1e-9))::BIGINT AS kept FROM (SELECT unnest(range(50)) AS i)) "
       "SELECT round(fraction::DOUBLE, 6) AS fraction, kept, round(run / kept, 6) AS accuracy FROM f JOIN x ON rn = kept")  # fmt: skip
def rejection_curve(spark, sf_dir):
    """Points of the curve, ready for a chart."""
    r = metrics.rejection_curve(_judged(spark, sf_dir), F.col("grade") == "CORRECT", F.col("semantic_entropy"), "question_idx", places=6)
    return r.select(F.round("fraction", 6).alias("fraction"), "kept", F.round("accuracy", 6).alias("accuracy"))


@query()
def bootstrap_auroc(spark, sf_dir):
    """M7: resampled, so not expressible in SQL; the tests hold its interval to its definition."""
    return metrics.bootstrap_auroc(_judged(spark, sf_dir), _wrong(), F.col("semantic_entropy"), "role", places=6)


_REPLICATES, _QUANTILE = 200, 0.8
_WEIGHT = " + ".join(f"(u >= '{x}')::INT" for x in S.limits())
_BOOTSTRAP = f"""b AS (SELECT role, round(semantic_entropy, 6) AS score, (grade <> 'CORRECT')::INT AS y, question_idx FROM j WHERE grade <> 'NOT_ATTEMPTED'),
h AS (SELECT role, score, y, i, md5(concat('42:', i, ':', question_idx)) AS m FROM b, (SELECT unnest(range({(_REPLICATES + 7) // 8})) AS i)),
u AS (SELECT role, score, y, i * 8 + k AS r, substr(m, (4 * k + 1)::INT, 4) AS u FROM h, (SELECT unnest(range(8)) AS k)),
d AS (SELECT role, score, y, r, {_WEIGHT} AS w FROM u WHERE r < {_REPLICATES} UNION ALL SELECT role, score, y, -1, 1 FROM b),
t AS (SELECT role, r, score, sum(w) AS n, sum(w * y) AS p FROM d WHERE w > 0 GROUP BY ALL),
w AS (SELECT *, sum(n) OVER o AS upto, sum(n - p) OVER o AS good, sum(n) OVER (PARTITION BY role, r) AS total FROM t WINDOW o AS (PARTITION BY role, r ORDER BY score ROWS UNBOUNDED PRECEDING)),
a AS (SELECT role, r, 'auroc' AS metric, CASE WHEN sum(p) > 0 AND sum(n) > sum(p) THEN (sum(p * (upto - n + (n + 1) / 2.0::DOUBLE)) - sum(p) * (sum(p) + 1) / 2.0::DOUBLE) / (sum(p) * (sum(n) - sum(p))) END AS value FROM w GROUP BY ALL),
g AS (SELECT unnest(range(21)) AS i, unnest([{_GRID}, {_QUANTILE}::DOUBLE]) AS q),
en AS (SELECT role, r, i, q * (total - 1) - floor(q * (total - 1)) AS part, min({{'s': score, 'u': upto, 'g': good}}) FILTER (floor(q * (total - 1)) < upto) AS lo, min({{'s': score, 'u': upto, 'g': good}}) FILTER (ceil(q * (total - 1)) < upto) AS hi FROM w, g GROUP BY role, r, i, q, total),
ac AS (SELECT role, r, i, CASE WHEN hi.s <= lo.s + (hi.s - lo.s) * part + 1e-12 THEN hi.g / hi.u ELSE lo.g / lo.u END AS acc FROM en),
v AS (SELECT * FROM a UNION ALL SELECT role, r, 'aurac', sum(acc) * (0.9 / 19)::DOUBLE FROM ac WHERE i < 20 GROUP BY ALL UNION ALL SELECT role, r, 'accuracy', acc FROM ac WHERE i = 20)
SELECT role, metric, round(max(value) FILTER (r = -1), 6) AS value, round(stddev_samp(value) FILTER (r >= 0), 6) AS std_err, round(quantile_cont(value, 0.05) FILTER (r >= 0), 6) AS low, round(quantile_cont(value, 0.95) FILTER (r >= 0), 6) AS high, count(value) FILTER (r >= 0) AS n FROM v GROUP BY role, metric"""


@query("WITH " + JUDGED + ", " + _BOOTSTRAP)
def bootstrap_metrics(spark, sf_dir):
    """M7 of three metrics: AUROC, accuracy at a quantile (M5) and the area under it (M6), by role, from one table of weighted counts."""
    measured = {"auroc": S.auroc, "accuracy": S.accuracy_at(_QUANTILE), "aurac": S.aurac}
    r = S.bootstrap(_judged(spark, sf_dir), _wrong(), F.col("semantic_entropy"), F.col("question_idx"), measured, "role", n=_REPLICATES, places=6)
    return r.select("role", "metric", *(F.round(c, 6).alias(c) for c in ("value", "std_err", "low", "high")), "n")


def _mcnemar_sql(x: str, y: str) -> str:
    return (
        f"(SELECT '{x}' AS judge_a, '{y}' AS judge_b, sum(({x} AND NOT {y})::INT)::BIGINT AS x_win, sum(({y} AND NOT {x})::INT)::BIGINT AS y_win FROM v)"
    )


@query("WITH " + VERDICTS + ", d AS (" + " UNION ALL ".join(_mcnemar_sql(*p) for p in (("a", "b"), ("a", "c"), ("b", "c"))) + "), "
       "p AS (SELECT *, x_win + y_win AS n_discordant, least(x_win, y_win) AS k FROM d), "
       "t AS (SELECT judge_a, judge_b, i, lgamma(n_discordant + 1) - lgamma(i + 1) - lgamma(n_discordant - i + 1) - n_discordant * ln(2.0::DOUBLE) AS l FROM p, LATERAL (SELECT unnest(range(k + 1)) AS i)) "
       "SELECT judge_a, judge_b, x_win, y_win, n_discordant, round(CASE WHEN n_discordant = 0 THEN 1.0 ELSE least(1.0, 2 * sum(exp(l))) END, 6) AS p_value, CASE WHEN round(CASE WHEN n_discordant = 0 THEN 1.0 ELSE least(1.0, 2 * sum(exp(l))) END, 6) < 0.05 THEN 'significant' ELSE 'not significant' END AS label "
       "FROM p JOIN t USING (judge_a, judge_b) GROUP BY judge_a, judge_b, x_win, y_win, n_discordant")  # fmt: skip
def mcnemar(spark, sf_dir):
    """M9, M10, J14."""
    return compare.pairwise_mcnemar(B.verdicts(spark, sf_dir), ["a", "b", "c"]).withColumn("p_value", F.round("p_value", 6))


@query("WITH " + VERDICTS + " SELECT judge, round(avg(x::INT), 6) AS accuracy, count(*) AS n FROM (SELECT unnest(['a', 'b', 'c']) AS judge, unnest([a, b, c]) AS x FROM v) GROUP BY judge")
def judge_accuracy(spark, sf_dir):
    """A12, T29."""
    return compare.judge_accuracy(B.verdicts(spark, sf_dir), ["a", "b", "c"], "doc_id").withColumn("accuracy", F.round("accuracy", 6))


@query("WITH " + VERDICTS + " SELECT 'a' AS judge_a, 'b' AS judge_b, round(avg((a = b)::INT), 6) AS agreement FROM v UNION ALL SELECT 'a', 'c', round(avg((a = c)::INT), 6) FROM v UNION ALL SELECT 'b', 'c', round(avg((b = c)::INT), 6) FROM v")
def judge_agreement(spark, sf_dir):
    """A13, J14."""
    return compare.agreement(B.verdicts(spark, sf_dir), ["a", "b", "c"]).withColumn("agreement", F.round("agreement", 6))


@query("WITH " + VERDICTS + " SELECT doc_id, a, b, c FROM v WHERE NOT (a = b AND b = c)")
def judge_disagreements(spark, sf_dir):
    """A14."""
    return compare.disagreements(B.verdicts(spark, sf_dir), ["a", "b", "c"])


@query("WITH " + ANSWERS + ", z AS (SELECT pos AS seed, role, avg((response = 'purchase')::INT) AS acc FROM s GROUP BY ALL) SELECT role, round(avg(acc), 6) AS mean_acc, round(stddev_samp(acc), 6) AS sd_acc, round(min(acc), 6) AS min_acc, round(max(acc), 6) AS max_acc, count(*) AS n_seeds FROM z GROUP BY role")
def seed_summary(spark, sf_dir):
    """A10: each sample place as a seed."""
    a = B.answers(spark, sf_dir).select("role", F.col("pos").alias("seed"), B.grade(F.col("response")).alias("grade"))
    return metrics.seed_summary(a, "role").withColumns({c: F.round(c, 6) for c in ("mean_acc", "sd_acc", "min_acc", "max_acc")})


# Clusters. Event types in alphabetical order are places on a line; neighbours are equivalent.
_KINDS = "['click', 'error', 'purchase', 'signup', 'view']"
_NEAR = f"abs(list_position({_KINDS}, {{a}}) - list_position({_KINDS}, {{b}})) <= 1"
_LEADERS = (
    ANSWERS
    + ", x AS (SELECT question_idx, list(response ORDER BY pos) AS a FROM s WHERE pos > 0 GROUP BY 1), "
    "l AS (SELECT question_idx, a, 0 AS j, []::BIGINT[] AS lead FROM x UNION ALL SELECT question_idx, a, j + 1, CASE WHEN len(list_filter(lead, lambda i: "
    + _NEAR.format(a="a[i + 1]", b="a[j + 1]")
    + ")) = 0 THEN list_append(lead, j) ELSE lead END FROM l WHERE j < 10), "
    "o AS (SELECT question_idx, a, list_transform(range(10), lambda k: CASE WHEN list_contains(lead, k) THEN k ELSE list_max(list_filter(lead, lambda i: i < k AND "
    + _NEAR.format(a="a[i + 1]", b="a[k + 1]")
    + ")) END) AS owner FROM l WHERE j = 10)"
)


def _near(a, b):
    kinds = F.array(*map(F.lit, ["click", "error", "purchase", "signup", "view"]))
    return F.abs(F.array_position(kinds, a) - F.array_position(kinds, b)) <= 1


@query("WITH RECURSIVE " + _LEADERS + " SELECT question_idx, array_to_string(owner, ',') AS owners FROM o")
def cluster_stealing(spark, sf_dir):
    """Leaders under a judge that isn't transitive."""
    r = B.records(spark, sf_dir)
    return r.select("question_idx", F.array_join(C.leaders_by(F.col("raw_responses"), _near), ",").alias("owners"))


def kinds_near(a: pa.Array, b: pa.Array) -> pa.Array:
    """A judge written in Python: entailment where the kinds are neighbours, contradiction elsewhere."""
    place = {k: i for i, k in enumerate(["click", "error", "purchase", "signup", "view"])}
    return pa.array([2 if abs(place[x] - place[y]) <= 1 else 0 for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.int32())


@query("WITH RECURSIVE " + _LEADERS + " SELECT question_idx, array_to_string(owner, ',') AS owners FROM o")
def judge_as_code(spark, sf_dir):
    """§2.14, E1, E4, J13, B2: leaders under a judge that is user code over Arrow columns; each distinct pair of the table is judged once."""
    r = judging.leaders_by_judge(B.records(spark, sf_dir).select("question_idx", "raw_responses"), "question_idx", "raw_responses", kinds_near)
    return r.select("question_idx", F.array_join("owners", ",").alias("owners"))


def same_start(said: pa.Array, gold: pa.Array) -> pa.Array:
    """A grader written in Python, with replies as free as a model's."""
    reply = lambda x, y: "C" if x == y else "not attempted" if x == "error" else "B."
    return pa.array([reply(x, y) for x, y in zip(said.to_pylist(), gold.to_pylist(), strict=True)])


@query("WITH " + JUDGED + " SELECT question_idx, CASE WHEN low_temp_response = CASE WHEN question_idx % 2 = 0 THEN 'view' ELSE 'click' END THEN 'C' WHEN low_temp_response = 'error' THEN 'not attempted' ELSE 'B.' END AS reply FROM j")
def grader_as_code(spark, sf_dir):
    """§2.14: a grader that is user code; equal answers to equal gold are graded once."""
    gold = F.when(F.col("question_idx") % 2 == 0, "view").otherwise("click")
    r = B.records(spark, sf_dir).select("question_idx", "low_temp_response", gold.alias("gold"))
    return judging.graded(r, same_start, "low_temp_response", "gold", name="reply").select("question_idx", "reply")


@query("WITH RECURSIVE " + _LEADERS + ", m AS (SELECT question_idx, unnest(a) AS a, unnest(owner) AS o, unnest(range(10)) AS k FROM o), "
       "n AS (SELECT question_idx, o, a, count(*) AS c, min(k) AS f FROM m GROUP BY ALL), "
       "r AS (SELECT *, row_number() OVER (PARTITION BY question_idx, o ORDER BY c DESC, f) AS rn, sum(c) OVER (PARTITION BY question_idx, o) AS size FROM n), "
       "d AS (SELECT question_idx, a, sum(size) / 10.0::DOUBLE AS p, min(o) AS f, count(*) AS k FROM r WHERE rn = 1 GROUP BY ALL) "
       "SELECT question_idx, round(abs(sum(-p * ln(p))), 6) AS semantic_entropy, arg_min(a, (-round(p, 6), f)) AS predicted, sum(k)::INT AS n_clusters, round(max(p), 6) AS top FROM d GROUP BY question_idx")  # fmt: skip
def cluster_distribution(spark, sf_dir):
    """Entropy after clusters with one representative are merged; another judge than the stored one."""
    r = C.rejudge(B.records(spark, sf_dir), _near)
    return r.select("question_idx", F.round("semantic_entropy", 6).alias("semantic_entropy"), F.col("predicted_response").alias("predicted"), "n_clusters", F.round(F.array_max(F.transform("cluster_probs", lambda s: s["p"])), 6).alias("top"))


@query("WITH " + ANSWERS + ", c AS (SELECT question_idx, response, count(*) AS c, min(pos) AS f, max((pos = 0)::INT) AS fixed FROM s GROUP BY ALL) SELECT question_idx, round(abs(sum(-c / 11.0::DOUBLE * ln(c / 11.0::DOUBLE))), 6) AS semantic_entropy, max(CASE WHEN fixed = 1 THEN response END) AS fixed_response_cluster, arg_min(response, (-c, f)) AS predicted_response FROM c GROUP BY question_idx")
def cluster_with_fixed(spark, sf_dir):
    """The low-temperature answer in front of the samples."""
    r = C.with_entropy(B.records(spark, sf_dir), "raw_responses", C.same_text, fixed="low_temp_response")
    return r.select("question_idx", F.round("semantic_entropy", 6).alias("semantic_entropy"), "fixed_response_cluster", "predicted_response")


@query("WITH " + ANSWERS + " SELECT a.question_idx, coalesce(min(CASE WHEN b.response = a.response THEN b.pos - 1 END), -1)::BIGINT AS place FROM s a JOIN s b USING (question_idx) WHERE a.pos = 0 AND b.pos > 0 GROUP BY 1")
def locate_fixed(spark, sf_dir):
    """E8."""
    return B.records(spark, sf_dir).select("question_idx", C.locate_fixed(F.col("raw_responses"), F.col("low_temp_response")).cast("long").alias("place"))


@query("WITH " + ANSWERS + " SELECT a.question_idx, count(*) AS n_pairs, sum((a.response = b.response)::INT)::BIGINT AS n_equal FROM s a JOIN s b ON a.question_idx = b.question_idx AND a.pos < b.pos WHERE a.pos > 0 GROUP BY 1")
def sample_pairs(spark, sf_dir):
    """J13."""
    p = C.sample_pairs(B.answers(spark, sf_dir).where("pos > 0"))
    return p.groupBy("a.question_idx").agg(F.count("*").alias("n_pairs"), F.count_if(F.col("a.response") == F.col("b.response")).alias("n_equal"))


# Choice distributions: the numbers of an embedding as raw values of so many choices, labelled 0, 1, ...
_LABELLED = "e AS (SELECT vec_id, list_transform(embedding, lambda x: greatest(x::DOUBLE, 0)) AS raw FROM embeddings), n AS (SELECT vec_id, raw, list_sum(raw) AS t FROM e), p AS (SELECT vec_id, raw, CASE WHEN t > 0 THEN list_transform(raw, lambda x: x / t) ELSE list_transform(raw, lambda x: 1.0::DOUBLE / len(raw)) END AS p FROM n)"


def _raw(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.greatest(x.cast("double"), F.lit(0.0))).alias("raw"))


def _labels():
    return F.transform("raw", lambda _, i: i.cast("string"))


@query("WITH " + _LABELLED + " SELECT vec_id, round(list_max(p), 6) AS top, (list_position(raw, list_max(raw)) - 1)::VARCHAR AS argmax, round(abs(coalesce(list_sum(list_transform(list_filter(p, lambda x: x > 0), lambda x: -x * ln(x))), 0)), 6) AS entropy FROM p")
def choice_distribution(spark, sf_dir):
    """E9, E10."""
    d = _raw(spark, sf_dir).select("vec_id", E.choice_distribution(F.col("raw"), _labels()).alias("d"))
    return d.select("vec_id", F.round(F.array_max("d.probs"), 6).alias("top"), "d.argmax", F.round("d.entropy", 6).alias("entropy"))


@query("WITH " + _LABELLED + ", h AS (SELECT vec_id, list_transform(raw, lambda x: pow(x, 2.0)) AS r FROM p), g AS (SELECT vec_id, r, list_sum(r) AS t FROM h) SELECT vec_id, round(CASE WHEN t > 0 THEN list_max(r) / t ELSE 1.0 / len(r) END, 6) AS top FROM g")
def choice_temperature(spark, sf_dir):
    """E11 at temperature one half."""
    return _raw(spark, sf_dir).select("vec_id", F.round(F.array_max(E.temperature(F.col("raw"), 0.5)), 6).alias("top"))


@query("WITH " + _LABELLED + ", z AS (SELECT vec_id, unnest(range(len(p))) AS i, unnest(p) AS pr FROM p) SELECT vec_id, i::INT AS index, round(pr, 6) AS prob FROM z QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY pr DESC, i) <= 2")
def choice_top_k(spark, sf_dir):
    """The two largest."""
    d = _raw(spark, sf_dir).select("vec_id", F.explode(E.top_k(E.normalise(F.col("raw")), 2)).alias("t"))
    return d.select("vec_id", "t.index", F.round("t.prob", 6).alias("prob"))


# Targets.
def _pairs_out(df):
    return df.select("question_idx", F.col("sample").cast("long").alias("sample"), "prompt", "response")


_PAIR = "SELECT question_idx, 0::BIGINT AS sample, concat('Question: ', question_idx) AS prompt, {response} AS response FROM j WHERE grade <> 'NOT_ATTEMPTED'{more}"


@query("WITH " + JUDGED + " " + _PAIR.format(response="low_temp_response", more=""))
def pairs_default(spark, sf_dir):
    """D1."""
    return _pairs_out(targets.build_pairs(B.judged(spark, sf_dir)))


@query("WITH " + JUDGED + " " + _PAIR.format(response="low_temp_response", more=" AND round(semantic_entropy, 6) <= 1.4"))
def pairs_filter(spark, sf_dir):
    """D2."""
    return _pairs_out(targets.build_pairs(B.judged(spark, sf_dir).withColumn("semantic_entropy", F.round("semantic_entropy", 6)), se_threshold=1.4))


@query("WITH " + JUDGED + " " + _PAIR.format(response="CASE WHEN round(semantic_entropy, 6) > 1.4 THEN 'Unknown' ELSE low_temp_response END", more=""))
def pairs_replace(spark, sf_dir):
    """D3."""
    return _pairs_out(targets.build_pairs(B.judged(spark, sf_dir).withColumn("semantic_entropy", F.round("semantic_entropy", 6)), se_threshold=1.4, se_mode="replace"))


@query("WITH " + JUDGED + " SELECT question_idx, pos - 1 AS sample, concat('Question: ', question_idx) AS prompt, response FROM s JOIN (SELECT question_idx FROM j WHERE grade <> 'NOT_ATTEMPTED') USING (question_idx) WHERE pos BETWEEN 1 AND 3")
def pairs_samples(spark, sf_dir):
    """D4."""
    return _pairs_out(targets.build_pairs(B.judged(spark, sf_dir), raw_samples=3))


@query("WITH " + JUDGED + f", l AS (SELECT unnest(['loose', 'medium', 'tight']) AS level, unnest([{LEVELS['loose']}::DOUBLE, {LEVELS['medium']}, {LEVELS['tight']}]) AS t) SELECT level, sum((semantic_entropy <= t)::INT)::BIGINT AS kept, sum((semantic_entropy > t)::INT)::BIGINT AS swapped FROM j, l WHERE grade <> 'NOT_ATTEMPTED' GROUP BY level")
def levels(spark, sf_dir):
    """What each level keeps and swaps."""
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.lit(v).alias("t")) for k, v in LEVELS.items()])).alias("l")
    x = _judged(spark, sf_dir).select("semantic_entropy", rows)
    return x.groupBy("l.level").agg(F.count_if(F.col("semantic_entropy") <= F.col("l.t")).alias("kept"), F.count_if(F.col("semantic_entropy") > F.col("l.t")).alias("swapped"))


@query("WITH " + JUDGED + " SELECT question_idx, unnest(range(3))::INT AS copy, low_temp_response AS response FROM j WHERE grade = 'CORRECT'")
def repeated_pairs(spark, sf_dir):
    """D6."""
    p = targets.build_pairs(B.judged(spark, sf_dir).where("grade = 'CORRECT'"))
    return targets.repeat_pairs(p, 3).select("question_idx", "copy", "response")


@query("SELECT status, ceil(n / 16.0)::BIGINT * 3 AS steps FROM (SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1)")
def training_steps(spark, sf_dir):
    """D11."""
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    return n.select("status", targets.training_steps(F.col("n"), 3, 4, 4).alias("steps"))


@query("WITH " + JUDGED + ", t AS (SELECT pair_idx AS q, low_temp_response AS x FROM j WHERE role = 'teacher' AND question_idx % 7 <> 0), g AS (SELECT pair_idx AS q, CASE WHEN question_idx % 5 = 0 THEN concat(upper(low_temp_response), '.') ELSE low_temp_response END AS y FROM j WHERE role = 'student') "
       "SELECT n, exact, near, round(exact / n, 6) AS exact_rate, round(near / n, 6) AS near_rate FROM (SELECT count(*) AS n, sum(coalesce(x = y, false)::INT)::BIGINT AS exact, sum((NOT coalesce(x = y, false) AND coalesce(rtrim(lower(x), '.') = rtrim(lower(y), '.'), false))::INT)::BIGINT AS near FROM g LEFT JOIN t USING (q))")  # fmt: skip
def reproduction(spark, sf_dir):
    """J5, A8."""
    e = B.entropies(spark, sf_dir)
    t = e.where("role = 'teacher' and question_idx % 7 <> 0").select(F.col("pair_idx").alias("question_idx"), F.col("low_temp_response").alias("target"))
    y = F.when(F.col("question_idx") % 5 == 0, F.concat(F.upper("low_temp_response"), F.lit("."))).otherwise(F.col("low_temp_response"))
    g = e.where("role = 'student'").select(F.col("pair_idx").alias("question_idx"), y.alias("response"))
    return targets.reproduction(g, t).withColumns({c: F.round(c, 6) for c in ("exact_rate", "near_rate")})


@query("WITH " + JUDGED + " SELECT pair_idx AS question_idx, arg_max(low_temp_response, question_idx) AS last, arg_min(low_temp_response, question_idx) AS first FROM j GROUP BY 1")
def first_and_last(spark, sf_dir):
    """Both policies for repeated keys."""
    e = B.entropies(spark, sf_dir).select(F.col("question_idx").alias("line"), "pair_idx", "low_temp_response")
    last, first = targets.last_wins(e, "pair_idx", "line"), targets.first_wins(e, "pair_idx", "line")
    return last.select("pair_idx", F.col("low_temp_response").alias("last")).join(first.select("pair_idx", F.col("low_temp_response").alias("first")), "pair_idx").withColumnRenamed("pair_idx", "question_idx")


# Claims.
@query("WITH " + CLAIMS + " SELECT question_idx, claim_idx, md5(nullif(string_agg(claim, ' ') OVER (PARTITION BY question_idx ORDER BY claim_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '')) AS context_md5 FROM k")
def running_context(spark, sf_dir):
    """The claims before each claim of an answer, all of them, as a digest."""
    return longform.context_digests(B.claims(spark, sf_dir))


@query("WITH " + CLAIMS + ", e AS (SELECT question_idx, claim_idx, coalesce(length(string_agg(claim, ' ') OVER (PARTITION BY question_idx ORDER BY claim_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 0)::INT AS context_end FROM k) SELECT question_idx, count(*) AS n, sum(context_end)::BIGINT AS context_chars, max(context_end) AS longest FROM e GROUP BY 1")
def context_sizes(spark, sf_dir):
    """How much context an answer's claims have, from where each one ends; no context is built."""
    ends = longform.context_ends(B.claims(spark, sf_dir))
    return ends.groupBy("question_idx").agg(F.count("*").alias("n"), F.sum("context_end").alias("context_chars"), F.max("context_end").alias("longest"))


@query("WITH " + CLAIMS + " SELECT question_idx, sum((is_true AND claim_idx % 2 = 0)::INT)::BIGINT AS n_true, sum((NOT (is_true AND claim_idx % 2 = 0))::INT)::BIGINT AS n_false FROM k GROUP BY 1")
def claim_counts(spark, sf_dir):
    """A19, flatten."""
    k = B.claims(spark, sf_dir).withColumn("is_true", F.col("is_true") & (F.col("claim_idx") % 2 == 0))
    return longform.claim_counts(k)


@query("WITH " + CLAIMS + " SELECT count(DISTINCT question_idx) AS n_scored, count(*) AS n_claims FROM k")
def scored_totals(spark, sf_dir):
    """Nested claims counted without flattening."""
    nested = B.claims(spark, sf_dir).groupBy("question_idx").agg(F.collect_list(F.struct(F.col("claim").alias("atom"), F.col("is_true").alias("is_supported"))).alias("claims"))
    return longform.scored_totals(nested)


@query("WITH " + ANSWERS + ", c AS (SELECT question_idx, response, count(*) AS c FROM s WHERE pos > 0 GROUP BY ALL), e AS (SELECT question_idx, abs(sum(-c / 10.0::DOUBLE * ln(c / 10.0::DOUBLE))) AS h FROM c GROUP BY 1), u AS (SELECT question_idx, sum((response = 'error')::INT) AS bad FROM s WHERE pos > 0 GROUP BY 1) "
       "SELECT question_idx // 2 AS question_idx, 0::BIGINT AS claim_idx, round(avg(CASE WHEN bad >= 5 THEN ln(10.0::DOUBLE) ELSE h END), 6) AS semantic_entropy FROM e JOIN u USING (question_idx) GROUP BY 1")  # fmt: skip
def claim_entropy(spark, sf_dir):
    """Two questions a claim, ten answers each; error stands for a refusal."""
    r = B.records(spark, sf_dir).withColumn("answers", F.transform("raw_responses", lambda x: F.when(x == "error", "Unknown").otherwise(x)))
    q = C.with_entropy(r, "answers").select(F.floor(F.col("question_idx") / 2).cast("long").alias("question_idx"), F.lit(0).cast("long").alias("claim_idx"), "answers", "semantic_entropy")
    return longform.claim_entropy(q).withColumn("semantic_entropy", F.round("semantic_entropy", 6))


@query("SELECT c_custkey AS question_idx, entity FROM customer LEFT JOIN (SELECT o_custkey, arg_max(concat('Entity ', o_orderkey), o_orderkey) AS entity FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def entity_names(spark, sf_dir):
    """Customers stand for sampled ids, orders for records."""
    records = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("question_idx"), F.concat(F.lit("Entity "), F.col("o_orderkey").cast("string")).alias("entity"), F.col("o_orderkey").alias("line"))
    return longform.entity_names(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("question_idx")), records)


# Keys and sets over the sales tables.
@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def keep_members(spark, sf_dir):
    """F1, F2."""
    ids = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return select.keep_members(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ids, "o_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def missing_members(spark, sf_dir):
    """Customers without an order."""
    ids = table(spark, sf_dir, "customer").select("c_custkey")
    return select.missing_members(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), ids, "c_custkey")


@query("SELECT k AS custkey, side FROM (SELECT DISTINCT o_custkey AS k, 'a' AS side FROM orders WHERE o_orderstatus = 'F' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') UNION ALL SELECT DISTINCT o_custkey, 'b' FROM orders WHERE o_orderstatus = 'O' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'))")
def symmetric_difference(spark, sf_dir):
    """U3."""
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "custkey")
    return select.symmetric_difference(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), "custkey")


@query("SELECT k AS o_custkey FROM (SELECT unnest(range((SELECT min(o_custkey) FROM orders), (SELECT max(o_custkey) FROM orders) + 1)) AS k) WHERE k NOT IN (SELECT o_custkey FROM orders)")
def key_gaps(spark, sf_dir):
    """U5."""
    return select.gaps(table(spark, sf_dir, "orders"), "o_custkey")


_LEFT = "o_orderkey % 7 NOT IN (3, 4)"


@query(f"WITH o AS (SELECT o_orderkey FROM orders WHERE {_LEFT}) SELECT 'gap' AS way, k AS key FROM (SELECT unnest(range((SELECT min(o_orderkey) FROM o), (SELECT max(o_orderkey) FROM o) + 1)) AS k) WHERE k NOT IN (SELECT o_orderkey FROM o) UNION ALL SELECT 'missing', l_orderkey FROM (SELECT DISTINCT l_orderkey FROM lineitem) WHERE l_orderkey NOT IN (SELECT o_orderkey FROM o)")
def open_keys(spark, sf_dir):
    """Two orders of seven are taken out: the gaps that they leave, and the items' orders that aren't there."""
    left = table(spark, sf_dir, "orders").select("o_orderkey").where(_LEFT)
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    gaps = select.gaps(left, "o_orderkey").select(F.lit("gap").alias("way"), F.col("o_orderkey").alias("key"))
    return gaps.union(select.missing_members(left, items, "o_orderkey").select(F.lit("missing"), "o_orderkey"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 400")
def index_range(spark, sf_dir):
    """pushed down to the scan."""
    return select.index_range(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 100, 400, "o_orderkey")


@query("SELECT o_orderkey, CASE WHEN o_orderkey <= (SELECT max(o_orderkey) FROM (SELECT o_orderkey FROM orders ORDER BY 1 LIMIT (SELECT floor(0.9 * count(*) + 1e-9)::BIGINT FROM orders))) THEN 'train' ELSE 'test' END AS part FROM orders")
def positional_split(spark, sf_dir):
    """O9, O2."""
    return targets.positional_split(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


@query("SELECT line, sum((n = 4)::INT)::BIGINT AS complete, sum((n > 0 AND n < 4)::INT)::BIGINT AS partial, count(*) AS total FROM (SELECT o_orderstatus AS line, o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL) GROUP BY line")
def completeness(spark, sf_dir):
    """Orders as files, their items as lines; four are complete."""
    from ..operators import inventory

    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    counts = table(spark, sf_dir, "orders").join(n, "o_orderkey", "left").select(F.col("o_orderstatus").alias("line"), F.coalesce("n", F.lit(0)).alias("n"))
    return inventory.completeness(counts, "line", complete=4)


@query("SELECT p_type AS category, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, category LIMIT 5")
def top_categories(spark, sf_dir):
    """S14, O4 (a report of the top five)."""
    from ..operators import loaders

    return loaders.top_categories(table(spark, sf_dir, "part").withColumnRenamed("p_type", "category"))


_SAMPLE = "SELECT * FROM (SELECT o_orderkey AS question_idx, {0} AS seed FROM orders ORDER BY md5(concat({0}, ':', o_orderkey)), o_orderkey LIMIT 100)"


@query(_SAMPLE.format(42) + " UNION ALL " + _SAMPLE.format(44))
def sample_ids(spark, sf_dir):
    """A sample for each seed (of so many keys, which is the feature)."""
    pool = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("question_idx"))
    return sampling.seed_samples(pool, 100, [42, 44], early=False)


@query("SELECT c_nationkey, c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS INT) AS i, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer")
def label_occurrences(spark, sf_dir):
    """Place of a row among those with its label. Labels are display strings of one chart."""
    w = Window.partitionBy("c_nationkey")
    return table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.row_number().over(w.orderBy("c_custkey")).alias("i"), F.count("*").over(w).alias("n"))
