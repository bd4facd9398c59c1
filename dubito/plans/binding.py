"""Domain relations from the driver's tables, the same in both engines.

An event is an answer: by user and time, eleven events in a row are one question, the first
its low-temperature answer, the others its samples. Even questions of a user are the
teacher's, odd ones the student's; a teacher's and the next student's question are a pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.cluster import same_text, with_entropy

SAMPLES = 10
_BASE = 1_000_000

#: Whole documents as answers, with phrases put around them, so that every detector has something to find. Valid in both engines.
RESPONSE = """CASE doc_id % 11
  WHEN 0 THEN concat('There is no widely known record. ', text)
  WHEN 1 THEN concat(text, ' Details are limited and not available.')
  WHEN 2 THEN concat('n/a. ', text)
  WHEN 4 THEN concat('   ', text, '   ')
  WHEN 5 THEN concat('It is probably ', text, ' because of this.')
  WHEN 6 THEN concat('Unknown. ', text)
  WHEN 8 THEN concat('deadbeef-1234 ', text)
  ELSE text END"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(question_idx, pair_idx, role, pos, response, value) of complete questions.

    An event's place among its user's is its place within the hour plus the events of the
    user's earlier hours, which are counted first: no task needs all events of a user.
    """
    ev = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value", F.date_trunc("hour", "ts").alias("hour"))
    counts = ev.groupBy("user_id", "hour").agg(F.count("*").alias("c"))
    before = Window.partitionBy("user_id").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("user_id", "hour", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"), F.sum("c").over(Window.partitionBy("user_id")).alias("total"))
    here = Window.partitionBy("user_id", "hour").orderBy("ts", "event_id")
    ev = ev.withColumn("rn", F.row_number().over(here) - 1).join(counts, ["user_id", "hour"])
    n = F.col("before") + F.col("rn")
    block = F.floor(n / (SAMPLES + 1)).cast("long")
    ev = ev.withColumns({"block": block, "pos": (n % (SAMPLES + 1)).cast("long")}).where((F.col("block") + 1) * (SAMPLES + 1) <= F.col("total"))
    return ev.select(
        (F.col("user_id") * _BASE + F.col("block")).alias("question_idx"), (F.col("user_id") * _BASE + F.floor(F.col("block") / 2).cast("long")).alias("pair_idx"),
        F.when(F.col("block") % 2 == 0, "teacher").otherwise("student").alias("role"), "pos", F.col("event_type").alias("response"), "value",
    )


#: The same in SQL: s(question_idx, pair_idx, role, pos, response, value).
ANSWERS = """ev AS (SELECT user_id, event_type, value, count(*) OVER (PARTITION BY user_id) AS total, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events),
s AS (SELECT user_id * 1000000 + n // 11 AS question_idx, user_id * 1000000 + (n // 11) // 2 AS pair_idx, CASE WHEN (n // 11) % 2 = 0 THEN 'teacher' ELSE 'student' END AS role, n % 11 AS pos, event_type AS response, value FROM ev WHERE (n // 11 + 1) * 11 <= total)"""


def grade(low=None):
    low = F.col("low_temp_response") if low is None else low
    return F.when(low == "purchase", "CORRECT").when(low == "error", "NOT_ATTEMPTED").otherwise("INCORRECT")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(question_idx, pair_idx, role, prompt, low_temp_response, raw_responses, grade)."""
    a = answers(spark, sf_dir)
    raw = F.transform(F.array_sort(F.collect_list(F.when(F.col("pos") > 0, F.struct("pos", "response")))), lambda x: x["response"])
    g = a.groupBy("question_idx", "pair_idx", "role").agg(F.max(F.when(F.col("pos") == 0, F.col("response"))).alias("low_temp_response"), raw.alias("raw_responses"))
    return g.withColumns({"prompt": F.concat(F.lit("Question: "), F.col("question_idx").cast("string")), "grade": grade()})


def entropies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(question_idx, pair_idx, role, low_temp_response, grade, semantic_entropy): entropies by counting equal samples."""
    a = answers(spark, sf_dir)
    c = a.groupBy("question_idx", "pair_idx", "role", "response").agg(F.count_if(F.col("pos") > 0).alias("c"), F.max(F.when(F.col("pos") == 0, F.col("response"))).alias("low"))
    p = F.col("c") / SAMPLES
    g = c.groupBy("question_idx", "pair_idx", "role").agg(F.max("low").alias("low_temp_response"), F.abs(F.sum(F.when(F.col("c") > 0, -p * F.ln(p)).otherwise(0.0))).alias("semantic_entropy"))
    return g.withColumn("grade", grade())


#: The same in SQL, behind ANSWERS: j(question_idx, pair_idx, role, low_temp_response, grade, semantic_entropy).
JUDGED = (
    ANSWERS
    + """,
c AS (SELECT question_idx, response, count(*) AS c FROM s WHERE pos > 0 GROUP BY ALL),
e AS (SELECT question_idx, abs(-sum(c / 10.0::DOUBLE * ln(c / 10.0::DOUBLE))) AS semantic_entropy FROM c GROUP BY ALL),
j AS (SELECT s.question_idx, pair_idx, role, response AS low_temp_response, CASE response WHEN 'purchase' THEN 'CORRECT' WHEN 'error' THEN 'NOT_ATTEMPTED' ELSE 'INCORRECT' END AS grade, semantic_entropy
  FROM s JOIN e USING (question_idx) WHERE pos = 0)"""
)


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """records with clusters and entropy of their samples, by the clustering operator."""
    return with_entropy(records(spark, sf_dir), "raw_responses", same_text)


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, response): documents as answers, with phrases put in."""
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(RESPONSE).alias("response"))


#: The same in SQL: r(doc_id, response).
RESPONSES = f"r AS (SELECT doc_id, {RESPONSE} AS response FROM documents)"


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(question_idx, claim_idx, claim, is_true): sentences of labelled documents."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return docs.select(F.col("doc_id").alias("question_idx"), F.posexplode(F.split("text", r"\. ")).alias("claim_idx", "claim"), (F.col("quality") == 1).alias("is_true")).withColumn("claim_idx", F.col("claim_idx").cast("long"))


#: The same in SQL: k(question_idx, claim_idx, claim, is_true).
CLAIMS = """k AS (SELECT doc_id AS question_idx, unnest(range(len(parts))) AS claim_idx, unnest(parts) AS claim, is_true FROM
  (SELECT doc_id, string_split(text, '. ') AS parts, quality = 1 AS is_true FROM documents JOIN labels USING (doc_id)))"""


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, a, b, c): three judges of each labelled document."""
    return table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("a"), (F.col("toxic") == 0).alias("b"), (F.col("doc_id") % 3 != 0).alias("c"))


#: The same in SQL: v(doc_id, a, b, c).
VERDICTS = "v AS (SELECT doc_id, quality = 1 AS a, toxic = 0 AS b, doc_id % 3 <> 0 AS c FROM labels)"
