"""From raw documents to clean, encoded ones.

Each stage takes (session, documents, folder of the tables) and returns a DataFrame, which is
written as Parquet and read again as the next stage's documents. All but the last keep the
columns of documents, whatever else they hold and however it is named. Every stage works on
whole texts of any length, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dubito.llm import decontaminate, pieces, quality, simhash, suffixes
from dubito.llm.queries import PIECES, table, vocabulary
from dubito.llm.shared import scratch


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the trees over document statistics don't reject (score 0.5 or more).

    A null text is judged as an empty one; rows without a doc_id and repeated rows are judged
    each by its text, so equal texts stay or go together. Without labels of both kinds none goes.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of those whose five-word shingles are similar by 0.8 or more: the smallest doc_id.

    Null, empty and blank texts have no shingles and are one class; a text of fewer words than
    five is one shingle. Of rows that repeat a doc_id one stays, the first by the hash of its
    text; what they hold ties them together. Rows without a doc_id all stay.
    """
    return simhash.keep_one_similar(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that stand earlier in the corpus, by doc_id and place.

    n_chars follows the text where it is cut. Documents that lose their last word go; null and
    empty texts and those of fewer words stay as they are, as do rows without a doc_id. Rows
    that repeat a doc_id are read as copies: what is cut from one is cut from all.
    """
    return suffixes.cut_repeats(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item: no window of twelve tokens agrees with one of an item in ten or more.

    Null, empty and shorter texts leak nothing. Rows are judged by their texts, with or without
    a doc_id; repeated rows stay or go together.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, text): the ids of each text, and what they decode to.

    Null and empty texts have no ids and decode to the empty text; repeated rows get a row each;
    rows without a doc_id are left out, as ids are named by it.
    """
    coded = pieces.encode_documents(docs, vocabulary(PIECES))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "text")


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("SentencePiece encoding and decoding", sentencepiece),
]

#: SQL can't express a trained model or the encoding; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents.

    What each returns is written to the shared folder; when the next is written, the one before
    is deleted, and what the last one reads goes when the driver ends.
    """
    docs, folder = table(spark, sf_dir, "documents"), scratch(spark, "pipeline")
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{i}")
            docs = spark.read.parquet(f"{folder}/{i}")
            store.delete(path(f"{folder}/{i - 1}"), True)
    return docs
