"""Corpus cleaning in stages, each one operator applied to all that its predecessor kept.

Every stage takes and returns the columns of ``documents``; the last returns packed pieces. Rows with
null or empty texts pass through the stages that have nothing to decide about them. An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditframe.llm import queries
from auditframe.llm.common import held_out, saved, small_batches, table
from auditframe.llm.packing import pack
from auditframe.llm.privacy import pseudonymise
from auditframe.llm.quality import fit, score
from auditframe.llm.repeats import remove_repeats
from auditframe.llm.simhash import drop_near


def _with_text(docs: DataFrame, text) -> DataFrame:
    """``docs`` with another text, and its length in n_chars where there is such a column."""
    new = docs.withColumn("text", text)
    return new.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else new


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality network accepts (probability 0.5 and more).

    It learns from the labelled two thirds of ``documents`` that the registered query learns from.
    """
    labels = table(spark, sf_dir, "labels")
    net = fit(docs.select("doc_id", "text"), labels, ~held_out("doc_id", 3, 1))
    return score(docs, net).where("score >= 0.5").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies.

    Near copies share at least 0.8 of their five-word shingles. The index of fingerprints finds the nearest, which
    their shingle sets verify; an exact join of the sets completes them. Different texts with one id are documents of their own; equal rows are copies. Documents
    without an id stay.
    """
    small_batches(spark)
    return drop_near(docs, words=5, similarity=0.8)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 200 bytes that occur again; documents with nothing left go.

    A cut can fall inside a character; what it leaves of that character goes, too.
    """
    small_batches(spark)
    done = remove_repeats(docs, whole_characters=True).where("n_bytes = 0 OR octet_length(kept) > 0")
    whole = done.select("row.*", F.col("kept").cast("string").alias("__kept"))
    return _with_text(whole, F.when(F.col("text").isNotNull(), F.col("__kept"))).select(*docs.columns)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms for personal data."""
    return _with_text(pseudonymise(docs, queries.KEY), F.col("text")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents packed into sequences of 2048 tokens, with their ids."""
    small_batches(spark)
    return pack(docs, queries.vocabulary("byte_bpe_50k.tiktoken"), capacity=2048, end_id=0)


STAGES = [
    ("quality", keep_quality),
    ("near_copies", drop_near_copies),
    ("repeats", drop_repeats),
    ("personal_data", hide_personal_data),
    ("packing", pack_sequences),
]

#: SQL can't express the stages; tests compare them with brute force on a small fixture.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
