"""The corpus pipeline: STAGES over documents, each written as Parquet and read again.

A row is a document from the first stage to the last, whatever its doc_id; nulls, empty texts and repeated
rows have the results that each operator states. Rejected documents leave with the stage that rejects them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordina.llm import bpe, common, langid, mixing, simhash, suffix

#: A document stays if one language holds at least this share of it.
LEAST_SHARE = 0.5
#: Bytes of a string that repeats: nearly all passages of over 50 words have more (see README).
REPEAT_BYTES = 240


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without a letter or without a main language go."""
    return langid.accepted(docs, langid.fit(langid.training_rows(docs)), LEAST_SHARE)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: SimHash within 2 bits, or similarity 0.8 of five-word shingles."""
    return simhash.deduplicated(docs, words=5, similarity=0.8, radius=2)


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings that also occur elsewhere; n_chars follows the text."""
    cut = suffix.deduplicated(docs, REPEAT_BYTES)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.mix(docs).select(*docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document of the mix: number of ids, digests of the ids and of the bytes they decode to."""
    return bpe.digests(docs)


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeats", repeat_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

#: SQL can't express the stages' models and byte-level work; tests hold their operators against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
