"""The corpus pipeline: five stages over ``documents``, each written and reread before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brasswing.llm import decontamination, language, near_duplicates, personal_data, unigram
from brasswing.llm.shared import Scratch


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null, empty and letterless texts, and texts that no language of the labels explains."""
    return language.determined(docs, language.fit(docs))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates."""
    return near_duplicates.deduplicate(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain an item of ``benchmark``."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redaction_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by its kind."""
    return personal_data.redact(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document left."""
    return unigram.encode_documents(docs)


STAGES = [
    ("language", language_stage),
    ("near_dedup", dedup_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", redaction_stage),
    ("encode", encode_stage),
]
#: The stages are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents of ``sf_dir``."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
