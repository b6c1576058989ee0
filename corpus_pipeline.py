"""The corpus pipeline: every stage takes what its predecessor kept.

Language identification, one document of each near-duplicate class, substring dedup, benchmark
decontamination, and the mix of sources. Each stage's result is written as Parquet and reread.
Stages share Python workers, so the session's Arrow batches are kept small (``bounded_batches``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from groundshift.llm import decontaminate, language_id, mixing, near_join, unit_dedup
from groundshift.llm.common import bounded_batches, materialize, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    bounded_batches(spark)
    return language_id.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each class of near duplicates."""
    bounded_batches(spark)
    return near_join.keep_one(docs, near_join.classify(docs))


def repeated_units(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the units that an earlier one has; one left empty goes."""
    bounded_batches(spark)
    return unit_dedup.cut_documents(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    bounded_batches(spark)
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many copies of each document the mix takes."""
    bounded_batches(spark)
    return mixing.mix_sources(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_units", repeated_units), ("benchmark", benchmark), ("mix", mix)]

#: The stages learn models and hash shingles, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
