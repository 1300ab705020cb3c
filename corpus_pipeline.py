"""Corpus pipeline: quality, toxicity, near-duplicates, benchmark passages, mixing; each stage works on what the one before kept.

Every stage takes a table with the columns of documents (more columns are carried along, whatever their names) and gives each case
the result its operator states: a null text counts as empty, a null id or a repeated row is a row like any, an empty table
stays empty.  What is deleted: rows the classifier or the lexicon rejects, all but one row of a group of near-duplicates, rows
with a passage of a benchmark item.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ticklane.llm import decontam, mixing, quality, simhash, toxicity
from ticklane.llm.shared import Scratch


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.train(docs, labels))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon does not call toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.train(docs, labels))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    return decontam.keep_uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every document."""
    return mixing.mix(docs)


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: The classifiers are learnt and the near-duplicates are components: not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents; each result is written as Parquet and read again as the next one's docs."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        before, docs = docs, scratch.settle(lambda: stage(spark, docs, sf_dir))  # noqa: B023 - called at once
        scratch.drop(before)  # the first one is the input, which is left alone
    return docs
