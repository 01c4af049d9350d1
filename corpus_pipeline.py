"""The corpus pipeline: documents go through quality rules, line dedup, near-duplicate removal, decontamination and packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from contactspark.llm import decontaminate, line_dedup, near_copies, packing, quality_rules
from contactspark.operators.ordered import use_checkpoints


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a site go; every document stays."""
    return line_dedup.drop_boilerplate(docs).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity 0.8 or more."""
    return near_copies.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of what is left."""
    return packing.packed(docs)


STAGES = [("quality_rules", rules), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("decontaminate", benchmark), ("packing", windows)]
# packing needs the tokenizer, near duplicates a transitive closure over sets of shingles: SQL has neither
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written as Parquet to the shared folder and read again."""
    use_checkpoints(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
