"""The corpus pipeline: five stages from ``documents`` to a training mixture.

Each stage reads what the one before it wrote and writes its own rows as Parquet
in the shared folder, so a lost executor or driver costs one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parasol.llm import decontaminate, exact_dedup, mixing, simhash, toxicity
from parasol.llm.common import table
from parasol.session import materialized


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.7 or more go. The models learn from the labelled documents that reach the stage."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with the same text but for the case of A-Z, the one with the largest id stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by fingerprints at most 4 bits apart, the one with the smallest id stays."""
    return simhash.drop_near_duplicates(docs, words=4, max_bits=4)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more stands in benchmark phrases go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the target weights, with their topic, tokens, weight and probability."""
    return mixing.mixture(docs).where("sampled").drop("sampled")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("mixing", mix),
]

ORACLE_SQL = None  # scores, fingerprints and their components are not SQL; tests hold the stages to brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialized(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
