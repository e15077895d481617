"""From raw documents to packed token sequences, in five stages.

Each stage gets the documents that its predecessor kept, as a written table, and returns those
that it keeps with all their columns; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, exact, near, packing, toxicity
from tidemark.session import materialized

#: Shared five-word shingles, in percent of all of a pair, from which texts are near-duplicates.
NEAR_PERCENT = 80


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; the model learns from the labels of those that are there."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return exact.drop_exact(docs)


def _near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest id stays."""
    return near.drop_near(docs, percent=NEAR_PERCENT)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item occurs go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs).pieces.drop("row")


STAGES = [
    ("toxicity", _toxicity),
    ("exact_dedup", _exact),
    ("near_dedup", _near),
    ("decontamination", _decontaminate),
    ("packing", _pack),
]

# Trained models, shingle links, edit distances and tokens are beyond SQL; a brute-force version
# of the whole chain is in tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialized(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
