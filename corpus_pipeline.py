"""A corpus pipeline of four of the operators in lurelens.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lurelens.llm.queries import stage_decontaminate, stage_encode, stage_near_duplicates, stage_quality

STAGES = [
    ("quality classifier", stage_quality),
    ("minhash near-dedup", stage_near_duplicates),
    ("benchmark decontamination", stage_decontaminate),
    ("byte-level bpe", stage_encode),
]

# Rule fitting, hashing and merging cannot be told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents, each to all that the one before it kept."""
    from lurelens.llm.common import keep, table

    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
