"""A corpus pipeline over ``documents``: each stage applies one operator to what the one before kept.

Quality rules drop what they reject; near duplicates leave one document of each group; passages
that an earlier document holds are cut out; documents that hold benchmark windows are dropped; the
rest is packed into sequences. All stages but the last return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sheaf.llm import stages
from sheaf.session import scratch, scratch_dir

STAGES = [
    ("quality rules", stages.quality_rules),
    ("near dedup", stages.near_dedup),
    ("suffix-array dedup", stages.suffix_dedup),
    ("benchmark decontamination", stages.decontaminate),
    ("packing", stages.pack),
]

#: Compression ratios, hash sketches and a tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written as Parquet and read again by the next. What a stage has put into the
    scratch folder for itself is cleared once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_dir(spark, name.replace(" ", "-"))
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
