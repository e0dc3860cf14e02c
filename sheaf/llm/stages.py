"""The stages of the corpus pipeline: (spark, docs, sf_dir) to a frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sheaf.llm import packing
from sheaf.llm.common import table
from sheaf.llm.decontaminate import drop_contaminated
from sheaf.llm.near_dedup import drop_near_copies
from sheaf.llm.quality_rules import quality_filter
from sheaf.llm.suffix_dedup import cut_repeats
from sheaf.session import prepare


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that word counts or compression ratios reject."""
    return quality_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of every group of near copies."""
    prepare(spark)
    return drop_near_copies(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages out of texts that an earlier document holds."""
    prepare(spark)
    return cut_repeats(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark window."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut the rest into sequences of power-of-two length, with token ids, equal lengths together."""
    return packing.bucketed(packing.pack(docs))
