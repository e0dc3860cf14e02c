"""Joins between records, embeddings and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_embeddings(records: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Records that have a vector, with it."""
    return records.join(embeddings, records["id"] == embeddings["proposal_id"], "inner")


def without_embedding(records: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Every record that still lacks a vector, each once."""
    return records.join(
        embeddings.select("proposal_id"), records["id"] == F.col("proposal_id"), "left_anti"
    )


def existing(ids: DataFrame, records: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``ids`` whose key is a known record."""
    known = records.select(F.col("id").alias("_known"))
    return ids.join(known, F.col(key) == F.col("_known"), "left_semi")


def orphans_removed(embeddings: DataFrame, records: DataFrame) -> DataFrame:
    """Vectors whose record is still there."""
    return existing(embeddings, records, "proposal_id")


def with_descriptions(shown: DataFrame, descriptions: DataFrame, fallback: str = "description") -> DataFrame:
    """Full description by id where there is one, else the description already shown."""
    lookup = descriptions.select(F.col("id").alias("_id"), F.col("description").alias("_full"))
    joined = shown.join(lookup, F.col("id") == F.col("_id"), "left")
    full = F.coalesce(F.nullif(F.col("_full"), F.lit("")), F.col(fallback))
    return joined.withColumn(fallback, full).drop("_id", "_full")
