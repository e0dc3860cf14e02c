"""Deduplication, upserts and other table maintenance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.functions.vectors import from_text, to_text
from sheaf.session import union_all


def first_per_key(
    df: DataFrame, key: str = "id", order: Sequence[str | Column] = ("_origin",), within: Sequence[str] = ()
) -> DataFrame:
    """The first row of each key in load order, or of each key and value of the ``within`` columns; rows
    without a key are dropped.

    Spark cuts each task's rows to one per key before the shuffle, so a key that repeats in a
    third of all rows does not end up whole in one task.
    """
    window = Window.partitionBy(key, *within).orderBy(*order)
    return (
        df.filter(F.col(key).isNotNull())
        .withColumn("_position", F.row_number().over(window))
        .filter(F.col("_position") == 1)
        .drop("_position")
    )


def last_per_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The last row of each key in load order."""
    return first_per_key(df, key, [F.col(c).desc() for c in order])


def upsert(
    target: DataFrame,
    source: DataFrame,
    key: str = "id",
    keep: Sequence[str] = ("created_at",),
) -> DataFrame:
    """Target with the rows of ``source`` put in: new keys added, known keys overwritten
    except for the ``keep`` columns. Keys are unique on both sides.

    Updates and inserts are two equi-joins instead of one full outer join. A full outer join
    always shuffles the whole target; these two let Spark send a small batch to the target's
    tasks, and use bucketing or shuffles when the batch is large.
    """
    columns = target.columns
    incoming = source.select(*[F.col(c).alias(f"_{c}") for c in columns])
    updated = target.join(incoming, F.col(key) == F.col(f"_{key}"), "left").select(
        *[
            F.col(c)
            if c == key or c in keep
            else F.when(F.col(f"_{key}").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
            for c in columns
        ]
    )
    batch_keys = source.select(F.col(key).alias("_batch"))
    # Only the target's keys are read here, cut to the batch before they meet the source again.
    matched = target.select(F.col(key).alias("_matched")).join(
        batch_keys, F.col("_matched") == F.col("_batch"), "left_semi"
    )
    inserted = source.select(*columns).join(matched, F.col(key) == F.col("_matched"), "left_anti")
    return union_all(updated, inserted)


def append_new(df: DataFrame, target: DataFrame, key: str = "id") -> DataFrame:
    """Rows ready to append, the status defaulting to ``pending``.

    The job fails when a key is already taken, or comes twice, as a primary key would.
    """
    taken = target.select(F.col(key).alias("_taken"))
    repeats = F.count(F.lit(1)).over(Window.partitionBy(key))
    message = F.concat(F.lit("duplicate key: "), F.col(key))
    bad = F.col("_taken").isNotNull() | (F.col("_repeats") > 1)
    out = df.withColumn("_repeats", repeats).join(taken, F.col(key) == F.col("_taken"), "left")
    if "status" in df.columns:
        out = out.withColumn("status", F.coalesce("status", F.lit("pending")))
    else:
        out = out.withColumn("status", F.lit("pending"))
    # in a filter, so that no choice of columns leaves the check out
    return out.filter(F.when(bad, F.raise_error(message).cast("boolean")).otherwise(True)).drop("_repeats", "_taken")


def fill_missing(df: DataFrame, column: str, value: Column) -> DataFrame:
    """Set a derived text only where it is null or empty."""
    current = F.col(column)
    return df.withColumn(column, F.when(current.isNull() | (current == ""), value).otherwise(current))


# --- vectors: audit, text backup, restore ------------------------------------------------------


def dimension_audit(embeddings: DataFrame) -> DataFrame:
    """How many vectors there are of each length (null vectors under null)."""
    return embeddings.groupBy(F.size("embedding").alias("dimensions")).agg(F.count(F.lit(1)).alias("count"))


def export_vectors(embeddings: DataFrame) -> DataFrame:
    return embeddings.select("proposal_id", to_text(F.col("embedding")).alias("embedding_text"))


def import_vectors(backup: DataFrame, dimensions: int) -> tuple[DataFrame, DataFrame]:
    """Vectors of the wanted length, and ``(proposal_id, dimensions)`` of the others, which
    need a fresh embedding. Rows without a text are left out, as in the backup's restore."""
    parsed = backup.filter(F.col("embedding_text").isNotNull()).select(
        "proposal_id", from_text(F.col("embedding_text")).alias("embedding")
    )
    size = F.size("embedding")
    fits = F.coalesce(size == dimensions, F.lit(False))
    return parsed.filter(fits), parsed.filter(~fits).select("proposal_id", size.alias("dimensions"))


def verify_restore(before: DataFrame, after: DataFrame, dimensions: int) -> DataFrame:
    """Counts on both sides, and whether every vector came back with the wanted length."""
    expected = before.agg(F.count("embedding").alias("expected")).withColumn("_one", F.lit(1))
    restored = after.agg(
        F.count("embedding").alias("restored"),
        F.count(F.when(F.size("embedding") != dimensions, 1)).alias("mismatched"),
    ).withColumn("_one", F.lit(1))
    joined = expected.join(restored, "_one").drop("_one")
    good = (F.col("expected") == F.col("restored")) & (F.col("mismatched") == 0)
    return joined.withColumn("ok", good)
