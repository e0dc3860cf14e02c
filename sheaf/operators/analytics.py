"""Counts, summaries and ordered listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf import schema as S
from sheaf.session import union_all, written


def newest_first() -> list[Column]:
    """Newest rows first, undated rows before them, ties by id."""
    return [F.col("created_at").desc_nulls_first(), F.col("id").asc()]


def count_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("count"))


def group_count(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("count"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def amount_stats(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Totals, and the id of the highest and lowest amount (smallest id on a tie).

    The numbers come from a hash aggregation. The ids come from a second scan that keeps only
    rows holding a bound, because an aggregate with a text buffer would sort all rows.
    """
    keys = list(by)
    amount = F.col("amount_numeric")
    stats = df.groupBy(*keys).agg(
        F.count(amount).alias("n_amounts"),
        F.sum(amount).alias("total"),
        F.avg(amount).alias("average"),
        F.min(amount).alias("lowest"),
        F.max(amount).alias("highest"),
    )
    bounds = stats.select(*[F.col(k).alias(f"_{k}") for k in keys], "lowest", "highest")
    at_bound = (amount == F.col("lowest")) | (amount == F.col("highest"))
    if keys:
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        rows = df.select(*keys, "id", amount).join(bounds, [*same, at_bound])
    else:
        # An aggregate without keys is exactly one row.
        rows = df.select("id", amount).join(F.broadcast(bounds), at_bound)
    ids = rows.groupBy(*keys).agg(
        F.min(F.when(amount == F.col("lowest"), F.col("id"))).alias("lowest_id"),
        F.min(F.when(amount == F.col("highest"), F.col("id"))).alias("highest_id"),
    )
    if not keys:
        return stats.join(F.broadcast(ids), F.lit(True))
    ids = ids.select(*[F.col(k).alias(f"_{k}") for k in keys], "lowest_id", "highest_id")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return stats.join(ids, same, "left").drop(*[f"_{k}" for k in keys])


def coverage(records: DataFrame, embeddings: DataFrame) -> DataFrame:
    """How many records have a vector, and how many lack one."""
    keys = embeddings.select(F.col("proposal_id").alias("_key"))
    joined = records.select("id").join(keys, F.col("id") == F.col("_key"), "left")
    total, embedded = F.count(F.lit(1)), F.count("_key")
    return joined.agg(
        total.alias("total"),
        embedded.alias("embedded"),
        (total - embedded).alias("missing"),
        F.coalesce(F.try_divide(embedded * F.lit(100.0), total), F.lit(0.0)).alias("percent"),
    )


def count_with_examples(df: DataFrame, n: int = S.EXAMPLES, by: Sequence[str] = ()) -> DataFrame:
    """Row count and the ``n`` newest rows per group.

    The count is a hash aggregation. The examples are cut to ``n`` rows per group inside each
    input task before they move, so a group of any size costs ``n`` rows per task.
    """
    keys = list(by)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
    best = top_per_key(df, newest_first(), n, keys)
    example = F.struct("position", "id", "title", "type", "created_at")
    lists = best.groupBy(*keys).agg(F.sort_array(F.collect_list(example)).alias("examples"))
    empty = F.array().cast(lists.schema["examples"].dataType)
    if not keys:
        # Both sides are one row.
        joined = counts.withColumn("_one", F.lit(1)).join(lists.withColumn("_one", F.lit(1)), "_one", "left").drop("_one")
    else:
        right = lists.select(*[F.col(k).alias(f"_{k}") for k in keys], "examples")
        match = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        joined = counts.join(right, match, "left").drop(*[f"_{k}" for k in keys])
    return joined.withColumn("examples", F.coalesce("examples", empty))


def top_per_key(df: DataFrame, order: Sequence[Column], n: int, by: Sequence[str] = (), position: str = "position") -> DataFrame:
    """First ``n`` rows per key, numbered from one."""
    if not by:
        # A global window would pull every row into one task: cut first, then number n rows.
        df = df.orderBy(*order).limit(n)
        window = Window.partitionBy(F.lit(0)).orderBy(*order)
    else:
        window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(position, F.row_number().over(window)).filter(F.col(position) <= n)


def newest(df: DataFrame, n: int = S.EXAMPLES) -> DataFrame:
    return df.orderBy(*newest_first()).limit(n)


def sample_rows(df: DataFrame, n: int = S.EXAMPLES) -> DataFrame:
    """Any ``n`` rows; the first by id, so that a rerun gives the same."""
    return df.orderBy("id").limit(n)


def page(df: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """One page of the newest-first listing."""
    return df.orderBy(*newest_first()).offset(offset).limit(limit)


def deep_page(df: DataFrame, limit: int, offset: int, partitions: int | None = None) -> DataFrame:
    """:func:`page` for any offset, without bringing the rows before it into one task.

    Rows are dealt to ranges of the listing's order and written; how many each range has tells which of them
    hold the page, and only those are read and ordered.
    """
    spark = df.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *newest_first()).withColumn("_range", F.spark_partition_id())
    ranges = written(dealt, "listing")
    counts = sorted((r["_range"], r["count"]) for r in ranges.groupBy("_range").count().collect())  # a row a range
    before, wanted, skipped = 0, [], None
    for number, n in counts:
        if before + n > offset and before < offset + limit:
            skipped = before if skipped is None else skipped
            wanted.append(number)
        before += n
    held = ranges.filter(F.col("_range").isin(wanted) if wanted else F.lit(False)).drop("_range")
    return page(held, limit, offset - (skipped or 0) if wanted else 0)


def top_by_amount(df: DataFrame, n: int, amount: str = "amount_numeric") -> DataFrame:
    """Largest amounts first, a missing amount counting as zero."""
    return df.orderBy(F.coalesce(F.col(amount), F.lit(0.0)).desc(), F.col("id").asc()).limit(n)


def load_metrics(loaded: DataFrame, accepted: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rows read, rows left after dropping repeats, rows written, rows refused."""

    def counted(df: DataFrame, stage: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids")).select(
            F.lit(stage).alias("stage"), "n", "ids"
        )

    stages = union_all(counted(loaded, "loaded"), counted(accepted, "accepted"), counted(rejected, "rejected"))

    def pick(stage: str, column: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("stage") == stage, F.col(column))), F.lit(0))

    return stages.agg(
        pick("loaded", "n").alias("loaded"),
        pick("loaded", "ids").alias("deduplicated"),
        pick("accepted", "n").alias("upserted"),
        pick("rejected", "n").alias("failed"),
    )
