"""Row conditions: structured filters, refilter of shown rows, score cuts, constraints."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sheaf import schema as S
from sheaf.schema import SearchFilters

# Day limits of the shown date ranges.
DATE_RANGES = {"1d": 1, "7d": 7, "30d": 30, "90d": 90, "1y": 365}


def _moment(value: datetime, like: T.DataType | None) -> Column:
    """A constant of the column's own time type; a cast on the column would keep the
    comparison from the scan."""
    return F.lit(value).cast(like if isinstance(like, T.TimestampNTZType) else "timestamp")


def filter_condition(filters: SearchFilters | None, time_type: T.DataType | None = None) -> Column | None:
    """One condition on plain columns, so that it reaches the Parquet scan."""
    if filters is None:
        return None
    parts: list[Column] = []
    if filters.network:
        parts.append(F.col("network") == filters.network)
    if filters.proposal_type:
        parts.append(F.col("type") == filters.proposal_type)
    if filters.status:
        parts.append(F.col("status") == filters.status)
    if filters.min_amount is not None:
        parts.append(F.col("amount_numeric") >= filters.min_amount)
    if filters.max_amount is not None:
        parts.append(F.col("amount_numeric") <= filters.max_amount)
    if filters.start_date:
        parts.append(F.col("created_at") >= _moment(filters.start_date, time_type))
    if filters.end_date:
        parts.append(F.col("created_at") <= _moment(filters.end_date, time_type))
    return reduce(lambda a, b: a & b, parts) if parts else None


def apply_filters(df: DataFrame, filters: SearchFilters | None) -> DataFrame:
    time_type = df.schema["created_at"].dataType if "created_at" in df.columns else None
    condition = filter_condition(filters, time_type)
    return df if condition is None else df.filter(condition)


def refilter(
    df: DataFrame,
    network: str = "all",
    type: str = "all",
    date_range: str = "all",
    as_of: datetime | None = None,
) -> DataFrame:
    """Narrow shown rows. A row leaves when its age in whole days exceeds the range; rows
    without a date stay."""
    if network != "all":
        df = df.filter(F.lower("network") == network)
    if type != "all":
        df = df.filter(F.col("type") == type)
    days = DATE_RANGES.get(date_range)
    if days is not None:
        if as_of is None:
            raise ValueError("a date range needs as_of")
        # floor(age in days) <= n  is  created_at > as_of - (n + 1) days: a plain comparison
        # with a constant, which the scan can use.
        limit = _moment(as_of - timedelta(days=days + 1), df.schema["created_at"].dataType)
        df = df.filter(F.col("created_at").isNull() | (F.col("created_at") > limit))
    return df


def has_text(*columns: str) -> Column:
    """At least one of the columns holds more than white space."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.trim(F.col(c)) != "", F.lit(False)) for c in columns])


def cut_scores(
    df: DataFrame,
    min_score: float,
    cap: int | None = None,
    fallback: int = 0,
    score: str = "score",
    rank: str = "rank",
    by: Sequence[str] = ("query_id",),
) -> DataFrame:
    """Rows of at least ``min_score``, the best ``cap`` per key. Keys with no such row keep
    their first ``fallback`` rows. ``rank`` is the position already given to each row."""
    passed = F.coalesce(F.col(score) >= min_score, F.lit(False))
    keys = [F.col(c) for c in by]
    if not fallback:
        kept = df.filter(passed)
    else:
        any_passed = F.max(passed).over(Window.partitionBy(*keys))
        kept = (
            df.withColumn("_passed", passed)
            .withColumn("_any", any_passed)
            .filter(F.col("_passed") | (~F.col("_any") & (F.col(rank) <= fallback)))
            .drop("_passed", "_any")
        )
    if cap is None:
        return kept
    position = F.row_number().over(Window.partitionBy(*keys).orderBy(rank))
    return kept.withColumn("_position", position).filter(F.col("_position") <= cap).drop("_position")


def public_view(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The columns open to ad-hoc queries."""
    return df.select(*[c for c in (columns or S.PUBLIC_COLUMNS) if c in df.columns])


def publish_view(df: DataFrame, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Register :func:`public_view` for ``spark.sql``; other columns cannot be named there."""
    view = public_view(df, columns)
    view.createOrReplaceTempView(name)
    return view


def violation(networks: Sequence[str] = tuple(S.NETWORKS)) -> Column:
    """Name of the first broken table constraint, null for a valid record."""
    return (
        F.when(F.col("id").isNull(), F.lit("id is null"))
        .when(F.col("network").isNull(), F.lit("network is null"))
        .when(~F.col("network").isin(list(networks)), F.lit("network not allowed"))
        .when(F.col("type").isNull(), F.lit("type is null"))
        .when(F.col("created_at").isNull(), F.lit("created_at is null"))
    )


def split_valid(
    df: DataFrame, networks: Sequence[str] = tuple(S.NETWORKS)
) -> tuple[DataFrame, DataFrame]:
    """Records that satisfy the constraints, and the others with a ``reason``."""
    marked = df.withColumn("reason", violation(networks))
    return marked.filter(F.col("reason").isNull()).drop("reason"), marked.filter(F.col("reason").isNotNull())
