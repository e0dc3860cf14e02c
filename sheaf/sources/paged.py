"""Paged remote sources: which units to fetch, and the fetching itself inside the tasks."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf import schema as S

Fetcher = Callable[[str, str, str | None, int, int], dict]

PAGE_SCHEMA = "network string, type string, origin string, page int, position long, item string, error string"


def expand_units(
    pairs: DataFrame, origins: Sequence[str] = tuple(S.ORIGINS), origin_type: str = S.ORIGIN_TYPE
) -> DataFrame:
    """Fetch units from ``(network, type)`` pairs: one per pair, or one per origin where the
    type is fetched by origin."""
    by_origin = F.array(*[F.lit(o) for o in origins])
    single = F.array(F.lit(None).cast("string"))
    return pairs.select(
        "network", "type", F.explode(F.when(F.col("type") == origin_type, by_origin).otherwise(single)).alias("origin")
    )


def fetch_plan(
    spark: SparkSession,
    networks: Sequence[str] = tuple(S.NETWORKS),
    types: Sequence[str] = tuple(S.RECORD_TYPES),
    origins: Sequence[str] = tuple(S.ORIGINS),
) -> DataFrame:
    """All units to fetch: ``(network, type, origin)``."""
    pairs = spark.createDataFrame([(n, t) for n in networks for t in types], "network string, type string")
    return expand_units(pairs, origins)


def fetch_pages(
    plan: DataFrame,
    fetcher: Fetcher,
    limit: int = 50,
    max_items: int | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Items of every unit, as JSON texts, one row each.

    ``fetcher(network, type, origin, limit, page)`` returns a page ``{items, totalCount}``; it
    runs inside the tasks, and ``partitions`` bounds how many units are fetched at once. Paging
    stops at an empty page, at a page without ``items``, or at ``totalCount``. A unit that fails
    gives one row with ``error`` set after the items it had. So does a unit that a caller's
    ``max_items`` cuts short; without it nothing is cut.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for units in batches:
            for unit in units.itertuples(index=False):
                yield from pages(unit.network, unit.type, unit.origin if isinstance(unit.origin, str) else None)

    def pages(network: str, type: str, origin: str | None) -> Iterator[pd.DataFrame]:
        def frame(number: int, rows: list) -> pd.DataFrame:
            head = (network, type, origin, number)
            return pd.DataFrame([(*head, *row) for row in rows], columns=columns)

        columns = ["network", "type", "origin", "page", "position", "item", "error"]
        taken, wanted, number = 0, None, 1
        while wanted is None or taken < wanted:
            if max_items is not None and taken >= max_items:
                yield frame(number, [(None, None, f"cut after {taken} items")])
                return
            try:
                reply = fetcher(network, type, origin, limit, number) or {}
                items = reply.get("items") or []
            except Exception as e:
                yield frame(number, [(None, None, f"{e.__class__.__name__}: {e}")])
                return
            if not items:
                return
            wanted = reply.get("totalCount") or wanted
            most = min(len(items), *[n - taken for n in (wanted, max_items) if n is not None], len(items))
            short = max_items is not None and taken + most == max_items and most < len(items)
            items = items[:most]
            yield frame(number, [(taken + i, json.dumps(x, ensure_ascii=False), None) for i, x in enumerate(items)])
            taken += len(items)
            number += 1
            if short and (wanted is None or taken < wanted):
                yield frame(number, [(None, None, f"cut after {taken} items")])
                return

    parts = partitions or plan.sparkSession.sparkContext.defaultParallelism
    return plan.repartition(parts, "network", "type", "origin").mapInPandas(run, PAGE_SCHEMA)


def parse_items(pages: DataFrame, schema=S.RAW_ITEM_SCHEMA) -> DataFrame:
    """Fetched items with their declared fields, and the failures left out."""
    rows = pages.filter(F.col("item").isNotNull()).select(
        F.col("network").alias("unit_network"),
        F.col("type").alias("unit_type"),
        F.col("origin").alias("unit_origin"),
        "position",
        F.from_json("item", schema).alias("_item"),
    )
    return rows.select("unit_network", "unit_type", "unit_origin", "position", "_item.*")
