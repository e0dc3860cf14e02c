"""Connected components of a link table by alternating stars.

A large-star step hangs the larger neighbours of every node on its smallest one, a small-star step
does so with the smaller neighbours; repeated, each component becomes one star around its smallest
node. Every step is an aggregation with partial sums and an equi-join. A hub with very many links meets in one
partition of that join unless adaptive execution splits it, but rows stream through and no group is collected;
each round is written to shared storage before the next reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import stored
from sheaf.session import union_all


def components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) for every node of links (a, b), but the
    roots themselves. Self-links and nulls are left out."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    before = None
    while True:
        edges = stored(edges, "links")
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = mark
        both = union_all(edges.select(F.col("u").alias("x"), F.col("v").alias("y")), edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(least, "x").filter("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = union_all(small, least.select("u", F.col("m").alias("v"))).distinct()
