"""Shuffled shards by a Feistel permutation of global row numbers, in DataFrame functions only.

Rows are numbered 0 to n-1 in an order that depends on the rows alone: by a hash bucket of the id,
then by id, text checksum and size. A Feistel network over a grid of a x b cells, a * b >= n,
permutes the numbers; a number that lands at n or beyond walks on until it is back below n. So
shard and slot of a row number can be computed by anyone who knows n and the seed, and the inverse
walk gives the row number of a slot. Shards differ by at most one row, slots have no gaps.

Numbering needs no global sort and no single task: each bucket numbers its own rows, and the
buckets' offsets are a sum over the (few) bucket counts. Only id, size and checksum are shuffled;
texts stay where they are. Rows equal in all three are interchangeable, so their order is left open.
A null id is a value like any other; an empty table gives no rows.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROUNDS = 6
SEED = 20_240_601
#: Rows a numbering bucket is meant to hold.
BUCKET_ROWS = 100_000


def grid(n: int) -> tuple[int, int]:
    """Sides a, b of the smallest near-square grid with at least n cells, a - 1 <= b <= a."""
    a = isqrt(max(n, 1) - 1) + 1
    return a, -(-max(n, 1) // a)


def steps(n: int) -> int:
    """Walks after which a number is back below n.

    A walk passes only through cells at n or beyond, of which there are fewer than ``a``; for
    small grids that bound is used as it is. Beyond, each step is outside with a chance below
    1 / b, so 24 steps are missed by 1 in b ** 24 rows. A row that misses raises an error.
    """
    a, _ = grid(n)
    return min(a, 24) + 1


def scrambled(number: Column, a: int, b: int, seed: int) -> Column:
    """One pass of the Feistel network over the grid: halves take turns to shift each other."""

    def turn(state: Column, i: Column) -> Column:
        left, right = state["left"], state["right"]
        even = i % 2 == 0
        shift = F.xxhash64(F.lit(seed), i, F.when(even, right).otherwise(left))
        return F.struct(
            F.when(even, F.pmod(left + F.pmod(shift, F.lit(a)), F.lit(a))).otherwise(left).alias("left"),
            F.when(even, right).otherwise(F.pmod(right + F.pmod(shift, F.lit(b)), F.lit(b))).alias("right"),
        )

    start = F.struct(F.floor(number / b).cast("bigint").alias("left"), F.pmod(number, F.lit(b)).cast("bigint").alias("right"))
    turns = F.array(*[F.lit(i) for i in range(ROUNDS)])
    return F.aggregate(turns, start, turn, lambda s: s["left"] * b + s["right"])


def permuted(number: Column, n: int, seed: int = SEED) -> Column:
    """The place of a row number in the permutation of 0 to n-1."""
    a, b = grid(n)
    walks = F.sequence(F.lit(1), F.lit(steps(n)))

    def walk(at: Column, i: Column) -> Column:
        return F.when((i == 1) | (at >= n), scrambled(at, a, b, seed)).otherwise(at)

    place = F.aggregate(walks, number.cast("bigint"), walk)
    return F.when(place < n, place).otherwise(F.raise_error(F.lit("a row number walked too long")).cast("bigint"))


def numbered(rows: DataFrame, n: int, order: list[str]) -> DataFrame:
    """Add ``row_number`` 0 to n-1, fixed by the values of the columns in ``order``.

    The first of these columns need not be unique; rows equal in all of them may swap numbers.
    """
    buckets = 1
    while buckets * BUCKET_ROWS < n:
        buckets *= 2
    keyed = rows.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = keyed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)) - 1
    placed = keyed.withColumn("_inside", inside).join(offsets, "_bucket")
    return placed.withColumn("row_number", F.col("_offset") + F.col("_inside")).drop("_bucket", "_inside", "_offset")


def shards(docs: DataFrame, n_shards: int = 16, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, row_number, shard and slot of every document."""
    rows = docs.select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    n = docs.count()
    placed = numbered(rows, n, ["doc_id", "text_crc32", "size"])
    place = permuted(F.col("row_number"), max(n, 1), seed)
    placed = placed.withColumn("_place", place)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        "row_number",
        F.pmod("_place", F.lit(n_shards)).cast("int").alias("shard"),
        F.floor(F.col("_place") / n_shards).cast("bigint").alias("slot"),
    )
