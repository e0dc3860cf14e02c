"""Approximate neighbours from stored signatures, with probing of neighbouring buckets.

A signature says on which side of some fixed planes a vector lies, one number per table. It is kept beside
the vector, with as many planes as the number of rows asks for, so that a bucket's size stays the same as
the table grows. A search looks into each query's own bucket and into those it comes nearest to: the ones
reached by crossing the planes with the smallest margins. Distances are exact; what is
approximate is only which records are compared. How many of the true neighbours are found can be measured.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sheaf import schema as S
from sheaf.functions import vectors as V
from sheaf.operators.filters import apply_filters
from sheaf.operators.vector_search import nearest_of, nearest_schema, plane
from sheaf.schema import SearchFilters
from sheaf.session import read_text, write_new_text

TABLES, PROBES = 8, 8
#: Rows that a bucket is meant to hold, and at most in one task.
BUCKET_ROWS, PART_ROWS = 32, 50_000
#: Queries of a bucket that one task takes.
PART_QUERIES = 4096


@dataclass(frozen=True)
class Signatures:
    path: str
    dim: int
    tables: int
    bits: int
    rows: int
    largest: int  # rows of the largest bucket


def _planes(dim: int, tables: int, bits: int) -> np.ndarray:
    return np.array([[plane(t, b, a) for a in range(dim)] for t in range(tables) for b in range(bits)], np.float64)


def build_signatures(embeddings: DataFrame, path: str, dim: int, tables: int = TABLES, bits: int | None = None) -> Signatures:
    """Store ``proposal_id, embedding, sig`` at a new path. Vectors of another length, and zero, null or broken ones,
    are left out, as they have no distance to anything."""
    spark = embeddings.sparkSession
    usable = embeddings.select("proposal_id", "embedding").filter(V.is_usable(F.col("embedding")) & (F.size("embedding") == dim))
    rows = usable.count()
    bits = bits or min(24, max(2, int(log2(max(1, rows) / BUCKET_ROWS)) if rows > BUCKET_ROWS else 2))
    planes, weights = _planes(dim, tables, bits), 1 << np.arange(bits)
    schema = T.StructType([*usable.schema.fields, T.StructField("sig", T.ArrayType(T.IntegerType()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            sides = (flat.reshape(-1, dim) @ planes.T > 0).reshape(-1, tables, bits) @ weights
            column = pa.array(list(sides.astype(np.int32)), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], schema=to_arrow_schema(schema))

    usable.mapInArrow(sign, schema).write.parquet(f"{path}/rows")
    stored = spark.read.schema(schema).parquet(f"{path}/rows")
    buckets = stored.select(F.posexplode("sig").alias("table", "bucket")).groupBy("table", "bucket").count()
    largest = buckets.agg(F.max("count")).first()[0] or 0
    index = Signatures(path, dim, tables, bits, rows, largest)
    write_new_text(spark, f"{path}/meta/signatures.json", json.dumps(asdict(index)))
    return index


def open_signatures(spark: SparkSession, path: str) -> Signatures:
    return Signatures(**json.loads(read_text(spark, f"{path}/meta/signatures.json")))


def crossings(margins: np.ndarray, probes: int) -> list[int]:
    """The ``probes`` sets of planes, as bit masks, with the smallest sums of squared margins; the empty set
    first. Sets are grown from cheap ones: the last plane is moved on, or the next one is added."""
    order = np.argsort(margins**2, kind="stable")
    cost = (margins**2)[order]
    out, waiting = [0], [(cost[0], (0,))] if len(cost) else []
    while waiting and len(out) < probes:
        total, chosen = heapq.heappop(waiting)
        out.append(sum(1 << int(order[i]) for i in chosen))
        last = chosen[-1]
        if last + 1 < len(cost):
            heapq.heappush(waiting, (total + cost[last + 1], (*chosen, last + 1)))
            heapq.heappush(waiting, (total - cost[last] + cost[last + 1], (*chosen[:-1], last + 1)))
    return out


def _probes(queries: DataFrame, index: Signatures, probes: int) -> DataFrame:
    """``query_id, vector, table, bucket``: the buckets that each query looks into."""
    planes, weights = _planes(index.dim, index.tables, index.bits), 1 << np.arange(index.bits)
    kinds = [T.StructField("table", T.IntegerType()), T.StructField("bucket", T.IntegerType())]
    schema = T.StructType([*queries.schema.fields, *kinds])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, index.dim)
            margins = (flat @ planes.T).reshape(-1, index.tables, index.bits)
            row, table, bucket = [], [], []
            for r, one in enumerate(margins):
                for t, m in enumerate(one):
                    own = int((m > 0) @ weights)
                    found = crossings(m, probes)
                    row += [r] * len(found)
                    table += [t] * len(found)
                    bucket += [own ^ c for c in found]
            taken = batch.take(pa.array(row, pa.int64()))
            columns = [*taken.columns, pa.array(table, pa.int32()), pa.array(bucket, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return queries.mapInArrow(run, schema)


def probed_search(
    queries: DataFrame,
    docs: DataFrame,
    index: Signatures,
    filters: SearchFilters | None = None,
    limit: int = S.VECTOR_LIMIT,
    probes: int = PROBES,
) -> DataFrame:
    """``(query_id, id, distance, position)`` among the records of the probed buckets.

    A bucket of more than :data:`PART_ROWS` records is dealt to several tasks by id, and queries are sent to
    each; many queries are dealt to blocks. Each task hands on its ``limit`` best per query.
    """
    spark = queries.sparkSession
    known = apply_filters(docs, filters).select(F.col("id").alias("_known"))
    stored = spark.read.parquet(f"{index.path}/rows").join(known, F.col("proposal_id") == F.col("_known"), "left_semi")
    wanted = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    wanted = wanted.filter(V.is_usable(F.col("vector")) & (F.size("vector") == index.dim))
    parts, blocks = -(-index.largest // PART_ROWS) or 1, -(-wanted.count() // PART_QUERIES) or 1
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = (
        stored.select("proposal_id", "embedding", F.posexplode("sig").alias("table", "bucket"))
        .withColumn("part", F.pmod(F.xxhash64("proposal_id"), F.lit(parts)).cast("int"))
        .withColumn("block", every(blocks))
    )
    right = (
        _probes(wanted, index, probes)
        .withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
        .withColumn("part", every(parts))
    )
    schema = nearest_schema(queries, stored)
    arrow = to_arrow_schema(schema)

    def run(records: pa.Table, asked: pa.Table) -> pa.Table:
        if not records.num_rows or not asked.num_rows:
            return arrow.empty_table()
        return pa.Table.from_batches(nearest_of(records, [asked], limit, arrow), schema=arrow)

    keys = ["table", "bucket", "part", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)
    once = found.groupBy("query_id", "id").agg(F.min("distance").alias("distance"))
    window = Window.partitionBy("query_id").orderBy("distance", "id")
    return once.withColumn("position", F.row_number().over(window)).filter(F.col("position") <= limit)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact neighbours that were found."""
    hit = exact.join(found.select("query_id", "id").withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    return hit.agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0]
