"""Nearest records by cosine distance: exact for one or many queries, and approximate."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sheaf import schema as S
from sheaf.functions import vectors as V
from sheaf.operators.filters import apply_filters
from sheaf.schema import SearchFilters
from sheaf.session import scratch_dir, task_storage

# Queries in a file that tasks read: with 1536 doubles each, 12 MB. Vectors compared with it at a time.
QUERY_BLOCK, SLICE = 1024, 8192

# Digits kept of a distance, so that equal vectors tie whatever batch they came in.
DIGITS = 12


def vector_search_one(
    query: Sequence[float],
    docs: DataFrame,
    embeddings: DataFrame,
    filters: SearchFilters | None = None,
    limit: int = S.VECTOR_LIMIT,
) -> DataFrame:
    """``(id, distance, position)`` of the ``limit`` nearest records to one query vector.

    Distances are computed first, so that ``(id, distance)`` pairs and not vectors meet the
    filtered records. The last step is a distributed top-k, never a full sort.
    """
    scored = _distances(np.asarray(query, dtype=np.float64), embeddings)
    known = apply_filters(docs, filters).select(F.col("id").alias("_known"))
    found = scored.join(known, F.col("id") == F.col("_known"), "left_semi")
    best = found.orderBy("distance", "id").limit(limit)
    window = Window.partitionBy(F.lit(0)).orderBy("distance", "id")
    return best.withColumn("position", F.row_number().over(window))


def _distances(query: np.ndarray, embeddings: DataFrame) -> DataFrame:
    dim = len(query)
    query = query / np.sqrt((query * query).sum())
    id_type = embeddings.schema["proposal_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                matrix = _matrix(batch.column("embedding"), dim)
                distance = pa.array(np.round(1.0 - matrix @ query, DIGITS), type=pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column("proposal_id"), distance], ["id", "distance"])

    return _searchable(embeddings, dim).mapInArrow(run, f"id {id_type}, distance double")


def _searchable(embeddings: DataFrame, dim: int) -> DataFrame:
    usable = V.is_usable(F.col("embedding")) & (F.size("embedding") == dim)
    return embeddings.select("proposal_id", "embedding").filter(usable)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return _unit(flat.reshape(-1, dim).astype(np.float64))


def _unit(matrix: np.ndarray) -> np.ndarray:
    return matrix / np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))


def vector_search(
    queries: DataFrame,
    docs: DataFrame,
    embeddings: DataFrame,
    filters: SearchFilters | None = None,
    limit: int = S.VECTOR_LIMIT,
    block: int = QUERY_BLOCK,
    part_rows: int = 50_000,
) -> DataFrame:
    """``(query_id, id, distance, position)``: the ``limit`` nearest records per query.

    ``queries`` has ``query_id`` and ``vector``, of any number and with ids of any type. They are written once to
    the shared scratch folder, ``block`` of them a file. The vectors are read where they lie: each task takes
    up to ``part_rows`` of them at a time, multiplies them with one file of queries after the other, and
    hands on only the ``limit`` best per query. So vectors are neither copied nor shuffled, and no
    query goes through the driver.
    """
    known = apply_filters(docs, filters).select(F.col("id").alias("_known"))
    records = embeddings.select("proposal_id", "embedding").join(
        known, F.col("proposal_id") == F.col("_known"), "left_semi"
    )
    records = records.filter(V.is_usable(F.col("embedding")))
    wanted = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    folder = scratch_dir(queries.sparkSession, "query-blocks")
    wanted.filter(V.is_usable(F.col("vector"))).write.option("maxRecordsPerFile", block).parquet(folder)
    schema = nearest_schema(queries, embeddings)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, held = None, []
        for batch in batches:
            files = files if files is not None else _QueryFiles(folder)
            for part in _slices(batch, part_rows):
                if sum(b.num_rows for b in held) + part.num_rows > part_rows and held:
                    yield from nearest_of(pa.Table.from_batches(held), files, limit, arrow)
                    held = []
                held.append(part)
        if held:
            yield from nearest_of(pa.Table.from_batches(held), files, limit, arrow)

    best = records.mapInArrow(run, schema)
    window = Window.partitionBy("query_id").orderBy("distance", "id")
    return best.withColumn("position", F.row_number().over(window)).filter(F.col("position") <= limit)


def nearest_schema(queries: DataFrame, embeddings: DataFrame) -> T.StructType:
    """``query_id, id, distance``, typed like the caller's keys."""
    kinds = (("query_id", queries.schema["query_id"]), ("id", embeddings.schema["proposal_id"]))
    return T.StructType([*[T.StructField(n, f.dataType) for n, f in kinds], T.StructField("distance", T.DoubleType())])


class _QueryFiles:
    """Files of queries in shared storage. A few are kept once read, others are read again."""

    KEPT = 4

    def __init__(self, folder: str) -> None:
        self.fs, root = task_storage(folder)
        found = self.fs.get_file_info(pafs.FileSelector(root))
        self.paths = sorted(f.path for f in found if f.path.endswith(".parquet"))
        self.known: dict[str, pa.Table] = {}

    def __iter__(self) -> Iterator[pa.Table]:
        for path in self.paths:
            table = self.known.get(path)
            if table is None:
                with self.fs.open_input_file(path) as file:
                    table = pq.read_table(file)
                if len(self.known) < self.KEPT:
                    self.known[path] = table
            yield table


def _slices(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    for a in range(0, batch.num_rows, rows):
        yield batch.slice(a, rows)


def nearest_of(records: pa.Table, blocks: Iterable[pa.Table], limit: int, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The best of some records for each query of some blocks, as batches. Lengths of vectors have to agree."""
    parts = dict((dim, (ids, matrix)) for dim, ids, matrix in by_dimension(records, "proposal_id", "embedding"))
    for block in blocks:
        for dim, query_ids, vectors in by_dimension(block, "query_id", "vector"):
            if dim in parts:
                ids, matrix = parts[dim]
                rows, columns, distance = nearest(vectors, matrix, limit)
                columns = [query_ids.take(pa.array(rows)), ids.take(pa.array(columns)), pa.array(distance)]
                cast = [c.cast(f.type) for c, f in zip(columns, arrow, strict=True)]
                yield from pa.Table.from_arrays(cast, schema=arrow).to_batches()


def by_dimension(table: pa.Table, key: str, vector: str) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """Rows split by vector length: ids in their order, and the unit vectors as a matrix in that order."""
    table = table.take(pc.sort_indices(table, sort_keys=[(key, "ascending")], null_placement="at_start"))
    lengths = pc.list_value_length(table.column(vector)).to_numpy()
    for dim in np.unique(lengths):
        part = table.filter(pa.array(lengths == dim)).combine_chunks()
        yield int(dim), _whole(part.column(key)), _matrix(_whole(part.column(vector)), int(dim))


def _whole(column: pa.ChunkedArray) -> pa.Array:
    joined = column.combine_chunks()
    return joined if isinstance(joined, pa.Array) else pa.concat_arrays(joined.chunks)


def nearest(queries: np.ndarray, matrix: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and distance of the ``limit`` smallest distances of each query; equal ones in order of
    the columns. Only a slice of all distances is in memory at a time."""
    rows, columns, best = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    for a in range(0, len(matrix), SLICE):
        distance = np.round(1.0 - queries @ matrix[a : a + SLICE].T, DIGITS)
        edge = np.inf
        if distance.shape[1] > limit:  # everything that ties with the last one is weighed
            edge = np.partition(distance, limit - 1, axis=1)[:, limit - 1 : limit]
        r, c = np.nonzero(distance <= edge)
        rows, columns, best = np.concatenate([rows, r]), np.concatenate([columns, c + a]), np.concatenate([best, distance[r, c]])
        order = np.lexsort((columns, best, rows))
        rows, columns, best = rows[order], columns[order], best[order]
        starts = np.flatnonzero(np.diff(rows, prepend=-1))
        place = np.arange(len(rows)) - np.repeat(starts, np.diff([*starts, len(rows)]))
        rows, columns, best = rows[place < limit], columns[place < limit], best[place < limit]
    return rows, columns, best


# --- approximate: records that share a signature with the query --------------------------------


def plane(table: int, bit: int, axis: int) -> int:
    """Component of a fixed pseudo-random hyperplane, between -504 and 504."""
    x = (table + 1) * 7919 + (bit + 1) * 104729 + (axis + 1) * 1299709
    return (x * x // 97) % 1009 - 504


def signatures(df: DataFrame, vector: str, dim: int, tables: int, bits: int) -> DataFrame:
    """Adds ``_sig``, one bucket number per table: the side of each hyperplane a vector is on."""
    planes = np.array(
        [[plane(t, b, a) for a in range(dim)] for t in range(tables) for b in range(bits)], dtype=np.float64
    )
    weights = 1 << np.arange(bits)

    @F.pandas_udf("array<int>")
    def sides(column: pd.Series) -> pd.Series:
        if column.empty:
            return pd.Series([], dtype=object)
        above = np.stack(column.to_list()).astype(np.float64) @ planes.T > 0
        numbers = above.reshape(len(column), tables, bits) @ weights
        return pd.Series(list(numbers.astype(np.int32)), index=column.index)

    return df.withColumn("_sig", sides.asNondeterministic()(F.col(vector)))


def approx_search(
    queries: DataFrame,
    docs: DataFrame,
    embeddings: DataFrame,
    dim: int,
    filters: SearchFilters | None = None,
    limit: int = S.VECTOR_LIMIT,
    tables: int = 4,
    bits: int = 6,
    salts: int = 16,
) -> DataFrame:
    """Nearest records among those sharing a bucket with the query, by exact distance.

    Records are spread over ``salts`` parts of their bucket and queries are sent to each part,
    so a bucket with a third of all records is shared by many tasks. A pair that meets in
    several tables counts once, in the first; pairs are scored and cut to ``limit`` per query
    before the next shuffle.
    """
    known = apply_filters(docs, filters).select(F.col("id").alias("_known"))
    records = _searchable(embeddings, dim).join(known, F.col("proposal_id") == F.col("_known"), "left_semi")

    def spread(df: DataFrame, vector: str, salt: Column) -> DataFrame:
        signed = signatures(df, vector, dim, tables, bits)
        return signed.select("*", salt.alias("_salt")).select("*", F.posexplode("_sig").alias("_table", "_bucket"))

    own_part = F.pmod(F.xxhash64("proposal_id"), F.lit(salts)).cast("int")
    left = spread(records, "embedding", own_part)
    usable = queries.filter(V.is_usable(F.col("vector")) & (F.size("vector") == dim))
    every_part = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    right = spread(usable.select("query_id", "vector"), "vector", every_part)
    right = right.withColumnRenamed("_sig", "_query_sig")
    pairs = left.join(right, ["_table", "_bucket", "_salt"])
    agrees = F.zip_with("_sig", "_query_sig", lambda a, b: a == b)
    pairs = pairs.filter(F.array_position(agrees, F.lit(True)) == F.col("_table") + 1)
    scored = pairs.select(
        "query_id",
        F.col("proposal_id").alias("id"),
        V.cosine_distance(F.col("embedding"), F.col("vector")).alias("distance"),
    )
    window = Window.partitionBy("query_id").orderBy("distance", "id")
    return scored.withColumn("position", F.row_number().over(window)).filter(F.col("position") <= limit)
