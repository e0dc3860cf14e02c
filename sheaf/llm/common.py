"""What several operators of this subpackage need."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sheaf.session import written

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame below the shared scratch folder and read it back, which cuts its lineage.
    ``sheaf.session.scratch`` clears the folder."""
    return written(df, name)


def per_batch(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | None], schema: T.StructType) -> DataFrame:
    """``mapInArrow`` with a function from one batch to a dict of columns (None: no rows)."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield as_batch(out, arrow)

    return df.mapInArrow(run, schema)


def as_batch(columns: dict, arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in arrow], schema=arrow)


def as_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null gives no bytes."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def parts_for(total: int, each: int, least: int = 1) -> int:
    """The power of two of parts that keeps ``total`` at or below ``each`` a part."""
    parts = least
    while parts * each < total:
        parts *= 2
    return parts


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts."""
    return docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def ragged(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row number and place within the row for rows of the given lengths, laid end to end."""
    rows = np.repeat(np.arange(len(lengths)), lengths)
    starts = np.cumsum(lengths) - lengths
    return rows, np.arange(len(rows)) - starts[rows]


def fields(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns])


def fold_values(values: np.ndarray) -> np.ndarray:
    """Mix 64-bit values so that every bit depends on all bits of the input."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def learning_split(doc_id: Column) -> Column:
    """True for rows held out of learning: crc32 of the id as text leaves remainder 2 by 4."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
