"""Incremental load: newly landed files, each merged once."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf import schema as S
from sheaf.operators.embedding import EmbedFn
from sheaf.plans.ingest import LoadMetrics, load_into
from sheaf.session import list_names, prepare, remove_path, write_new_text
from sheaf.sources.files import CORRUPT, ORIGIN, located, records_of


def run_incremental(
    spark: SparkSession,
    directory: str,
    records_path: str,
    embeddings_path: str | None,
    checkpoint: str,
    as_of: datetime,
    schema: T.StructType = S.ENVELOPE_SCHEMA,
    max_files: int = 1000,
    embed_fn: EmbedFn | None = None,
    rejects_path: str | None = None,
    networks: Sequence[str] = tuple(S.NETWORKS),
    dim: int = 64,
    buckets: int | None = None,
) -> LoadMetrics:
    """Merge the JSON files that have landed since the last run, then stop.

    The stream's checkpoint remembers which files are done. Each batch of at most ``max_files`` files only parses
    them, once, and writes the records below the checkpoint. When the stream has stopped, the records
    of all its batches are loaded together, with the same tables, rejects by batch and counts as one load after each
    batch; so the many small jobs of a load are paid once a run, not once a batch. What is written and
    not merged yet, as after a failure, is merged by the next run. Merging a batch again gives the same
    tables, because it overwrites with equal values and the first ``created_at`` of a record stays.
    Late files are ordinary merges. Returns the metrics of all batches together.
    """
    prepare(spark)
    fields = [f for f in schema.fields if f.name != CORRUPT]
    declared = T.StructType([*fields, T.StructField(CORRUPT, T.StringType())])
    stream = (
        spark.readStream.schema(declared)
        .option("multiLine", True)
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("pathGlobFilter", "*.{json,JSON}")
        .option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", max_files)
        .json(directory)
    )

    pending, merged = f"{checkpoint}/pending", f"{checkpoint}/merged"

    def keep(batch: DataFrame, batch_id: int) -> None:
        number = F.lit(batch_id).cast("long").alias("batch")
        rows = records_of(batch).withColumn(ORIGIN, F.struct(number, f"{ORIGIN}.*"))
        rows.write.mode("overwrite").parquet(f"{pending}/{batch_id}")

    def merge() -> LoadMetrics:
        known = _numbers(spark, pending)
        last, before = (max(_numbers(spark, p), default=-1) for p in (f"{checkpoint}/commits", merged))
        # a batch that the stream has not committed may be half written, and comes again
        batches = [n for n in known if before < n <= last]
        metrics = LoadMetrics()
        if batches:
            loaded = spark.read.parquet(*[f"{pending}/{n}" for n in batches])
            options = {"embed_fn": embed_fn, "rejects_path": rejects_path, "networks": networks, "dim": dim, "buckets": buckets}
            metrics = load_into(spark, loaded, records_path, embeddings_path, as_of, batches=batches, **options)
            write_new_text(spark, f"{merged}/{batches[-1]}", "")
        for n in known:
            if n <= max([before, *batches]):
                remove_path(spark, f"{pending}/{n}")
        for n in _numbers(spark, merged)[:-1]:
            remove_path(spark, f"{merged}/{n}")
        return metrics

    query = (
        located(stream)
        .writeStream.foreachBatch(keep)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    try:
        query.awaitTermination()
    except StreamingQueryException:
        merge()  # the batches before the one that failed
        raise
    return merge()


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    return sorted(int(n) for n in list_names(spark, folder) if n.isdigit())
