"""Events from a file stream, each id stored once: repeats are dropped by bounded state, late rows are kept."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.operators.stored_table import append_missing, current
from sheaf.session import prepare, staged
from sheaf.sources.files import CORRUPT


@dataclass
class EventMetrics:
    """Rows read, rows added to the table, those of them that came behind the bound or without a time, and refused rows."""

    received: int = 0
    added: int = 0
    late: int = 0
    refused: int = 0


def _rows(spark: SparkSession, path: str) -> int:
    manifest = current(spark, path)
    return sum(f.rows for f in manifest.main.listed()) if manifest else 0


def _first_of_each(rows: DataFrame, key: str, event_time: str) -> DataFrame:
    order = [F.col(event_time).asc_nulls_last(), F.to_json(F.struct(*rows.columns))]
    numbered = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return numbered.filter("_n = 1").drop("_n")


def _dropped_below(told: list[dict]) -> str | None:
    """The watermark that held when the last of a run's files were read: rows above it were not dropped for being
    late. It only rises, so it also covers files of a run that died. Without new files it is the last one
    told; without any, unknown."""
    read = [p for p in told if any(s["startOffset"] != s["endOffset"] for s in p["sources"])]
    return (read or told)[-1]["eventTime"].get("watermark") if told else None


def run_events(
    spark: SparkSession,
    directory: str,
    path: str,
    checkpoint: str,
    schema: T.StructType,
    key: str,
    event_time: str,
    within: str,
    rejects_path: str | None = None,
    max_files: int = 1000,
    buckets: int | None = None,
) -> EventMetrics:
    """Add the events of JSON-lines files that have landed since the last run to the table at ``path``, then stop.

    An id that comes again within ``within`` of its first row's ``event_time`` is dropped by state that the
    checkpoint holds (``dropDuplicatesWithinWatermark``), also if the two rows lie in different batches or
    runs; state older than that is forgotten, so it does not grow with the table. What the state lets
    through is added only if the table does not have the id: an id that comes again later still, or a batch
    repeated after a failure, changes nothing.

    Spark's state drops rows that come behind the watermark. They are not lost here: a second stream
    over the same files, with a place of its own in the checkpoint, picks the rows that are no newer than the watermark
    in force when the last files were read, or that have no time, and adds the first by time of each id that the table
    does not have; it parses the files once. Of
    unlike rows with one id inside one batch of the first stream, Spark chooses the one that stays.

    Rows without a key and unreadable lines are refused; they go to ``rejects_path/load=<batch>``.
    """
    prepare(spark)
    declared = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])

    def source() -> DataFrame:
        return (
            spark.readStream.schema(declared)
            .option("columnNameOfCorruptRecord", CORRUPT)
            .option("recursiveFileLookup", True)
            .option("maxFilesPerTrigger", max_files)
            .option("maxFileAge", "36500d")  # a file with an old time of change is read as well
            .json(directory)
        )

    def run(stream: DataFrame, place: str, each: Callable[[DataFrame, int], None]):
        writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{checkpoint}/{place}")
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
        return query

    def usable(rows: DataFrame) -> DataFrame:
        return rows.filter(F.col(CORRUPT).isNull() & F.col(key).isNotNull()).drop(CORRUPT)

    def add(batch: DataFrame, _: int) -> None:
        append_missing(batch.sparkSession, path, batch, key, buckets)

    metrics, before = EventMetrics(), _rows(spark, path)
    timed = usable(source()).filter(F.col(event_time).isNotNull())
    first = run(timed.withWatermark(event_time, within).dropDuplicatesWithinWatermark([key]), "events", add)
    streamed = _rows(spark, path)
    # unknown as after a run that died here, then every row is looked at
    reached = _dropped_below(first.recentProgress)

    def sweep(batch: DataFrame, batch_id: int) -> None:
        refused = F.col(CORRUPT).isNotNull() | F.col(key).isNull()
        counts = Observation()
        rows = usable(batch.observe(counts, F.count(F.lit(1)).alias("n"), F.count_if(refused).alias("refused")))
        if reached:
            rows = rows.filter(F.col(event_time).isNull() | (F.col(event_time) <= F.lit(reached).cast("timestamp")))
        with staged(batch.sparkSession, rows, "late") as late:
            found = counts.get.get("refused", 0)
            metrics.received += counts.get.get("n", 0)
            metrics.refused += found
            if rejects_path is not None and found:
                batch.filter(refused).write.mode("overwrite").parquet(f"{rejects_path}/load=batch-{batch_id}")
            if not late.isEmpty():
                append_missing(batch.sparkSession, path, _first_of_each(late, key, event_time), key, buckets)

    run(source(), "late", sweep)
    after = _rows(spark, path)
    metrics.added, metrics.late = after - before, after - streamed
    return metrics
