"""Raw records to table rows, and the whole load."""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence
from contextlib import ExitStack
from dataclasses import dataclass
from dataclasses import fields as dataclass_fields
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf import schema as S
from sheaf.functions import normalize as N
from sheaf.functions import text as X
from sheaf.operators.embedding import EmbedFn, embed, texts_to_embed
from sheaf.operators.filters import split_valid, violation
from sheaf.operators.merge import fill_missing, first_per_key
from sheaf.operators.stored_table import merge_table
from sheaf.session import path_exists, prepare, shuffles_removed, staged, union_all
from sheaf.sources.files import BATCH, CORRUPT, ORIGIN, good_and_corrupt, load_records

# Fields that become table columns; all others go into metadata.
CONSUMED = [
    "id", "network", "type", "proposalType", "title", "description", "content", "proposer",
    "amount", "amount_numeric", "currency", "status", "created_at", "createdAt", "onChainInfo",
]


def normalize(df: DataFrame, as_of: datetime) -> DataFrame:
    """Raw records of any shape to the table's columns, in one projection without Python.

    Which of two fields is read follows the columns that exist for ``amount`` and
    ``created_at``, and the first value that is not empty for the others. A missing id becomes
    ``network_index``, or a hash of the whole row. ``as_of`` stands in for a missing time and
    for the load time. Load order (``_origin``) is kept if present.
    """
    fields = {f.name: f.dataType for f in df.schema.fields}
    info = fields.get("onChainInfo")
    nested = set(info.names) if isinstance(info, T.StructType) else set()
    null = F.lit(None).cast("string")

    def truthy(name: str) -> Column:
        """The field as text, null when missing, empty, zero or false."""
        kind = fields.get(name)
        if kind is None:
            return null
        c = F.col(f"`{name}`")
        if isinstance(kind, T.NumericType):
            return F.when(c != 0, c.cast("string"))
        if isinstance(kind, T.BooleanType):
            return F.when(c, F.lit("True"))
        return N.blank_to_null(c if isinstance(kind, T.StringType) else c.cast("string"))

    def on_chain(name: str) -> Column:
        return N.blank_to_null(F.col(f"onChainInfo.`{name}`").cast("string")) if name in nested else null

    def first_of(*names: str) -> Column:
        return next((F.col(f"`{n}`") for n in names if n in fields), F.lit(None))

    network = N.normalize_network(truthy("network"))
    kind = N.normalize_type(F.coalesce(truthy("type"), truthy("proposalType"), on_chain("type")))
    title = N.strip(truthy("title"))
    description = N.strip(F.coalesce(truthy("description"), truthy("content")))
    amount_name = next((n for n in ("amount", "amount_numeric") if n in fields), None)
    if amount_name is None:
        amount = F.lit(None).cast("double")
    elif isinstance(fields[amount_name], (T.NumericType, T.BooleanType)):
        amount = F.col(amount_name).cast("double")
    else:
        amount = N.normalize_amount(F.col(amount_name).cast("string"))
    created = first_of("created_at", "createdAt")
    created_type = fields.get("created_at", fields.get("createdAt"))
    fallback = F.lit(as_of).cast("timestamp")
    if isinstance(created_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        created_at = F.coalesce(created.cast("timestamp"), fallback)
    elif isinstance(created_type, T.StringType):
        created_at = N.normalize_created_at(created, as_of)
    else:
        created_at = fallback
    given = N.blank_to_null(F.col("id").cast("string")) if "id" in fields else null
    given = F.nullif(given, F.lit("None"))
    raw = [f"`{c}`" for c in df.columns if c not in (CORRUPT, ORIGIN)]
    hashed = F.concat(
        F.coalesce(truthy("network"), F.lit("")),
        F.lit("_"),
        F.substring(F.sha2(F.to_json(F.struct(*raw)), 256), 1, 12),
    )
    indexed = F.concat(truthy("network"), F.lit("_"), truthy("index"))
    rest = [f"`{c}`" for c in df.columns if c not in [*CONSUMED, CORRUPT, ORIGIN]]
    metadata = F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}) if rest else F.lit("{}")

    columns = [
        F.coalesce(given, indexed, hashed).alias("id"),
        network.alias("network"),
        kind.alias("type"),
        title.alias("title"),
        description.alias("description"),
        N.strip(F.coalesce(truthy("proposer"), on_chain("proposer"))).alias("proposer"),
        amount.alias("amount_numeric"),
        N.normalize_currency(truthy("currency")).alias("currency"),
        N.strip(F.coalesce(truthy("status"), on_chain("status"), F.lit("pending"))).alias("status"),
        created_at.alias("created_at"),
        fallback.alias("updated_at"),
        metadata.alias("metadata"),
    ]
    kept = [ORIGIN] if ORIGIN in df.columns else []
    out = df.select(*columns, *kept)
    return out.select(
        *[c for c in out.columns if c != ORIGIN],
        X.clean_doc_text(F.col("title"), F.col("description")).alias("doc_text"),
        *kept,
    )


def valid_and_rejected(
    loaded: DataFrame, as_of: datetime, networks: Sequence[str] = tuple(S.NETWORKS)
) -> tuple[DataFrame, DataFrame]:
    """Unique, valid records ready to merge, and the refused ones with their reason. Repeats
    are dropped first: a refused first record is not replaced by a later one."""
    unique = first_per_key(normalize(loaded, as_of)).drop(ORIGIN)
    return split_valid(unique, networks)


def refresh_texts(records: DataFrame) -> DataFrame:
    """Set the search text of records that have none."""
    return fill_missing(records, "doc_text", X.clean_doc_text(F.col("title"), F.col("description")))


@dataclass
class LoadMetrics:
    """What a load has done, counted from what it has written."""

    records: int = 0
    unreadable: int = 0
    deduplicated: int = 0
    upserted: int = 0
    refused: int = 0
    embedded: int = 0
    seconds: float = 0.0

    def __add__(self, other: LoadMetrics) -> LoadMetrics:
        return LoadMetrics(**{f.name: getattr(self, f.name) + getattr(other, f.name) for f in dataclass_fields(self)})


def _rejects(refused: DataFrame, corrupt: DataFrame | None) -> DataFrame:
    """Refused records with their reason, and unreadable documents with their file and text."""
    null = F.lit(None).cast("string")
    out = refused.select("*", null.alias("file"), null.alias("raw"))
    if corrupt is None:
        return out
    unread = corrupt.select(
        F.lit("unreadable").alias("reason"), F.col(f"{ORIGIN}.file").alias("file"), F.col(CORRUPT).alias("raw"),
        *[c for c in corrupt.columns if c == BATCH],
    )
    return union_all(out, unread, allow_missing=True)


def _write_rejects(rejects: DataFrame, path: str, load_id: str | None, batches: Sequence[int]) -> None:
    """Rejects to the folder of their load, or each to the folder of its batch, in one write. A load or
    batch without rejects gets a folder too, and what a load under the same id has left is replaced."""
    if BATCH not in rejects.columns:
        rejects.write.mode("overwrite").parquet(f"{path}/load={load_id or uuid.uuid4().hex}")
        return
    rejects = rejects.withColumn("load", F.concat(F.lit("batch-"), F.col(BATCH))).drop(BATCH)
    rejects.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("load").parquet(path)
    for batch in batches:
        if not path_exists(rejects.sparkSession, f"{path}/load=batch-{batch}"):
            rejects.drop("load").limit(0).write.parquet(f"{path}/load=batch-{batch}")


def _merge_rows(
    spark: SparkSession, path: str, rows: DataFrame, key: str, keep: Sequence[str], buckets: int | None
) -> None:
    """Merge stored rows, those of several batches as if one batch was merged after the other: a key's last
    row is taken, its ``keep`` columns from its first."""
    if BATCH not in rows.columns:
        merge_table(spark, path, rows, key, keep, buckets, stored=True)
    elif rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        merge_table(spark, path, rows.drop(BATCH), key, keep, buckets, stored=True)
    else:
        firsts = {c: F.min_by(c, BATCH).over(Window.partitionBy(key)) for c in keep}
        merge_table(spark, path, rows.withColumns(firsts), key, keep, buckets, order=(BATCH,))


def load_into(
    spark: SparkSession,
    loaded: DataFrame,
    records_path: str,
    embeddings_path: str | None,
    as_of: datetime,
    embed_fn: EmbedFn | None = None,
    rejects_path: str | None = None,
    networks: Sequence[str] = tuple(S.NETWORKS),
    dim: int = 64,
    buckets: int | None = None,
    load_id: str | None = None,
    batches: Sequence[int] | None = None,
) -> LoadMetrics:
    """Merge loaded records into the tables: records first, then vectors of what was loaded.

    The unique records, and then the fresh vectors, are written once below the shared scratch folder, which
    is cleared afterwards: records are parsed once, merged from there, and the model sees each text once.
    Each step reads what the step before has written, so a lost executor only costs the tasks it
    held, and running the load again leaves the same tables. Refused records and unreadable
    documents go below ``rejects_path/load=<load_id>``, beside those of other loads; a load that is
    run again under its id replaces its own.

    ``batches`` are the numbers of a stream's batches whose records, with the number in ``_origin.batch``, are loaded
    together. Tables, rejects (``load=batch-<n>``) and counts are those of one load for each batch in their order.
    """
    prepare(spark)
    began = time.monotonic()
    metrics = LoadMetrics()
    good, corrupt = good_and_corrupt(loaded) if CORRUPT in loaded.columns else (loaded, None)
    # rows are counted by the writes themselves, not by reading them again
    seen, kept, read, embedded = (Observation() for _ in range(4))
    every, valid = F.count(F.lit(1)).alias("n"), F.count_if(violation(networks).isNull()).alias("valid")
    number = [] if batches is None else [BATCH]
    rows = normalize(good, as_of).observe(seen, every)
    rows = first_per_key(rows.withColumns({c: F.col(f"{ORIGIN}.batch") for c in number}), within=number).drop(ORIGIN)
    with ExitStack() as stack:
        stack.enter_context(shuffles_removed(spark))
        unique = stack.enter_context(staged(spark, rows.observe(kept, every, valid), "records"))
        metrics.records = seen.get.get("n", 0)
        metrics.deduplicated, metrics.upserted = kept.get.get("n", 0), kept.get.get("valid", 0)
        records, refused = split_valid(unique, networks)
        metrics.refused = metrics.deduplicated - metrics.upserted
        if corrupt is not None:
            # their text goes from the files to the rejects, without a copy in between
            corrupt = corrupt.select(ORIGIN, CORRUPT).observe(read, every)
            corrupt = corrupt.withColumns({c: F.col(f"{ORIGIN}.batch") for c in number})
        if rejects_path is not None:
            _write_rejects(_rejects(refused, corrupt), rejects_path, load_id, batches or ())
        elif corrupt is not None:
            stack.enter_context(staged(spark, corrupt, "unreadable"))
        if corrupt is not None:
            metrics.unreadable = read.get.get("n", 0)
        _merge_rows(spark, records_path, records, "id", ("created_at",), buckets)
        if embeddings_path is not None:
            fresh = embed(texts_to_embed(records, carry=number), "text", embed_fn, dim)
            fresh = fresh.filter(F.col("embedding").isNotNull()).select("proposal_id", "embedding", *number)
            vectors = stack.enter_context(staged(spark, fresh.observe(embedded, every), "vectors"))
            metrics.embedded = embedded.get.get("n", 0)
            _merge_rows(spark, embeddings_path, vectors, "proposal_id", (), buckets)
    metrics.seconds = time.monotonic() - began
    return metrics


def run_load(
    spark: SparkSession,
    paths: Sequence[str],
    records_path: str,
    embeddings_path: str | None,
    as_of: datetime,
    schema: T.StructType | None = S.ENVELOPE_SCHEMA,
    **options,
) -> LoadMetrics:
    """Load files and merge them into the tables. ``schema=None`` infers one from all files."""
    prepare(spark)
    return load_into(spark, load_records(spark, paths, schema), records_path, embeddings_path, as_of, **options)
