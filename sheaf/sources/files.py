"""Loading of landed JSON and CSV files, and landing of items as envelopes."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from gzip import compress

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.session import holds_files, shuffles_removed, task_storage, union_all

CORRUPT = "_corrupt_record"
ORIGIN = "_origin"
#: Number of the batch of a stream that a record came with, where a load takes several batches.
BATCH = "_batch"


def located(raw: DataFrame) -> DataFrame:
    """Parsed documents with the file and block each came from, as :func:`records_of` wants."""
    return raw.select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")
    )


def _origin(position: Column) -> Column:
    """Where a row came from: file, block, row, place in its envelope. Sorts in load order."""
    return F.struct(
        F.col("_file").alias("file"),
        F.col("_block").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        position.cast("int").alias("item"),
    )


def load_json(spark: SparkSession, paths: Sequence[str], schema: T.StructType | None = None) -> DataFrame:
    """Records of JSON files: envelopes with ``items`` or ``data``, bare lists, or single objects.

    ``schema`` declares the file (an envelope, or a record); without it, Spark infers one from
    all files. Unreadable files come back as one row with ``_corrupt_record`` set. Fields come
    from the item alone; an envelope's own fields are not copied into it.
    """
    reader = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    reader = reader.option("ignoreMissingFiles", True).option("pathGlobFilter", "*.{json,JSON,json.gz,JSON.gz}")
    if schema is not None:
        if CORRUPT not in schema.names:
            schema = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
        reader = reader.schema(schema)
    raw = located(reader.json(list(paths)))
    if CORRUPT not in raw.columns:
        raw = raw.withColumn(CORRUPT, F.lit(None).cast("string"))
    return records_of(raw)


def _record_lists(schema: T.StructType) -> list[str]:
    return [
        name
        for name in ("items", "data")
        if name in schema.names
        and isinstance(schema[name].dataType, T.ArrayType)
        and isinstance(schema[name].dataType.elementType, T.StructType)
    ]


def records_of(raw: DataFrame) -> DataFrame:
    """One row per record of parsed, :func:`located` JSON documents, in one pass over them."""
    lists = _record_lists(raw.schema)
    place = ("_file", "_block")
    others = [c for c in raw.columns if c not in ("items", "data", CORRUPT, *place)]
    if not lists:
        return raw.select(*others, CORRUPT, _origin(F.lit(0)).alias(ORIGIN))
    items = {name: raw.schema[name].dataType.elementType for name in lists}
    holds = [F.col(n).isNotNull() for n in lists]
    is_envelope = holds[0]
    for h in holds[1:]:
        is_envelope = is_envelope | h
    # Each list is wrapped in a struct of lists, so that one explode serves both.
    def slot(name: str | None) -> Callable[[Column], Column]:
        return lambda x: F.struct(*[(x if m == name else F.lit(None).cast(items[m])).alias(m) for m in lists])

    wrapped = [F.transform(F.col(n), slot(n)) for n in lists]
    single = F.array(slot(None)(F.lit(None)))
    rows = raw.select(
        *others,
        CORRUPT,
        *place,
        is_envelope.alias("_is_envelope"),
        F.posexplode(F.coalesce(*wrapped, single)).alias("_item_position", "_item"),
    )
    names = list(dict.fromkeys([f.name for m in lists for f in items[m].fields] + [c for c in others]))
    columns = []
    for name in names:
        sources = [
            (F.col(f"_item.{m}.`{name}`"), items[m][name].dataType) for m in lists if name in items[m].names
        ]
        if name in others:
            sources.append((F.when(~F.col("_is_envelope"), F.col(f"`{name}`")), raw.schema[name].dataType))
        wide = _common([t for _, t in sources])
        columns.append(F.coalesce(*[_as(c, t, wide) for c, t in sources]).alias(name))
    return rows.select(*columns, CORRUPT, _origin(F.col("_item_position")).alias(ORIGIN))


def load_csv(spark: SparkSession, paths: Sequence[str], schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.option("header", True).option("pathGlobFilter", "*.{csv,CSV}").option("ignoreMissingFiles", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    df = located(reader.csv(list(paths)))
    return df.select(*[c for c in df.columns if c not in ("_file", "_block")], _origin(F.lit(0)).alias(ORIGIN))


def load_records(
    spark: SparkSession,
    paths: Sequence[str],
    schema: T.StructType | None = None,
    suffixes: Sequence[str] = ("json", "csv"),
) -> DataFrame:
    """Records of files, folders or globs, by suffix. Missing paths and other suffixes are
    skipped; it is an error when nothing is left to load."""
    parts = []
    for suffix, load in (("json", load_json), ("csv", load_csv)):
        endings = (f".{suffix}", f".{suffix.upper()}")
        endings += tuple(f"{e}.gz" for e in endings) if suffix == "json" else ()
        chosen = [p for p in paths if suffix in suffixes and holds_files(spark, p, endings)]
        if chosen:
            parts.append(load(spark, chosen, schema))
    if not parts:
        raise ValueError("no data loaded from any files")
    out = union_relaxed(*parts)
    return out if CORRUPT in out.columns else out.withColumn(CORRUPT, F.lit(None).cast("string"))


def good_and_corrupt(loaded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Readable records, and the rows of documents that could not be read."""
    bad = F.col(CORRUPT).isNotNull()
    return loaded.filter(~bad).drop(CORRUPT), loaded.filter(bad)


def _common(types: Sequence[T.DataType]) -> T.DataType:
    """A type that holds all the others: equal, merged struct, double for numbers, or text."""
    distinct = list(dict.fromkeys(t.simpleString() for t in types))
    if len(distinct) == 1:
        return types[0]
    if all(isinstance(t, T.NumericType) for t in types):
        integral = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
        return T.LongType() if all(isinstance(t, integral) for t in types) else T.DoubleType()
    if all(isinstance(t, T.StructType) for t in types):
        names = list(dict.fromkeys(n for t in types for n in t.names))
        return T.StructType([T.StructField(n, _common([t[n].dataType for t in types if n in t.names])) for n in names])
    return T.StringType()


def _as(c: Column, have: T.DataType, want: T.DataType) -> Column:
    if have == want:
        return c
    if isinstance(have, T.StructType) and isinstance(want, T.StructType):
        fields = [
            (_as(c[f.name], have[f.name].dataType, f.dataType) if f.name in have.names else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in want.fields
        ]
        return F.when(c.isNotNull(), F.struct(*fields))
    if isinstance(have, (T.StructType, T.ArrayType, T.MapType)) and isinstance(want, T.StringType):
        return F.to_json(c)
    return c.cast(want)


def union_relaxed(*frames: DataFrame) -> DataFrame:
    """Union by name: absent columns become null, differing types are widened."""
    names = list(dict.fromkeys(c for f in frames for c in f.columns))
    wide = {n: _common([f.schema[n].dataType for f in frames if n in f.columns]) for n in names}
    aligned = [
        f.select(
            *[
                (_as(F.col(f"`{n}`"), f.schema[n].dataType, wide[n]) if n in f.columns else F.lit(None).cast(wide[n])).alias(n)
                for n in names
            ]
        )
        for f in frames
    ]
    return union_all(*aligned)


def envelopes(items: DataFrame, unit: Sequence[str], position: str, as_of, chunk: int = 1000) -> DataFrame:
    """Items packed into envelopes of at most ``chunk`` items of one unit.

    ``position`` counts a unit's items from zero. A unit of any size becomes many envelopes,
    so no task gathers more than ``chunk`` items at a time.
    """
    fields = [c for c in items.columns if c != position and c not in unit[1:]]
    # items without a position are numbered where they lie, so that they do not become one envelope
    lost = -1 - F.floor(F.monotonically_increasing_id() / chunk)
    packed = items.withColumn("_lost", lost).withColumn("_chunk", F.coalesce(F.floor(F.col(position) / chunk), F.col("_lost"))).drop("_lost")
    item = F.struct(F.col(position).alias("_p"), F.struct(*fields).alias("item"))
    grouped = packed.groupBy(*unit, "_chunk").agg(
        F.count(F.lit(1)).alias("total_items"), F.sort_array(F.collect_list(item)).alias("_items")
    )
    return grouped.select(
        *unit,
        F.date_format(F.lit(as_of).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        "total_items",
        F.transform("_items", lambda x: x["item"]).alias("items"),
    )


def land(items: DataFrame, path: str, unit: Sequence[str], position: str, as_of, chunk: int = 1000, gzip: bool = False) -> None:
    """Write items as JSON envelopes ``{network, timestamp, total_items, items}``, one folder
    per unit below the first unit column's own value. ``gzip`` packs the files, which :func:`load_json` reads alike."""
    packed = envelopes(items, unit, position, as_of, chunk)
    folders = [c for c in unit if c != unit[0]]
    # One envelope per file, as a reader of whole JSON files expects.
    writer = packed.write.mode("append").option("maxRecordsPerFile", 1)
    with shuffles_removed(items.sparkSession):
        (writer.partitionBy(*folders) if folders else writer).json(path, compression="gzip" if gzip else None)


def land_texts(texts: DataFrame, path: str, gzip: bool = False) -> None:
    """Write each text of the only column to a JSON file of its own, as it is, readable or not.

    Tasks write the files where they are to stay, so the driver handles none of them. A task that runs
    again writes the same names. ``gzip`` packs each file.
    """

    def run(rows: Iterator[Row]) -> None:
        fs, root = task_storage(path)
        fs.create_dir(root)
        task = TaskContext.get().partitionId()
        for i, row in enumerate(rows):
            text = f"{'' if row[0] is None else row[0]}\n".encode()
            # packed here: by its own guess of the name the stream would pack what is packed
            with fs.open_output_stream(f"{root}/text-{task:05d}-{i:06d}.json{'.gz' if gzip else ''}", compression=None) as file:
                file.write(compress(text, 6) if gzip else text)

    texts.foreachPartition(run)
