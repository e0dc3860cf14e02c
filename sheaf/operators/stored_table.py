"""Keyed tables on shared storage, merged file by file and read through a manifest.

Layout: ``data/<write>/id_bucket=<n>/`` holds Parquet files, ``stats/<write>`` says which keys they may
hold, ``manifest/<version>.json`` names the files of each table. A write puts its files into a new
folder and then creates the next manifest; readers follow the newest one. So a write that dies
leaves the tables as they were and a reader never sees half a write. Two writers at once cannot both win:
the second finds its version taken and fails. That needs a store in which a file appears in one step
and only if it is new: HDFS and POSIX folders are such, plain object stores are not.

One manifest may name several tables, by default it names ``main``. A commit that changes two of them
shows both changes or neither.

A file's statistics are its number of rows, its smallest and largest key, and a Bloom filter in words of
64 bits, kept as Parquet rows (file, word, bits). A merge joins its keys to buckets, ranges and
words, and opens and rewrites only files that may hold one of them. Rows of a bucket are sorted by key,
so that a bucket's files hold ranges. A bucket whose files have become many and small is rewritten whole.

The bucket count belongs to the table. It is chosen by the size of the first write, kept in the
manifest, and doubled by a merge that finds buckets grown beyond :data:`BUCKET_BYTES`. A batch is cast to
the table's types before anything is hashed; a value that the cast would change is refused.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence
from contextlib import nullcontext
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.operators.merge import last_per_key, upsert
from sheaf.session import folder_bytes, list_names, path_exists, read_text, remove_path, staged, write_new_text

BUCKET = "id_bucket"
MAIN = "main"
#: Bytes of Parquet that a bucket is meant to hold.
BUCKET_BYTES = 256 << 20
#: Rows that a file holds at most, and files beyond which a bucket of few rows is put together.
FILE_ROWS, LOOSE_FILES = 1 << 18, 8
#: Keys to a word of a Bloom filter, and bits that each key sets in its word.
WORD_KEYS, KEY_BITS = 4, 4
#: Keys of a batch, about, by which it is told which files very many of its keys fall to.
PROBED = 1 << 20

BLOOM = "file string, word int, bits long, rows long"


class DuplicateKeys(ValueError):
    """A batch repeats a key, or appends one that the table has."""


class LossyCast(ValueError):
    """A batch holds a value that the table's type cannot hold."""


class DamagedSnapshot(ValueError):
    """A version's files do not hold what its manifest or the caller's check expects."""


@dataclass
class StoredFile:
    path: str
    rows: int
    low: int | str | None
    high: int | str | None
    stats: str  # folder of its Bloom filter
    words: int


@dataclass
class Table:
    key: str
    buckets: int
    schema: dict
    files: dict[str, list[StoredFile]] = field(default_factory=dict)  # by bucket

    @property
    def struct(self) -> T.StructType:
        return T.StructType.fromJson(self.schema)

    def listed(self, buckets: Iterable[int] | None = None) -> list[StoredFile]:
        wanted = self.files if buckets is None else map(str, buckets)
        return [f for b in wanted for f in self.files.get(b, [])]


@dataclass
class Manifest:
    version: int
    tables: dict[str, Table] = field(default_factory=dict)

    @property
    def main(self) -> Table:
        return self.tables[MAIN]


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _word(key: Column, words: int | Column) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(1)), F.lit(words) if isinstance(words, int) else words).cast("int")


def _bits(key: Column) -> Column:
    """The bits of a key within its word, six bits of a hash for each."""
    h = F.xxhash64(key, F.lit(2))
    one = F.lit(1).cast("long")
    mask = F.lit(0).cast("long")
    for i in range(KEY_BITS):
        place = F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", one, place))
    return mask


def versions(spark: SparkSession, path: str) -> list[int]:
    """Versions that can be read, oldest first."""
    if not path_exists(spark, f"{path}/manifest/*.json"):
        return []
    return [int(n.removesuffix(".json")) for n in list_names(spark, f"{path}/manifest") if n.endswith(".json")]


def manifest_of(spark: SparkSession, path: str, version: int) -> Manifest:
    held = json.loads(read_text(spark, f"{path}/manifest/{version:012d}.json"))
    tables = {
        name: Table(t["key"], t["buckets"], t["schema"], {b: [StoredFile(**f) for f in files] for b, files in t["files"].items()})
        for name, t in held["tables"].items()
    }
    return Manifest(held["version"], tables)


def current(spark: SparkSession, path: str) -> Manifest | None:
    """The newest manifest, or none where there is no table."""
    known = versions(spark, path)
    return manifest_of(spark, path, known[-1]) if known else None


def switch(spark: SparkSession, path: str, manifest: Manifest) -> None:
    """Make a manifest the newest. Fails if its version exists already."""
    write_new_text(spark, f"{path}/manifest/{manifest.version:012d}.json", json.dumps(asdict(manifest)))


def _read(spark: SparkSession, path: str, files: Iterable[StoredFile], schema: T.StructType) -> DataFrame:
    paths = [f"{path}/{f.path}" for f in files]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_table(spark: SparkSession, path: str, name: str = MAIN, version: int | None = None) -> DataFrame:
    """A table as the newest manifest has it, or as it was in an older ``version`` that is still kept."""
    if version is not None and version not in versions(spark, path):
        raise ValueError(f"no version {version} at {path}")
    manifest = current(spark, path) if version is None else manifest_of(spark, path, version)
    if manifest is None or name not in manifest.tables:
        raise ValueError(f"no table {name} at {path}")
    table = manifest.tables[name]
    return _read(spark, path, table.listed(), table.struct)


def _write(df: DataFrame, path: str, key: str, buckets: int) -> dict[str, list[StoredFile]]:
    """Put rows into a new folder, sorted by key within each bucket; the files of each bucket with their
    statistics. The rebalance hint gathers each bucket and lets Spark split one that outgrows the
    advisory partition size."""
    spark, write = df.sparkSession, uuid.uuid4().hex
    folder, stats = f"data/{write}", f"stats/{write}"
    rows = df.withColumn(BUCKET, bucket_of(key, buckets)).hint("rebalance", F.col(BUCKET)).sortWithinPartitions(BUCKET, key)
    rows.write.partitionBy(BUCKET).option("maxRecordsPerFile", FILE_ROWS).parquet(f"{path}/{folder}")
    if not any(n.startswith(f"{BUCKET}=") for n in list_names(spark, f"{path}/{folder}")):
        return {}
    words = max(1, FILE_ROWS // WORD_KEYS)
    kind = df.schema[key].dataType
    ranged = _ranged(kind)
    written = spark.read.schema(T.StructType([df.schema[key], T.StructField(BUCKET, T.IntegerType())])).parquet(f"{path}/{folder}")
    place = F.concat(F.lit(f"{folder}/{BUCKET}="), F.col(BUCKET).cast("string"), F.lit("/"), F.col("_metadata.file_name"))
    keys = written.select(F.col(key).alias("key"), BUCKET, place.alias("file"))
    keys.groupBy("file", BUCKET, _word(F.col("key"), words).alias("word")).agg(
        F.bit_or(_bits(F.col("key"))).alias("bits"), F.count("*").alias("rows"), F.min("key").alias("low"), F.max("key").alias("high")
    ).sortWithinPartitions("file", "word").write.parquet(f"{path}/{stats}")
    sums = spark.read.parquet(f"{path}/{stats}").groupBy("file", BUCKET)
    found: dict[str, list[StoredFile]] = {}
    for r in sums.agg(F.sum("rows").alias("rows"), F.min("low").alias("low"), F.max("high").alias("high")).collect():
        low, high = (r.low, r.high) if ranged else (None, None)
        found.setdefault(str(r[BUCKET]), []).append(StoredFile(r.file, r.rows, low, high, stats, words))
    return {b: sorted(files, key=lambda f: f.path) for b, files in found.items()}


def _ranged(kind: T.DataType) -> bool:
    return isinstance(kind, T.IntegralType | T.StringType)


def _listing(spark: SparkSession, kind: T.DataType, rows: list[tuple]) -> DataFrame:
    """Files to be asked: bucket, path, smallest and largest key if the key's type has them, words."""
    if not _ranged(kind):
        return spark.createDataFrame([(b, p, w) for b, p, _, _, w in rows], f"{BUCKET} int, file string, words int")
    return spark.createDataFrame(
        rows,
        T.StructType(
            [T.StructField(BUCKET, T.IntegerType()), T.StructField("file", T.StringType())]
            + [T.StructField(n, kind) for n in ("low", "high")]
            + [T.StructField("words", T.IntegerType())]
        ),
    )


def _inside(kind: T.DataType) -> Column:
    return F.col("_key").between(F.col("low"), F.col("high")) if _ranged(kind) else F.lit(True)


def holding(spark: SparkSession, path: str, table: Table, keys: DataFrame) -> set[str]:
    """Paths of the files that may hold one of the keys, by bucket, key range and Bloom filter.

    A file that more keys fall to than a file has rows, judged by a share of the keys, counts as one without its
    filter being asked: so many keys would meet a false hit, and keys times files would grow with the square
    of the table. For the others, no more than a file's rows are asked of each.
    """
    files = table.listed()
    if not files:
        return set()
    kind = table.struct[table.key].dataType
    rows = [(int(b), f.path, f.low, f.high, f.words) for b, held in table.files.items() for f in held]
    probes = keys.select(F.col(table.key).alias("_key"), bucket_of(table.key, table.buckets).alias(BUCKET))
    sure: set[str] = set()
    if (many := keys.count()) > FILE_ROWS:  # fewer cannot fall to one file in such numbers
        share = max(1, many // PROBED)
        few = probes.filter(F.pmod(F.xxhash64("_key", F.lit(3)), F.lit(share)) == 0)
        counts = few.join(F.broadcast(_listing(spark, kind, rows)), BUCKET).filter(_inside(kind)).groupBy("file").count()
        sure = {r.file for r in counts.filter(F.col("count") * share > FILE_ROWS).collect()}
        rows = [r for r in rows if r[1] not in sure]
        if not rows:
            return sure
    near = probes.join(F.broadcast(_listing(spark, kind, rows)), BUCKET).filter(_inside(kind))
    asked = near.select("file", _word(F.col("_key"), F.col("words")).alias("word"), _bits(F.col("_key")).alias("mask"))
    blooms = spark.read.schema(BLOOM).parquet(*sorted({f"{path}/{f.stats}" for f in files if f.path not in sure}))
    hit = asked.join(blooms, ["file", "word"]).filter(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"))
    return sure | {r.file for r in hit.select("file").distinct().collect()}


def _checked(table: Table | None, key: str, buckets: int | None) -> None:
    if table and buckets is not None and buckets != table.buckets:
        raise ValueError(f"the table has {table.buckets} buckets, not {buckets}")
    if table and key != table.key:
        raise ValueError(f"the table's key is {table.key}, not {key}")


def conformed(batch: DataFrame, schema: T.StructType) -> DataFrame:
    """A batch in a table's columns and types. A value that does not come back from the cast as it was
    is an error; nothing is rounded, wrapped or lost."""
    batch = batch.select(*schema.names)
    cast, changed = [], []
    for f in schema:
        old = batch.schema[f.name].dataType
        if old.simpleString() == f.dataType.simpleString() or isinstance(old, T.NullType):  # but for nullability
            cast.append(F.col(f.name).cast(f.dataType) if isinstance(old, T.NullType) else F.col(f.name))
            continue
        there = F.col(f.name).try_cast(f.dataType)
        cast.append(there.alias(f.name))
        changed.append(~there.try_cast(old).eqNullSafe(F.col(f.name)))
    if changed:
        lost = changed[0]
        for c in changed[1:]:
            lost = lost | c
        if not batch.filter(lost).isEmpty():
            raise LossyCast("the batch holds values that the table's types cannot hold")
    return batch.select(*cast)


def _repeats(batch: DataFrame, key: str) -> bool:
    return not batch.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").isEmpty()


def _fitting(size: int, buckets: int = 1) -> int:
    while buckets * BUCKET_BYTES < size:
        buckets *= 2
    return buckets


def _loose(files: list[StoredFile]) -> bool:
    return len(files) > LOOSE_FILES + 2 * (sum(f.rows for f in files) // FILE_ROWS)


def _replaced(table: Table, gone: set[str], new: dict[str, list[StoredFile]]) -> Table:
    files = {b: [f for f in held if f.path not in gone] for b, held in table.files.items()}
    for b, added in new.items():
        files[b] = files.get(b, []) + added
    return replace(table, files={b: f for b, f in files.items() if f})


def _touched(spark: SparkSession, path: str, table: Table, keys: DataFrame) -> set[str]:
    """Files to rewrite for these keys, with the rest of a bucket that has become loose."""
    gone = holding(spark, path, table, keys)
    for files in table.files.values():
        if _loose(files) and any(f.path in gone for f in files):
            gone |= {f.path for f in files}
    return gone


def merge_table(
    spark: SparkSession,
    path: str,
    source: DataFrame,
    key: str = "id",
    keep: Sequence[str] = ("created_at",),
    buckets: int | None = None,
    order: Sequence[str] = (),
    name: str = MAIN,
    stored: bool = False,
) -> Manifest:
    """Upsert a batch into the table at ``path``, which is made if there is none.

    ``order`` names columns by which the last of several rows of a key is taken (they need not be
    columns of the table); without it a repeated key is an error. ``buckets`` fixes the count of a
    new table; given for an existing one it must be the table's own. The batch is read once, into
    the shared scratch folder, or where it lies if it is ``stored`` in files already; only files that may hold one of its keys are read and written. Merging the
    same batch again changes nothing. Rows without a key are left out.
    """
    manifest = current(spark, path) or Manifest(-1)
    table = manifest.tables.get(name)
    _checked(table, key, buckets)
    source = source.filter(F.col(key).isNotNull())
    if order:
        source = last_per_key(source, key, order)
    if table is not None:
        source = source.select(*table.struct.names)
    elif order:
        source = source.drop(*order)
    with nullcontext(source) if stored else staged(spark, source, "batch") as batch:
        if table is not None:
            batch = conformed(batch, table.struct)
        if not order and _repeats(batch, key):
            raise DuplicateKeys("the batch repeats a key; name the columns that order its rows")
        if table is None:
            n = buckets or _fitting(folder_bytes(spark, batch.inputFiles()))
            table = Table(key, n, batch.schema.jsonValue(), _write(batch, path, key, n))
        else:
            files = table.listed()
            held = folder_bytes(spark, sorted({f"{path}/{f.path.rsplit('/', 1)[0]}" for f in files}))
            n = table.buckets if buckets else _fitting(held, table.buckets)
            grown = n != table.buckets  # then every bucket is dealt anew
            gone = {f.path for f in files} if grown else _touched(spark, path, table, batch)
            old = _read(spark, path, [f for f in files if f.path in gone], table.struct)
            new = _write(upsert(old, batch, key, keep), path, key, n)
            table = replace(_replaced(table, gone, new), buckets=n)
        manifest = Manifest(manifest.version + 1, manifest.tables | {name: table})
        switch(spark, path, manifest)
    return manifest


def append_table(
    spark: SparkSession, path: str, rows: DataFrame, key: str = "id", buckets: int | None = None, name: str = MAIN
) -> Manifest:
    """Add rows with new keys, the status defaulting to ``pending``. A key that repeats or that the
    table has is an error, and then nothing is added. No stored row is rewritten, and only files that
    may hold one of the keys are looked into."""
    status = F.coalesce("status", F.lit("pending")) if "status" in rows.columns else F.lit("pending")
    return _append(spark, path, rows.withColumn("status", status), key, buckets, name, skip_known=False)


def append_missing(
    spark: SparkSession, path: str, rows: DataFrame, key: str = "id", buckets: int | None = None, name: str = MAIN
) -> Manifest:
    """Add the rows whose keys the table does not have; stored rows stay as they are. A key that repeats
    among ``rows`` is an error, rows without a key are left out. Adding the same rows again changes nothing."""
    return _append(spark, path, rows.filter(F.col(key).isNotNull()), key, buckets, name, skip_known=True)


def _append(
    spark: SparkSession, path: str, rows: DataFrame, key: str, buckets: int | None, name: str, skip_known: bool
) -> Manifest:
    manifest = current(spark, path) or Manifest(-1)
    table = manifest.tables.get(name)
    _checked(table, key, buckets)
    if table is not None:
        rows = rows.select(*table.struct.names)
    with staged(spark, rows, "appended") as batch:
        if skip_known and table is not None and batch.isEmpty():
            return manifest
        if not batch.filter(F.col(key).isNull()).isEmpty():
            raise DuplicateKeys("a row has no key")
        if table is not None:
            batch = conformed(batch, table.struct)
        taken = _repeats(batch, key)
        if table is not None and not taken:
            hit = holding(spark, path, table, batch)
            old = _read(spark, path, [f for f in table.listed() if f.path in hit], table.struct).select(key)
            if skip_known:
                batch = batch.join(old, key, "left_anti").select(*table.struct.names)
            else:
                taken = not old.join(batch.select(key), key, "left_semi").isEmpty()
        if taken:
            raise DuplicateKeys("duplicate key")
        if table is None:
            n = buckets or _fitting(folder_bytes(spark, batch.inputFiles()))
            table = Table(key, n, batch.schema.jsonValue())
        table = _replaced(table, set(), _write(batch, path, key, table.buckets))
        manifest = Manifest(manifest.version + 1, manifest.tables | {name: table})
        switch(spark, path, manifest)
    return manifest


def delete_keys(spark: SparkSession, path: str, keys: DataFrame, tables: Mapping[str, str] | None = None) -> Manifest:
    """Delete rows by key from one or several tables of a manifest, in one commit.

    ``keys`` has one column. ``tables`` maps a table to the column of it that holds the key, by default every
    table to its own key; a table whose column is not its key is read whole. A reader sees all
    deletions or none. Keys that no table has, repeated and null keys change nothing.
    """
    manifest = current(spark, path)
    if manifest is None:
        raise ValueError(f"no table at {path}")
    columns = dict(tables) if tables is not None else {n: t.key for n, t in manifest.tables.items()}
    if unknown := columns.keys() - manifest.tables.keys():
        raise ValueError(f"no table {sorted(unknown)} at {path}")
    column = keys.columns[0]
    changed = {}
    with staged(spark, keys.filter(F.col(column).isNotNull()).select(column).distinct(), "deleted") as dead:
        for name, own in columns.items():
            table = manifest.tables[name]
            mine = conformed(dead.withColumnRenamed(column, own), T.StructType([table.struct[own]]))
            gone = _touched(spark, path, table, mine) if own == table.key else {f.path for f in table.listed()}
            old = _read(spark, path, [f for f in table.listed() if f.path in gone], table.struct)
            new = _write(old.join(mine, own, "left_anti").select(*table.struct.names), path, table.key, table.buckets) if gone else {}
            changed[name] = _replaced(table, gone, new)
        manifest = Manifest(manifest.version + 1, manifest.tables | changed)
        switch(spark, path, manifest)
    return manifest


def restore(spark: SparkSession, path: str, version: int, check: Callable[[dict[str, DataFrame]], bool] | None = None) -> Manifest:
    """Make an older version the newest one, as a new manifest over the old files.

    Before the switch every file is read: its rows must be as many as were written. ``check`` is given all
    tables of the version and says whether they may come back. If either fails, nothing changes and
    :class:`DamagedSnapshot` is raised; the version stays as it is.
    """
    newest = current(spark, path)
    if version not in versions(spark, path):
        raise ValueError(f"no version {version} at {path}")
    old = manifest_of(spark, path, version)
    frames = {}
    for name, table in old.tables.items():
        files = table.listed()
        frames[name] = _read(spark, path, files, table.struct)
        try:
            found = frames[name].agg(F.count("*"), F.count(table.key)).first()
        except Exception as e:
            raise DamagedSnapshot(f"a file of {name} cannot be read") from e
        if tuple(found) != (sum(f.rows for f in files),) * 2:
            raise DamagedSnapshot(f"{name} holds {found[0]} rows, not {sum(f.rows for f in files)}")
    if check is not None and not check(frames):
        raise DamagedSnapshot(f"version {version} has not passed the check")
    manifest = Manifest(newest.version + 1, old.tables)
    switch(spark, path, manifest)
    return manifest


def vectors_fit(column: str, dimensions: int) -> Callable[[DataFrame], bool]:
    """A check for :func:`restore`: every vector has the length, and numbers only."""

    def fits(df: DataFrame) -> bool:
        bad = F.exists(column, lambda x: x.isNull() | F.isnan(x)) | (F.size(column) != dimensions)
        return df.filter(F.coalesce(bad, F.lit(True))).isEmpty()

    return fits


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Drop manifests but the ``keep`` newest, and files that none of those names. Not to be run while
    others read an older version or write. Returns how many folders and files went."""
    known = versions(spark, path)
    if not known:
        return 0
    held = [manifest_of(spark, path, v) for v in known[-max(1, keep) :]]
    files = [f for m in held for t in m.tables.values() for f in t.listed()]
    named = {f.path for f in files}
    folders = {f.path.rsplit("/", 1)[0] for f in files}
    used = {f.stats for f in files}
    gone = 0
    for write in list_names(spark, f"{path}/data"):
        for bucket in list_names(spark, f"{path}/data/{write}"):
            folder = f"data/{write}/{bucket}"
            if not bucket.startswith(f"{BUCKET}="):
                continue
            lost = [folder] if folder not in folders else [f"{folder}/{n}" for n in list_names(spark, f"{path}/{folder}")]
            for one in lost:
                if one == folder or one.endswith(".parquet") and one not in named:
                    remove_path(spark, f"{path}/{one}")
                    gone += 1
    for write in list_names(spark, f"{path}/stats"):
        if f"stats/{write}" not in used:
            remove_path(spark, f"{path}/stats/{write}")
    for version in known[: -max(1, keep)]:
        remove_path(spark, f"{path}/manifest/{version:012d}.json")
    return gone

