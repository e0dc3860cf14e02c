"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", app: str = "sheaf", conf: dict | None = None) -> SparkSession:
    """A local session for tests and benchmarks. On a cluster, use the session it gives."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in (conf or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder name under the cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` is read from the session. Only a local session without it, as in
    tests, uses a folder of this machine; on a cluster that would scatter the rows over machines.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="sheaf-")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _blocks:
        _blocks[-1].append(path)
    return path


#: Folders named within each open :func:`scratch` block, innermost last.
_blocks: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes, at its end, every scratch folder that was named within. Results that are still to be read
    from such folders have to be written before: ``with scratch(spark): answers.write.parquet(path)``."""
    _blocks.append([])
    try:
        yield
    finally:
        for path in _blocks.pop():
            remove_path(spark, path)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of a frame, written once to the shared scratch folder and read back. What follows neither
    repeats their work nor carries their plan. :func:`scratch` clears the folder."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def staged(spark: SparkSession, df: DataFrame, name: str) -> Iterator[DataFrame]:
    """The rows of a frame, written once to the shared scratch folder, which is removed after use."""
    path = scratch_dir(spark, f"staged-{name}")
    try:
        df.write.parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        remove_path(spark, path)


#: Spark removes the shuffle files of a write or an action when it has ended, not when the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within, each write or action leaves no shuffle files. For steps that are run once each and read what the
    step before has written: a frame that is run again shuffles again."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def task_storage(path: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system of a path or URI, and the path on it: for tasks that read shared files. Knows
    local and mounted folders, hdfs, s3, gs and abfs."""
    if "://" not in path:
        return pafs.LocalFileSystem(), path.removeprefix("file:")
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path))


def path_exists(spark: SparkSession, path: str) -> bool:
    """True if a path or glob matches anything on the file system it belongs to."""
    return bool(_matches(spark, path)[1])


def holds_files(spark: SparkSession, path: str, suffixes: Sequence[str]) -> bool:
    """True if a file, folder or glob holds a file with one of the suffixes, at any depth."""
    fs, found = _matches(spark, path)
    endings = "{" + ",".join(suffixes) + "}"
    for status in found:
        if status.isFile():
            if status.getPath().getName().endswith(tuple(suffixes)):
                return True
            continue
        # by patterns, one level after the other: the store's own listing, not a call for each file
        level = re.sub(r"([\\{}\[\]*?])", r"\\\1", status.getPath().toString())
        while fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{level}/*")):
            files = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{level}/*{endings}"))
            if any(f.isFile() for f in files or ()):
                return True
            level += "/*"
    return False


def _matches(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, list(fs.globStatus(hadoop_path) or [])


def _file(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def list_names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none if it does not exist."""
    fs, path = _file(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def remove_path(spark: SparkSession, path: str) -> None:
    fs, hadoop_path = _file(spark, path)
    fs.delete(hadoop_path, True)


def rename_path(spark: SparkSession, old: str, new: str) -> None:
    fs, source = _file(spark, old)
    if not fs.rename(source, _file(spark, new)[1]):
        raise OSError(f"cannot rename {old}")


def folder_bytes(spark: SparkSession, paths: Sequence[str]) -> int:
    """Bytes of files or folders."""
    total = 0
    for path in paths:
        fs, hadoop_path = _file(spark, path)
        total += fs.getContentSummary(hadoop_path).getLength()
    return total


def read_text(spark: SparkSession, path: str) -> str:
    fs, hadoop_path = _file(spark, path)
    stream = fs.open(hadoop_path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_new_text(spark: SparkSession, path: str, text: str) -> None:
    """Create a small file in one step; an error if it exists. A reader sees all of it or nothing:
    it is written beside its place and then linked (on a POSIX folder) or renamed, both of which refuse a
    place that is taken. HDFS renames so; a store whose rename replaces or copies gives no such promise."""
    fs, hadoop_path = _file(spark, path)
    temporary = spark._jvm.org.apache.hadoop.fs.Path(f"{hadoop_path.getParent().getParent()}/.{uuid.uuid4().hex}")
    stream = fs.create(temporary, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    fs.mkdirs(hadoop_path.getParent())
    try:
        if fs.getUri().getScheme() == "file":
            os.link(temporary.toUri().getPath(), hadoop_path.toUri().getPath())
        elif fs.exists(hadoop_path) or not fs.rename(temporary, hadoop_path):
            raise FileExistsError(path)
    finally:
        fs.delete(temporary, False)


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings that results depend on; all can be changed while a session runs.

    Times are read and shown in UTC. Spark 4.1 takes over the partitioning of a union's inputs
    and then leaves out shuffles above it; on 4.1.2 this loses rows of later joins and
    aggregations, so it is switched off.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark


def union_all(*frames: DataFrame, allow_missing: bool = False) -> DataFrame:
    """Union by column name. Refuses a session without the setting that :func:`prepare` makes,
    as joins and aggregations above a union could then lose rows."""
    out = frames[0]
    if out.sparkSession.conf.get("spark.sql.unionOutputPartitioning", "true") != "false":
        raise ValueError("call sheaf.session.prepare(spark) first: spark.sql.unionOutputPartitioning must be false")
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=allow_missing)
    return out


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Deal rows out to a number of partitions, for costly work on an input of few splits. Without a
    number the rows stay where they are."""
    return df.repartition(partitions) if partitions else df


def at_most(df: DataFrame, rows: int) -> bool:
    """True if the frame has no more than ``rows`` rows. Reads no further than it must."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if(df: DataFrame, proven: bool) -> DataFrame:
    """Broadcast a side whose size has been proven small; otherwise leave the join to Spark."""
    return F.broadcast(df) if proven else df
