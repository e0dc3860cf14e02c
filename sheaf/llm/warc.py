"""WARC archives of pages, found and read through an index.

Writing. Each task appends records to archive files of its own, every record a gzip member, and returns the
index of what it wrote: file, offset, length, URL and digest of each record. Spark commits the index as a
Parquet table, and an archive counts only where the index names it. So a task that dies or runs twice
leaves a file that nobody reads, and the index never points at a record that is not there.

Reading. Rows are selected in the index, sorted by file and offset, neighbouring byte ranges are joined
into one request where the gap between them is small, and only those ranges are fetched.

Payloads. Of records with equal payloads of at least ``least_bytes`` bytes that with the largest page_id is
the ``response``, the others are ``revisit`` records, which hold no payload. Payloads are compared by SHA-1,
length and a second 64-bit hash. Only ids and hashes are shuffled to find them; a payload held by
more than a thousandth of all rows (at most 1,000 such) is matched by broadcast, any other by a join,
so no payload meets in one task. Texts are shuffled once.

Null html is an empty payload, a null URL gives no target field, a null page_id is smaller than
any other and may be referred to as null. Rows that repeat a page_id and payload are records each; one
of them is the response (of several URLs the one of the larger record id), the others revisit it. An empty table
gives an empty index. Only ``page_id``, ``url`` and ``html`` are read, so other columns cannot clash.
Pages are handled whole, one at a time. Archives lie in a folder that tasks reach through Arrow's file systems
(local or mounted folders, hdfs, s3, gs, abfs).
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sheaf.llm.common import as_batch, as_bytes, fields, parts_for, stored
from sheaf.session import scratch_dir, union_all

#: A new archive is begun beyond this many bytes.
ARCHIVE_BYTES = 256 << 20
#: Compressed bytes that one task reads, that one request fetches, and that may be skipped within it.
TASK_BYTES, REQUEST_BYTES, GAP_BYTES = 32 << 20, 8 << 20, 64 << 10
#: A payload is frequent if more than one of so many rows hold it.
FREQUENT = 1000
#: Revisits of one page that are made in one step.
COPIES = 10_000
GZIP_LEVEL = 4
#: Pages carry no time of fetching; archives need one.
DATE = "1970-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"

INDEX = fields(
    ("page_id", T.LongType()),
    ("url", T.StringType()),
    ("record_id", T.StringType()),
    ("record_type", T.StringType()),
    ("refers_to", T.LongType()),
    ("payload_bytes", T.LongType()),
    ("payload_digest", T.StringType()),
    ("file", T.StringType()),
    ("offset", T.LongType()),
    ("length", T.LongType()),
)
RECORD = fields(
    ("page_id", T.LongType()),
    ("url", T.StringType()),
    ("record_id", T.StringType()),
    ("record_type", T.StringType()),
    ("refers_to", T.LongType()),
    ("payload_bytes", T.LongType()),
    ("payload_digest", T.StringType()),
    ("payload", T.BinaryType()),
)


def storage(path: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system of a path or URI, and the path on it."""
    if "://" not in path:
        return pafs.LocalFileSystem(), path.removeprefix("file:")
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path))


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uuid(record: str) -> str:
    return f"<urn:uuid:{uuid.UUID(record)}>"


def record_bytes(page_id, url, record_id, kind, refers_to, refers_id, payload_bytes, digest, payload: bytes) -> bytes:
    """One WARC record. Fields beginning with ``X-`` are extensions that readers may pass over."""
    block = HTTP % payload_bytes + (payload if kind == "response" else b"")
    head = [("WARC-Type", kind), ("WARC-Record-ID", _uuid(record_id)), ("WARC-Date", DATE)]
    if url is not None:  # a line break in a URL must not end the field
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), url)))
    head += [("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", payload_bytes)]
    if page_id is not None:
        head.append(("X-Page-Id", page_id))
    if kind == "revisit":
        head += [("WARC-Profile", REVISIT), ("WARC-Refers-To", _uuid(refers_id))]
        if refers_to is not None:
            head.append(("X-Refers-To-Page-Id", refers_to))
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of one record. Raises if it is cut or its digest does not fit."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    found = dict(x.split(": ", 1) for x in lines)
    size = int(found["Content-Length"])
    if version != "WARC/1.1" or len(rest) != size + 4:
        raise ValueError("a record is cut or does not begin here")
    payload = rest[:size].partition(b"\r\n\r\n")[2]
    if found["WARC-Type"] == "response" and found["WARC-Payload-Digest"] != f"sha1:{digest_of(payload)}":
        raise ValueError(f"the payload of {found['WARC-Record-ID']} is damaged")
    return found, payload


def _deflated(data: bytes) -> bytes:
    packer = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _marked(pages: DataFrame) -> DataFrame:
    """Pages with the hex id of their record and of their payload."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    sums = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        "url",
        "html",
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.concat(F.sha1(payload), F.hex(F.xxhash64(payload))).alias("content"),
    )
    ident = F.to_json(F.struct("page_id", "url", "content", "payload_bytes"))
    return sums.withColumn("record", F.md5(ident.cast("binary")))


def planned_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """What is to be written: one row a record, with html for responses only."""
    marked = _marked(pages)
    names = ["record", "page_id", "url", "content", "payload_bytes"]
    rows = stored(marked.groupBy(*names).agg(F.count("*").alias("n")), "warc-rows")
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shared = rows.filter(F.col("payload_bytes") >= least_bytes).groupBy("content", F.col("payload_bytes").alias("size"))
    shared = shared.agg(F.max(F.struct("page_id", "record")).alias("first"), F.sum("n").alias("copies"))
    shared = stored(shared.filter("copies > 1").select("content", "first", "copies"), "warc-shared")
    frequent = F.broadcast(shared.filter(F.col("copies") * FREQUENT > total).drop("copies"))  # fewer than FREQUENT rows
    rare = shared.filter(F.col("copies") * FREQUENT <= total).drop("copies")
    judged = union_all(
        rows.join(frequent, "content"),
        rows.join(frequent.select("content"), "content", "left_anti").join(rare, "content", "left"),
    )
    judged = stored(judged, "warc-judged")
    leads = F.col("first").isNull() | (F.col("first.record") == F.col("record"))
    whole = marked.select("record", "html").dropDuplicates(["record"])
    single = F.col("first").isNull()
    responses = judged.filter(leads).withColumn("n", F.when(single, F.col("n")).otherwise(1)).join(whole, "record")
    # rows below least_bytes that repeat are responses each
    revisits = judged.filter(~single).withColumn("n", F.col("n") - leads.cast("long")).withColumn("html", F.lit(None).cast("string"))
    # copies are numbered in steps, so that no row grows with their count and no task holds them all
    step = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long")))
    parts = parts_for(total, 20 * COPIES, marked.sparkSession.sparkContext.defaultParallelism)
    revisits = revisits.filter("n > 0").withColumn("step", step).repartition(parts, "record", "step")
    steps = union_all(
        responses.withColumn("step", step).withColumn("record_type", F.lit("response")).withColumn("start", F.lit(0)),
        revisits.withColumn("record_type", F.lit("revisit")).withColumn("start", leads.cast("int")),
    )
    return steps.withColumn("m", F.least(F.lit(COPIES), F.col("n") - F.col("step"))).withColumn("start", F.col("start") + F.col("step"))


def write_archives(planned: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the records of :func:`planned_records` to archives in ``folder``; the index of them.

    The index has to be stored to run the tasks once; a folder's files that it does not name are left
    over from tasks that were lost.
    """
    arrow = to_arrow_schema(INDEX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = storage(folder)
        out, name, at = None, "", 0
        for batch in batches:
            columns = {n: batch.column(n).to_pylist() for n in batch.schema.names if n != "html"}
            html = as_bytes(batch.column("html"))
            rows: dict[str, list] = {n: [] for n in INDEX.names}
            for i, payload in enumerate(html):
                row = {n: c[i] for n, c in columns.items()}
                digest = base64.b32encode(bytes.fromhex(row["content"][:40])).decode()
                first = row["first"] or {}
                for copy in range(row["start"], row["start"] + row["m"]):
                    if out is None or at >= archive_bytes:
                        if out is not None:
                            out.close()
                        fs.create_dir(root, recursive=True)
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    own = row["record"] if not copy else hashlib.md5(f"{row['record']}#{copy}".encode()).hexdigest()
                    refers = first.get("page_id") if row["record_type"] == "revisit" else None
                    member = _deflated(
                        record_bytes(
                            row["page_id"], row["url"], own, row["record_type"], refers, first.get("record"),
                            row["payload_bytes"], digest, payload,
                        )
                    )
                    out.write(member)
                    found = (row["page_id"], row["url"], own, row["record_type"], refers, row["payload_bytes"], digest, name, at, len(member))
                    for n, value in zip(INDEX.names, found, strict=True):
                        rows[n].append(value)
                    at += len(member)
                    if len(rows["file"]) >= COPIES:
                        yield as_batch(rows, arrow)
                        rows = {n: [] for n in INDEX.names}
            if rows["file"]:
                yield as_batch(rows, arrow)
        if out is not None:
            out.close()

    names = ["page_id", "url", "record", "record_type", "first", "payload_bytes", "content", "html", "start", "m"]
    return planned.select(*names).mapInArrow(run, INDEX)


def write_warc(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> tuple[DataFrame, str]:
    """Write pages to archives. The stored index and the folder of the archives."""
    folder = folder or scratch_dir(pages.sparkSession, "warc")
    return stored(write_archives(planned_records(pages, least_bytes), folder), "warc-index"), folder


def _requests(files: list[str], offsets: list[int], lengths: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of index rows, sorted by file and offset, that one byte range serves."""
    start = 0
    for i in range(1, len(files) + 1):
        joined = (
            i < len(files)
            and files[i] == files[start]
            and offsets[i] - offsets[i - 1] - lengths[i - 1] <= GAP_BYTES
            and offsets[i] + lengths[i] - offsets[start] <= REQUEST_BYTES
        )
        if not joined:
            yield start, i
            start = i


def read_records(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records that rows of an index point at, read from the archives.

    ``index`` is any selection of rows. A revisit's payload is null; its length and digest are those of
    the payload it stands for. ``payloads=False`` leaves payloads out once they have been checked.
    """
    schema = RECORD if payloads else T.StructType(RECORD.fields[:-1])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = storage(folder)
        for batch in batches:
            files, offsets, lengths, urls = (batch.column(n).to_pylist() for n in ("file", "offset", "length", "url"))
            for a, z in _requests(files, offsets, lengths):
                with fs.open_input_file(f"{root}/{files[a]}") as archive:
                    archive.seek(offsets[a])
                    data = archive.read(offsets[z - 1] + lengths[z - 1] - offsets[a])
                rows: dict[str, list] = {n: [] for n in schema.names}
                for i in range(a, z):
                    at = offsets[i] - offsets[a]
                    head, payload = parse_record(zlib.decompress(data[at : at + lengths[i]], 31))
                    kind, size = head["WARC-Type"], int(head["X-Payload-Length"])
                    if kind == "response" and size != len(payload):
                        raise ValueError(f"the payload of {head['WARC-Record-ID']} is cut")
                    page, refers = head.get("X-Page-Id"), head.get("X-Refers-To-Page-Id")
                    rows["page_id"].append(None if page is None else int(page))
                    rows["url"].append(urls[i])
                    rows["record_id"].append(head["WARC-Record-ID"][10:-1].replace("-", ""))
                    rows["record_type"].append(kind)
                    rows["refers_to"].append(None if refers is None else int(refers))
                    rows["payload_bytes"].append(size)
                    rows["payload_digest"].append(head["WARC-Payload-Digest"].removeprefix("sha1:"))
                    if payloads:
                        rows["payload"].append(payload if kind == "response" else None)
                yield as_batch(rows, arrow)

    spark = index.sparkSession
    total = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    parts = parts_for(total, TASK_BYTES, spark.sparkContext.defaultParallelism)
    block = F.floor(F.col("offset") / TASK_BYTES)
    dealt = index.select("file", "offset", "length", "url").repartition(parts, "file", block)
    return dealt.sortWithinPartitions("file", "offset").mapInArrow(run, schema)
