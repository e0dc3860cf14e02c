"""Upserts, stored merges, constraint splits and whole loads."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.operators import merge as M
from sheaf.operators import stored_table as ST
from sheaf.operators.filters import split_valid
from sheaf.plans.ingest import normalize, refresh_texts, run_load
from sheaf.schema import ENVELOPE_SCHEMA
from sheaf.session import scratch_dir
from sheaf.sources import files as S
from sheaf.streaming.events import run_events
from sheaf.streaming.incremental import run_incremental
from workload import bindings as B
from workload.registry import query
from workload.tables import HASHED_SQL, checksum, plain_times, raw_orders


def _settled(spark, sf_dir):
    return B.orders_records(spark, sf_dir).filter(F.col("status") != "P").drop("custkey")


def _shipped(spark, sf_dir):
    """What line items say about their orders: new amounts, a later time."""
    lines = B.table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_orderkey").alias("id")).agg(
        F.lit("shipped").alias("type"),
        F.max("l_linestatus").alias("status"),
        F.count(F.lit(1)).cast("double").alias("amount_numeric"),
        F.max("l_shipdate").alias("created_at"),
    )


_UPSERTED = """
  WITH t AS (SELECT * FROM orders WHERE o_orderstatus <> 'P'),
  s AS (SELECT l_orderkey, max(l_linestatus) AS status, count(*)::DOUBLE AS amount, max(l_shipdate) AS created FROM lineitem GROUP BY 1)
  SELECT coalesce(o_orderkey, l_orderkey) AS id, CASE WHEN l_orderkey IS NULL THEN o_orderpriority ELSE 'shipped' END AS type,
    CASE WHEN l_orderkey IS NULL THEN o_orderstatus ELSE status END AS status,
    CASE WHEN l_orderkey IS NULL THEN o_totalprice ELSE amount END AS amount_numeric, coalesce(o_orderdate, created) AS created_at
  FROM t FULL JOIN s ON o_orderkey = l_orderkey"""


@query("upsert", _UPSERTED)
def upsert(spark, sf_dir):
    return M.upsert(_settled(spark, sf_dir), _shipped(spark, sf_dir))


@query("stored_merge", _UPSERTED)
def stored_merge(spark, sf_dir):
    """The same upsert into a table on disk, of which only touched buckets are rewritten."""
    path = scratch_dir(spark, "merged")
    ST.merge_table(spark, path, _settled(spark, sf_dir), buckets=16)
    for _ in range(2):
        ST.merge_table(spark, path, _shipped(spark, sf_dir))
    return ST.read_table(spark, path)


def _narrow(df):
    """The batch as another system may give it: a narrower key, a wider amount."""
    return df.withColumn("id", F.col("id").cast("int")).withColumn("amount_numeric", F.col("amount_numeric").cast("decimal(20,4)"))


@query("stored_merge_narrow", _UPSERTED)
def stored_merge_narrow(spark, sf_dir):
    """The upsert with a batch whose key and amount have other types than the table's."""
    path = scratch_dir(spark, "merged-narrow")
    ST.merge_table(spark, path, _settled(spark, sf_dir), buckets=16)
    ST.merge_table(spark, path, _narrow(_shipped(spark, sf_dir)))
    return ST.read_table(spark, path)


def _records_and_vectors(spark, sf_dir, path):
    docs = B.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", F.md5("text").alias("text"))
    ST.merge_table(spark, path, docs, "id", (), 8, name="records")
    ST.merge_table(spark, path, B.document_embeddings(spark, sf_dir), "proposal_id", (), 4, name="vectors")


@query(
    "cascading_delete",
    """SELECT coalesce(doc_id, vec_id) AS id, lang, md5(text) AS text, embedding[1]::DOUBLE AS first FROM documents FULL JOIN embeddings ON doc_id = vec_id
    WHERE lang IS DISTINCT FROM 'de'""",
)
def cascading_delete(spark, sf_dir):
    """Records and vectors in one manifest; German records go together with their vectors."""
    path = scratch_dir(spark, "cascade")
    _records_and_vectors(spark, sf_dir, path)
    ST.delete_keys(spark, path, B.table(spark, sf_dir, "documents").filter("lang = 'de'").select("doc_id"))
    vectors = ST.read_table(spark, path, "vectors").select(
        F.col("proposal_id").alias("id"), F.element_at("embedding", 1).cast("double").alias("first")
    )
    left = ST.read_table(spark, path, "records").join(vectors, "id", "full")  # a vector without a record would show
    return left.select("id", "lang", "text", "first")


@query(
    "restored_version",
    """SELECT doc_id AS id, md5(text) AS text, embedding[1]::DOUBLE AS first, len(embedding)::INTEGER AS n, 'refused' AS cut
    FROM documents LEFT JOIN embeddings ON doc_id = vec_id""",
)
def restored_version(spark, sf_dir):
    """Vectors cut by a bad merge: that version is refused, the one before it is checked and restored."""
    path = scratch_dir(spark, "restored")
    _records_and_vectors(spark, sf_dir, path)
    good = ST.current(spark, path).version
    vectors = B.document_embeddings(spark, sf_dir)
    size = vectors.agg(F.max(F.size("embedding"))).first()[0]
    cut = vectors.withColumn("embedding", F.slice("embedding", 1, 3))
    bad = ST.merge_table(spark, path, cut, "proposal_id", (), name="vectors").version
    fits = ST.vectors_fit("embedding", size)
    try:
        ST.restore(spark, path, bad, lambda t: fits(t["vectors"]))
        verdict = "taken"
    except ST.DamagedSnapshot:
        verdict = "refused"
    ST.restore(spark, path, good, lambda t: fits(t["vectors"]))
    back = ST.read_table(spark, path, "vectors").select(
        F.col("proposal_id").alias("id"),
        F.element_at("embedding", 1).cast("double").alias("first"),
        F.size("embedding").alias("n"),
    )
    return ST.read_table(spark, path, "records").join(back, "id", "left").select("id", "text", "first", "n", F.lit(verdict).alias("cut"))


@query(
    "append_new",
    "SELECT o_orderkey AS id, CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN 'pending' ELSE o_orderstatus END AS status FROM orders",
)
def append_new(spark, sf_dir):
    """Open orders appended to a stored table of the others."""
    path = scratch_dir(spark, "appended")
    ST.append_table(spark, path, _settled(spark, sf_dir), buckets=4)
    fresh = B.orders_records(spark, sf_dir).filter(F.col("status") == "P")
    fresh = fresh.withColumn("status", F.when(F.col("type") != "5-LOW", F.col("status")))
    ST.append_table(spark, path, M.append_new(fresh, ST.read_table(spark, path)))
    return ST.read_table(spark, path).select("id", "status")


@query(
    "fill_missing",
    "SELECT page_id AS id, CASE WHEN t = '' THEN url ELSE t END AS doc_text FROM (SELECT *, regexp_extract(html, '<h2>([^<]*)</h2>', 1) AS t FROM pages)",
)
def fill_missing(spark, sf_dir):
    pages = B.table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("id"), "url", F.regexp_extract("html", "<h2>([^<]*)</h2>", 1).alias("doc_text")
    )
    return M.fill_missing(pages, "doc_text", F.col("url")).select("id", "doc_text")


@query(
    "constraint_split",
    """SELECT doc_id AS id, CASE WHEN lang NOT IN ('en', 'fr') THEN 'network not allowed' WHEN quality IS NULL THEN 'created_at is null' END AS reason
    FROM documents LEFT JOIN labels USING (doc_id)""",
)
def constraint_split(spark, sf_dir):
    labels = B.table(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = B.table(spark, sf_dir, "documents").join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.col("lang").alias("network"),
        F.col("source").alias("type"),
        F.when(F.col("quality").isNotNull(), F.lit(B.AS_OF)).alias("created_at"),
    )
    ok, refused = split_valid(docs, ["en", "fr"])
    return B.union_all(ok.withColumn("reason", F.lit(None).cast("string")), refused).select("id", "reason")


@query(
    "rejected_loads",
    "SELECT 'network not allowed' AS reason, count(*) AS n FROM orders WHERE o_orderstatus = 'O'",
)
def rejected_loads(spark, sf_dir):
    rows = normalize(raw_orders(spark, sf_dir), B.AS_OF)
    return split_valid(rows, ["polkadot"])[1].groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def _landed(spark, sf_dir):
    path = scratch_dir(spark, "inbox")
    docs = B.table(spark, sf_dir, "documents").select(
        F.col("lang").alias("network"),
        F.col("source").alias("type"),
        F.col("doc_id").cast("string").alias("id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("content"),
        F.col("n_chars").cast("string").alias("amount"),
        F.col("doc_id").alias("position"),
    )
    S.land(docs.withColumn("unit", F.col("network")), path, ["network", "unit"], "position", B.AS_OF, chunk=200)
    return path


_BLANK = "chr(9)||chr(10)||chr(13)||' '"
_LOADED = f"""
  d AS (SELECT doc_id::VARCHAR AS id, lang, source, n_chars, trim(split_part(text, chr(10), 1), {_BLANK}) AS title, trim(text, {_BLANK}) AS description FROM documents),
  x AS (SELECT id, trim(concat_ws(chr(10), CASE WHEN title <> '' THEN 'Title: ' || title END, 'Network: ' || lang, 'Type: ' || source,
      CASE WHEN description <> '' THEN 'Description: ' || (CASE WHEN length(description) > 2000 THEN substring(description, 1, 2000) || '...' ELSE description END) END), {_BLANK}) AS text FROM d)"""
_WHOLE = (
    "WITH "
    + _LOADED
    + ","
    + HASHED_SQL.replace("{texts}", "SELECT id, text FROM x")
    + r""",
  c AS (SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(concat_ws(' ', nullif(title, ''), nullif(description, '')),
      '[\x00-\x1f\x7f-\x{9f}]', ' ', 'g'), '[\s\x{a0}]+', ' ', 'g'), '[^\p{L}\p{N}_\s]', ' ', 'g')) AS t FROM d)
  SELECT d.id, lang AS network, source AS type, n_chars::DOUBLE AS amount_numeric, 'pending' AS status, TIMESTAMP '2025-01-01' AS created_at,
    length(description)::INTEGER AS n, md5(title) AS title, round(checksum, 3) AS vector, md5(substring(t, 1, 1000)) AS doc_text
  FROM d JOIN c USING (id) LEFT JOIN h USING (id)"""
)


def _shown(records, vectors):
    v = vectors.select(F.col("proposal_id").alias("_id"), F.round(checksum("embedding"), 3).alias("vector"))
    rows = records.join(v, F.col("id") == F.col("_id"), "left").select(
        "id", "network", "type", "amount_numeric", "status", "created_at", F.length("description").alias("n"),
        F.md5("title").alias("title"), "vector", F.md5("doc_text").alias("doc_text"),
    )
    return plain_times(rows)


@query("whole_load", _WHOLE)
def whole_load(spark, sf_dir):
    """Landed files to the stored record and embedding tables."""
    inbox, records, vectors = _landed(spark, sf_dir), scratch_dir(spark, "records"), scratch_dir(spark, "vectors")
    langs = ["en", "fr", "de", "es"]
    run_load(spark, [f"{inbox}/*"], records, vectors, B.AS_OF, ENVELOPE_SCHEMA, networks=langs, buckets=8)
    return _shown(ST.read_table(spark, records), ST.read_table(spark, vectors))


@query("incremental_load", _WHOLE)
def incremental_load(spark, sf_dir):
    """The same load as a file stream, run twice; the second run finds nothing new."""
    inbox, records, vectors = _landed(spark, sf_dir), scratch_dir(spark, "records"), scratch_dir(spark, "vectors")
    checkpoint = scratch_dir(spark, "stream")
    langs = ["en", "fr", "de", "es"]
    for _ in range(2):
        run_incremental(spark, inbox, records, vectors, checkpoint, B.AS_OF, networks=langs, max_files=100, buckets=8)
    return _shown(ST.read_table(spark, records), ST.read_table(spark, vectors))


@query("event_stream", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def event_stream(spark, sf_dir):
    """The later half of all events is landed and streamed, then all of them: the earlier half comes behind
    the watermark, the later half a second time."""
    inbox, path, checkpoint = (scratch_dir(spark, n) for n in ("events", "stored-events", "events-stream"))
    events = B.table(spark, sf_dir, "events")
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    middle = events.agg(F.percentile_approx("ts", 0.5)).first()[0]
    for part in (events.filter(F.col("ts") >= F.lit(middle)), events):
        landed = part.repartitionByRange(8, "ts").write.mode("append")
        landed.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(inbox)
        run_events(spark, inbox, path, checkpoint, events.schema, "event_id", "ts", "12 hours", buckets=4)
    return plain_times(ST.read_table(spark, path))


@query(
    "refreshed_texts",
    rf"""SELECT doc_id AS id, CASE WHEN lang = 'en' THEN 'kept' ELSE substring(trim(regexp_replace(regexp_replace(regexp_replace(trim(text, chr(9)||chr(10)||chr(13)||' '),
      '[\x00-\x1f\x7f-\x{{9f}}]', ' ', 'g'), '[\s\x{{a0}}]+', ' ', 'g'), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g')), 1, 1000) END AS doc_text FROM documents""",
)
def refreshed_texts(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("description"), F.when(F.col("lang") == "en", "kept").otherwise("").alias("doc_text")
    )
    return refresh_texts(docs.withColumn("title", F.lit(None).cast("string"))).select("id", "doc_text")
