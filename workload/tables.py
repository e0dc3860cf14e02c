"""Sources, joins between tables, embeddings and vector maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.functions import normalize as N
from sheaf.functions import vectors as V
from sheaf.operators import embedding as E
from sheaf.operators import joins as J
from sheaf.operators import merge as M
from sheaf.operators.analytics import coverage
from sheaf.operators.stored_table import read_table
from sheaf.plans.ingest import normalize, run_load
from sheaf.session import scratch_dir
from sheaf.sources import files as S
from sheaf.sources.paged import expand_units, fetch_pages, parse_items
from workload import bindings as B
from workload.registry import query
from workload.texts import WS

# --- landing and loading -----------------------------------------------------------------------


def _items(spark, sf_dir):
    """Documents as landed items, numbered within their language and source."""
    docs = B.table(spark, sf_dir, "documents")
    return docs.select(
        F.col("lang").alias("network"),
        F.col("source").alias("type"),
        F.col("doc_id").cast("string").alias("id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("content"),
        F.col("n_chars").alias("amount"),
    )


@query(
    "landed_envelopes",
    "SELECT doc_id::VARCHAR AS id, source AS type, split_part(text, chr(10), 1) AS title, md5(text) AS content, n_chars AS amount FROM documents",
)
def landed_envelopes(spark, sf_dir):
    """Land the documents as JSON envelopes, then load them back."""
    path = scratch_dir(spark, "landed")
    numbered = _items(spark, sf_dir).withColumn("position", F.col("id").cast("long"))
    S.land(numbered.withColumn("unit", F.col("network")), path, ["network", "unit"], "position", B.AS_OF)
    good, _ = S.good_and_corrupt(S.load_records(spark, [path]))
    return good.select("id", "type", "title", F.md5("content").alias("content"), "amount")


@query(
    "envelope_sizes",
    """SELECT lang AS network, source AS type, (doc_id // 100)::BIGINT AS chunk, count(*) AS total_items, max(doc_id)::VARCHAR AS last_id
    FROM documents GROUP BY ALL""",
)
def envelope_sizes(spark, sf_dir):
    numbered = _items(spark, sf_dir).withColumn("position", F.col("id").cast("long"))
    packed = S.envelopes(numbered, ["network", "type"], "position", B.AS_OF, chunk=100)
    last = F.element_at("items", -1)["id"]
    return packed.select(
        "network", "type", F.floor(last.cast("long") / 100).alias("chunk"), "total_items", last.alias("last_id")
    )


@query(
    "csv_scan",
    "SELECT c_custkey::INTEGER AS id, c_name AS title, c_acctbal AS amount, c_mktsegment AS type FROM customer",
)
def csv_scan(spark, sf_dir):
    path = scratch_dir(spark, "csv")
    rows = B.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.col("c_acctbal").alias("amount"), F.col("c_mktsegment").alias("type")
    )
    rows.write.option("header", True).csv(path)
    return S.load_records(spark, [path], suffixes=("csv",)).select("id", "title", "amount", "type")


@query(
    "mixed_files",
    """SELECT 'c' || c_custkey AS id, c_name AS title, c_acctbal AS amount, NULL::VARCHAR AS network FROM customer
    UNION ALL SELECT 's' || s_suppkey, s_name, s_acctbal, 'nation' || s_nationkey FROM supplier""",
)
def mixed_files(spark, sf_dir):
    """CSV and JSON files with different columns, in one load."""
    path = scratch_dir(spark, "mixed")
    c, s = B.table(spark, sf_dir, "customer"), B.table(spark, sf_dir, "supplier")
    left = c.select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("title"), F.col("c_acctbal").alias("amount")
    )
    left.write.option("header", True).csv(f"{path}/a")
    right = s.select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"),
        F.col("s_name").alias("title"),
        F.col("s_acctbal").alias("amount"),
        F.concat(F.lit("nation"), F.col("s_nationkey").cast("string")).alias("network"),
        F.lit("all").alias("type"),
        F.col("s_suppkey").cast("long").alias("position"),
    )
    S.land(right.withColumn("unit", F.lit("u")), f"{path}/b", ["network", "unit"], "position", B.AS_OF)
    loaded = S.load_records(spark, [f"{path}/a", f"{path}/b", f"{path}/absent"])
    return loaded.select("id", "title", "amount", "network")


@query(
    "corrupt_files",
    """SELECT 'record' AS kind, doc_id::VARCHAR AS id, md5(text) AS content FROM documents
    UNION ALL SELECT 'unreadable', NULL, lang || doc_id // 100 || ':' || count(*) || ':' || md5(string_agg(md5(text), '' ORDER BY doc_id)) FROM documents GROUP BY lang, doc_id // 100""",
)
def corrupt_files(spark, sf_dir):
    """Every document lands twice: in a good envelope, and in one cut off before its end. The records of the
    good ones are stored, the broken files are among the rejects with all their text."""
    inbox, records, rejects = (scratch_dir(spark, n) for n in ("corrupt", "records", "rejects"))
    docs = B.table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("network"), F.col("source").alias("type"), F.col("text").alias("content"),
        F.substring_index("text", "\n", 1).alias("title"), F.col("doc_id").alias("position"),
    )
    S.land(docs, f"{inbox}/good", ["network"], "position", B.AS_OF, chunk=200, gzip=True)
    chunk = F.floor(F.col("position") / 100).cast("string")
    item = F.struct("position", F.to_json(F.struct("id", F.md5("content").alias("sum"), "content")).alias("item"))
    chunks = docs.groupBy(F.concat("network", chunk).alias("name")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    body = F.array_join(F.transform("items", lambda x: x["item"]), ",")
    broken = chunks.select(F.concat(F.lit('{"name": "'), "name", F.lit('", "items": ['), body).alias("value"))
    S.land_texts(broken, f"{inbox}/broken", gzip=True)
    langs = ["en", "fr", "de", "es"]
    run_load(spark, [f"{inbox}/good", f"{inbox}/broken"], records, None, B.AS_OF, rejects_path=rejects, networks=langs, load_id="one")
    good = read_table(spark, records).select(F.lit("record").alias("kind"), "id", F.md5("description").alias("content"))
    bad = spark.read.parquet(rejects).filter(F.col("reason") == "unreadable")
    sums = F.regexp_extract_all("raw", F.lit('"sum":"([0-9a-f]{32})"'), F.lit(1))
    told = F.concat_ws(":", F.regexp_extract("raw", '"name": "(\\w+)"', 1), F.size(sums).cast("string"), F.md5(F.array_join(sums, "").cast("binary")))
    return B.union_all(good, bad.select(F.lit("unreadable").alias("kind"), F.lit(None).cast("string").alias("id"), told.alias("content")))


def _paged(network: str, type: str, origin: str, limit: int, page: int) -> dict:
    """A remote source that has as many items as ``origin`` says."""
    total = int(origin)
    ids = range((page - 1) * limit, min(page * limit, total))
    return {"items": [{"id": f"{network}-{type}-{i}", "title": f"item {i}"} for i in ids], "totalCount": total}


@query(
    "paged_items",
    """SELECT lang AS unit_network, source AS unit_type, (row_number() OVER (PARTITION BY lang, source) - 1)::BIGINT AS position,
      lang || '-' || source || '-' || (row_number() OVER (PARTITION BY lang, source) - 1) AS id FROM documents""",
)
def paged_items(spark, sf_dir):
    """A unit for each language and source, with as many items to page over as it has documents."""
    docs = B.table(spark, sf_dir, "documents")
    units = docs.groupBy(F.col("lang").alias("network"), F.col("source").alias("type")).agg(F.count(F.lit(1)).cast("string").alias("origin"))
    pages = fetch_pages(units, _paged, limit=7, partitions=B.PARTS)
    return parse_items(pages).select("unit_network", "unit_type", "position", "id")


@query(
    "fetch_units",
    """WITH p AS (SELECT DISTINCT lang AS network, source AS type FROM documents)
    SELECT network, type, NULL::VARCHAR AS origin FROM p WHERE type <> 'src3'
    UNION ALL SELECT network, type, o FROM p, (SELECT unnest(['Root', 'Treasurer', 'BigTipper']) AS o) WHERE type = 'src3'""",
)
def fetch_units(spark, sf_dir):
    pairs = B.table(spark, sf_dir, "documents").select(F.col("lang").alias("network"), F.col("source").alias("type")).distinct()
    return expand_units(pairs, ["Root", "Treasurer", "BigTipper"], "src3")


# --- normalising -------------------------------------------------------------------------------


def raw_orders(spark, sf_dir):
    """Orders as dirty items: odd spellings, symbols in amounts, several time formats."""
    o = B.spread(B.table(spark, sf_dir, "orders"), B.PARTS)
    p, s, d = F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("o_orderdate")
    price = F.format_number("o_totalprice", 2)
    return o.select(
        F.when(p != "5-LOW", F.col("o_orderkey").cast("string")).alias("id"),
        F.col("o_orderkey").alias("index"),
        F.when(s == "F", " DOT ").when(s == "O", "Ksm").alias("network"),
        F.when(p == "1-URGENT", "treasury_proposal").when(p == "2-HIGH", "CHILDBOUNTY").when(p == "3-MEDIUM", " Other ").alias("type"),
        F.when(s == "P", "tip").alias("proposalType"),
        F.concat(F.lit("  Order "), F.col("o_orderkey").cast("string"), F.lit("\t")).alias("title"),
        F.when(s == "F", "").otherwise("about this order").alias("description"),
        F.lit("from content").alias("content"),
        F.when(p == "1-URGENT", F.concat(F.lit("$"), price)).when(p == "2-HIGH", F.concat(F.lit("£ "), price)).when(p == "3-MEDIUM", "abc").otherwise(price).alias("amount"),
        F.when(s == "F", " dot").when(s == "O", "").alias("currency"),
        F.when(p == "1-URGENT", F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
        .when(p == "2-HIGH", F.date_format(d, "yyyy-MM-dd HH:mm:ss"))
        .when(p == "3-MEDIUM", F.date_format(d, "MMM d, yyyy"))
        .when(p == "4-NOT SPECIFIED", F.date_format(d, "yyyy-MM-dd"))
        .otherwise("soon")
        .alias("createdAt"),
        F.when(s == "F", F.struct(F.lit("T").alias("type"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("proposer"), F.lit("Executed").alias("status"))).alias("onChainInfo"),
        F.col("o_custkey").alias("customer"),
    )


RAW_ORDERS_SQL = """
  SELECT CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderkey::VARCHAR
      WHEN o_orderstatus = 'F' AND o_orderkey <> 0 THEN ' DOT _' || o_orderkey WHEN o_orderstatus = 'O' AND o_orderkey <> 0 THEN 'Ksm_' || o_orderkey END AS id,
    CASE o_orderstatus WHEN 'O' THEN 'kusama' ELSE 'polkadot' END AS network,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 'TreasuryProposal' WHEN o_orderpriority = '2-HIGH' THEN 'ChildBounty'
      WHEN o_orderpriority = '3-MEDIUM' THEN ' Other ' WHEN o_orderstatus = 'P' THEN 'Tip' WHEN o_orderstatus = 'F' THEN 'T' ELSE 'Unknown' END AS type,
    'Order ' || o_orderkey AS title, CASE o_orderstatus WHEN 'F' THEN 'from content' ELSE 'about this order' END AS description,
    CASE o_orderstatus WHEN 'F' THEN 'c' || o_custkey END AS proposer,
    CASE WHEN o_orderpriority <> '3-MEDIUM' THEN round(o_totalprice, 2) END AS amount_numeric,
    CASE o_orderstatus WHEN 'F' THEN 'DOT' END AS currency,
    CASE o_orderstatus WHEN 'F' THEN 'Executed' ELSE 'pending' END AS status,
    CASE WHEN o_orderpriority = '5-LOW' THEN TIMESTAMP '2025-01-01' ELSE o_orderdate END AS created_at,
    TIMESTAMP '2025-01-01' AS updated_at, '{"index":' || o_orderkey || ',"customer":' || o_custkey || '}' AS metadata,
    'Order ' || o_orderkey || CASE o_orderstatus WHEN 'F' THEN ' from content' ELSE ' about this order' END AS doc_text
  FROM orders
"""


def plain_times(df):
    """Timestamps without a zone, as the SQL side has them."""
    return df.select(
        *[F.col(f.name).cast("timestamp_ntz").alias(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(f.name) for f in df.schema.fields]
    )


@query("normalize_records", f"SELECT * REPLACE (coalesce(id, 'hashed') AS id) FROM ({RAW_ORDERS_SQL})")
def normalize_records(spark, sf_dir):
    rows = plain_times(normalize(raw_orders(spark, sf_dir), B.AS_OF))
    hashed = F.col("id").rlike("^( DOT |Ksm)?_[0-9a-f]{12}$")
    return rows.withColumn("id", F.when(hashed, "hashed").otherwise(F.col("id")))


@query(
    "generated_ids",
    "SELECT count(*) AS n, count(DISTINCT o_orderkey) AS n_distinct FROM orders WHERE o_orderpriority = '5-LOW' AND (o_orderstatus = 'P' OR o_orderkey = 0)",
)
def generated_ids(spark, sf_dir):
    """Ids made from row hashes: one per row, and never the same twice."""
    rows = normalize(raw_orders(spark, sf_dir), B.AS_OF).filter(F.col("id").rlike("^( DOT |Ksm)?_[0-9a-f]{12}$"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("n_distinct"))


@query(
    "type_words",
    """SELECT o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 'TreasuryProposal' WHEN '2-HIGH' THEN 'CouncilMotion'
      WHEN '3-MEDIUM' THEN 'Tip' ELSE o_orderpriority END AS type FROM orders""",
)
def type_words(spark, sf_dir):
    p = F.col("o_orderpriority")
    word = F.when(p == "1-URGENT", "Treasury").when(p == "2-HIGH", "council").when(p == "3-MEDIUM", "TIP").otherwise(p)
    return B.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), N.type_from_word(word).alias("type"))


@query(
    "event_items",
    "SELECT event_id, event_type, json_extract(props, '$.k')::BIGINT AS k FROM events",
)
def event_items(spark, sf_dir):
    """JSON items inside a text column, packed as an envelope per event and unpacked again."""
    e = B.table(spark, sf_dir, "events").select("event_id", "event_type", F.from_json("props", "k long").alias("p"))
    item = F.array(F.struct("event_id", "event_type", F.col("p.k").alias("k"))).alias("items")
    shaped = e.select(item, F.lit(None).cast("string").alias(S.CORRUPT), F.lit("events").alias("_file"), F.lit(0).alias("_block"))
    return S.records_of(shaped).select("event_id", "event_type", "k")


# --- joins -------------------------------------------------------------------------------------


@query(
    "with_embeddings",
    "SELECT doc_id AS id, lang AS network, len(embedding)::INTEGER AS dimensions FROM documents JOIN embeddings ON doc_id = vec_id",
)
def with_embeddings(spark, sf_dir):
    joined = J.with_embeddings(B.document_records(spark, sf_dir).select("id", "network"), B.document_embeddings(spark, sf_dir))
    return joined.select("id", "network", F.size("embedding").alias("dimensions"))


@query("without_embedding", "SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def without_embedding(spark, sf_dir):
    return J.without_embedding(B.document_records(spark, sf_dir).select("id"), B.document_embeddings(spark, sf_dir))


@query(
    "existing_ids",
    "SELECT l_orderkey AS id, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')",
)
def existing_ids(spark, sf_dir):
    lines = B.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber")
    return J.existing(lines, B.orders_records(spark, sf_dir).filter(F.col("status") == "F"))


@query(
    "orphans_removed",
    "SELECT vec_id AS proposal_id, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels)",
)
def orphans_removed(spark, sf_dir):
    vectors = B.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("proposal_id"), "label")
    return J.orphans_removed(vectors, B.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")))


@query(
    "description_lookup",
    """SELECT page_id AS id, coalesce(nullif(text, ''), url) AS description FROM pages LEFT JOIN documents ON page_id = doc_id AND lang = 'en'""",
)
def description_lookup(spark, sf_dir):
    shown = B.table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("description"))
    english = B.document_records(spark, sf_dir).filter(F.col("network") == "en")
    return J.with_descriptions(shown, english)


# --- embeddings --------------------------------------------------------------------------------


@query(
    "coverage",
    """SELECT count(*) AS total, count(vec_id) AS embedded, count(*) - count(vec_id) AS missing,
      round(count(vec_id) * 100.0::DOUBLE / count(*), 6) AS percent FROM documents LEFT JOIN embeddings ON doc_id = vec_id""",
)
def embedding_coverage(spark, sf_dir):
    found = coverage(B.document_records(spark, sf_dir), B.document_embeddings(spark, sf_dir))
    return found.withColumn("percent", F.round("percent", 6))


@query("dimension_audit", "SELECT len(embedding)::INTEGER AS dimensions, count(*) AS count FROM embeddings GROUP BY 1")
def dimension_audit(spark, sf_dir):
    return M.dimension_audit(B.document_embeddings(spark, sf_dir))


@query(
    "vector_backup",
    """SELECT count(*) AS expected, count(*) AS restored, 0::BIGINT AS mismatched, true AS ok, count(*) AS equal FROM embeddings""",
)
def vector_backup(spark, sf_dir):
    """Vectors to text and back: the same number, of the same length, with the same values."""
    vectors = B.document_embeddings(spark, sf_dir)
    restored, _ = M.import_vectors(M.export_vectors(vectors), 64)
    checked = M.verify_restore(vectors, restored, 64)
    same = vectors.join(restored.select(F.col("proposal_id").alias("_id"), F.col("embedding").alias("_e")), F.col("proposal_id") == F.col("_id"))
    equal = same.filter(F.col("embedding") == F.col("_e")).agg(F.count(F.lit(1)).alias("equal"))
    return checked.join(F.broadcast(equal), F.lit(True))


@query(
    "vector_mismatches",
    "SELECT vec_id AS proposal_id, (64 - label)::INTEGER AS dimensions FROM embeddings WHERE label <> 0",
)
def vector_mismatches(spark, sf_dir):
    """Vectors cut short by their label: those that no longer fit are reported for embedding."""
    e = B.table(spark, sf_dir, "embeddings")
    cut = e.select(F.col("vec_id").alias("proposal_id"), F.slice("embedding", F.lit(1), 64 - F.col("label")).alias("embedding"))
    return M.import_vectors(M.export_vectors(cut), 64)[1]


@query(
    "zero_vectors",
    "SELECT vec_id AS proposal_id, label <> 0 AS usable FROM embeddings",
)
def zero_vectors(spark, sf_dir):
    e = B.table(spark, sf_dir, "embeddings")
    zeroed = F.when(F.col("label") == 0, F.transform("embedding", lambda x: F.lit(0.0).cast("float"))).otherwise(F.col("embedding"))
    kept = E.without_zero_vectors(e.select(F.col("vec_id").alias("proposal_id"), zeroed.alias("embedding")))
    return kept.select("proposal_id", F.col("embedding").isNotNull().alias("usable"))


def checksum(c: str):
    """One number per vector in which every place counts differently."""
    products = F.transform(c, lambda x, i: x.cast("double") * (i + 1))
    return F.aggregate(products, F.lit(0.0), lambda a, x: a + x)


HASHED_SQL = """
  t AS ({texts}),
  w AS (SELECT id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w FROM t),
  b AS (SELECT id, ('0x' || substr(md5(w), 1, 7))::BIGINT % 64 AS b, count(*) AS n FROM w GROUP BY ALL),
  l AS (SELECT id, sqrt(sum(n * n)) AS len FROM b GROUP BY id),
  h AS (SELECT id, sum((n / len)::FLOAT::DOUBLE * (b + 1)) AS checksum FROM b JOIN l USING (id) GROUP BY id)"""


@query(
    "embed_texts",
    "WITH " + HASHED_SQL.replace("{texts}", "SELECT doc_id AS id, text FROM documents") + " SELECT id, round(checksum, 3) AS checksum FROM h",
)
def embed_texts(spark, sf_dir):
    docs = B.document_records(spark, sf_dir).select("id", F.col("description").alias("text"))
    return E.embed(docs, "text").select("id", F.round(checksum("embedding"), 3).alias("checksum"))


_MISSING_TEXTS = f"""SELECT id, CASE WHEN length(x) > 6000 THEN substring(x, 1, 6000) || '...' ELSE x END AS text FROM (
    SELECT id, trim(title || chr(10) || (CASE WHEN length(description) > 2000 THEN substring(description, 1, 2000) || '...' ELSE description END), {WS}) AS x
    FROM ({B.DOCS_SQL}) WHERE id NOT IN (SELECT vec_id FROM embeddings))"""


@query(
    "embedding_backfill",
    "WITH " + HASHED_SQL.replace("{texts}", _MISSING_TEXTS) + """
    SELECT id::VARCHAR AS proposal_id, round(checksum, 3) AS checksum FROM h
    UNION ALL SELECT vec_id::VARCHAR, round(list_sum(list_transform(embedding::DOUBLE[], lambda x, i: x * i)), 3) FROM embeddings""",
)
def embedding_backfill(spark, sf_dir):
    docs = B.document_records(spark, sf_dir).withColumn("id", F.col("id").cast("string"))
    vectors = B.document_embeddings(spark, sf_dir).withColumn("proposal_id", F.col("proposal_id").cast("string"))
    filled = E.backfill(docs, vectors)
    return filled.select("proposal_id", F.round(checksum("embedding"), 3).alias("checksum"))


@query(
    "upsert_embeddings",
    """SELECT vec_id AS proposal_id, CASE WHEN label = 0 THEN -1 ELSE 1 END AS sign FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels) OR label <> 0""",
)
def upsert_embeddings(spark, sf_dir):
    """Fresh vectors replace those with label 0 of known records, and only known ids are added."""
    e = B.table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "proposal_id")
    known = B.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    stored = e.filter(F.col("label") != 0).select("proposal_id", "embedding")
    fresh = e.filter(F.col("label") == 0).select("proposal_id", F.transform("embedding", lambda x: -x).alias("embedding"))
    merged = E.upsert_embeddings(stored, fresh, known)
    back = merged.join(e.select(F.col("proposal_id").alias("_id"), F.col("embedding").alias("_e")), F.col("proposal_id") == F.col("_id"))
    sign = F.when(V.dot(F.col("embedding"), F.col("_e")) > 0, 1).otherwise(-1)
    return back.select("proposal_id", sign.alias("sign"))
