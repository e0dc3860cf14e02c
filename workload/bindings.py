"""The test tables seen as records, embeddings, questions and raw items."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.session import spread, union_all  # noqa: F401

AS_OF = datetime(2025, 1, 1)
#: The test tables are single files; costly work on their rows is dealt out to so many tasks.
PARTS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as records, without network and proposer."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("type"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("amount_numeric"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_custkey").alias("custkey"),
    )


def full_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer's segment as network and name as proposer."""
    customer = table(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_mktsegment").alias("network"), F.col("c_name").alias("proposer")
    )
    return orders_records(spark, sf_dir).join(customer, F.col("custkey") == F.col("c_custkey")).drop("custkey", "c_custkey")


FULL_RECORDS_SQL = """
  SELECT o_orderkey AS id, o_orderpriority AS type, o_orderstatus AS status, o_totalprice AS amount_numeric,
         o_orderdate AS created_at, c_mktsegment AS network, c_name AS proposer
  FROM orders JOIN customer ON o_custkey = c_custkey
"""


def chain_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as records of named networks, with a title and a description."""
    o = table(spark, sf_dir, "orders")
    status = F.col("o_orderstatus")
    network = F.when(status == "F", "polkadot").when(status == "O", "kusama").otherwise("westend")
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "TreasuryProposal").otherwise(F.col("o_orderpriority"))
    return o.select(
        F.col("o_orderkey").alias("id"),
        network.alias("network"),
        kind.alias("type"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"),
        F.concat(F.lit("Placed by customer "), F.col("o_custkey").cast("string")).alias("description"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("proposer"),
        F.col("o_totalprice").alias("amount_numeric"),
        F.lit("DOT").alias("currency"),
        status.alias("status"),
        F.col("o_orderdate").alias("created_at"),
    )


CHAIN_SQL = """
  SELECT o_orderkey AS id,
         CASE o_orderstatus WHEN 'F' THEN 'polkadot' WHEN 'O' THEN 'kusama' ELSE 'westend' END AS network,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 'TreasuryProposal' ELSE o_orderpriority END AS type,
         'Order ' || o_orderkey AS title, 'Placed by customer ' || o_custkey AS description,
         'c' || o_custkey AS proposer, o_totalprice AS amount_numeric, 'DOT' AS currency,
         o_orderstatus AS status, o_orderdate AS created_at
  FROM orders
"""


def chain_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question per order, worded after its priority and date."""
    o = table(spark, sf_dir, "orders")
    p, d = F.col("o_orderpriority"), F.col("o_orderdate")
    text = (
        F.when(p == "1-URGENT", F.concat(F.lit("How many treasury proposals on Polkadot in "), F.date_format(d, "MMMM yyyy"), F.lit("?")))
        .when(p == "2-HIGH", F.concat(F.lit("Show recent kusama proposals from "), F.date_format(d, "yyyy-MM")))
        .when(p == "3-MEDIUM", F.lit("Show me treasury proposals"))
        .when(p == "4-NOT SPECIFIED", F.concat(F.lit("Tell me about customer "), F.translate(F.col("o_custkey").cast("string"), "0123456789", "abcdefghij")))
        .otherwise(F.lit("How many proposals exist and show some examples?"))
    )
    return spread(o.select(F.col("o_orderkey").alias("query_id"), text.alias("query")), PARTS)


CHAIN_QUESTIONS_SQL = """
  SELECT o_orderkey AS query_id, CASE o_orderpriority
    WHEN '1-URGENT' THEN 'How many treasury proposals on Polkadot in ' || strftime(o_orderdate, '%B %Y') || '?'
    WHEN '2-HIGH' THEN 'Show recent kusama proposals from ' || strftime(o_orderdate, '%Y-%m')
    WHEN '3-MEDIUM' THEN 'Show me treasury proposals'
    WHEN '4-NOT SPECIFIED' THEN 'Tell me about customer ' || translate(o_custkey::VARCHAR, '0123456789', 'abcdefghij')
    ELSE 'How many proposals exist and show some examples?' END AS query
  FROM orders
"""


def talk_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What users said, as questions."""
    c = table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    return c.select("conv_id", "turn", F.col("text").alias("query"))


def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records: the first line as title, the whole text as description."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return spread(docs, PARTS).select(
        F.col("doc_id").alias("id"),
        F.col("lang").alias("network"),
        F.col("source").alias("type"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("description"),
        F.lit(None).cast("string").alias("proposer"),
        F.lit(None).cast("double").alias("amount_numeric"),
        F.lit(None).cast("string").alias("status"),
        F.lit(None).cast("timestamp").alias("created_at"),
    )


DOCS_SQL = """
  SELECT doc_id AS id, lang AS network, source AS type, split_part(text, chr(10), 1) AS title, text AS description
  FROM documents
"""


def document_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("proposal_id"), "embedding")


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as search queries, with the vector of the same number."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return items.join(vectors, "query_id")


BENCHMARK_SQL = """
  SELECT item_id AS query_id, text AS query, embedding::DOUBLE[] AS vector
  FROM benchmark JOIN embeddings ON item_id = vec_id
"""

# SQL for the words, key terms and rank of a text.
TOKENS_SQL = r"regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]+')"
TERMS_SQL = (
    r"list_distinct(list_filter(regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]+'), lambda w: length(w) > 2 AND w NOT IN "
    "('tell','me','about','the','a','an','and','or','but','in','on','at','to','for','of','with','by')))"
)


def tokens_sql(c: str) -> str:
    return TOKENS_SQL.format(c=c)


def terms_sql(c: str) -> str:
    return TERMS_SQL.format(c=c)
