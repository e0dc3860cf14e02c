"""Filters, counts, summaries and ordered listings over orders seen as records."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from sheaf.operators import analytics as A
from sheaf.operators import filters as C
from sheaf.operators.merge import first_per_key
from sheaf.schema import SearchFilters
from workload import bindings as B
from workload.registry import query

RECORD = ["id", "type", "status", "amount_numeric", "created_at"]
RECORD_SQL = (
    "SELECT o_orderkey AS id, o_orderpriority AS type, o_orderstatus AS status, o_totalprice AS amount_numeric, "
    "o_orderdate AS created_at FROM orders"
)
AUGUST = SearchFilters(status="F", start_date=datetime(1996, 8, 1), end_date=datetime(1996, 8, 31))


@query(
    "structured_filter",
    RECORD_SQL + " WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' AND o_totalprice BETWEEN 1000 AND 250000 "
    "AND o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-06-30'",
)
def structured_filter(spark, sf_dir):
    wanted = SearchFilters(
        proposal_type="1-URGENT",
        status="F",
        min_amount=1000.0,
        max_amount=250000.0,
        start_date=datetime(1996, 1, 1),
        end_date=datetime(1997, 6, 30),
    )
    return C.apply_filters(B.orders_records(spark, sf_dir), wanted).select(*RECORD)


@query(
    "network_filter",
    f"SELECT id, network, proposer FROM ({B.FULL_RECORDS_SQL}) WHERE network = 'BUILDING' AND status = 'O' AND amount_numeric >= 400000",
)
def network_filter(spark, sf_dir):
    wanted = SearchFilters(network="BUILDING", status="O", min_amount=400000.0)
    return C.apply_filters(B.full_records(spark, sf_dir), wanted).select("id", "network", "proposer")


@query(
    "interactive_refilter",
    f"""SELECT id, network, type, created_at FROM ({B.FULL_RECORDS_SQL})
    WHERE lower(network) = 'machinery' AND type = '2-HIGH'
      AND floor(date_diff('second', created_at, TIMESTAMP '1998-08-02') / 86400.0) <= 90""",
)
def interactive_refilter(spark, sf_dir):
    rows = B.full_records(spark, sf_dir)
    shown = C.refilter(rows, "machinery", "2-HIGH", "90d", datetime(1998, 8, 2))
    return shown.select("id", "network", "type", "created_at")


@query(
    "filtered_count",
    """SELECT count(*) AS count FROM orders WHERE o_orderstatus = 'F'
    AND o_orderdate BETWEEN TIMESTAMP '1996-08-01' AND TIMESTAMP '1996-08-31'""",
)
def filtered_count(spark, sf_dir):
    return A.count_rows(C.apply_filters(B.orders_records(spark, sf_dir), AUGUST))


@query("group_count", "SELECT o_orderstatus AS status, count(*) AS count FROM orders GROUP BY 1")
def group_count(spark, sf_dir):
    return A.group_count(B.orders_records(spark, sf_dir), "status")


@query("distinct_values", "SELECT DISTINCT o_orderpriority AS type FROM orders ORDER BY 1")
def distinct_values(spark, sf_dir):
    return A.distinct_values(B.orders_records(spark, sf_dir), "type")


_STATS = """
  SELECT {keys} count(o_totalprice) AS n_amounts, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS average,
         min(o_totalprice) AS lowest, max(o_totalprice) AS highest,
         first(o_orderkey ORDER BY o_totalprice, o_orderkey) AS lowest_id,
         first(o_orderkey ORDER BY o_totalprice DESC, o_orderkey) AS highest_id
  FROM orders {group}
"""


def _rounded(df):
    return df.withColumn("total", F.round("total", 2)).withColumn("average", F.round("average", 4))


@query("amount_stats", _STATS.format(keys="o_orderpriority AS type,", group="GROUP BY o_orderpriority"))
def amount_stats(spark, sf_dir):
    return _rounded(A.amount_stats(B.orders_records(spark, sf_dir), ["type"]))


@query("amount_stats_overall", _STATS.format(keys="", group=""))
def amount_stats_overall(spark, sf_dir):
    return _rounded(A.amount_stats(B.orders_records(spark, sf_dir)))


@query("amount_over", "SELECT count(*) AS count FROM orders WHERE o_totalprice >= 1000")
def amount_over(spark, sf_dir):
    return A.count_rows(C.apply_filters(B.orders_records(spark, sf_dir), SearchFilters(min_amount=1000.0)))


@query(
    "count_with_examples",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC NULLS FIRST, o_orderkey) AS n,
                         count(*) OVER (PARTITION BY o_orderpriority) AS count FROM orders)
    SELECT o_orderpriority AS type, count, n::INTEGER AS position, o_orderkey AS id, o_orderdate AS created_at FROM r WHERE n <= 5""",
)
def count_with_examples(spark, sf_dir):
    rows = B.orders_records(spark, sf_dir).withColumn("title", F.col("status"))
    found = A.count_with_examples(rows, 5, ["type"])
    return found.select("type", "count", F.explode("examples").alias("e")).select(
        "type", "count", "e.position", "e.id", "e.created_at"
    )


@query(
    "august_report",
    """WITH f AS (SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_orderdate BETWEEN TIMESTAMP '1996-08-01' AND TIMESTAMP '1996-08-31'),
    r AS (SELECT *, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS n FROM f)
    SELECT (SELECT count(*) FROM f) AS count, n::INTEGER AS position, o_orderkey AS id, o_orderdate AS created_at FROM r WHERE n <= 5""",
)
def august_report(spark, sf_dir):
    rows = C.apply_filters(B.orders_records(spark, sf_dir), AUGUST).withColumn("title", F.col("status"))
    found = A.count_with_examples(rows, 5)
    return found.select("count", F.explode("examples").alias("e")).select("count", "e.position", "e.id", "e.created_at")


@query("newest", RECORD_SQL + " ORDER BY o_orderdate DESC NULLS FIRST, o_orderkey LIMIT 5")
def newest(spark, sf_dir):
    return A.newest(B.orders_records(spark, sf_dir)).select(*RECORD)


@query("sample_rows", RECORD_SQL + " ORDER BY o_orderkey LIMIT 5")
def sample_rows(spark, sf_dir):
    return A.sample_rows(B.orders_records(spark, sf_dir)).select(*RECORD)


@query("listing_page", RECORD_SQL + " ORDER BY o_orderdate DESC NULLS FIRST, o_orderkey LIMIT 20 OFFSET 40")
def listing_page(spark, sf_dir):
    return A.page(B.orders_records(spark, sf_dir), 20, 40).select(*RECORD)


@query("deep_page", RECORD_SQL + " ORDER BY o_orderdate DESC NULLS FIRST, o_orderkey LIMIT 20 OFFSET 10000")
def deep_page(spark, sf_dir):
    return A.deep_page(B.orders_records(spark, sf_dir), 20, 10_000).select(*RECORD)


@query("top_by_amount", RECORD_SQL + " ORDER BY coalesce(o_totalprice, 0) DESC, o_orderkey LIMIT 10")
def top_by_amount(spark, sf_dir):
    return A.top_by_amount(B.orders_records(spark, sf_dir), 10).select(*RECORD)


@query(
    "top_per_group",
    """SELECT network, status, id, amount_numeric, n::INTEGER AS position FROM (
      SELECT *, row_number() OVER (PARTITION BY network, status ORDER BY created_at DESC NULLS FIRST, id) AS n
      FROM (%s)) WHERE n <= 3""" % B.FULL_RECORDS_SQL,
)
def top_per_group(spark, sf_dir):
    rows = A.top_per_key(B.full_records(spark, sf_dir), A.newest_first(), 3, ["network", "status"])
    return rows.select("network", "status", "id", "amount_numeric", "position")


@query(
    "keep_first",
    """SELECT l_orderkey AS id, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate FROM (
      SELECT *, row_number() OVER (PARTITION BY l_orderkey
        ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS n FROM lineitem) WHERE n = 1""",
)
def keep_first(spark, sf_dir):
    rows = B.table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "id")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
    return first_per_key(rows, "id", order).select("id", *order)


@query(
    "public_view",
    f"""SELECT network, status, count(*) AS n, round(max(amount_numeric), 2) AS highest FROM ({B.FULL_RECORDS_SQL})
    WHERE type = '5-LOW' GROUP BY network, status""",
)
def public_view(spark, sf_dir):
    C.publish_view(B.full_records(spark, sf_dir), "proposals")
    return spark.sql(
        "SELECT network, status, count(*) AS n, round(max(amount_numeric), 2) AS highest FROM proposals "
        "WHERE type = '5-LOW' GROUP BY network, status"
    )


@query(
    "load_metrics",
    """SELECT (SELECT count(*) FROM lineitem)::BIGINT AS loaded, (SELECT count(DISTINCT l_orderkey) FROM lineitem)::BIGINT AS deduplicated,
    (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_returnflag <> 'R')::BIGINT AS upserted,
    (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R')::BIGINT AS failed""",
)
def load_metrics(spark, sf_dir):
    rows = B.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), "l_returnflag", "l_linenumber")
    good = rows.filter(F.col("l_returnflag") != "R")
    accepted = first_per_key(good, "id", ["l_linenumber"])
    return A.load_metrics(rows, accepted, rows.filter(F.col("l_returnflag") == "R"))


@query(
    "display_cut",
    """WITH r AS (SELECT o_custkey AS query_id, o_orderkey AS id, o_totalprice / 500000.0 AS score,
        row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INTEGER AS rank FROM orders),
    p AS (SELECT *, score >= 0.9 AS pass, max((score >= 0.9)::INTEGER) OVER (PARTITION BY query_id) AS any_pass FROM r),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM p WHERE pass OR (any_pass = 0 AND rank <= 2))
    SELECT query_id, id, rank FROM k WHERE n <= 5""",
)
def display_cut(spark, sf_dir):
    rows = B.orders_records(spark, sf_dir).select(F.col("custkey").alias("query_id"), "id", F.col("amount_numeric"))
    order = Window.partitionBy("query_id").orderBy(F.col("amount_numeric").desc(), F.col("id").asc())
    ranked = rows.withColumn("rank", F.row_number().over(order))
    scored = ranked.withColumn("score", F.col("amount_numeric") / 500000.0)
    return C.cut_scores(scored, 0.9, 5, 2).select("query_id", "id", "rank")
