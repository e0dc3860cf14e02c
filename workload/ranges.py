"""Questions with any window of time and bounds of amounts."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.plans import ranges as R
from workload import bindings as B
from workload.registry import query

_ASKED = """
  SELECT o_orderkey AS query_id, o_custkey % 7 AS k, o_orderpriority AS p, date_trunc('quarter', o_orderdate)::DATE AS q, o_orderdate::DATE AS d,
    (o_custkey % 5) * 50000 AS low, (o_custkey % 3 + 2) * 60000 AS high FROM orders"""

_RANGES = f"""
  WITH asked AS ({_ASKED}), r AS ({B.CHAIN_SQL}),
  plans AS (SELECT query_id, CASE WHEN p IN ('1-URGENT', '5-LOW') THEN 'count' WHEN p = '2-HIGH' THEN 'newest' ELSE 'sample' END AS op,
      CASE p WHEN '1-URGENT' THEN 'polkadot' WHEN '2-HIGH' THEN 'kusama' END AS network, CASE p WHEN '3-MEDIUM' THEN 'TreasuryProposal' END AS type,
      CASE p WHEN '1-URGENT' THEN q WHEN '2-HIGH' THEN d WHEN '4-NOT SPECIFIED' THEN date_trunc('year', d)::DATE END::TIMESTAMP AS from_ts,
      CASE p WHEN '1-URGENT' THEN q + INTERVAL 3 MONTH WHEN '2-HIGH' THEN date_trunc('month', d) + INTERVAL 2 MONTH WHEN '4-NOT SPECIFIED' THEN date_trunc('year', d) + INTERVAL 1 YEAR END::TIMESTAMP AS to_ts,
      CASE WHEN p NOT IN ('2-HIGH') THEN low::DOUBLE END AS "over", CASE WHEN p IN ('3-MEDIUM', '5-LOW') THEN high::DOUBLE END AS under FROM asked),
  s AS (SELECT DISTINCT op, network, type, from_ts, to_ts, "over", under FROM plans),
  hit AS (SELECT s.*, r.id, row_number() OVER w AS position, count(*) OVER (PARTITION BY s.op, s.network, s.type, s.from_ts, s.to_ts, s."over", s.under) AS n
    FROM s JOIN r ON (s.network IS NULL OR r.network = s.network) AND (s.type IS NULL OR r.type = s.type) AND (s.from_ts IS NULL OR r.created_at >= s.from_ts)
      AND (s.to_ts IS NULL OR r.created_at < s.to_ts) AND (s."over" IS NULL OR r.amount_numeric > s."over") AND (s.under IS NULL OR r.amount_numeric < s.under)
    WINDOW w AS (PARTITION BY s.op, s.network, s.type, s.from_ts, s.to_ts, s."over", s.under ORDER BY CASE WHEN s.op <> 'sample' THEN r.created_at END DESC, r.id)),
  a AS (SELECT op, network, type, from_ts, to_ts, "over", under, max(n) AS n, string_agg(id::VARCHAR, ',' ORDER BY position) FILTER (position <= 5) AS ids FROM hit GROUP BY ALL)
  SELECT query_id, coalesce(n, 0) AS count, coalesce(ids, '') AS ids FROM plans p LEFT JOIN a ON p.op = a.op AND p.network IS NOT DISTINCT FROM a.network
    AND p.type IS NOT DISTINCT FROM a.type AND p.from_ts IS NOT DISTINCT FROM a.from_ts AND p.to_ts IS NOT DISTINCT FROM a.to_ts
    AND p."over" IS NOT DISTINCT FROM a."over" AND p.under IS NOT DISTINCT FROM a.under"""


def range_questions(spark, sf_dir):
    """A question per order: quarters, spans of days, years, and amounts over and under."""
    o = B.table(spark, sf_dir, "orders")
    p, d = F.col("o_orderpriority"), F.col("o_orderdate")
    low = ((F.col("o_custkey") % 5) * 50000).cast("string")
    high = F.format_number((F.col("o_custkey") % 3 + 2) * 60000, 0)
    last = F.date_sub(F.add_months(F.trunc(d, "month"), 2), 1).cast("string")
    text = (
        F.when(p == "1-URGENT", F.concat(F.lit("How many Polkadot proposals over "), low, F.lit(" in Q"), F.quarter(d).cast("string"), F.lit(" "), F.year(d).cast("string"), F.lit("?")))
        .when(p == "2-HIGH", F.concat(F.lit("Show recent kusama proposals between "), d.cast("date").cast("string"), F.lit(" and "), last))
        .when(p == "3-MEDIUM", F.concat(F.lit("Treasury proposals more than "), low, F.lit(" but less than "), high))
        .when(p == "4-NOT SPECIFIED", F.concat(F.lit("Proposals above "), low, F.lit(".0 in "), F.year(d).cast("string")))
        .otherwise(F.concat(F.lit("How many proposals above $"), low, F.lit(" and below "), high))
    )
    return B.spread(o.select(F.col("o_orderkey").alias("query_id"), text.alias("query")), B.PARTS)


@query("range_answers", _RANGES)
def range_answers(spark, sf_dir):
    """Counts and examples of arbitrary windows and bounds, against a join of plans and records by condition."""
    plans = R.range_plans(range_questions(spark, sf_dir))
    found = R.answer_ranges(plans, B.chain_records(spark, sf_dir))
    return found.select("query_id", "count", F.array_join(F.transform("examples", lambda x: x.cast("string")), ",").alias("ids"))
