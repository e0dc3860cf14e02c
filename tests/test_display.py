from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sheaf.functions import display as D
from sheaf.operators.analytics import amount_stats, count_with_examples, newest, page, top_by_amount
from sheaf.operators.filters import apply_filters, publish_view, refilter
from sheaf.operators.joins import with_descriptions
from sheaf.schema import SearchFilters


def values(spark, data, fn):
    df = spark.createDataFrame(list(enumerate(data)), "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_text(spark):
    data = ["**Bold** and *it* `code`\n\n## Head  é", None, "", "a*b"]
    assert values(spark, data, D.display_text) == ["Bold and it code Head", "-", "-", "ab"]


def test_first_sentence(spark):
    data = ["One. Two.", "x" * 120, None]
    assert values(spark, data, D.display_first_sentence) == ["One", "x" * 100 + "...", "-"]


def test_amounts_and_dates(spark):
    df = spark.createDataFrame([(1234.5, "DOT", datetime(2024, 1, 5)), (0.125, None, None), (None, "DOT", None)], "a double, c string, d timestamp")
    got = [tuple(r) for r in df.select(D.display_amount(F.col("a"), F.col("c")), D.display_date(F.col("d"))).collect()]
    assert got == [("1,234.50 DOT", "Jan 5, 2024"), ("0.13", "-"), ("-", "-")]


def test_type(spark):
    assert values(spark, ["TreasuryProposal", "referendumV2", None], D.display_type) == ["Treasury Proposal", "Referendum V2", "-"]
    assert values(spark, [None], lambda c: D.display_type(c, "Unknown")) == ["Unknown"]


def test_tags(spark):
    data = ["<p>One</p>\n<b>Two</b>", None, "plain"]
    assert values(spark, data, D.first_line_without_tags) == ["One", "No description available", "plain"]


def test_repair(spark):
    data = ["**b**\n\n* item\nhttpst.co/x &amp; y", None, "1. one\n2. two"]
    assert values(spark, data, D.repair_description) == [
        '<p><strong>b</strong></p><p><li>item</li><br><a href="https://t.co/x" target="_blank" rel="noopener noreferrer" '
        'class="text-blue-600 hover:text-blue-800 underline">https://t.co/x</a> & y</p>',
        "",
        "<p><li>one</li><br><li>two</li></p>",
    ]


def test_links(spark):
    df = spark.createDataFrame(
        [("Kusama", "TreasuryProposal", "1"), (None, None, "2"), ("westend", "ChildBounty", "3"), ("kusama", "Tip", None)], "n string, t string, i string"
    )
    got = [r[0] for r in df.select(D.external_links(F.col("n"), F.col("t"), F.col("i"))).collect()]
    assert got[0].subsquare == "https://kusama.subsquare.io/treasury/1"
    assert got[1].subscan == "https://polkadot.subscan.io/referenda/2"
    assert got[2].polkassembly == "https://polkadot.polkassembly.io/bounties/3"
    assert got[3] is None


AS_OF = datetime(2025, 1, 10, 12)


def listing(spark):
    rows = [
        ("1", "Kusama", "Tip", 5.0, AS_OF - timedelta(days=1, hours=23)),
        ("2", "kusama", "Tip", None, AS_OF - timedelta(days=2)),
        ("3", "polkadot", "Tip", 7.0, None),
        ("4", "kusama", "Bounty", 7.0, AS_OF),
    ]
    return spark.createDataFrame(rows, "id string, network string, type string, amount_numeric double, created_at timestamp").withColumn("title", F.lit("t"))


def ids(df):
    return [r.id for r in df.collect()]


def test_refilter_counts_whole_days(spark):
    assert sorted(ids(refilter(listing(spark), date_range="1d", as_of=AS_OF))) == ["1", "3", "4"]
    assert sorted(ids(refilter(listing(spark), "kusama", "Tip"))) == ["1", "2"]


def test_listings(spark):
    df = listing(spark)
    assert ids(newest(df, 3)) == ["3", "4", "1"]
    assert ids(page(df, 2, 1)) == ["4", "1"]
    assert ids(top_by_amount(df, 4)) == ["3", "4", "1", "2"]
    assert ids(apply_filters(df, SearchFilters())) == ["1", "2", "3", "4"]
    assert ids(apply_filters(df, SearchFilters(min_amount=5.0, max_amount=7.0, end_date=AS_OF))) == ["1", "4"]


def test_stats_and_counts(spark):
    row = amount_stats(listing(spark)).first()
    assert (row.n_amounts, row.total, row.lowest_id, row.highest_id) == (3, 19.0, "1", "3")
    found = {r.type: r for r in count_with_examples(listing(spark), 2, ["type"]).collect()}
    assert found["Tip"]["count"] == 3 and [e.id for e in found["Tip"].examples] == ["3", "1"]
    empty = count_with_examples(listing(spark).filter("false")).first()
    assert (empty["count"], empty.examples) == (0, [])


def test_filters_reach_the_scan(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"), "o_orderkey")
    plan = apply_filters(orders, SearchFilters(status="F", start_date=datetime(1996, 1, 1)))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in plan and "GreaterThanOrEqual(o" in plan


def test_public_view_hides_other_columns(spark):
    publish_view(listing(spark).withColumn("metadata", F.lit("x")), "shown_rows")
    assert spark.sql("SELECT count(*) FROM shown_rows WHERE network = 'kusama'").first()[0] == 2
    assert "metadata" not in spark.table("shown_rows").columns


def test_description_lookup(spark):
    shown = spark.createDataFrame([("1", "cut"), ("2", "cut")], "id string, description string")
    full = spark.createDataFrame([("1", "whole"), ("2", "")], "id string, description string")
    assert sorted((r.id, r.description) for r in with_descriptions(shown, full).collect()) == [("1", "whole"), ("2", "cut")]
