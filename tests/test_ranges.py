"""Plans with any window and bounds against every record compared with every plan."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sheaf.plans import ranges as R

D0 = datetime(2021, 1, 1)


def day(n):
    return None if n is None else D0 + timedelta(days=n)


def plain(specs, records, n):
    out = {}
    for q, op, network, kind, a, z, over, under in specs:
        hit = []
        for i, net, typ, at, amount in records:
            if (network is None or net == network) and (kind is None or typ == kind):
                if (a is not None and not (at is not None and at >= a)) or (z is not None and not (at is not None and at < z)):
                    continue
                if (over is not None and not (amount is not None and amount > over)) or (under is not None and not (amount is not None and amount < under)):
                    continue
                hit.append((i, at))
        newest = sorted(hit, key=lambda x: (x[1] is not None, -(x[1] - D0).total_seconds() if x[1] else 0, x[0]))
        ids = sorted(i for i, _ in hit) if op == "sample" else [i for i, _ in newest]
        out[q] = (len(hit), ids[:n])
    return out


RECORDS = [
    (i, ["polkadot", "kusama", None][i % 3], ["TreasuryProposal", "Tip", None][i % 4 % 3], None if i % 11 == 0 else day(i * 7 % 40), None if i % 13 == 0 else float(i % 9 * 100))
    for i in range(400)
] + [(1000 + i, "kusama", "Tip", day(5), 500.0) for i in range(200)]  # one frequent cell
SPECS = [
    (0, "count", None, None, None, None, None, None),
    (1, "newest", "kusama", None, day(5), day(6), None, None),
    (2, "count", "kusama", "Tip", day(0), day(20), 100.0, 500.0),
    (3, "sample", None, "TreasuryProposal", None, day(9), None, 300.0),
    (4, "count", None, None, day(30), day(10), None, None),  # ends before it begins
    (5, "newest", None, None, day(3), None, 800.0, None),
    (6, "sample", "nowhere", None, None, None, 0.0, None),
    (7, "count", None, None, None, None, 500.0, 500.0),
    (8, "newest", None, None, None, None, None, None),
    (9, "newest", None, None, None, None, None, None),
]


@pytest.mark.parametrize("block", [R.BLOCK, 2])
def test_every_plan_against_every_record(spark, block):
    records = spark.createDataFrame(RECORDS, "id long, network string, type string, created_at timestamp, amount_numeric double").repartition(4)
    names = "query_id long, op string, network string, type string, from_ts timestamp, to_ts timestamp, over double, under double"
    plans = spark.createDataFrame(SPECS, names)
    got = {r.query_id: (r["count"], r.examples) for r in R.answer_ranges(plans, records, 5, block).collect()}
    assert got == plain(SPECS, RECORDS, 5)
    empty = R.answer_ranges(plans, records.limit(0), 5, block).collect()
    assert {(r["count"], tuple(r.examples)) for r in empty} == {(0, ())}
    assert R.answer_ranges(plans.limit(0), records).count() == 0


def test_questions_name_windows_and_bounds(spark):
    texts = {
        "How many proposals have amounts over 1000?": ("count", None, None, 1000.0, None),
        "recent kusama proposals in Q4 2020 under $2,500.50": ("newest", datetime(2020, 10, 1), datetime(2021, 1, 1), None, 2500.5),
        "proposals 2021-02-10 to 2021-02-12 above 5": ("sample", datetime(2021, 2, 10), datetime(2021, 2, 13), 5.0, None),
        "How many in August 2025?": ("count", datetime(2025, 8, 1), datetime(2025, 9, 1), None, None),
        "proposals in 2019": ("sample", datetime(2019, 1, 1), datetime(2020, 1, 1), None, None),
        "proposals 2021-02-30 to 2021-03-01": ("sample", datetime(2021, 2, 1), datetime(2021, 3, 1), None, None),
        "nothing at all": ("sample", None, None, None, None),
    }
    rows = R.range_plans(spark.createDataFrame([(t,) for t in texts], "query string")).collect()
    assert {r.query: (r.op, r.from_ts, r.to_ts, r.over, r.under) for r in rows} == texts


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=6), st.lists(st.integers(-2, 32), min_size=1, max_size=20), st.data())
def test_nodes_hold_the_bins_of_a_range_once(bounds, values, data):
    bins = R.Bins(bounds)
    low, high = (data.draw(st.sampled_from([None, *bounds])) for _ in range(2))
    found = bins.of(np.array(values), np.zeros(len(values), bool))
    for span, inside in ((bins.window(low, high), lambda v: (low is None or v >= low) and (high is None or v < high)),
                         (bins.between(low, high), lambda v: (low is None or v > low) and (high is None or v < high))):
        nodes = list(bins.nodes(*span))
        assert len(nodes) <= 2 * bins.size.bit_length()
        for v, b in zip(values, found.tolist(), strict=True):
            above = [(b + bins.size) >> k for k in range(bins.size.bit_length())]
            assert len(set(above) & set(nodes)) == inside(v)
