import json
import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sheaf.functions import normalize as N
from sheaf.functions import text as X
from sheaf.operators.filters import split_valid
from sheaf.plans.ingest import normalize, valid_and_rejected

AS_OF = datetime(2025, 1, 1)


def one(spark, values, fn, type="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {type}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_network(spark):
    values = [None, "", "DOT", " ksm ", "Westend", "  ", "Polkadot"]
    expected = ["polkadot", "polkadot", "polkadot", "kusama", "westend", "", "polkadot"]
    assert one(spark, values, N.normalize_network) == expected


def test_type(spark):
    values = ["treasury_proposal", "CHILDBOUNTY", " Other ", None, "", "DemocracyProposal", " referendum_v2", "tech_committee_proposal"]
    expected = ["TreasuryProposal", "ChildBounty", " Other ", "Unknown", "Unknown", "DemocracyProposal", "ReferendumV2", "TechCommitteeProposal"]
    assert one(spark, values, N.normalize_type) == expected


def test_type_words(spark):
    assert one(spark, ["Treasury", "tech", "Weird"], N.type_from_word) == ["TreasuryProposal", "TechCommitteeProposal", "Weird"]


def test_amount(spark):
    values = ["$1,000.50", "$ 100", "1_000", "1d", "abc", "7", None, "", "1e3", ".5", "5.", "£-2", "1__0", "--1", "1 0", "\t3\n"]
    expected = [1000.5, 100.0, 1000.0, None, None, 7.0, None, None, 1000.0, 0.5, 5.0, -2.0, None, None, None, 3.0]
    assert one(spark, values, N.normalize_amount) == expected


def test_amount_agrees_with_python_floats(spark):
    rng = random.Random(5)
    values = ["".join(rng.choice("0123456789.,-+eE_$ f") for _ in range(rng.randint(0, 7))) for _ in range(600)]

    def direct(v):
        bare = re.sub("[,$€£]", "", v.strip())
        try:
            return float(bare)
        except ValueError:
            return None

    assert one(spark, values, N.normalize_amount) == [direct(v) for v in values]


def test_currency(spark):
    assert one(spark, ["dot", "", None, " usd ", "xyz"], N.normalize_currency) == ["DOT", None, None, "USD", "XYZ"]


def test_created_at(spark):
    values = [
        "2024-12-03T01:02:03.123Z",
        "2024-12-03T01:02:03Z",
        "2024-12-03 01:02:03",
        "2024-12-03T01:02:03",
        "2024-12-03",
        "2024-1-5",
        "Jan 5, 2024",
        "x",
        None,
        "2024-12-03T01:02:03+02:00",
    ]
    got = one(spark, values, lambda c: N.normalize_created_at(c, AS_OF).cast("string"))
    assert got == [
        "2024-12-03 01:02:03.123",
        "2024-12-03 01:02:03",
        "2024-12-03 01:02:03",
        "2024-12-03 01:02:03",
        "2024-12-03 00:00:00",
        "2024-01-05 00:00:00",
        "2024-01-05 00:00:00",
        "2025-01-01 00:00:00",
        "2025-01-01 00:00:00",
        "2024-12-02 23:02:03",
    ]


def test_token_estimate(spark):
    assert one(spark, ["a b  c", "", "  "], N.token_estimate) == [pytest.approx(3.9), 0.0, 0.0]


RAW = [
    {"id": "7", "network": "DOT", "type": "treasury_proposal", "title": " A  title ", "description": "One.\nTwo", "amount": "$1,000.50", "currency": "dot", "created_at": "2024-12-03", "extra": "x"},
    {"index": 5, "network": "kusama", "proposalType": "Tip", "content": "from content", "onChainInfo": {"type": "T", "proposer": "p1", "status": "Executed"}},
    {"index": 0, "network": "kusama", "onChainInfo": {"type": "Bounty", "proposer": None, "status": None}},
    {"id": "7", "network": "ksm", "title": "second with the same id"},
    {"id": "9", "network": "Westend", "title": "not allowed"},
]


def raw(spark):
    lines = spark.createDataFrame([(json.dumps(r),) for r in RAW], "value string").coalesce(1)
    schema = (
        "id string, index long, network string, type string, proposalType string, title string, description string, "
        "content string, proposer string, amount string, currency string, status string, created_at string, "
        "onChainInfo struct<type:string,proposer:string,status:string>, extra string"
    )
    parsed = lines.select(F.from_json("value", schema).alias("r"), F.monotonically_increasing_id().alias("n"))
    return parsed.select("r.*", F.struct("n").alias("_origin"))


def test_normalize(spark):
    rows = normalize(raw(spark), AS_OF).orderBy("_origin").collect()
    first, second, third = rows[:3]
    assert (first.id, first.network, first.type, first.title) == ("7", "polkadot", "TreasuryProposal", "A  title")
    assert (first.amount_numeric, first.currency, first.status) == (1000.5, "DOT", "pending")
    assert first.doc_text == "A title One  Two"
    assert json.loads(first.metadata) == {"index": None, "extra": "x"}
    assert (second.id, second.type, second.description) == ("kusama_5", "Tip", "from content")
    assert (second.proposer, second.status) == ("p1", "Executed")
    assert second.created_at == AS_OF
    assert re.fullmatch("kusama_[0-9a-f]{12}", third.id) and third.type == "Bounty" and third.status == "pending"


def test_amount_follows_column_presence(spark):
    df = spark.createDataFrame([("1", None, 5.0)], "id string, amount string, amount_numeric double")
    assert normalize(df, AS_OF).first().amount_numeric is None
    assert normalize(df.drop("amount"), AS_OF).first().amount_numeric == 5.0


def test_valid_and_rejected(spark):
    ok, refused = valid_and_rejected(raw(spark), AS_OF)
    assert sorted(r.title or "" for r in ok.collect()) == ["", "", "A  title"]
    assert [(r.id, r.reason) for r in refused.collect()] == [("9", "network not allowed")]


def test_split_valid_reasons(spark):
    df = spark.createDataFrame(
        [(None, "polkadot", "T", AS_OF), ("1", None, "T", AS_OF), ("2", "kusama", None, AS_OF), ("3", "kusama", "T", None), ("4", "kusama", "T", AS_OF)],
        "id string, network string, type string, created_at timestamp",
    )
    ok, bad = split_valid(df)
    assert [r.id for r in ok.collect()] == ["4"]
    assert sorted(r.reason for r in bad.collect()) == ["created_at is null", "id is null", "network is null", "type is null"]


def test_clean_doc_text_agrees_with_python(spark):
    rng = random.Random(3)
    alphabet = "abcXYZ éüß0189_-.,!?()\t\n\x07\x85 %$€中"
    pairs = [("".join(rng.choices(alphabet, k=rng.randint(0, 30))), "".join(rng.choices(alphabet, k=rng.randint(0, 900)))) for _ in range(200)]
    pairs.append(("t", "word " * 400))

    def direct(title, description):
        text = f"{title or ''} {description or ''}".strip()
        text = re.sub(r"[\x00-\x1f\x7f-\x9f]", " ", text)
        text = re.sub(r"\s+", " ", text)
        return re.sub(r"[^\w\s]", " ", text).strip()[:1000]

    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, t string, d string")
    got = [r[0] for r in df.orderBy("i").select(X.clean_doc_text(F.col("t"), F.col("d"))).collect()]
    assert got == [direct(*p) for p in pairs]


def test_embedding_text(spark):
    df = spark.createDataFrame(
        [("T", "d" * 2100, "Unknown", "kusama", "Tip"), ("", "No description available", "p", None, None), (None, None, None, None, None)],
        "title string, description string, proposer string, network string, type string",
    )
    c = F.col
    got = [r[0] for r in df.select(X.embedding_text("structured", c("title"), c("description"), c("proposer"), c("network"), c("type"))).collect()]
    assert got == ["Title: T\nNetwork: kusama\nType: Tip\nDescription: " + "d" * 2000 + "...", "Proposer: p", ""]
    plain = [r[0] for r in df.select(X.embedding_text("plain", c("title"), c("description"))).collect()]
    assert plain == ["T\n" + "d" * 2100, "No description available", ""]
    capped = df.select(X.embedding_text("capped", c("title"), c("description"), max_description=10, max_total=8)).first()[0]
    assert capped == "T\ndddddd..."


def test_snippet(spark):
    df = spark.createDataFrame([("t", "d"), ("", "d" * 200), (None, "d"), (None, None)], "t string, d string")
    got = [r[0] for r in df.select(X.snippet(F.col("t"), F.col("d"))).collect()]
    assert got == ["t", "d" * 150 + "...", "d", "No description available"]
