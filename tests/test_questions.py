import json
import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sheaf.functions import questions as Q
from sheaf.plans import questions as P

ROUTES = [
    ("highest amount in Aug 2025", "sql_agent"),
    ("subsquare proposal", "retrieval_agent"),
    ("hello world", "composer"),
    ("Find Kusama proposals", "sql_agent"),
    ("What treasury proposals exist?", "sql_agent"),
    ("Tell me about subsquare proposal", "retrieval_agent"),
    ("proposal 123456", "sql_agent"),
    ("give me the details", "sql_agent"),
    ("on 1/2/2023", "sql_agent"),
    ("", "composer"),
]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")


def test_routes(spark):
    got = {r.query: r.route for r in P.route(frame(spark, [q for q, _ in ROUTES])).collect()}
    assert got == dict(ROUTES)


def direct_intent(query):
    low = query.lower()

    def any_of(words):
        return any(w in low for w in words)

    if any_of(Q.ID_PHRASES) or ("proposal" in low and any(c.isdigit() for c in query)) or any_of(Q.DETAIL_PHRASES):
        return "exact_lookup"
    if any_of(Q.COUNT_WORDS) and any_of(Q.EXAMPLE_PHRASES):
        return "mixed"
    if any_of(Q.ANALYTIC_WORDS):
        return "analytical"
    if any_of(Q.DATE_WORDS) or any(re.search(p, low) for p in Q.DATE_SHAPES):
        return "date_filtered"
    if any_of(Q.FILTER_NETWORKS + Q.FILTER_TYPES) and any_of(Q.FILTER_VERBS):
        return "filtered"
    general = "proposal" in low and not any(c.isdigit() for c in low) and not any_of(Q.GENERAL_STOPPERS)
    return "semantic" if any_of(Q.SEARCH_PHRASES) or any_of(Q.ENTITIES) or general else "general"


def test_intents_agree_with_a_direct_restatement(spark):
    rng = random.Random(9)
    pieces = sorted({*Q.ID_PHRASES, *Q.DETAIL_PHRASES, *Q.EXAMPLE_PHRASES, *Q.ANALYTIC_WORDS, *Q.DATE_WORDS, *Q.FILTER_NETWORKS, *Q.FILTER_TYPES, *Q.FILTER_VERBS, *Q.SEARCH_PHRASES, *Q.ENTITIES, "proposal", "7", "1/2/2023", "xyz", "Hello"})
    texts = [" ".join(rng.choices(pieces + ["zz"] * 80, k=rng.randint(0, 4))).title() for _ in range(800)]
    got = [r.intent for r in P.route(frame(spark, texts)).orderBy("query_id").collect()]
    assert got == [direct_intent(t) for t in texts]
    assert len(set(got)) == 7


@pytest.mark.parametrize(
    "question,start,end",
    [
        ("How many proposals in August 2025?", datetime(2025, 8, 1), datetime(2025, 9, 1)),
        ("since Dec 2024", datetime(2024, 12, 1), datetime(2025, 1, 1)),
        ("from 2024-02-11", datetime(2024, 2, 1), datetime(2024, 3, 1)),
        ("market of 2024", datetime(2024, 3, 1), datetime(2024, 4, 1)),
        ("august or january 2023", datetime(2023, 1, 1), datetime(2023, 2, 1)),
        ("in May", None, None),
        ("2024-13", None, None),
    ],
)
def test_month_window(spark, question, start, end):
    row = frame(spark, [question]).select(Q.month_window(F.col("query")).alias("w")).first().w
    assert (row and row.from_ts, row and row.to_ts) == (start, end)


def test_word_boundaries_are_optional(spark):
    df = frame(spark, ["anecdote market 2024", "dot in mar 2024"])
    got = df.select(Q.network_of(F.col("query"), True).alias("n"), Q.month_window(F.col("query"), True).alias("w")).collect()
    assert got[0].n is None and got[0].w is None
    assert got[1].n == "polkadot" and got[1].w.from_ts == datetime(2024, 3, 1)
    assert df.select(Q.network_of(F.col("query"))).first()[0] == "polkadot"


def records(spark):
    rows = [
        (str(i), ["polkadot", "kusama"][i % 2], ["TreasuryProposal", "Tip", "Bounty"][i % 3], f"T{i}", "d" * (150 + i * 10), "p", float(i), "Executed", datetime(2025, 7 + i % 3, 1 + i % 5))
        for i in range(40)
    ]
    return spark.createDataFrame(rows, "id string, network string, type string, title string, description string, proposer string, amount_numeric double, status string, created_at timestamp")


QUESTIONS = [
    "How many proposals in August 2025?",
    "Show me some treasury proposals",
    "How many treasury proposals are there?",
    "How many Kusama proposals exist?",
    "Show recent polkadot ones from 2025-09",
    "anything",
    "How many proposals in rococo?",
    "How many proposals in 2024-13?",
]


def answered(spark):
    return P.answer_questions(P.plan_questions(frame(spark, QUESTIONS)), records(spark))


def test_answers_agree_with_direct_filters(spark):
    data = records(spark).collect()
    for r in answered(spark).collect():
        rows = [
            d for d in data
            if (r.type is None or d.type == r.type) and (r.network is None or d.network == r.network)
            and (r.from_ts is None or r.from_ts <= d.created_at < r.to_ts)
        ]
        if r.op == "invalid":
            rows = []
        by_id = sorted(rows, key=lambda d: d.id)
        shown = by_id if r.op == "sample" else sorted(by_id, key=lambda d: d.created_at, reverse=True)
        assert [e.id for e in r.examples] == [d.id for d in shown[:5]], r.query
        assert r["count"] == (len(rows) if r.op == "count" else min(5, len(rows))), r.query


def test_plan_texts(spark):
    texts = {r.query: (r.op, r.plan_text) for r in P.plan_questions(frame(spark, QUESTIONS)).collect()}
    assert texts[QUESTIONS[0]] == ("count", "Count all proposals in created_at >= '2025-08-01' AND created_at < '2025-09-01'")
    assert texts[QUESTIONS[1]] == ("sample", "Get treasury proposals")
    assert texts[QUESTIONS[3]] == ("count", "Count all proposals for kusama")
    assert texts[QUESTIONS[7]][0] == "invalid"


def test_answer_text_reads_back_as_rows(spark):
    out = answered(spark).cache()
    texts = {r.query: r.answer for r in out.collect()}
    assert texts[QUESTIONS[6]] == texts[QUESTIONS[7]] == P.NOTHING_FOUND
    sample = texts[QUESTIONS[1]]
    assert sample.startswith("Found 5 proposals. Here are some examples:\n\n## Proposal 1: T0\n**ID:** 0\n")
    assert "**Amount:** 12.0\n" in sample and "**Created:** 2025-07-01 00:00:00+00:00\n" in sample
    assert "d" * 200 + "..." in sample and "d" * 201 not in sample
    assert "**Amount:**" not in texts[QUESTIONS[0]]
    rows = P.markdown_to_rows(out.select("query_id", "answer")).filter("query_id = 1").orderBy("position").collect()
    assert [(r.id, r.amount_numeric, r.currency) for r in rows] == [("0", None, None), ("12", 12.0, "DOT"), ("15", 15.0, "DOT"), ("18", 18.0, "DOT"), ("21", 21.0, "DOT")]


def test_events_and_responses(spark):
    asked = frame(spark, ["How many proposals are there?", "subsquare proposal", "hello world", "How many proposals in 2024-13?", "subsquare docs"])
    routed = P.route(asked)
    hits = spark.createDataFrame(
        [(1, 1, "7", "Title", "kusama", "Tip", 0.1234567891, datetime(2025, 1, 1), "Title", 0.05, "text", "p", "Executed")],
        "query_id int, rank int, id string, title string, network string, type string, amount double, created_at timestamp, "
        "snippet string, score double, description string, proposer string, status string",
    )
    found_hits = P.compose_hits(asked.filter("query_id < 4"), hits)
    events = P.stage_events(routed, records(spark), found_hits).cache()
    stages = {q: [r.stage for r in events.filter(F.col("query_id") == q).orderBy("seq").collect()] for q in range(5)}
    assert stages[0] == ["router_decision", "sql_result", "final_answer"]
    assert stages[1] == ["router_decision", "retrieval_hits", "final_answer", "proposal_descriptions", "proposals_data"]
    assert stages[2] == ["router_decision", "final_answer"]
    assert stages[3] == ["router_decision", "error"]
    assert stages[4] == ["router_decision", "error"]
    found = {r.query_id: r for r in P.collapse_events(events).collect()}
    assert found[1]["count"] == 1 and json.loads(found[1].results)[0]["id"] == "7"
    assert found[1].response.startswith("Found 1 relevant proposals:\n\n## Proposal 1: Title\n")
    assert "**Amount:** 0.1234567891\n" in found[1].response
    assert found[2].response == P.NOTHING_RELEVANT and found[0].processing_type == "sql_agent"
    assert found[3].response == P.FAILED


def test_amounts_are_shown_in_full(spark):
    values = [0.0, -0.0, 0.1234567891, 1e-7, 0.0001, 0.00012345, 10000.0, 1234567.0, 123456789.125, 9999999999999998.0, 1e16, 1e22, -3.25, 1e-12, 3e-5, 0.1, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(P.plain_number(F.col("v"))).collect()] == [None if v is None else repr(v or 0.0) for v in values]


def test_more_examples_and_whole_descriptions(spark):
    plans = P.plan_questions(frame(spark, ["Show me treasury proposals"]))
    row = P.answer_questions(plans, records(spark), n=7).first()
    assert row.answer.count("## Proposal ") == len(row.examples) == 7
    whole = P.compose(P.answer_questions(plans, records(spark)), chars=None).first().answer
    assert max(len(r.description) for r in records(spark).collect()) > 200 and "d" * 201 in whole


def test_model_replies(spark):
    replies = [
        ("q", '```json\n{"plan": "p", "sql": "SELECT 1"}\n```', ("SELECT 1", False)),
        ("q", 'Sure: {"sql": "(select 1); DROP TABLE x"} done', ("select 1", False)),
        ("q", '{"sql": ["SELECT 1"]}', (None, True)),
        ("q", '{"plan": "p"}', (None, True)),
        ("q", "no json", (None, True)),
        ("q", '{"sql": "SELECT', (None, True)),
        ("How many?", '{"sql": "WITH a AS (SELECT 1) SELECT 2"}', ("WITH a AS (SELECT 1) SELECT 2", True)),
        ("List", '{"sql": "WITH a AS (SELECT 1) SELECT 2"}', ("WITH a AS (SELECT 1) SELECT 2", False)),
    ]
    df = spark.createDataFrame([(i, q, r) for i, (q, r, _) in enumerate(replies)], "i int, query string, response string")
    got = [(r.sql, r.use_fallback) for r in P.parse_model_json(df).orderBy("i").collect()]
    assert got == [expected for _, _, expected in replies]


def test_json_arrays_in_text(spark):
    texts = ['x [{"id": "1", "amount_numeric": 2}] y', 'Data: [{"id": "a"}, {"id": "b"}]', '[{"id": "1"', "plain", '[\n{"id": "z"}\n]']
    df = spark.createDataFrame(list(enumerate(texts)), "query_id int, content string")
    got = sorted((r.query_id, r.position, r.id) for r in P.json_array_rows(df).collect())
    assert got == [(0, 0, "1"), (1, 0, "a"), (1, 1, "b"), (4, 0, "z")]


def test_count_question(spark):
    df = frame(spark, ["HOW MANY", "The Total", "none"])
    assert [r[0] for r in df.orderBy("query_id").select(Q.is_count_question(F.col("query"))).collect()] == [True, True, False]


def test_responses_sum_up_no_examples(spark):
    """Of a plan's result only plan and count are sorted by question, of the hits' repeats nothing; the response is the same."""
    examples = '[{"id":"1","title":"a,\\"examples\\":b"}]'
    rows = [
        (1, "sql_result", f'{{"plan":"p \\",\\"examples\\": q","count":7,"examples":{examples}}}'),
        (1, "final_answer", '{"answer":"yes","metadata":{"processing_type":"sql_agent"}}'),
        (2, "retrieval_hits", '{"hits":[{"id":"h,\\"examples\\":"}],"count":1}'),
        (2, "proposals_data", '{"proposals":[{"id":"h"}]}'),
        (3, "router_decision", '{"decision":"composer"}'),
        (4, "sql_result", '{"examples":[],"plan":"later"}'),
        (4, "sql_result", '{"count":1,"examples":[],"plan":"even later"}'),
    ]
    found = P.collapse_events(spark.createDataFrame(rows, "query_id int, stage string, payload string"))
    got = {r.query_id: r for r in found.collect()}
    assert (got[1].plan, got[1].response, got[1].processing_type) == ('p ","examples": q', "yes", "sql_agent")
    assert (got[2].results, got[2]["count"]) == ('[{"id":"h,\\"examples\\":"}]', 1)
    assert got[3].response == "No response generated" and got[4].plan == "later"
    assert "substring_index(payload" in found._jdf.queryExecution().optimizedPlan().toString()
