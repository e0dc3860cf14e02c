"""Questions in bulk: routing, plans, answers, events, and reading of answer texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sheaf.functions import questions as Q
from sheaf.operators.hybrid import hybrid_search
from sheaf.plans import questions as P
from sheaf.session import written
from workload import bindings as B
from workload.registry import query
from workload.search import HYBRID_SQL


def _any(phrases) -> str:
    return "(" + " OR ".join(f"contains(l, '{p}')" for p in phrases) + ")"


_INTENT = f"""CASE
  WHEN {_any(Q.ID_PHRASES)} OR (contains(l, 'proposal') AND regexp_matches(q, '\\p{{Nd}}')) OR {_any(Q.DETAIL_PHRASES)} THEN 'exact_lookup'
  WHEN {_any(Q.COUNT_WORDS)} AND {_any(Q.EXAMPLE_PHRASES)} THEN 'mixed'
  WHEN {_any(Q.ANALYTIC_WORDS)} THEN 'analytical'
  WHEN {_any(Q.DATE_WORDS)} OR regexp_matches(l, '\\d{{4}}-\\d{{2}}-\\d{{2}}|\\d{{2}}/\\d{{2}}/\\d{{4}}|\\d{{4}}/\\d{{2}}/\\d{{2}}|\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}')
    THEN 'date_filtered'
  WHEN {_any(Q.FILTER_NETWORKS + Q.FILTER_TYPES)} AND {_any(Q.FILTER_VERBS)} THEN 'filtered'
  WHEN {_any(Q.SEARCH_PHRASES)} OR {_any(Q.ENTITIES)} OR (contains(l, 'proposal') AND NOT regexp_matches(l, '\\p{{Nd}}')
    AND NOT {_any(Q.GENERAL_STOPPERS)}) THEN 'semantic'
  ELSE 'general' END"""
_ROUTE = "CASE intent WHEN 'semantic' THEN 'retrieval_agent' WHEN 'general' THEN 'composer' ELSE 'sql_agent' END"


@query(
    "route_conversations",
    f"""SELECT *, {_ROUTE} AS route FROM (SELECT conv_id, turn, {_INTENT} AS intent
    FROM (SELECT conv_id, turn, text AS q, lower(text) AS l FROM conversations WHERE role = 'user'))""",
)
def route_conversations(spark, sf_dir):
    return P.route(B.talk_questions(spark, sf_dir)).drop("query")


@query(
    "route_questions",
    f"""SELECT *, {_ROUTE} AS route FROM (SELECT query_id, {_INTENT} AS intent
    FROM (SELECT query_id, query AS q, lower(query) AS l FROM ({B.CHAIN_QUESTIONS_SQL})))""",
)
def route_questions(spark, sf_dir):
    return P.route(B.chain_questions(spark, sf_dir)).drop("query")


@query(
    "intent_flags",
    f"""SELECT doc_id, {_any(Q.COUNT_WORDS)} AND {_any(Q.EXAMPLE_PHRASES)} AS mixed, {_any(Q.ANALYTIC_WORDS)} AS analytical,
      {_any(Q.FILTER_NETWORKS + Q.FILTER_TYPES)} AND {_any(Q.FILTER_VERBS)} AS filtered,
      regexp_matches(l, 'count|how many|total|number of') AS count_question
    FROM (SELECT doc_id, lower(text) AS l FROM documents)""",
)
def intent_flags(spark, sf_dir):
    text = F.col("text")
    return B.spread(B.table(spark, sf_dir, "documents").select("doc_id", "text"), B.PARTS).select(
        "doc_id",
        Q.is_mixed(text).alias("mixed"),
        Q.is_analytical(text).alias("analytical"),
        Q.is_filtered(text).alias("filtered"),
        Q.is_count_question(text).alias("count_question"),
    )


_MONTH = "CASE " + " ".join(f"WHEN contains(l, '{w}') THEN {n}" for w, n in Q.MONTHS) + " END"
_NETWORK = "CASE " + " ".join(f"WHEN contains(l, '{w}') THEN '{n}'" for w, n in Q.NETWORK_WORDS) + " END"


@query(
    "question_network",
    f"SELECT conv_id, turn, {_NETWORK} AS network FROM (SELECT conv_id, turn, lower(text) AS l FROM conversations WHERE role = 'user')",
)
def question_network(spark, sf_dir):
    return B.talk_questions(spark, sf_dir).select("conv_id", "turn", Q.network_of(F.col("query")).alias("network"))


_WINDOW = f"""
  w AS (SELECT query_id, l, {_MONTH} AS m, nullif(regexp_extract(l, '(\\d{{4}})', 1), '') AS y,
      nullif(regexp_extract(l, '(\\d{{4}})-(\\d{{2}})', 0), '') AS ym FROM l),
  d AS (SELECT query_id, l, CASE WHEN m IS NOT NULL AND y IS NOT NULL THEN make_date(y::INTEGER, m, 1)
      WHEN ym IS NOT NULL THEN (ym || '-01')::DATE END AS first FROM w)"""


@query(
    "question_month",
    f"""WITH l AS (SELECT o_orderkey AS query_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'in ' || lower(strftime(o_orderdate, '%B %Y'))
        WHEN '2-HIGH' THEN lower(strftime(o_orderdate, '%b, %Y')) || ' decide' WHEN '3-MEDIUM' THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'no date, maybe' END AS l FROM orders), {_WINDOW}
    SELECT query_id, first::TIMESTAMP AS from_ts, (first + INTERVAL 1 MONTH)::TIMESTAMP AS to_ts FROM d""",
)
def question_month(spark, sf_dir):
    o = B.table(spark, sf_dir, "orders")
    p, d = F.col("o_orderpriority"), F.col("o_orderdate")
    text = (
        F.when(p == "1-URGENT", F.concat(F.lit("In "), F.date_format(d, "MMMM yyyy")))
        .when(p == "2-HIGH", F.concat(F.date_format(d, "MMM, yyyy"), F.lit(" decide")))
        .when(p == "3-MEDIUM", F.date_format(d, "yyyy-MM-dd"))
        .otherwise("no date, maybe")
    )
    window = Q.month_window(text)
    return o.select(
        F.col("o_orderkey").alias("query_id"),
        window["from_ts"].cast("timestamp_ntz").alias("from_ts"),
        window["to_ts"].cast("timestamp_ntz").alias("to_ts"),
    )


_PLANS = f"""
  q AS ({B.CHAIN_QUESTIONS_SQL}), l AS (SELECT query_id, query, lower(query) AS l FROM q), {_WINDOW},
  f AS (SELECT query_id, l, first, contains(l, 'how many') AND contains(l, 'proposals') AS counting,
      contains(l, 'show') AND contains(l, 'recent') AS recent, contains(l, 'treasury') AS treasury, {_NETWORK} AS network FROM d),
  plans AS (SELECT query_id, CASE WHEN counting THEN 'count' WHEN recent THEN 'newest' ELSE 'sample' END AS op,
      CASE WHEN treasury AND (counting OR (NOT recent AND contains(l, 'show'))) THEN 'TreasuryProposal' END AS type, network,
      first::TIMESTAMP AS from_ts, (first + INTERVAL 1 MONTH)::TIMESTAMP AS to_ts, CASE WHEN NOT counting THEN 5 END AS "limit",
      concat_ws(' ', CASE WHEN counting AND treasury THEN 'Count treasury proposals' WHEN counting THEN 'Count all proposals'
          WHEN recent THEN 'Get recent proposals' WHEN contains(l, 'show') AND treasury THEN 'Get treasury proposals' ELSE 'Get sample proposals' END,
        'for ' || network, 'in created_at >= ''' || strftime(first, '%Y-%m-%d') || ''' AND created_at < ''' || strftime(first + INTERVAL 1 MONTH, '%Y-%m-%d') || '''') AS plan_text
    FROM f)"""


@query("question_plans", f"WITH {_PLANS} SELECT * FROM plans")
def question_plans(spark, sf_dir):
    plans = P.plan_questions(B.chain_questions(spark, sf_dir)).drop("query")
    return plans.withColumn("from_ts", F.col("from_ts").cast("timestamp_ntz")).withColumn("to_ts", F.col("to_ts").cast("timestamp_ntz"))


_ANSWERS = f"""{_PLANS},
  r AS ({B.CHAIN_SQL}),
  p AS (SELECT DISTINCT op, type, network, from_ts, to_ts FROM plans),
  hit AS (SELECT p.op, p.type AS want, p.network AS net, p.from_ts, r.*,
      row_number() OVER (PARTITION BY p.op, p.type, p.network, p.from_ts ORDER BY CASE WHEN p.op <> 'sample' THEN r.created_at END DESC, r.id) AS position,
      count(*) OVER (PARTITION BY p.op, p.type, p.network, p.from_ts) AS total
    FROM p JOIN r ON (p.type IS NULL OR r.type = p.type) AND (p.network IS NULL OR r.network = p.network)
      AND (p.from_ts IS NULL OR (r.created_at >= p.from_ts AND r.created_at < p.to_ts))),
  shown AS (SELECT * FROM hit WHERE position <= 5),
  joined AS (SELECT plans.query_id, plans.op, plans.plan_text, s.position, s.id, s.total, s.title, s.created_at, s.type AS record_type,
      s.network AS record_network, s.proposer, s.status, s.amount_numeric, s.description
    FROM plans LEFT JOIN shown s ON plans.op = s.op AND plans.type IS NOT DISTINCT FROM s.want
      AND plans.network IS NOT DISTINCT FROM s.net AND plans.from_ts IS NOT DISTINCT FROM s.from_ts)"""


@query(
    "answers",
    f"""WITH {_ANSWERS} SELECT query_id, coalesce(CASE WHEN op = 'count' THEN total ELSE count(position) OVER (PARTITION BY query_id) END, 0) AS count,
      position::INTEGER AS position, id FROM joined""",
)
def answers(spark, sf_dir):
    found = P.answer_questions(P.plan_questions(B.chain_questions(spark, sf_dir)), B.chain_records(spark, sf_dir))
    return found.select("query_id", "count", F.explode_outer("examples").alias("e")).select("query_id", "count", "e.position", "e.id")


_ANY_TYPE = _ANSWERS.replace("(p.type IS NULL OR r.type = p.type)", "(p.type IS NULL OR p.op = 'count' OR r.type = p.type)")


@query("answers_ignoring_type", f"WITH {_ANY_TYPE} SELECT query_id, position::INTEGER AS position, id FROM joined WHERE position IS NOT NULL")
def answers_ignoring_type(spark, sf_dir):
    plans = P.plan_questions(B.chain_questions(spark, sf_dir))
    found = P.answer_questions(plans, B.chain_records(spark, sf_dir), examples_ignore_type=True)
    return found.select("query_id", F.explode("examples").alias("e")).select("query_id", "e.position", "e.id")


_TEXTS = f"""{_ANSWERS},
  t AS (SELECT *, amount_numeric::VARCHAR AS a FROM joined),
  s AS (SELECT query_id, op, position, total, '## Proposal ' || position || ': ' || title || chr(10) || '**ID:** ' || id || chr(10) ||
      '**Type:** ' || record_type || chr(10) || '**Network:** ' || CASE op WHEN 'count' THEN 'Unknown' ELSE record_network END || chr(10) ||
      '**Proposer:** ' || CASE op WHEN 'count' THEN 'Unknown' ELSE proposer END || chr(10) ||
      '**Status:** ' || CASE op WHEN 'count' THEN 'Unknown' ELSE status END || chr(10) ||
      '**Created:** ' || strftime(created_at, '%Y-%m-%d %H:%M:%S') || '+00:00' || chr(10) ||
      CASE WHEN op <> 'count' AND amount_numeric <> 0 THEN '**Amount:** ' || a || chr(10) ELSE '' END ||
      '**Description:** ' || CASE op WHEN 'count' THEN 'No description available' ELSE description END || chr(10) || chr(10) AS section FROM t),
  answers AS (SELECT query_id, CASE WHEN count(position) = 0 THEN 'No proposals found matching your criteria.' ELSE
      'Found ' || max(CASE WHEN op = 'count' THEN total ELSE position END) || ' proposals. Here are some examples:' || chr(10) || chr(10) || string_agg(section, '' ORDER BY position) END AS answer
    FROM s GROUP BY query_id)"""


def _answered(spark, sf_dir):
    return P.answer_questions(P.plan_questions(B.chain_questions(spark, sf_dir)), B.chain_records(spark, sf_dir))


@query("answer_texts", f"WITH {_TEXTS} SELECT query_id, answer FROM answers")
def answer_texts(spark, sf_dir):
    return _answered(spark, sf_dir).select("query_id", "answer")


@query(
    "markdown_rows",
    f"""WITH {_TEXTS} SELECT query_id, position::INTEGER AS position, id::VARCHAR AS id, title, record_type AS type,
      CASE op WHEN 'count' THEN 'Unknown' ELSE record_network END AS network, CASE op WHEN 'count' THEN 'Unknown' ELSE status END AS status,
      CASE WHEN op <> 'count' THEN amount_numeric END AS amount_numeric, CASE WHEN op <> 'count' THEN 'DOT' END AS currency
    FROM joined WHERE position IS NOT NULL""",
)
def markdown_rows(spark, sf_dir):
    """Answer texts read back into rows."""
    rows = P.markdown_to_rows(_answered(spark, sf_dir).select("query_id", "answer"))
    return rows.select("query_id", "position", "id", "title", "type", "network", "status", "amount_numeric", "currency")


def _sections_sql(rows: str, keys: str) -> str:
    """Numbered sections of result rows, as text."""
    return f"""SELECT {keys}, position, '## Proposal ' || position || ': ' || CASE WHEN title = '' THEN 'Untitled' ELSE title END || chr(10) || '**ID:** ' || id || chr(10) ||
      '**Type:** ' || type || chr(10) || '**Network:** ' || network || chr(10) || '**Proposer:** ' || coalesce(proposer, 'Unknown') || chr(10) ||
      '**Status:** ' || coalesce(status, 'Unknown') || chr(10) || '**Created:** ' || coalesce(strftime(created_at, '%Y-%m-%d %H:%M:%S') || '+00:00', 'Unknown') || chr(10) ||
      CASE WHEN amount <> 0 THEN '**Amount:** ' || amount::VARCHAR || chr(10) ELSE '' END || '**Description:** ' ||
      (CASE WHEN length(description) > 200 THEN substring(description, 1, 200) || '...' WHEN description = '' THEN 'No description available' ELSE description END) || chr(10) || chr(10) AS section
    FROM {rows}"""


_NOTHING = "I couldn''t find any relevant information for your query."


@query(
    "hit_answers",
    f"""WITH found AS ({HYBRID_SQL}),
    kept AS (SELECT query_id, id, title, network, type, NULL::DOUBLE AS amount, NULL::VARCHAR AS proposer, NULL::VARCHAR AS status, NULL::TIMESTAMP AS created_at, description,
        row_number() OVER (PARTITION BY query_id ORDER BY rank)::INTEGER AS position FROM found WHERE score >= 0.015),
    sections AS ({_sections_sql("kept", "query_id")}),
    texts AS (SELECT query_id, count(*) AS count, string_agg(section, '' ORDER BY position) AS body FROM sections GROUP BY query_id)
    SELECT item_id AS query_id, text AS query, coalesce(count, 0) AS count,
      CASE WHEN count IS NULL THEN '{_NOTHING}' ELSE 'Found ' || count || ' relevant proposals:' || chr(10) || chr(10) || body END AS answer
    FROM benchmark JOIN embeddings ON item_id = vec_id LEFT JOIN texts ON item_id = query_id""",
)
def hit_answers(spark, sf_dir):
    """Search results as answer texts."""
    asked = B.benchmark_queries(spark, sf_dir)
    found = hybrid_search(asked, B.document_records(spark, sf_dir), B.document_embeddings(spark, sf_dir))
    return P.compose_hits(asked.select("query_id", "query"), found).select("query_id", "query", "count", "answer")


def _searched(spark, sf_dir, routed):
    """Results for the questions about customers: the customer's orders, newest first."""
    o = B.chain_records(spark, sf_dir).withColumn("customer", F.col("proposer"))
    number = F.translate(F.regexp_extract("query", "customer ([a-j]+)$", 1), "abcdefghij", "0123456789")
    asked = routed.filter(F.col("route") == P.SEARCHED).select("query_id", "query", F.concat(F.lit("c"), number).alias("customer"))
    order = Window.partitionBy("customer").orderBy(F.col("created_at").desc(), "id")
    best = o.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= 10)
    hits = asked.select("query_id", "customer").join(best, "customer").select(
        "query_id", "rank", "id", "title", "network", "type", F.col("amount_numeric").alias("amount"), "created_at",
        F.col("title").alias("snippet"), (F.lit(0.02) - F.col("rank") * 0.001).alias("score"), "description", "proposer", "status",
    )
    return P.compose_hits(asked.select("query_id", "query"), hits)


_SEARCHED = f"""
  i AS (SELECT query_id, {_INTENT} AS intent FROM (SELECT query_id, query AS q, lower(query) AS l FROM q)),
  rt AS (SELECT query_id, {_ROUTE} AS route FROM i),
  best AS (SELECT *, row_number() OVER (PARTITION BY proposer ORDER BY created_at DESC, id)::INTEGER AS position FROM r QUALIFY position <= 5),
  asked AS (SELECT query_id, 'c' || o_custkey AS proposer FROM rt JOIN orders ON query_id = o_orderkey WHERE route = 'retrieval_agent'),
  hits AS (SELECT query_id, position, id, title, network, type, amount_numeric AS amount, created_at, description, proposer, status FROM asked JOIN best USING (proposer)),
  hit_sections AS ({_sections_sql("hits", "query_id, id")}),
  searched AS (SELECT query_id, count(*) AS count, 'Found ' || count(*) || ' relevant proposals:' || chr(10) || chr(10) || string_agg(section, '' ORDER BY position) AS answer,
      string_agg(id::VARCHAR, ',' ORDER BY position) AS ids FROM hit_sections GROUP BY query_id),
  n AS (SELECT query_id, any_value(op) AS op, coalesce(max(CASE WHEN op = 'count' THEN total ELSE position END), 0) AS n FROM joined GROUP BY query_id)"""


@query(
    "stage_events",
    f"""WITH {_TEXTS}, {_SEARCHED}
    SELECT query_id, 1 AS seq, 'router_decision' AS stage, '{{"decision":"' || route || '"}}' AS payload, NULL::BIGINT AS count FROM rt
    UNION ALL SELECT query_id, 2, 'sql_result', plan_text, n FROM rt JOIN plans USING (query_id) JOIN n USING (query_id) WHERE route = 'sql_agent'
    UNION ALL SELECT query_id, 3, 'final_answer', md5(answer), NULL FROM rt JOIN answers USING (query_id) WHERE route = 'sql_agent'
    UNION ALL SELECT query_id, 3, 'final_answer', md5('{_NOTHING}'), NULL FROM rt WHERE route = 'composer'
    UNION ALL SELECT query_id, 2, 'retrieval_hits', ids, count FROM searched
    UNION ALL SELECT query_id, 3, 'final_answer', md5(answer), NULL FROM searched
    UNION ALL SELECT query_id, seq, stage, ids, NULL FROM searched, (VALUES (4, 'proposal_descriptions'), (5, 'proposals_data')) s(seq, stage)""",
)
def stage_events(spark, sf_dir):
    """All events of all questions; of results and proposals, the ids are compared."""
    routed = written(P.route(B.chain_questions(spark, sf_dir)), "routed")
    events = P.stage_events(routed, B.chain_records(spark, sf_dir), _searched(spark, sf_dir, routed))
    rows = F.from_json("payload", "hits array<struct<id:string>>, proposals array<struct<id:string>>")
    ids = F.array_join(F.transform(F.coalesce(rows["hits"], rows["proposals"]), lambda x: x["id"]), ",")
    payload = (
        F.when(F.col("stage") == "sql_result", F.get_json_object("payload", "$.plan"))
        .when(F.col("stage") == "final_answer", F.md5(F.get_json_object("payload", "$.answer")))
        .when(F.col("stage") == "router_decision", F.col("payload"))
        .otherwise(ids)
    )
    return events.select("query_id", "seq", "stage", payload.alias("payload"), F.get_json_object("payload", "$.count").cast("long").alias("count"))


_SEARCH_EVENTS = f"""
  WITH q AS (SELECT item_id AS query_id, item_id % 4 = 0 AS dated, item_id % 4 <> 1 AS searched, text,
      CASE WHEN item_id % 4 = 0 THEN 'Show recent kusama proposals from 2021-' || CASE WHEN item_id % 8 = 0 THEN '13' ELSE '03' END
        ELSE 'Explain ' || text END AS query FROM benchmark JOIN embeddings ON item_id = vec_id),
  l AS (SELECT query_id, dated, searched, query AS q, lower(query) AS l FROM q),
  i AS (SELECT query_id, dated, searched, l, {_INTENT} AS intent FROM l),
  rt AS (SELECT query_id, dated, searched, l, {_ROUTE} AS route FROM i),
  found AS ({HYBRID_SQL}),
  kept AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rank)::INTEGER AS position FROM found WHERE score >= 0.015),
  hits AS (SELECT query_id, string_agg(id::VARCHAR, ',' ORDER BY position) AS ids, count(*) AS n FROM kept GROUP BY query_id),
  s AS (SELECT rt.query_id, searched, coalesce(n, 0) AS n, coalesce(ids, '') AS ids FROM rt LEFT JOIN hits USING (query_id) WHERE route = 'retrieval_agent')
  SELECT query_id, 1 AS seq, 'router_decision' AS stage, route AS payload FROM rt
  UNION ALL SELECT query_id, 3, 'error', 'no such month' FROM rt WHERE route = 'sql_agent' AND query_id % 8 = 0
  UNION ALL SELECT query_id, 2, 'sql_result', NULL FROM rt WHERE route = 'sql_agent' AND query_id % 8 <> 0
  UNION ALL SELECT query_id, 3, 'final_answer', NULL FROM rt WHERE route = 'sql_agent' AND query_id % 8 <> 0
  UNION ALL SELECT query_id, 3, 'final_answer', NULL FROM rt WHERE route = 'composer'
  UNION ALL SELECT query_id, 3, 'error', 'no search results' FROM s WHERE NOT searched
  UNION ALL SELECT query_id, 2, 'retrieval_hits', n || ':' || ids FROM s WHERE searched
  UNION ALL SELECT query_id, 3, 'final_answer', NULL FROM s WHERE searched
  UNION ALL SELECT query_id, seq, stage, ids FROM s, (VALUES (4, 'proposal_descriptions'), (5, 'proposals_data')) v(seq, stage) WHERE searched AND n > 0"""


@query("search_events", _SEARCH_EVENTS)
def search_events(spark, sf_dir):
    """Events of a hybrid search, of months that do not exist, and of questions nothing was searched for."""
    b = B.benchmark_queries(spark, sf_dir)
    month = F.when(F.col("query_id") % 8 == 0, "13").otherwise("03")
    dated = F.concat(F.lit("Show recent kusama proposals from 2021-"), month)
    text = F.when(F.col("query_id") % 4 == 0, dated).otherwise(F.concat(F.lit("Explain "), F.col("query")))
    routed = written(P.route(b.select("query_id", text.alias("query"))), "routed")
    asked = routed.filter((F.col("route") == P.SEARCHED) & (F.col("query_id") % 4 != 1)).select("query_id")
    wanted = b.join(asked, "query_id", "left_semi")
    found = hybrid_search(wanted, B.document_records(spark, sf_dir), B.document_embeddings(spark, sf_dir))
    hits = P.compose_hits(wanted.select("query_id", "query"), found)
    records = B.document_records(spark, sf_dir).withColumn("created_at", F.lit(B.AS_OF))
    events = P.stage_events(routed, records, hits)
    rows = F.from_json("payload", "hits array<struct<id:string>>, proposals array<struct<id:string>>")
    ids = F.array_join(F.transform(F.coalesce(rows["hits"], rows["proposals"]), lambda x: x["id"]), ",")
    payload = (
        F.when(F.col("stage") == "router_decision", F.get_json_object("payload", "$.decision"))
        .when(F.col("stage") == "error", F.get_json_object("payload", "$.error"))
        .when(F.col("stage") == "retrieval_hits", F.concat_ws(":", F.get_json_object("payload", "$.count"), ids))
        .when(F.col("stage").isin("proposal_descriptions", "proposals_data"), ids)
    )
    return events.select("query_id", "seq", "stage", payload.alias("payload"))


@query(
    "responses",
    f"""WITH {_TEXTS}, {_SEARCHED}
    SELECT query_id, CASE route WHEN 'sql_agent' THEN a.answer WHEN 'retrieval_agent' THEN s.answer ELSE '{_NOTHING}' END AS response,
      CASE route WHEN 'sql_agent' THEN plan_text END AS plan, s.ids AS results, coalesce(s.count, 0) AS count, route AS processing_type
    FROM rt LEFT JOIN answers a USING (query_id) LEFT JOIN plans USING (query_id) LEFT JOIN searched s USING (query_id)""",
)
def responses(spark, sf_dir):
    routed = written(P.route(B.chain_questions(spark, sf_dir)), "routed")
    events = P.stage_events(routed, B.chain_records(spark, sf_dir), _searched(spark, sf_dir, routed))
    ids = F.array_join(F.transform(F.from_json("results", "array<struct<id:string>>"), lambda x: x["id"]), ",")
    return P.collapse_events(events).withColumn("results", ids)


@query(
    "json_rows",
    """SELECT event_id, n AS position, CASE n WHEN 0 THEN event_id::VARCHAR ELSE 'u' || user_id END AS id, CASE n WHEN 0 THEN event_type END AS title,
      CASE n WHEN 0 THEN value END AS amount_numeric FROM events, (SELECT unnest([0, 1]) AS n) WHERE event_type <> 'error'""",
)
def json_rows(spark, sf_dir):
    """Messages that carry rows as a JSON array: after a label, alone over lines, or broken."""
    e = B.table(spark, sf_dir, "events")
    first = F.struct(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("title"), F.col("value").alias("amount_numeric"))
    second = F.struct(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("id"))
    body = F.concat(F.to_json(first), F.lit(","), F.to_json(second))
    text = (
        F.when(F.col("event_type") == "error", F.concat(F.lit("see [{"), body, F.lit("}]")))
        .when(F.col("event_type") == "view", F.concat(F.lit("[\n"), body, F.lit("\n]")))
        .otherwise(F.concat(F.lit("Found these. Data: ["), body, F.lit("] and more")))
    )
    rows = P.json_array_rows(e.select("event_id", text.alias("content")), key="event_id")
    return rows.select("event_id", "position", "id", "title", "amount_numeric")


@query(
    "model_replies",
    f"""WITH {_PLANS} SELECT q.query_id, CASE op WHEN 'newest' THEN NULL ELSE plan_text END AS plan,
      CASE op WHEN 'count' THEN 'SELECT COUNT(*) FROM proposals' WHEN 'sample' THEN 'WITH x AS (SELECT 1) SELECT * FROM x' END AS sql,
      op = 'newest' OR (op = 'sample' AND (contains(lower(query), 'show some') OR contains(lower(query), 'how many'))) AS use_fallback
    FROM plans JOIN q USING (query_id)""",
)
def model_replies(spark, sf_dir):
    """Logged model replies: fenced JSON with several statements, complex SQL, or no SQL text."""
    plans = P.plan_questions(B.chain_questions(spark, sf_dir))
    sql = (
        F.when(F.col("op") == "count", "(SELECT COUNT(*) FROM proposals); DROP TABLE proposals;")
        .when(F.col("op") == "sample", "WITH x AS (SELECT 1) SELECT * FROM x")
    )
    reply = F.to_json(F.struct(F.col("plan_text").alias("plan"), sql.alias("sql"), F.array().cast("array<string>").alias("params")))
    shaped = F.when(F.col("op") == "newest", F.lit('{"plan": oops')).otherwise(F.concat(F.lit("```json\nHere: "), reply, F.lit("\n```")))
    parsed = P.parse_model_json(plans.select("query_id", "query", shaped.alias("response")))
    return parsed.select("query_id", "plan", "sql", "use_fallback")
