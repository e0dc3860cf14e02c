"""Questions in bulk: routing, structured plans, answers, and what a client reads from them.

A table of questions ``(query_id, query)`` goes through Column expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf import schema as S
from sheaf.functions import questions as Q
from sheaf.functions.normalize import strip
from sheaf.operators.analytics import newest_first
from sheaf.operators.filters import cut_scores
from sheaf.session import union_all, written

TREASURY = "TreasuryProposal"

# The texts of an answer.
NOTHING_FOUND = "No proposals found matching your criteria."
NOTHING_RELEVANT = "I couldn't find any relevant information for your query."
NO_DESCRIPTION = "No description available"


def route(questions: DataFrame, word: str = "query") -> DataFrame:
    """Adds ``intent`` and ``route``."""
    out = questions.withColumn("intent", Q.intent(F.col(word)))
    return out.withColumn("route", Q.route_of(F.col("intent")))


def plan_questions(questions: DataFrame, word_boundary: bool = False) -> DataFrame:
    """Adds ``op, type, network, from_ts, to_ts, limit, plan_text``.

    ``op`` is ``count``, ``newest`` or ``sample``, or ``invalid`` for a month that does not
    exist. Null filters do not restrict.
    """
    text = F.col("_text")

    def has(word: str) -> Column:
        return F.contains(text, F.lit(word))

    counting, recent = F.col("_counting"), F.col("_recent")
    treasury = (counting | (~recent & has("show"))) & F.col("_treasury")
    # Each step is a column of its own: an expression used several times is computed once.
    base = (
        questions.withColumn("_text", F.lower("query"))
        .withColumn("_first", Q.first_of_month(text, word_boundary))
        .withColumn("_start", Q.month_start(F.col("_first")))
        .withColumn("_network", Q.network_in(text, word_boundary))
        .withColumn("_counting", has("how many") & has("proposals"))
        .withColumn("_recent", has("show") & has("recent"))
        .withColumn("_treasury", has("treasury"))
    )
    op = F.when(counting, F.lit("count")).when(recent, F.lit("newest")).otherwise(F.lit("sample"))
    bad = F.col("_first").isNotNull() & F.col("_start").isNull()
    label = (
        F.when(counting & F.col("_treasury"), F.lit("Count treasury proposals"))
        .when(counting, F.lit("Count all proposals"))
        .when(recent, F.lit("Get recent proposals"))
        .when(treasury, F.lit("Get treasury proposals"))
        .otherwise(F.lit("Get sample proposals"))
    )

    end = F.add_months("_start", 1)
    period = F.concat(
        F.lit("in created_at >= '"), F.col("_start").cast("string"), F.lit("' AND created_at < '"), end.cast("string"), F.lit("'")
    )
    return base.select(
        *questions.columns,
        F.when(bad, F.lit("invalid")).otherwise(op).alias("op"),
        F.when(treasury, F.lit(TREASURY)).alias("type"),
        F.col("_network").alias("network"),
        F.col("_start").cast("timestamp").alias("from_ts"),
        end.cast("timestamp").alias("to_ts"),
        F.when(~counting, F.lit(S.EXAMPLES)).alias("limit"),
        F.concat_ws(" ", label, F.concat(F.lit("for "), F.col("_network")), period).alias("plan_text"),
    )


# --- answers -----------------------------------------------------------------------------------

_EXAMPLE = ["id", "title", "type", "network", "proposer", "status", "created_at", "description", "amount_numeric"]


def answer_questions(
    plans: DataFrame,
    proposals: DataFrame,
    n: int = S.EXAMPLES,
    examples_ignore_type: bool = False,
) -> DataFrame:
    """Adds ``count``, ``examples`` (array of structs) and ``answer`` (text) to the plans of
    :func:`plan_questions`. See :func:`answer_plans`; equal plans are answered once."""
    plans = written(plans, "question-plans")
    answered = written(answer_plans(plans, proposals, n, examples_ignore_type), "plan-answers")
    return _to_questions(plans, answered).select(*plans.columns, "count", "examples", "answer")


def answer_plans(plans: DataFrame, proposals: DataFrame, n: int = S.EXAMPLES, examples_ignore_type: bool = False) -> DataFrame:
    """One row per distinct plan: ``_op, _spec, _plan, count, examples, answer``.

    A plan restricts network, type and calendar month, each or not at all. So the records are
    read once and summed up per (network, type, month); the eight ways of leaving a restriction
    out are formed from those sums, and plans are joined to them by equality. The cost of the
    records does not grow with the number of questions, and no question meets a record.

    The examples of a count are its newest records, in short form (id, title, type, time).
    ``examples_ignore_type`` drops the type restriction there.
    """
    month = F.trunc(F.col("created_at").cast("timestamp"), "month")
    cell = ["network", "type", "month"]
    rows = proposals.select("network", "type", month.alias("month"), "id", "created_at")
    counts = _rolled_up(rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))).groupBy("_key").agg(F.sum("n").alias("n"))

    key, any_type = _plan_key(F.col("type")), _plan_key(F.lit(None).cast("string"))
    of_examples = F.when((F.col("op") == "count") & F.lit(examples_ignore_type), any_type).otherwise(key)
    distinct = plans.select(
        F.col("op").alias("_op"), key.alias("_spec"), F.col("plan_text").alias("_plan"), of_examples.alias("_example_key")
    ).distinct()
    # Few distinct plans stand behind many questions. Only what they ask for is looked up.
    distinct = written(distinct.withColumn("_newest", F.col("_op").isin("count", "newest")), "distinct-plans")
    lists = [
        _best(rows, newest_first(), n).withColumn("_newest", F.lit(True)),
        _best(rows, [F.col("id").asc()], n).withColumn("_newest", F.lit(False)),
    ]
    ranked = union_all(*lists).withColumnRenamed("_key", "_example_key").withColumnRenamed("id", "_id")
    used = distinct.filter(F.col("_op") != "invalid").select("_example_key", "_newest").distinct()
    chosen = used.join(ranked, ["_example_key", "_newest"])
    wide = proposals.select(*_EXAMPLE).join(chosen, F.col("id") == F.col("_id"))
    example = F.struct("position", *_EXAMPLE)
    collected = wide.groupBy("_example_key", "_newest").agg(F.sort_array(F.collect_list(example)).alias("examples"))

    found = distinct.join(counts, F.col("_spec") == F.col("_key"), "left").join(collected, ["_example_key", "_newest"], "left")
    valid = F.col("_op") != "invalid"
    number = F.when(valid, F.coalesce("n", F.lit(0))).otherwise(F.lit(0))
    shown = F.coalesce(F.when(valid, F.col("examples")), F.array().cast(collected.schema["examples"].dataType))
    answered = found.select("_op", "_spec", "_plan", shown.alias("examples"), number.alias("_number"))
    count = F.when(F.col("_op") == "count", F.col("_number")).otherwise(F.size("examples").cast("long"))
    answered = compose(answered.withColumn("count", count).withColumnRenamed("_op", "op"), n)
    return answered.select(F.col("op").alias("_op"), "_spec", "_plan", "count", "examples", "answer")


def _to_questions(plans: DataFrame, by_plan: DataFrame) -> DataFrame:
    """Rows of distinct plans joined to the questions that ask for them. A plan behind very many
    questions is a skewed join key, which adaptive execution splits; the plans' side is small."""
    same = (F.col("op") == F.col("_op")) & (_plan_key(F.col("type")) == F.col("_spec")) & F.col("plan_text").eqNullSafe(F.col("_plan"))
    return plans.join(by_plan, same)


def _key(network: Column, type: Column, month: Column) -> Column:
    """One text per combination; a part that does not restrict is a mark no name has."""
    parts = [F.coalesce(c.cast("string"), F.lit("\x1e")) for c in (network, type, month)]
    return F.concat_ws("\x1f", *parts)


def _plan_key(type: Column) -> Column:
    return _key(F.col("network"), type, F.col("from_ts").cast("date"))


def _rolled_up(cells: DataFrame) -> DataFrame:
    """Each row of a small summary under all eight combinations of restrictions."""
    nothing = F.lit(None).cast("string")
    keys = [
        _key(network, type, month)
        for network in (F.col("network"), nothing)
        for type in (F.col("type"), nothing)
        for month in (F.col("month"), nothing)
    ]
    return cells.select("*", F.explode(F.array_distinct(F.array(*keys))).alias("_key"))


def _best(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows of every combination: of the cells, then of what each combination joins."""
    cell = Window.partitionBy("network", "type", "month").orderBy(*order)
    near = rows.withColumn("position", F.row_number().over(cell)).filter(F.col("position") <= n).drop("position")
    combined = Window.partitionBy("_key").orderBy(*order)
    ranked = _rolled_up(near).withColumn("position", F.row_number().over(combined))
    return ranked.filter(F.col("position") <= n).select("_key", "id", "position")


# --- answer text -------------------------------------------------------------------------------


def plain_number(c: Column) -> Column:
    """A double in as few digits as name it, as ``10000.0``, ``0.25`` or ``1e-07``: plain from 1e-4
    up to 1e16, with an exponent of at least two digits beyond."""
    size = F.abs(c)
    digits = F.regexp_replace(F.when((size < 1e16), c).try_cast("decimal(38,21)").cast("string"), "0+$", "")
    plain = F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits)
    text = c.cast("string")
    base = F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$", "")
    power = F.substring_index(text, "E", -1).try_cast("int")
    sign = F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+"))
    scientific = F.concat(base, sign, F.lpad(F.abs(power).cast("string"), 2, "0"))
    inside = (size == 0) | ((size >= 1e-4) & (size < 1e16))
    return F.when(inside, plain).otherwise(F.when(F.contains(text, F.lit("E")), scientific).otherwise(F.lower(text)))


def _time_text(c: Column) -> Column:
    whole = F.date_format(c, "yyyy-MM-dd HH:mm:ssxxx")
    return F.when(c == F.date_trunc("second", c), whole).otherwise(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSSxxx"))


def _section(number: Column, row: Column, amount: Column, brief: Column, chars: int | None) -> Column:
    """One numbered record of an answer. ``brief`` rows show no more than id, title, type, time.
    Descriptions are cut after ``chars`` characters, or not at all."""

    def shown(name: str, default: str) -> Column:
        return F.coalesce(F.nullif(row[name], F.lit("")), F.lit(default))

    def full(name: str, default: str) -> Column:
        return F.when(brief, F.lit(default)).otherwise(shown(name, default))

    description = full("description", NO_DESCRIPTION)
    cut = description if chars is None else F.substring(description, 1, chars)
    dots = F.lit("") if chars is None else F.when(F.char_length(description) > chars, F.lit("...")).otherwise(F.lit(""))
    created = row["created_at"].cast("timestamp")
    lines = [
        F.concat(F.lit("## Proposal "), number.cast("string"), F.lit(": "), shown("title", "Untitled")),
        F.concat(F.lit("**ID:** "), F.coalesce(row["id"].cast("string"), F.lit("N/A"))),
        F.concat(F.lit("**Type:** "), shown("type", "Unknown")),
        F.concat(F.lit("**Network:** "), full("network", "Unknown")),
        F.concat(F.lit("**Proposer:** "), full("proposer", "Unknown")),
        F.concat(F.lit("**Status:** "), full("status", "Unknown")),
        F.concat(F.lit("**Created:** "), F.coalesce(_time_text(created), F.lit("Unknown"))),
        F.when(~brief & (amount != 0), F.concat(F.lit("**Amount:** "), plain_number(amount))),
        F.concat(F.lit("**Description:** "), cut, dots, F.lit("\n\n")),
    ]
    return F.concat_ws("\n", *lines)


def compose(answers: DataFrame, n: int | None = None, chars: int | None = S.ANSWER_DESCRIPTION_CHARS) -> DataFrame:
    """Adds ``answer``, the text shown for ``op``, ``count`` and the first ``n`` or all ``examples``."""
    brief = F.col("op") == "count"
    sections = F.transform(
        F.col("examples") if n is None else F.slice("examples", 1, n),
        lambda x: _section(x["position"], x, x["amount_numeric"], brief, chars),
    )
    head = F.concat(F.lit("Found "), F.col("count").cast("string"), F.lit(" proposals"))
    body = F.when(
        F.size("examples") > 0, F.concat(F.lit(". Here are some examples:\n\n"), F.array_join(sections, ""))
    ).otherwise(F.lit(""))
    return answers.withColumn("answer", F.when(F.col("count") > 0, F.concat(head, body)).otherwise(F.lit(NOTHING_FOUND)))


def displayed_hits(hits: DataFrame) -> DataFrame:
    """Hits fit to be shown: those over the display cut, at most five, or else the best two.
    ``hits`` has ``query_id, rank, score`` and the result columns."""
    kept = cut_scores(hits, S.DISPLAY_CUT, S.MAX_RESULTS, S.DISPLAY_FALLBACK)
    order = Window.partitionBy("query_id").orderBy("rank")
    return kept.withColumn("position", F.row_number().over(order))


_HIT = ["id", "title", "network", "type", "amount", "created_at", "snippet", "score", "description", "proposer", "status"]


def compose_hits(questions: DataFrame, hits: DataFrame, chars: int | None = S.ANSWER_DESCRIPTION_CHARS) -> DataFrame:
    """``(query_id, query, count, hits, answer)`` from search results, one row per question."""
    shown = displayed_hits(hits)
    section = _section(
        F.col("position"), F.struct(*[F.col(c) for c in _HIT]), F.col("amount").cast("double"), F.lit(False), chars
    )
    grouped = shown.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("count"),
        F.sort_array(F.collect_list(F.struct("position", *_HIT))).alias("hits"),
        F.sort_array(F.collect_list(F.struct("position", section.alias("text")))).alias("_sections"),
    )
    out = questions.join(grouped, "query_id", "left")
    head = F.concat(F.lit("Found "), F.col("count").cast("string"), F.lit(" relevant proposals:\n\n"))
    answer = F.concat(head, F.array_join(F.transform("_sections", lambda x: x["text"]), ""))
    return out.select(
        *questions.columns,
        F.coalesce("count", F.lit(0)).alias("count"),
        F.coalesce("hits", F.array().cast(grouped.schema["hits"].dataType)).alias("hits"),
        F.coalesce(answer, F.lit(NOTHING_RELEVANT)).alias("answer"),
    )


# --- events ------------------------------------------------------------------------------------


ANSWERED, SEARCHED, COMPOSED = "sql_agent", "retrieval_agent", "composer"
FAILED = "Failed to process query"


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]), {"ignoreNullFields": "false"})


def _event(seq: int, stage: str, payload: Column) -> Column:
    return F.struct(F.lit(seq).alias("seq"), F.lit(stage).alias("stage"), payload.alias("payload"))


def _final(answer: Column, route: str) -> Column:
    return _event(3, "final_answer", _json(answer=answer, metadata=F.struct(F.lit(route).alias("processing_type"))))


def stage_events(
    routed: DataFrame, proposals: DataFrame, hits: DataFrame, n: int = S.EXAMPLES, word_boundary: bool = False
) -> DataFrame:
    """``(query_id, seq, stage, payload)``: what happened to each question, in order.

    ``routed`` comes from :func:`route`; questions to be answered are planned and answered over
    ``proposals``, those to be searched take their results from ``hits`` (of :func:`compose_hits`).
    Payloads are JSON texts. What a plan yields is put into text once and then joined to all
    questions that ask for it. A month that does not exist and a question without search results
    of its own end in an ``error`` event.
    """

    def with_decision(route: str, outcome: Column) -> Column:
        # the route by name: its expression is needed in the filter only
        return F.concat(F.array(_event(1, "router_decision", _json(decision=F.lit(route)))), outcome).alias("events")

    def failed(why: Column) -> Column:
        return F.array(_event(3, "error", _json(error=why, message=F.lit(FAILED))))

    # what the questions mean is worked out once, and not again in each branch
    routed = written(routed.select("query_id", "query", "route"), "routed")
    plans = written(plan_questions(routed.filter(F.col("route") == ANSWERED).select("query_id", "query"), word_boundary), "question-plans")
    result = _event(2, "sql_result", _json(plan=F.col("_plan"), count=F.col("count"), examples=F.col("examples")))
    done = F.array(result, _final(F.col("answer"), ANSWERED))
    outcome = F.when(F.col("_op") == "invalid", failed(F.lit("no such month"))).otherwise(done)
    by_plan = written(answer_plans(plans, proposals, n).select("_op", "_spec", "_plan", outcome.alias("outcome")), "plan-events")
    answered = _to_questions(plans, by_plan).select("query_id", with_decision(ANSWERED, F.col("outcome")))

    asked = routed.filter(F.col("route") == SEARCHED).select("query_id")
    found = asked.join(hits.select("query_id", "count", "hits", "answer"), "query_id", "left")
    shown = [_event(k, stage, _json(proposals=F.col("hits"))) for k, stage in ((4, "proposal_descriptions"), (5, "proposals_data"))]
    always = F.array(_event(2, "retrieval_hits", _json(hits=F.col("hits"), count=F.col("count"))), _final(F.col("answer"), SEARCHED))
    outcome = (
        F.when(F.col("count").isNull(), failed(F.lit("no search results")))
        .when(F.col("count") > 0, F.concat(always, F.array(*shown)))
        .otherwise(always)
    )
    searched = found.select("query_id", with_decision(SEARCHED, outcome))

    rest = routed.filter(~F.col("route").isin(ANSWERED, SEARCHED)).select("query_id")
    composed = rest.select("query_id", with_decision(COMPOSED, F.array(_final(F.lit(NOTHING_RELEVANT), COMPOSED))))
    every = union_all(answered, searched, composed)
    return every.select("query_id", F.explode("events").alias("e")).select("query_id", "e.seq", "e.stage", "e.payload")


def collapse_events(events: DataFrame) -> DataFrame:
    """One response row per question from its events."""

    def payload(stage: str) -> Column:
        return F.max(F.when(F.col("stage") == stage, F.col("payload")))

    # Texts are summed up by sorting them, so only what a response is made of goes there: not a plan's
    # examples, which its answer shows, nor the payloads of other events, which leave but their question.
    plan = F.substring_index("payload", ',"examples":', 1)
    plan_first = F.col("payload").startswith('{"plan":') & F.contains("payload", F.lit(',"examples":'))
    cut = F.when(plan_first, F.concat(plan, F.lit("}"))).otherwise(F.col("payload"))
    read = F.when(F.col("stage") == "sql_result", cut).when(F.col("stage").isin("final_answer", "retrieval_hits", "error"), F.col("payload"))
    grouped = events.select("query_id", "stage", read.alias("payload")).groupBy("query_id").agg(
        payload("final_answer").alias("_final"),
        payload("sql_result").alias("_sql"),
        payload("retrieval_hits").alias("_hits"),
        payload("error").alias("_error"),
    )
    return grouped.select(
        "query_id",
        F.coalesce(
            F.get_json_object("_final", "$.answer"), F.get_json_object("_error", "$.message"), F.lit("No response generated")
        ).alias("response"),
        F.get_json_object("_sql", "$.plan").alias("plan"),
        F.get_json_object("_hits", "$.hits").alias("results"),
        F.coalesce(F.get_json_object("_hits", "$.count").cast("long"), F.lit(0)).alias("count"),
        F.get_json_object("_final", "$.metadata.processing_type").alias("processing_type"),
    )


# --- reading answers and model output ----------------------------------------------------------

# How a model reply is judged.
COMPLEX_SQL = ["WITH ", "CTE", "UNION"]
SIMPLE_REQUESTS = ["how many", "show examples", "show some", "name a few"]


def parse_model_json(df: DataFrame, response: str = "response", question: str = "query") -> DataFrame:
    """Adds ``plan``, ``sql`` and ``use_fallback`` read from a model's reply.

    The JSON object is what lies between the first ``{`` and the last ``}``. Of several
    statements the first SELECT is taken. ``use_fallback`` is true where the reply is no JSON
    object with a text under ``sql``, or answers a simple request with complex SQL.
    """
    body = F.regexp_extract(F.col(response), r"(?s)(\{.*\})", 1)
    parsed = F.try_parse_json(body)
    marked = df.withColumn("_v", parsed).withColumn("_sql_kind", F.schema_of_variant(F.try_variant_get("_v", "$.sql", "variant")))
    raw = F.when(F.col("_sql_kind") == "STRING", F.try_variant_get("_v", "$.sql", "string"))
    marked = marked.withColumn("_sql", raw).withColumn("plan", F.try_variant_get("_v", "$.plan", "string"))
    statements = F.filter(
        F.transform(F.split("_sql", ";"), strip), lambda s: (s != "") & F.contains(F.upper(s), F.lit("SELECT"))
    )
    first = F.get(statements, F.lit(0))
    wrapped = first.startswith("(") & first.endswith(")")
    bare = F.when(wrapped, strip(F.substr(first, F.lit(2), F.char_length(first) - 2))).otherwise(first)
    several = F.contains("_sql", F.lit(";")) & F.contains(F.upper("_sql"), F.lit("SELECT"))
    too_complex = Q.mentions(F.lower(F.col(question)), SIMPLE_REQUESTS) & Q.mentions(F.upper("_sql"), COMPLEX_SQL)
    return marked.select(
        *df.columns,
        "plan",
        F.when(several, bare).otherwise(F.col("_sql")).alias("sql"),
        F.coalesce(F.col("_sql").isNull() | too_complex, F.lit(True)).alias("use_fallback"),
    )


# The shape of one record in an answer.
_RECORD = (
    r"^## Proposal \d+: ([^\n]+)\n\*\*ID:\*\* ([^\n]+)\n\*\*Type:\*\* ([^\n]+)\n\*\*Network:\*\* ([^\n]+)"
    r"\n\*\*Proposer:\*\* ([^\n]+)\n\*\*Status:\*\* ([^\n]+)\n\*\*Created:\*\* ([^\n]+)"
    r"(?:\n\*\*Amount:\*\* ([^\n]+))?(?:\n\*\*Description:\*\* ([^\n]+))?"
)
_RECORD_FIELDS = ["title", "id", "type", "network", "proposer", "status", "created_at", "amount", "description"]


def markdown_to_rows(df: DataFrame, answer: str = "answer", key: str = "query_id") -> DataFrame:
    """The records listed in answer texts, one row each, in order."""
    text = F.col(answer)
    about = F.contains(text, F.lit("Found")) & F.contains(text, F.lit("proposals"))
    parts = df.filter(about).select(key, F.posexplode(F.split(text, r"(?=## Proposal \d+: )")).alias("_pos", "_part"))
    fields = [
        F.nullif(F.regexp_extract("_part", _RECORD, i + 1), F.lit("")).alias(name) for i, name in enumerate(_RECORD_FIELDS)
    ]
    rows = parts.filter(F.col("_part").rlike(_RECORD)).select(key, "_pos", *fields)
    return rows.select(
        key,
        F.col("_pos").alias("position"),
        "id",
        "title",
        "type",
        "network",
        "proposer",
        "status",
        "created_at",
        F.regexp_extract("amount", r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double").alias("amount_numeric"),
        F.when(F.col("amount").isNotNull(), F.lit("DOT")).alias("currency"),
        F.coalesce("description", F.lit("[Loading description...]")).alias("description"),
    )


ROW_SCHEMA = (
    "array<struct<id:string,network:string,type:string,title:string,description:string,"
    "proposer:string,amount_numeric:double,currency:string,status:string,created_at:string>>"
)


def json_array_rows(df: DataFrame, content: str = "content", key: str = "query_id", schema: str = ROW_SCHEMA) -> DataFrame:
    """Rows of the JSON array found in a text: the longest ``[{...}]`` of its first line with
    one, else the whole text. Text without a readable array gives no rows."""
    found = F.nullif(F.regexp_extract(F.col(content), r"(\[\{.*\}\])", 1), F.lit(""))
    array = F.from_json(F.coalesce(found, F.col(content)), schema)
    return df.select(key, F.posexplode(array).alias("position", "_row")).select(key, "position", "_row.*")
