"""Text columns: cleaning, tokens, embedding text, shown forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.functions import display as D
from sheaf.functions import normalize as N
from sheaf.functions import text as X
from sheaf.operators.filters import has_text
from sheaf.operators.text_search import postings
from workload import bindings as B
from workload.registry import query

WS = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||' '||chr(133)||chr(160)||chr(8195)||chr(12288)"


@query(
    "clean_doc_text",
    rf"""SELECT id, substring(trim(regexp_replace(regexp_replace(regexp_replace(trim(title || ' ' || description, {WS}),
      '[\x00-\x1f\x7f-\x{{9f}}]', ' ', 'g'), '[\s\x{{a0}}]+', ' ', 'g'), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g')), 1, 1000) AS doc_text
    FROM ({B.DOCS_SQL})""",
)
def clean_doc_text(spark, sf_dir):
    docs = B.document_records(spark, sf_dir)
    return docs.select("id", X.clean_doc_text(F.col("title"), F.col("description")).alias("doc_text"))


_CUT = "CASE WHEN length({c}) > {n} THEN substring({c}, 1, {n}) || '...' ELSE {c} END"


@query(
    "embedding_text_structured",
    f"""SELECT id, trim(concat_ws(chr(10), CASE WHEN title <> '' THEN 'Title: ' || title END,
        CASE WHEN network <> '' AND network <> 'Unknown' THEN 'Network: ' || network END,
        CASE WHEN type <> '' THEN 'Type: ' || type END,
        CASE WHEN description <> '' AND description <> 'No description available'
          THEN 'Description: ' || ({_CUT.format(c='description', n=2000)}) END), {WS}) AS text
    FROM ({B.DOCS_SQL})""",
)
def embedding_text_structured(spark, sf_dir):
    docs = B.document_records(spark, sf_dir)
    c = F.col
    text = X.embedding_text("structured", c("title"), c("description"), c("proposer"), c("network"), c("type"))
    return docs.select("id", text.alias("text"))


@query("embedding_text_plain", f"SELECT id, md5(trim(title || chr(10) || description, {WS})) AS text FROM ({B.DOCS_SQL})")
def embedding_text_plain(spark, sf_dir):
    docs = B.document_records(spark, sf_dir)
    text = X.embedding_text("plain", F.col("title"), F.col("description"))
    return docs.select("id", F.md5(text).alias("text"))


@query(
    "embedding_text_capped",
    f"""SELECT id, {_CUT.format(c='t', n=6000)} AS text FROM (
      SELECT id, trim(title || chr(10) || ({_CUT.format(c='description', n=2000)}), {WS}) AS t FROM ({B.DOCS_SQL}))""",
)
def embedding_text_capped(spark, sf_dir):
    docs = B.document_records(spark, sf_dir)
    text = X.embedding_text("capped", F.col("title"), F.col("description"))
    return docs.select("id", text.alias("text"))


@query(
    "snippet",
    f"""SELECT page_id AS id, CASE WHEN title <> '' THEN title WHEN d <> '' THEN {_CUT.format(c='d', n=150)}
      ELSE 'No description available' END AS snippet
    FROM (SELECT page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS title, url AS d FROM pages)""",
)
def snippet(spark, sf_dir):
    pages = B.table(spark, sf_dir, "pages")
    title = F.regexp_extract("html", "<h1>([^<]*)</h1>", 1)
    return pages.select(F.col("page_id").alias("id"), X.snippet(title, F.col("url")).alias("snippet"))


@query(
    "token_estimate",
    rf"""SELECT lang, sum(len(regexp_split_to_array(trim(text, {WS}), '[\s\x{{a0}}]+')))::BIGINT AS words,
      round(sum(CASE WHEN trim(text, {WS}) = '' THEN 0 ELSE len(regexp_split_to_array(trim(text, {WS}), '[\s\x{{a0}}]+')) END * 1.3::DOUBLE), 2) AS tokens
    FROM documents GROUP BY lang""",
)
def token_estimate(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents").select("lang", N.token_estimate(F.col("text")).alias("t"))
    return docs.groupBy("lang").agg(F.round(F.sum("t") / 1.3).cast("long").alias("words"), F.round(F.sum("t"), 2).alias("tokens"))


@query(
    "search_tokens",
    f"""SELECT id, len(t)::INTEGER AS n, len(list_distinct(t))::INTEGER AS n_distinct, md5(array_to_string(t, ' ')) AS hash
    FROM (SELECT id, {B.tokens_sql("title || ' ' || description")} AS t FROM ({B.DOCS_SQL}))""",
)
def search_tokens(spark, sf_dir):
    docs = B.document_records(spark, sf_dir)
    words = docs.select("id", X.tokens(X.document(F.col("title"), F.col("description"))).alias("t"))
    return words.select(
        "id",
        F.size("t").alias("n"),
        F.size(F.array_distinct("t")).alias("n_distinct"),
        F.md5(F.array_join("t", " ")).alias("hash"),
    )


@query(
    "postings",
    f"""WITH w AS (SELECT id, unnest({B.tokens_sql('title')}) AS token, true AS in_title FROM ({B.DOCS_SQL})
      UNION ALL SELECT id, unnest({B.tokens_sql('description')}) AS token, false FROM ({B.DOCS_SQL})),
    p AS (SELECT token, id, count(*) AS tf, bool_or(in_title) AS t, bool_or(NOT in_title) AS d FROM w GROUP BY token, id)
    SELECT token, count(*) AS records, sum(tf)::BIGINT AS occurrences, count(*) FILTER (t) AS titles, count(*) FILTER (d) AS descriptions
    FROM p GROUP BY token""",
)
def postings_summary(spark, sf_dir):
    rows = postings(B.document_records(spark, sf_dir))
    return rows.groupBy("token").agg(
        F.count(F.lit(1)).alias("records"),
        F.sum("tf").alias("occurrences"),
        F.count(F.when(F.col("in_title"), 1)).alias("titles"),
        F.count(F.when(F.col("in_description"), 1)).alias("descriptions"),
    )


@query("key_terms", f"SELECT conv_id, turn, unnest({B.terms_sql('text')}) AS term FROM conversations WHERE role = 'user'")
def key_terms(spark, sf_dir):
    return B.talk_questions(spark, sf_dir).select("conv_id", "turn", F.explode(X.key_terms(F.col("query"))).alias("term"))


@query("has_text", f"SELECT id FROM ({B.DOCS_SQL}) WHERE trim(title) <> '' OR trim(description) <> ''")
def has_text_filter(spark, sf_dir):
    return B.document_records(spark, sf_dir).filter(has_text("title", "description")).select("id")


# --- shown forms -------------------------------------------------------------------------------

_ASCII_CLEAN = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({c},
  '\*\*(.*?)\*\*', '\1', 'g'), '\*(.*?)\*', '\1', 'g'), '`(.*?)`', '\1', 'g'), '#{{1,6}}[\s\x{{a0}}]*', '', 'g'),
  '[\s\x{{a0}}]+', ' ', 'g'), '[^A-Za-z0-9_\s.,!?()-]', '', 'g'))"""


@query(
    "display_text",
    f"""SELECT id, md5(t) AS text, CASE WHEN length(s) > 100 THEN substring(s, 1, 100) || '...' ELSE s END AS summary
    FROM (SELECT id, t, split_part(t, '.', 1) AS s FROM (
      SELECT id, CASE WHEN description = '' THEN '-' ELSE {_ASCII_CLEAN.format(c='description')} END AS t FROM ({B.DOCS_SQL})))""",
)
def display_text(spark, sf_dir):
    docs = B.document_records(spark, sf_dir)
    return docs.select(
        "id",
        F.md5(D.display_text(F.col("description"))).alias("text"),
        D.display_first_sentence(F.col("description")).alias("summary"),
    )


@query(
    "display_values",
    """SELECT o_orderkey AS id, printf('%,.2f', o_totalprice) || CASE WHEN o_orderstatus = 'P' THEN '' ELSE ' DOT' END AS amount,
      strftime(o_orderdate, '%b %-d, %Y') AS created,
      CASE o_orderpriority WHEN '1-URGENT' THEN 'Treasury Proposal' WHEN '2-HIGH' THEN 'Referendum V2' ELSE 'Tip' END AS type
    FROM orders""",
)
def display_values(spark, sf_dir):
    o = B.table(spark, sf_dir, "orders")
    p = F.col("o_orderpriority")
    kind = F.when(p == "1-URGENT", "TreasuryProposal").when(p == "2-HIGH", "ReferendumV2").otherwise("tip")
    currency = F.when(F.col("o_orderstatus") != "P", "DOT")
    return o.select(
        F.col("o_orderkey").alias("id"),
        D.display_amount(F.col("o_totalprice"), currency).alias("amount"),
        D.display_date(F.col("o_orderdate")).alias("created"),
        D.display_type(kind).alias("type"),
    )


@query(
    "first_line_without_tags",
    rf"""SELECT page_id, CASE WHEN html = '' THEN 'No description available'
      ELSE split_part(trim(regexp_replace(html, '<[^>]*>', '', 'g'), {WS}), chr(10), 1) END AS line FROM pages""",
)
def first_line_without_tags(spark, sf_dir):
    return B.table(spark, sf_dir, "pages").select("page_id", D.first_line_without_tags(F.col("html")).alias("line"))


def _repair_sql(c: str) -> str:
    """The description repairs as nested SQL, innermost first."""
    steps = [
        ("x20", " "), ("&#x20;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"),
        (r"httpsdocs\.google\.com", "https://docs.google.com"), (r"httpsforms\.gle", "https://forms.gle"),
        (r"httpst\.co", "https://t.co"), (r"httpsdrive\.google\.com", "https://drive.google.com"),
        (r"\*\*(.*?)\*\*", r"<strong>\1</strong>"), (r"\*(.*?)\*", r"<em>\1</em>"),
        (r"\* ([^\n]*)", r"<li>\1</li>"), (r"\d+\. ([^\n]*)", r"<li>\1</li>"),
        (r"\n\n+", "</p><p>"), (r"\n", "<br>"),
    ]
    after = [
        (r"[\s\x{a0}]+", " "), (r"\s*<br>\s*", "<br>"), (r"\s*</p>\s*<p>\s*", "</p><p>"),
        (r"(https?://[^\s\x{a0}]+)", r'<a href="\1" target="_blank" rel="noopener noreferrer" '
         r'class="text-blue-600 hover:text-blue-800 underline">\1</a>'),
    ]
    for pattern, replacement in steps:
        c = f"regexp_replace({c}, '{pattern}', '{replacement}', 'g')"
    c = f"'<p>' || {c} || '</p>'"
    for pattern, replacement in after:
        c = f"regexp_replace({c}, '{pattern}', '{replacement}', 'g')"
    return c


@query(
    "repair_description",
    f"SELECT 'd' || doc_id AS id, md5({_repair_sql('text')}) AS html FROM documents "
    f"UNION ALL SELECT 'p' || page_id, md5({_repair_sql('html')}) FROM pages",
)
def repair_description(spark, sf_dir):
    docs = B.spread(B.table(spark, sf_dir, "documents"), B.PARTS).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.col("text").alias("t"))
    pages = B.spread(B.table(spark, sf_dir, "pages"), B.PARTS).select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), F.col("html").alias("t"))
    return B.union_all(docs, pages).select("id", F.md5(D.repair_description(F.col("t"))).alias("html"))


@query(
    "external_links",
    f"""SELECT id, 'https://' || h || '.polkassembly.io' || p || '/' || id AS polkassembly,
      'https://' || h || '.subsquare.io' || p || '/' || id AS subsquare, 'https://' || h || '.subscan.io' || p || '/' || id AS subscan,
      'https://' || h || '.subscan.io/proposal/' || id AS simple
    FROM (SELECT id, CASE WHEN network = 'kusama' THEN 'kusama' ELSE 'polkadot' END AS h,
      CASE WHEN contains(lower(type), 'treasury') THEN '/treasury' ELSE '/referenda' END AS p FROM ({B.CHAIN_SQL}))""",
)
def external_links(spark, sf_dir):
    rows = B.chain_records(spark, sf_dir)
    id = F.col("id").cast("string")
    links = D.external_links(F.col("network"), F.col("type"), id)
    simple = D.external_links(F.col("network"), F.col("type"), id, simple=True)
    return rows.select("id", links.alias("l"), simple["subscan"].alias("simple")).select("id", "l.*", "simple")


@query(
    "display_table",
    """SELECT o_orderkey::VARCHAR AS id, 'Order ' || o_orderkey AS title, 'Placed by customer ' || o_custkey AS summary,
      printf('%,.2f', o_totalprice) || ' DOT' AS amount, strftime(o_orderdate, '%b %-d, %Y') AS created,
      CASE o_orderpriority WHEN '1-URGENT' THEN 'Treasury Proposal' ELSE
        trim(regexp_replace(o_orderpriority, '([A-Z])', ' \\1', 'g')) END AS type,
      '<p>Placed by customer ' || o_custkey || '</p>' AS description_html
    FROM orders""",
)
def display_table(spark, sf_dir):
    return D.display_table(B.chain_records(spark, sf_dir)).drop("links")
