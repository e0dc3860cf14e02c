"""Keyword, full-text, trigram, vector and hybrid search."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.functions import text as X
from sheaf.functions.vectors import cosine_distance
from sheaf.operators import hybrid as H
from sheaf.operators import text_search as T
from sheaf.operators import vector_index as VI
from sheaf.operators import vector_search as V
from sheaf.operators import word_index as W
from sheaf.operators.embedding import hashed_words
from sheaf.schema import SearchFilters
from sheaf.session import scratch_dir
from workload import bindings as B
from workload.registry import query

WORDS = "tell me about retitioning and the ouen"
COMMON = "the and that of"
ENGLISH = SearchFilters(network="en")


# --- one literal query -------------------------------------------------------------------------

_LEXICAL_ONE = f"""
  SELECT id, score AS rank_score, row_number() OVER (ORDER BY score DESC, id)::INTEGER AS position FROM (
    SELECT id, CASE WHEN contains(lower(title), 'retitioning') OR contains(lower(title), 'ouen') THEN 0.8::DOUBLE
      WHEN contains(lower(description), 'retitioning') OR contains(lower(description), 'ouen') THEN 0.6::DOUBLE END AS score
    FROM ({B.DOCS_SQL}) {{where}}) WHERE score IS NOT NULL
  QUALIFY position <= 30"""


@query("lexical_search_one", _LEXICAL_ONE.format(where=""))
def lexical_search_one(spark, sf_dir):
    return T.lexical_search_one(WORDS, B.document_records(spark, sf_dir))


@query("lexical_search_filtered", _LEXICAL_ONE.format(where="WHERE lang = 'en'").replace("lang =", "network ="))
def lexical_search_filtered(spark, sf_dir):
    return T.lexical_search_one(WORDS, B.document_records(spark, sf_dir), ENGLISH)


@query(
    "fulltext_search_one",
    f"""WITH d AS (SELECT id, {B.tokens_sql("title || ' ' || description")} AS w FROM ({B.DOCS_SQL})),
    m AS (SELECT id, len(list_filter(w, lambda x: x IN ('the', 'and', 'that', 'of'))) AS hits FROM d
      WHERE list_has_all(w, ['the', 'and', 'that', 'of']))
    SELECT id, round(0.5::DOUBLE * (1 - exp(-0.1::DOUBLE * hits)), 6) AS rank,
      row_number() OVER (ORDER BY 0.5::DOUBLE * (1 - exp(-0.1::DOUBLE * hits)) DESC, id)::INTEGER AS position FROM m QUALIFY position <= 10""",
)
def fulltext_search_one(spark, sf_dir):
    return T.fulltext_search_one(COMMON, B.document_records(spark, sf_dir)).withColumn("rank", F.round("rank", 6))


_GRAMS = r"""list_distinct(flatten(list_transform(regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}]+'),
  lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"""


def _similar(a: str, b: str) -> str:
    shared = f"len(list_intersect({a}, {b}))"
    return f"({shared}::DOUBLE / (len({a}) + len({b}) - {shared}))"


@query(
    "fuzzy_search_one",
    f"""WITH g AS (SELECT p_partkey AS id, {_GRAMS.format(c='p_name')} AS t, {_GRAMS.format(c='p_brand')} AS b,
        {_GRAMS.format(c="'red widgit'")} AS q FROM part),
    s AS (SELECT id, greatest({_similar('t', 'q')}, {_similar('b', 'q')}) AS s FROM g)
    SELECT id, round(s, 6) AS similarity, row_number() OVER (ORDER BY s DESC, id)::INTEGER AS position FROM s
    WHERE s >= 0.3 QUALIFY position <= 10""",
)
def fuzzy_search_one(spark, sf_dir):
    parts = B.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("proposer")
    )
    return T.fuzzy_search_one("red widgit", parts).withColumn("similarity", F.round("similarity", 6))


@query(
    "trigram_similarity",
    f"""SELECT id, round({_similar('t', 'b')}, 6) AS similarity FROM (
      SELECT p_partkey AS id, {_GRAMS.format(c='p_name')} AS t, {_GRAMS.format(c="p_brand || ' ' || p_name")} AS b FROM part)""",
)
def trigram_similarity(spark, sf_dir):
    part = B.table(spark, sf_dir, "part")
    score = X.similarity(X.trigrams(F.col("p_name")), X.trigrams(F.concat_ws(" ", "p_brand", "p_name")))
    return part.select(F.col("p_partkey").alias("id"), F.round(score, 6).alias("similarity"))


# --- tables of queries -------------------------------------------------------------------------

_LEXICAL = f"""
  q AS (SELECT query_id, unnest({B.terms_sql('query')}) AS term FROM ({B.BENCHMARK_SQL})),
  d AS (SELECT id, network, lower(title) AS t, lower(description) AS x FROM ({B.DOCS_SQL})),
  v AS (SELECT DISTINCT term FROM q),
  h AS (SELECT term, id, CASE WHEN contains(t, term) THEN 0.8::DOUBLE ELSE 0.6::DOUBLE END AS score
        FROM v JOIN d ON contains(t, term) OR contains(x, term)),
  s AS (SELECT query_id, id, max(score) AS score FROM q JOIN h USING (term) GROUP BY query_id, id),
  lexical AS (SELECT query_id, id, score AS rank_score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS position
        FROM s QUALIFY position <= 30)"""


@query("lexical_search", f"WITH {_LEXICAL} SELECT * FROM lexical")
def lexical_search(spark, sf_dir):
    return T.lexical_search(B.benchmark_queries(spark, sf_dir), B.document_records(spark, sf_dir))


@query("lexical_search_indexed", f"WITH {_LEXICAL} SELECT * FROM lexical")
def lexical_search_indexed(spark, sf_dir):
    docs = B.document_records(spark, sf_dir)
    return T.lexical_search(B.benchmark_queries(spark, sf_dir), docs, index=T.postings(docs))


_FULLTEXT = f"""
  WITH q AS (SELECT item_id AS query_id, list_distinct({B.tokens_sql('text')}) AS w FROM benchmark),
  d AS (SELECT id, {B.tokens_sql("title || ' ' || description")} AS w FROM ({B.DOCS_SQL}) {{where}}),
  m AS (SELECT query_id, id, len(list_filter(d.w, lambda x: list_contains(q.w, x))) AS hits FROM q JOIN d ON list_has_all(d.w, q.w)),
  s AS (SELECT query_id, id, 0.5::DOUBLE * (1 - exp(-0.1::DOUBLE * hits)) AS rank FROM m)
  SELECT query_id, id, round(rank, 6) AS rank, row_number() OVER (PARTITION BY query_id ORDER BY rank DESC, id)::INTEGER AS position
  FROM s QUALIFY position <= 10"""


def _benchmark_texts(spark, sf_dir):
    return B.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query("fulltext_search", _FULLTEXT.replace("{where}", ""))
def fulltext_search(spark, sf_dir):
    found = T.fulltext_search(_benchmark_texts(spark, sf_dir), B.document_records(spark, sf_dir))
    return found.withColumn("rank", F.round("rank", 6))


@query("fulltext_search_filtered", _FULLTEXT.replace("{where}", "WHERE network = 'en'"))
def fulltext_search_filtered(spark, sf_dir):
    docs = B.document_records(spark, sf_dir)
    found = T.fulltext_search(_benchmark_texts(spark, sf_dir), docs, filters=ENGLISH, index=T.postings(docs))
    return found.withColumn("rank", F.round("rank", 6))


def _followed_index(spark, sf_dir):
    """An index that has followed four loads: texts that German records had before, with records that go
    later; the German texts of now; the same again; the deletion."""
    path, docs = scratch_dir(spark, "words"), B.document_records(spark, sf_dir)
    german = F.col("network") == "de"
    before = docs.withColumns({c: F.when(german, F.reverse(c)).otherwise(F.col(c)) for c in ("title", "description")})
    passing = docs.filter(F.col("network") == "fr").withColumn("id", -1 - F.col("id"))
    W.update_index(spark, path, B.union_all(before, passing))
    for _ in range(2):
        W.update_index(spark, path, docs.filter(german))
    return W.update_index(spark, path, deleted=passing.select("id"))


@query("lexical_search_stored", f"WITH {_LEXICAL} SELECT * FROM lexical")
def lexical_search_stored(spark, sf_dir):
    """Keyword search by an index kept up to date by loads; no text is read."""
    docs = B.document_records(spark, sf_dir)
    return T.lexical_search(B.benchmark_queries(spark, sf_dir), docs, index=_followed_index(spark, sf_dir))


@query("fulltext_search_stored", _FULLTEXT.replace("{where}", ""))
def fulltext_search_stored(spark, sf_dir):
    docs = B.document_records(spark, sf_dir)
    found = T.fulltext_search(_benchmark_texts(spark, sf_dir), docs, index=_followed_index(spark, sf_dir))
    return found.withColumn("rank", F.round("rank", 6))


@query(
    "fuzzy_search",
    f"""WITH q AS (SELECT s_suppkey AS query_id, {_GRAMS.format(c='s_name')} AS q FROM supplier),
    c AS (SELECT c_custkey AS id, {_GRAMS.format(c='c_name')} AS t, {_GRAMS.format(c='c_mktsegment')} AS b FROM customer),
    s AS (SELECT query_id, id, greatest({_similar('t', 'q')}, {_similar('b', 'q')}) AS s FROM q, c)
    SELECT query_id, id, round(s, 6) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id)::INTEGER AS position
    FROM s WHERE s >= 0.3 QUALIFY position <= 10""",
)
def fuzzy_search(spark, sf_dir):
    names = B.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("query_id"), F.col("s_name").alias("query"))
    customers = B.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("proposer")
    )
    return T.fuzzy_search(names, customers).withColumn("similarity", F.round("similarity", 6))


# --- vectors -----------------------------------------------------------------------------------

_PROBE = hashed_words(64)([WORDS])[0]
_PROBE_SQL = "[" + ",".join(map(str, _PROBE)) + "]::DOUBLE[]"
_EMBEDDED = f"""
  SELECT id, network, embedding::DOUBLE[] AS v FROM embeddings JOIN ({B.DOCS_SQL}) ON vec_id = id"""


@query(
    "vector_search_one",
    f"""SELECT id, round(list_cosine_distance(v, {_PROBE_SQL}), 6) AS distance,
      row_number() OVER (ORDER BY list_cosine_distance(v, {_PROBE_SQL}), id)::INTEGER AS position
    FROM ({_EMBEDDED}) QUALIFY position <= 50""",
)
def vector_search_one(spark, sf_dir):
    found = V.vector_search_one(_PROBE, B.document_records(spark, sf_dir), B.document_embeddings(spark, sf_dir))
    return found.withColumn("distance", F.round("distance", 6))


_VECTOR = """
  n AS (SELECT query_id, id, list_cosine_distance(v, vector) AS distance FROM ({q}) CROSS JOIN ({e})),
  near AS (SELECT query_id, id, distance, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 12), id)::INTEGER AS position
        FROM n QUALIFY position <= 50)"""


@query(
    "vector_search",
    f"WITH {_VECTOR.format(q=B.BENCHMARK_SQL, e=_EMBEDDED)} SELECT query_id, id, abs(round(distance, 6)) AS distance, position FROM near",
)
def vector_search(spark, sf_dir):
    found = V.vector_search(
        B.benchmark_queries(spark, sf_dir), B.document_records(spark, sf_dir), B.document_embeddings(spark, sf_dir)
    )
    return found.withColumn("distance", F.abs(F.round("distance", 6)))


_ALL_VECTORS = "SELECT vec_id AS query_id, embedding::DOUBLE[] AS vector FROM embeddings"


@query(
    "vector_neighbours",
    f"WITH {_VECTOR.format(q=_ALL_VECTORS, e=_EMBEDDED)} SELECT query_id, id, position FROM near WHERE position <= 5",
)
def vector_neighbours(spark, sf_dir):
    """Nearest records of every stored vector: more queries than one block, so in parts."""
    vectors = B.document_embeddings(spark, sf_dir)
    asked = vectors.select(F.col("proposal_id").alias("query_id"), F.col("embedding").alias("vector"))
    found = V.vector_search(asked, B.document_records(spark, sf_dir), vectors, limit=5, block=128)
    return found.select("query_id", "id", "position")


@query(
    "vector_search_filtered",
    f"WITH {_VECTOR.format(q=B.BENCHMARK_SQL, e=_EMBEDDED + chr(10) + chr(32) + 'WHERE network = ' + repr('en'))} "
    "SELECT query_id, id, position FROM near",
)
def vector_search_filtered(spark, sf_dir):
    found = V.vector_search(
        B.benchmark_queries(spark, sf_dir), B.document_records(spark, sf_dir), B.document_embeddings(spark, sf_dir), ENGLISH
    )
    return found.select("query_id", "id", "position")


@query(
    "cosine_distance",
    """SELECT vec_id, abs(round(list_cosine_distance(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]), 6)) AS distance FROM embeddings""",
)
def cosine(spark, sf_dir):
    e = B.table(spark, sf_dir, "embeddings")
    distance = cosine_distance(F.col("embedding"), F.reverse("embedding"))
    return e.select("vec_id", F.abs(F.round(distance, 6)).alias("distance"))


_PLANE = "((((t + 1) * 7919 + (b + 1) * 104729 + (a + 1) * 1299709) ^ 2)::BIGINT // 97) % 1009 - 504"
_APPROX = f"""
  p AS (SELECT t, b, list(({_PLANE})::DOUBLE ORDER BY a) AS normal FROM range(4) x(t), range(6) y(b), range(64) z(a) GROUP BY t, b),
  s AS (SELECT vec_id, embedding::DOUBLE[] AS v, t, sum(CASE WHEN list_dot_product(embedding::DOUBLE[], normal) > 0 THEN (1 << b) ELSE 0 END)::INTEGER AS sig
        FROM embeddings, p GROUP BY vec_id, embedding, t),
  c AS (SELECT DISTINCT q.vec_id AS query_id, r.vec_id AS id, q.v AS qv, r.v AS rv FROM s q JOIN s r ON q.t = r.t AND q.sig = r.sig
        WHERE q.vec_id IN (SELECT item_id FROM benchmark) AND r.vec_id IN (SELECT doc_id FROM documents)),
  n AS (SELECT query_id, id, list_cosine_distance(qv, rv) AS distance FROM c)
  SELECT query_id, id, abs(round(distance, 6)) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 12), id)::INTEGER AS position
  FROM n QUALIFY position <= 50"""


@query("approx_search", f"WITH {_APPROX}")
def approx_search(spark, sf_dir):
    found = V.approx_search(
        B.benchmark_queries(spark, sf_dir), B.document_records(spark, sf_dir), B.document_embeddings(spark, sf_dir), 64
    )
    return found.withColumn("distance", F.abs(F.round("distance", 6)))


@query("probed_search")
def probed_search(spark, sf_dir):
    """Neighbours of every twentieth vector from stored signatures; tests measure what is found."""
    vectors = B.document_embeddings(spark, sf_dir)
    dim = vectors.agg(F.max(F.size("embedding"))).first()[0]
    index = VI.build_signatures(vectors, scratch_dir(spark, "signatures"), dim)
    asked = vectors.filter("proposal_id % 20 = 0").select(F.col("proposal_id").alias("query_id"), F.col("embedding").alias("vector"))
    return VI.probed_search(asked, vectors.select(F.col("proposal_id").alias("id")), index, limit=10)


# --- fusion, reranking, hybrid -----------------------------------------------------------------

_FUSED = f"""{_LEXICAL}, {_VECTOR.format(q=B.BENCHMARK_SQL, e=_EMBEDDED)},
  fused AS (SELECT coalesce(l.query_id, v.query_id) AS query_id, coalesce(l.id, v.id) AS id,
      coalesce(1::DOUBLE / (60 + l.position), 0) + coalesce(1::DOUBLE / (60 + v.position) * 4, 0) AS rrf_score
    FROM lexical l FULL JOIN near v ON l.query_id = v.query_id AND l.id = v.id),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, id)::INTEGER AS rank FROM fused)"""


@query("rank_fusion", f"WITH {_FUSED} SELECT query_id, id, round(rrf_score, 9) AS rrf_score, rank FROM ranked")
def rank_fusion(spark, sf_dir):
    q, docs = B.benchmark_queries(spark, sf_dir), B.document_records(spark, sf_dir)
    lexical = T.lexical_search(q, docs)
    near = V.vector_search(q, docs, B.document_embeddings(spark, sf_dir))
    fused = H.fuse_rrf(lexical, near, vector_weight=4.0)
    return fused.select("query_id", "id", F.round("rrf_score", 9).alias("rrf_score"), "rank")


_SNIPPET = """CASE WHEN title <> '' THEN title WHEN description <> '' THEN
  (CASE WHEN length(description) > 150 THEN substring(description, 1, 150) || '...' ELSE description END) ELSE 'No description available' END"""


HYBRID_SQL = f"""WITH {_FUSED},
    kept AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM ranked WHERE rank <= 10 AND rrf_score >= 0.045)
    SELECT query_id, rank, id, title, network, type, {_SNIPPET} AS snippet, round(rrf_score, 9) AS score, description
    FROM kept JOIN ({B.DOCS_SQL}) USING (id) WHERE n <= 5"""


@query("hybrid_search", f"SELECT * REPLACE (md5(description) AS description) FROM ({HYBRID_SQL})")
def hybrid_search(spark, sf_dir):
    found = H.hybrid_search(
        B.benchmark_queries(spark, sf_dir), B.document_records(spark, sf_dir), B.document_embeddings(spark, sf_dir)
    )
    return found.select(
        "query_id", "rank", "id", "title", "network", "type", "snippet",
        F.round("score", 9).alias("score"), F.md5("description").alias("description"),
    )


_OVERLAP = f"""
  texts AS (SELECT id, {B.tokens_sql("title || ' ' || description")} AS w FROM ({B.DOCS_SQL})),
  asked AS (SELECT item_id AS query_id, list_distinct({B.tokens_sql('text')}) AS q FROM benchmark),
  head AS (SELECT r.*, len(list_intersect(q, w))::DOUBLE / len(q) AS s FROM ranked r JOIN texts USING (id) JOIN asked USING (query_id) WHERE rank <= 30),
  reordered AS (SELECT query_id, id, rrf_score, s, 0 AS segment, -s AS o, rank FROM head WHERE s >= 0.5
    UNION ALL SELECT query_id, id, rrf_score, NULL, 1, NULL, rank FROM ranked WHERE rank > 30),
  final AS (SELECT query_id, id, rrf_score, s, row_number() OVER (PARTITION BY query_id ORDER BY segment, o, rank)::INTEGER AS rank FROM reordered)"""


@query("rerank", f"WITH {_FUSED}, {_OVERLAP} SELECT query_id, id, rank, round(s, 6) AS rerank_score FROM final")
def rerank(spark, sf_dir):
    q, docs = B.benchmark_queries(spark, sf_dir), B.document_records(spark, sf_dir)
    near = V.vector_search(q, docs, B.document_embeddings(spark, sf_dir))
    fused = H.fuse_rrf(T.lexical_search(q, docs), near, vector_weight=4.0)
    wide = fused.join(docs.select("id", "title", "description"), "id").join(q.select("query_id", "query"), "query_id")
    ordered = H.rerank(wide, "overlap")
    return ordered.select("query_id", "id", "rank", F.round("rerank_score", 6).alias("rerank_score"))


@query(
    "hybrid_search_reranked",
    f"""WITH {_FUSED}, {_OVERLAP},
    kept AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM final WHERE rank <= 10 AND rrf_score >= 0.045)
    SELECT query_id, rank, id, round(rrf_score, 9) AS score FROM kept WHERE n <= 5""",
)
def hybrid_search_reranked(spark, sf_dir):
    found = H.hybrid_search(
        B.benchmark_queries(spark, sf_dir), B.document_records(spark, sf_dir), B.document_embeddings(spark, sf_dir), scorer="overlap"
    )
    return found.select("query_id", "rank", "id", F.round("score", 9).alias("score"))


@query(
    "hybrid_search_one",
    f"""WITH lexical AS ({_LEXICAL_ONE.format(where='')}),
    near AS (SELECT id, row_number() OVER (ORDER BY list_cosine_distance(v, {_PROBE_SQL}), id) AS position FROM ({_EMBEDDED}) QUALIFY position <= 50),
    fused AS (SELECT coalesce(l.id, v.id) AS id, coalesce(1::DOUBLE / (60 + l.position), 0) + coalesce(1::DOUBLE / (60 + v.position) * 4, 0) AS s
      FROM lexical l FULL JOIN near v ON l.id = v.id),
    ranked AS (SELECT *, row_number() OVER (ORDER BY s DESC, id)::INTEGER AS rank FROM fused),
    kept AS (SELECT *, row_number() OVER (ORDER BY rank) AS n FROM ranked WHERE rank <= 10 AND s >= 0.045)
    SELECT rank, id, title, round(s, 9) AS score FROM kept JOIN ({B.DOCS_SQL}) USING (id) WHERE n <= 5""",
)
def hybrid_search_one(spark, sf_dir):
    found = H.hybrid_search_one(WORDS, _PROBE, B.document_records(spark, sf_dir), B.document_embeddings(spark, sf_dir))
    return found.select("rank", "id", "title", F.round("score", 9).alias("score"))
