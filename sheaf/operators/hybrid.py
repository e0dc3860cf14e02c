"""Fusion of lexical and vector results, reranking, and the whole hybrid search."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf import schema as S
from sheaf.functions import text as X
from sheaf.operators.filters import cut_scores
from sheaf.operators.text_search import lexical_search, lexical_search_one
from sheaf.operators.vector_search import vector_search, vector_search_one
from sheaf.schema import SearchFilters

Scorer = Callable[[str, list[str]], list[float]]


def fuse_rrf(
    lexical: DataFrame, vector: DataFrame, k: int = S.RRF_K, vector_weight: float = 1.0
) -> DataFrame:
    """``(query_id, id, lexical_score, vector_score, rrf_score, rank)`` from two ranked lists
    with ``(query_id, id, position)``, best first, ties by id."""

    def side(df: DataFrame, name: str, weight: float) -> DataFrame:
        score = (F.lit(1.0) / (F.lit(k) + F.col("position"))) * F.lit(float(weight))
        return df.select("query_id", "id", score.alias(name))

    both = side(lexical, "lexical_score", 1.0).join(
        side(vector, "vector_score", vector_weight), ["query_id", "id"], "full_outer"
    )
    total = F.coalesce("lexical_score", F.lit(0.0)) + F.coalesce("vector_score", F.lit(0.0))
    window = Window.partitionBy("query_id").orderBy(F.col("rrf_score").desc(), F.col("id").asc())
    return both.withColumn("rrf_score", total).withColumn("rank", F.row_number().over(window))


def overlap_score(query: Column, document: Column) -> Column:
    """Share of the query's distinct words that occur in the document."""
    words = F.array_distinct(X.tokens(query))
    shared = F.size(F.array_intersect(words, X.tokens(document)))
    return F.coalesce(F.try_divide(shared.cast("double"), F.size(words)), F.lit(0.0))


def _scored_by(scorer: Scorer) -> Callable[[Column, Column], Column]:
    @F.pandas_udf("double")
    def run(query: pd.Series, document: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(query), index=query.index, dtype="float64")
        for text, rows in document.dropna().groupby(query, sort=False):  # past the head there is no text
            try:
                out.loc[rows.index] = [float(s) for s in scorer(text, list(rows))]
            except Exception:  # a scorer that fails leaves its query unscored
                continue
        return out

    # Nondeterministic: the optimizer must not call a scorer twice for one row.
    return run.asNondeterministic()


def rerank(
    ranked: DataFrame, scorer: Scorer | str | None = None, head: int = S.RERANK_HEAD, cut: float = S.RERANK_CUT
) -> DataFrame:
    """Reorder the first ``head`` rows of each query by the scorer, drop those below ``cut``,
    and keep the rest behind them.

    ``ranked`` has ``query_id, query, id, title, description, rank``; the result adds
    ``rerank_score`` and a new ``rank``. Without a scorer, or where it fails, the order stays.
    ``scorer="overlap"`` uses :func:`overlap_score`.
    """
    if scorer is None:
        return ranked.withColumn("rerank_score", F.lit(None).cast("double"))
    return reorder(scored(ranked, scorer, head), head, cut)


def scored(ranked: DataFrame, scorer: Scorer | str, head: int = S.RERANK_HEAD) -> DataFrame:
    """Adds ``rerank_score`` to the first ``head`` rows of each query, from their texts."""
    title = F.coalesce(F.col("title"), F.lit(""))
    description = F.coalesce(F.col("description"), F.lit(""))
    document = X.embedding_text("plain", title, description)
    in_head = F.col("rank") <= head
    if scorer == "overlap":
        score = F.when(in_head, overlap_score(F.col("query"), document))
    else:
        score = _scored_by(scorer)(F.col("query"), F.when(in_head, document))
    return ranked.withColumn("rerank_score", score)


def reorder(rows: DataFrame, head: int = S.RERANK_HEAD, cut: float = S.RERANK_CUT) -> DataFrame:
    """The order that ``rerank_score`` gives. Needs no text: ids, ranks and scores are enough."""
    in_head = F.col("rank") <= head
    failed = F.max(in_head & F.col("rerank_score").isNull()).over(Window.partitionBy("query_id"))
    marked = rows.withColumn("_failed", failed).filter(~in_head | F.col("_failed") | (F.col("rerank_score") >= cut))
    segment = F.when(in_head, 0).otherwise(1)
    by_score = F.when(F.col("_failed") | (segment == 1), F.lit(None)).otherwise(-F.col("rerank_score"))
    order = Window.partitionBy("query_id").orderBy(segment.asc(), by_score.asc(), F.col("rank").asc())
    return marked.withColumn("_new", F.row_number().over(order)).drop("rank", "_failed").withColumnRenamed("_new", "rank")


def cut_results(
    ranked: DataFrame, top_k: int = S.TOP_K, min_score: float = S.RRF_CUT, cap: int = S.MAX_RESULTS
) -> DataFrame:
    """First ``top_k`` rows, then those scoring ``min_score``, then at most ``cap``."""
    kept = ranked.filter(F.col("rank") <= top_k)
    return cut_scores(kept, min_score, cap, score="rrf_score")


def result_columns(rows: DataFrame) -> DataFrame:
    """The result shape: eleven fields, with the snippet and the fused score."""
    keys = [c for c in ("query_id", "rank") if c in rows.columns]
    return rows.select(
        *keys,
        "id",
        F.coalesce("title", F.lit("")).alias("title"),
        "network",
        "type",
        F.col("amount_numeric").alias("amount"),
        "created_at",
        X.snippet(F.col("title"), F.col("description")).alias("snippet"),
        F.col("rrf_score").alias("score"),
        "description",
        "proposer",
        "status",
    )


@dataclass(frozen=True)
class Fusion:
    """How two ranked lists become one: their lengths, the rank constant and the vector weight."""

    lexical_limit: int = S.LEXICAL_LIMIT
    vector_limit: int = S.VECTOR_LIMIT
    k: int = S.RRF_K
    vector_weight: float = S.VECTOR_WEIGHT


def hybrid_search(
    queries: DataFrame,
    docs: DataFrame,
    embeddings: DataFrame,
    filters: SearchFilters | None = None,
    top_k: int = S.TOP_K,
    scorer: Scorer | str | None = None,
    min_score: float = S.RRF_CUT,
    cap: int = S.MAX_RESULTS,
    index: DataFrame | None = None,
    fusion: Fusion = Fusion(),
) -> DataFrame:
    """Search a table ``(query_id, query, vector)``; blank queries give no rows.

    Ranking works on ids and scores alone. The wide columns are joined afterwards, to the few
    rows that are left.
    """
    if top_k <= 0:
        raise ValueError("top_k must be positive")
    asked = queries.filter(F.coalesce(F.trim("query") != "", F.lit(False)))
    lexical = lexical_search(asked, docs, filters, fusion.lexical_limit, index)
    vector = vector_search(asked, docs, embeddings, filters, fusion.vector_limit)
    return _finish(asked.select("query_id", "query"), lexical, vector, docs, top_k, scorer, min_score, cap, fusion)


def hybrid_search_one(
    query: str,
    vector: list[float],
    docs: DataFrame,
    embeddings: DataFrame,
    filters: SearchFilters | None = None,
    top_k: int = S.TOP_K,
    scorer: Scorer | str | None = None,
    min_score: float = S.RRF_CUT,
    cap: int = S.MAX_RESULTS,
    fusion: Fusion = Fusion(),
) -> DataFrame:
    """Search with one literal query; filters and terms reach the scan as constants."""
    if top_k <= 0:
        raise ValueError("top_k must be positive")
    spark = docs.sparkSession
    asked = spark.range(1).select(F.lit(0).alias("query_id"), F.lit(query).alias("query"))
    if not query or not query.strip():
        docs = docs.filter(F.lit(False))
    lexical = lexical_search_one(query, docs, filters, fusion.lexical_limit).withColumn("query_id", F.lit(0))
    near = vector_search_one(vector, docs, embeddings, filters, fusion.vector_limit).withColumn("query_id", F.lit(0))
    return _finish(asked, lexical, near, docs, top_k, scorer, min_score, cap, fusion)


def _finish(
    asked: DataFrame,
    lexical: DataFrame,
    vector: DataFrame,
    docs: DataFrame,
    top_k: int,
    scorer: Scorer | str | None,
    min_score: float,
    cap: int,
    fusion: Fusion,
) -> DataFrame:
    """Rows are ranked and cut by ids and scores; wide columns are joined to those that are left. How
    is left to adaptive execution, which sees how few they are."""
    ranked = fuse_rrf(lexical, vector, fusion.k, fusion.vector_weight)
    wide = docs.select(
        "id", "network", "type", "title", "description", "proposer", "amount_numeric", "status", "created_at"
    )
    if scorer is None:
        ids = cut_results(ranked, top_k, min_score, cap).withColumnRenamed("id", "_id")
        return result_columns(wide.join(ids, F.col("id") == F.col("_id")).drop("_id"))
    # Rows past the head keep their order, so those past head + top_k can no longer be returned. The few
    # that are left take their texts along, so that records are read once more and not twice.
    ranked = ranked.filter(F.col("rank") <= S.RERANK_HEAD + top_k).withColumnRenamed("id", "_id")
    with_texts = wide.join(ranked, F.col("id") == F.col("_id")).drop("_id").join(asked, "query_id")
    return result_columns(cut_results(reorder(scored(with_texts, scorer)), top_k, min_score, cap))
