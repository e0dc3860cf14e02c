"""Embedding of texts through a user's model, and backfill of missing vectors."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from sheaf.functions import vectors as V
from sheaf.functions.normalize import strip
from sheaf.functions.text import embedding_text
from sheaf.operators.joins import existing, without_embedding
from sheaf.operators.merge import upsert
from sheaf.session import union_all

EmbedFn = Callable[[list[str]], list[list[float]]]


def hashed_words(dim: int = 64) -> EmbedFn:
    """Default model: counts of words by the hash of each word. No network, no weights."""

    def bucket(word: str) -> int:
        return int(hashlib.md5(word.encode("utf-8")).hexdigest()[:7], 16) % dim

    def run(texts: list[str]) -> list[list[float]]:
        known: dict[str, int] = {}
        out = np.zeros((len(texts), dim), dtype=np.float64)
        for i, text in enumerate(texts):
            hits = []
            for word in re.findall(r"\w+", text.lower()):
                if word not in known:
                    known[word] = bucket(word)
                hits.append(known[word])
            out[i] = np.bincount(hits, minlength=dim) if hits else 0
        return out.tolist()

    return run


def embed(
    df: DataFrame,
    text_col: str,
    fn: EmbedFn | None = None,
    dim: int = 64,
    output: str = "embedding",
    batch: int = 100,
    normalise: bool = True,
) -> DataFrame:
    """Add a vector per text. ``fn`` gets at most ``batch`` texts per call, inside the tasks;
    the number of partitions bounds how many calls run at once. Blank texts are not sent and
    get null, as do vectors of zeros."""
    model = fn or hashed_words(dim)

    @F.pandas_udf(ArrayType(FloatType()))
    def run(chunks: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in chunks:
            result: list = [None] * len(texts)
            wanted = [i for i, t in enumerate(texts) if t is not None and t.strip()]
            for start in range(0, len(wanted), batch):
                part = wanted[start : start + batch]
                for i, vector in zip(part, model([texts.iloc[i] for i in part]), strict=True):
                    values = np.asarray(vector, dtype=np.float64)
                    length = float(np.sqrt((values * values).sum()))
                    if length > 0:
                        result[i] = (values / length if normalise else values).astype(np.float32)
            yield pd.Series(result, index=texts.index, dtype=object)

    # Marked nondeterministic, so that a later filter on the vector does not call the model again.
    return df.withColumn(output, run.asNondeterministic()(F.col(text_col)))


def texts_to_embed(records: DataFrame, style: str = "structured", carry: Sequence[str] = ()) -> DataFrame:
    """``(proposal_id, text)`` of every record with something to embed, and the ``carry`` columns."""
    names = [c if c in records.columns else None for c in ("proposer", "network", "type")]
    extra = [F.coalesce(F.col(c), F.lit("")) if c else None for c in names]
    text = embedding_text(style, F.col("title"), F.col("description"), *extra)
    return records.select(F.col("id").cast("string").alias("proposal_id"), text.alias("text"), *carry).filter(
        strip(F.col("text")) != ""
    )


def backfill(
    records: DataFrame,
    embeddings: DataFrame,
    fn: EmbedFn | None = None,
    style: str = "capped",
    dim: int = 64,
    partitions: int | None = None,
) -> DataFrame:
    """The embeddings table with a vector added for every record that lacked one.

    Vectors already there are untouched; a second run has nothing left to add. ``partitions``
    sets how many model calls run side by side; otherwise the input's partitioning is kept.
    """
    missing = texts_to_embed(without_embedding(records, embeddings), style)
    if partitions:
        missing = missing.repartition(partitions, "proposal_id")
    added = embed(missing, "text", fn, dim).filter(F.col("embedding").isNotNull())
    return union_all(embeddings.select("proposal_id", "embedding"), added.select("proposal_id", "embedding"))


def upsert_embeddings(embeddings: DataFrame, fresh: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """Put fresh vectors in, the last write winning. With ``records``, only known ids count."""
    if records is not None:
        fresh = existing(fresh, records, "proposal_id")
    return upsert(embeddings.select("proposal_id", "embedding"), fresh, key="proposal_id", keep=())


def without_zero_vectors(embeddings: DataFrame) -> DataFrame:
    """Zero vectors, which have no direction, turned into null."""
    usable = V.is_usable(F.col("embedding"))
    return embeddings.withColumn("embedding", F.when(usable, F.col("embedding")))
