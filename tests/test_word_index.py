import random

import pytest
from pyspark.sql import functions as F

from sheaf.operators import text_search as T
from sheaf.operators import word_index as W
from sheaf.operators.stored_table import DuplicateKeys, LossyCast

WORDS = ["tax", "taxi", "the", "upgrade", "runtime", "treasury", "naïve", "x_y", "treasuries"]
QUERIES = [(1, "tax upgrade"), (2, "treasur"), (3, "the of"), (4, "runtime the"), (5, "missing"), (6, "naïve x_y")]
SCHEMA = "id long, title string, description string"


def frame(spark, records):
    return spark.createDataFrame([(i, *r) for i, r in records.items()], SCHEMA).repartition(3)


def found(spark, index, docs):
    queries = spark.createDataFrame(QUERIES, "query_id int, query string")
    lexical = T.lexical_search(queries, docs, limit=5, index=index).collect()
    full = T.fulltext_search(queries, docs, limit=5, index=index).withColumn("rank", F.round("rank", 9)).collect()
    return sorted(map(tuple, lexical)), sorted(map(tuple, full))


def test_index_follows_loads(spark, tmp_path, monkeypatch):
    """After every load the index answers as a fresh one does, also when segments are put together."""
    monkeypatch.setattr(W, "SMALLEST", 64)
    rng, path, live = random.Random(5), str(tmp_path / "words"), {}
    text = lambda n: " ".join(rng.choices(WORDS, k=rng.randint(0, n))) or None
    together = 0
    for load in range(9):
        batch = {i: (text(3), text(9)) for i in rng.sample(range(60), 40 if load == 0 else 12)}
        gone = rng.sample(range(80), 5) if load else []
        deleted = spark.createDataFrame([(i,) for i in [*gone, None]], "key long") if load % 2 else None
        live = {i: r for i, r in live.items() if deleted is None or i not in gone} | batch
        index = W.update_index(spark, path, frame(spark, batch), deleted, source=load)
        segments = index.manifest.segments
        together += len(segments) < load + 1
        assert len(index.manifest.dead) <= W.FANOUT and index.manifest.source == load
        if load in (4, 8):
            docs = frame(spark, live)
            assert sorted(map(tuple, index.postings().collect())) == sorted(map(tuple, T.postings(docs).collect()))
            assert found(spark, W.read_index(spark, path), docs) == found(spark, None, docs)
    assert together
    before = W.read_index(spark, path)
    index = W.compact_index(spark, path)
    assert len(index.manifest.segments) == 1 and not index.manifest.dead
    assert sorted(map(tuple, index.postings().collect())) == sorted(map(tuple, before.postings().collect()))
    assert W.vacuum_index(spark, path) > 0
    assert W.index_versions(spark, path) == [index.manifest.version]
    assert found(spark, W.read_index(spark, path), docs) == found(spark, None, docs)


def test_search_reads_no_texts_and_only_the_index(spark, tmp_path):
    path, texts = str(tmp_path / "words"), str(tmp_path / "texts")
    frame(spark, {1: ("tax", "the tax"), 2: (None, "upgrade")}).write.parquet(texts)
    docs = spark.read.parquet(texts)
    index = W.update_index(spark, path, docs)
    queries = spark.createDataFrame(QUERIES, "query_id int, query string")
    for search in (T.lexical_search, T.fulltext_search):
        files = search(queries, docs, index=index).inputFiles()
        assert files and all("/words/" in f and "/texts/" not in f for f in files)


def test_updates_that_change_nothing_or_are_refused(spark, tmp_path):
    path = str(tmp_path / "words")
    with pytest.raises(ValueError):
        W.update_index(spark, path, deleted=spark.range(3))
    index = W.update_index(spark, path, frame(spark, {}))
    assert index.postings().count() == 0 and not index.manifest.segments
    W.update_index(spark, path, frame(spark, {1: ("tax", None), 2: (None, None), None: ("lost", "")}))
    for _ in range(2):  # the same batch again, by narrower ids
        narrow = frame(spark, {1: ("tax", None)}).withColumn("id", F.col("id").cast("int"))
        index = W.update_index(spark, path, narrow, spark.range(1, 2))
        assert [tuple(r) for r in index.postings().collect()] == [("tax", 1, 1, True, False)]
    version = index.manifest.version
    with pytest.raises(DuplicateKeys):
        W.update_index(spark, path, frame(spark, {1: ("a", None)}).union(frame(spark, {1: ("b", None)})))
    with pytest.raises(LossyCast):
        W.update_index(spark, path, frame(spark, {1: ("a", None)}).withColumn("id", F.lit("x")))
    assert W.current_index(spark, path).version == version
    index = W.update_index(spark, path, frame(spark, {1: (None, "")}))  # no words: the old ones end
    assert index.postings().count() == 0
