from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheaf.operators import embedding as E
from sheaf.operators import merge as M
from sheaf.operators.analytics import coverage


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def table(spark, data):
    return spark.createDataFrame(data, "id string, title string, created_at timestamp")


D1, D2 = datetime(2024, 1, 1), datetime(2024, 2, 2)


def test_upsert_keeps_first_time_and_takes_nulls(spark):
    target = table(spark, [("a", "old", D1), ("b", "stay", D1)])
    source = table(spark, [("a", None, D2), ("c", "new", D2)])
    merged = M.upsert(target, source)
    expected = [("a", None, D1), ("b", "stay", D1), ("c", "new", D2)]
    assert rows(merged, "id") == expected
    assert rows(M.upsert(merged, source), "id") == expected


def test_first_per_key_with_a_hot_key(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("id"), F.col("id").alias("n"))
    kept = M.first_per_key(df, "id", ["n"])
    assert kept.count() == 2001
    assert kept.filter("id = 'hot'").first().n == 0
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_append_new(spark):
    target = table(spark, [("a", "x", D1)]).withColumn("status", F.lit("done"))
    fresh = table(spark, [("b", "x", D1)]).withColumn("status", F.lit(None).cast("string"))
    assert M.append_new(fresh, target).first().status == "pending"
    with pytest.raises(Exception, match="duplicate key: a"):
        M.append_new(table(spark, [("a", "x", D1)]), target).collect()
    with pytest.raises(Exception, match="duplicate key: z"):
        M.append_new(table(spark, [("z", "x", D1), ("z", "x", D1)]), target).collect()
    with pytest.raises(Exception, match="duplicate key: a"):  # whatever columns are asked for
        M.append_new(table(spark, [("a", "x", D1)]), target).select("status").collect()


def test_vectors_survive_text(spark):
    vectors = spark.createDataFrame([("a", [0.1, -2.5e-7]), ("b", [1.0]), ("c", None)], "proposal_id string, embedding array<float>")
    ok, mismatched = M.import_vectors(M.export_vectors(vectors), 2)
    assert [r.proposal_id for r in ok.collect()] == ["a"]
    assert np.allclose(ok.first().embedding, [0.1, -2.5e-7], rtol=1e-7)
    assert rows(mismatched, "proposal_id") == [("b", 1)]
    checked = M.verify_restore(vectors, ok, 2).first()
    assert (checked.expected, checked.restored, checked.ok) == (2, 1, False)


def test_dimension_audit(spark):
    vectors = spark.createDataFrame([("a", [0.1, 1.0]), ("b", [1.0]), ("c", [1.0]), ("d", None)], "proposal_id string, embedding array<float>")
    assert {(r[0], r[1]) for r in M.dimension_audit(vectors).collect()} == {(2, 1), (1, 2), (None, 1)}


def test_backfill_fills_each_gap_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def model(texts):
        calls.add(len(texts))
        return [[float(len(t)), 1.0] for t in texts]

    records = spark.createDataFrame([(str(i), "t" * i, "") for i in range(1, 31)], "id string, title string, description string")
    records = records.union(spark.createDataFrame([("blank", " ", None)], records.schema))
    stored = spark.createDataFrame([("1", [9.0, 9.0])], "proposal_id string, embedding array<float>")
    filled = E.backfill(records, stored, model, dim=2).cache()
    assert filled.count() == 30 and calls.value == 29
    assert filled.filter("proposal_id = '1'").first().embedding == [9.0, 9.0]
    assert E.backfill(records, filled, model, dim=2).count() == 30
    found = coverage(records, filled).first()
    assert (found.total, found.embedded, found.missing) == (31, 30, 1)


def test_embed_skips_blank_and_zero(spark):
    texts = spark.createDataFrame([("a",), ("  ",), (None,), ("zero",)], "text string")
    out = [r.embedding for r in E.embed(texts, "text", lambda ts: [[0.0, 0.0] if t == "zero" else [3.0, 4.0] for t in ts]).collect()]
    assert out[0] == pytest.approx([0.6, 0.8]) and out[1:] == [None, None, None]
