import pytest
from pyspark.sql import functions as F

from sheaf.operators.text_search import postings
from sheaf.session import (
    at_most,
    list_names,
    path_exists,
    prepare,
    read_text,
    scratch_dir,
    spread,
    staged,
    union_all,
    write_new_text,
)


def test_union_keeps_rows_of_a_join_above_it(spark):
    """Words of two columns, kept where wanted, counted, then joined again by both keys.

    Needs the setting that keeps unions from handing on their partitioning."""
    docs = spark.range(300).select(
        F.col("id"), F.concat_ws(" ", F.lit("w"), (F.col("id") % 17).cast("string")).alias("title"),
        F.concat_ws(" ", (F.col("id") % 5).cast("string"), (F.col("id") % 7).cast("string")).alias("description"),
    )
    rows = postings(docs)
    direct = {}
    for r in docs.collect():
        for word in f"{r.title} {r.description}".split():
            direct[(word, r.id)] = direct.get((word, r.id), 0) + 1
    assert {(r.token, r.id): r.tf for r in rows.collect()} == direct
    again = rows.join(rows.select("token", "id"), ["token", "id"])
    assert again.count() == len(direct)


def test_scratch_dir_uses_the_shared_folder(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    first, second = scratch_dir(spark, "a"), scratch_dir(spark, "a")
    assert first.startswith(base) and first != second


def test_at_most(spark):
    assert at_most(spark.range(5), 5) and not at_most(spark.range(6), 5)


def test_spread_deals_rows_out_only_when_asked(spark):
    df = spark.range(0, 100, 1, 3)
    assert spread(df) is df and spread(df, 7).rdd.getNumPartitions() == 7


def test_union_refuses_an_unprepared_session(spark):
    spark.conf.set("spark.sql.unionOutputPartitioning", "true")
    try:
        with pytest.raises(ValueError, match="prepare"):
            union_all(spark.range(1), spark.range(1))
        assert spark.conf.get("spark.sql.unionOutputPartitioning") == "true"
    finally:
        prepare(spark)


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})
        sparkContext = Context

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_dir(Session, "x")


def test_staged_rows_are_removed_after_use(spark):
    with staged(spark, spark.range(5), "five") as rows:
        folder = rows.inputFiles()[0].rpartition("/")[0]
        assert rows.count() == 5 and path_exists(spark, folder)
    assert not path_exists(spark, folder)


def test_small_files_are_created_once(spark, tmp_path):
    write_new_text(spark, f"{tmp_path}/a/m/1.json", "é")
    assert read_text(spark, f"{tmp_path}/a/m/1.json") == "é" and list_names(spark, f"{tmp_path}/a/m") == ["1.json"]
    with pytest.raises(FileExistsError):
        write_new_text(spark, f"{tmp_path}/a/m/1.json", "x")


def test_union_all_fills_missing_columns(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2, "y")], "x int, z string")
    assert sorted(union_all(a, b, allow_missing=True).collect(), key=lambda r: r.x) == [(1, None), (2, "y")]


def test_task_functions_travel_with_their_code():
    """A process without this package on its path can load and run what is sent to tasks."""
    import base64
    import subprocess
    import sys

    from pyspark import cloudpickle

    from sheaf.operators.embedding import hashed_words

    sent = base64.b64encode(cloudpickle.dumps(hashed_words(4))).decode()
    code = f"import base64, pyspark.cloudpickle as c; print(c.loads(base64.b64decode('{sent}'))(['a b'])[0])"
    out = subprocess.run([sys.executable, "-I", "-c", code], capture_output=True, text=True, cwd="/", timeout=60)
    assert out.returncode == 0, out.stderr
    assert sum(map(float, out.stdout.strip("[]\n ").split(","))) == 2.0


def test_scratch_blocks_clear_what_was_named_within(spark):
    from pathlib import Path

    from sheaf.session import scratch, written

    outer = written(spark.range(3), "outer")
    with scratch(spark):
        inner = written(spark.range(5), "inner")
        assert inner.count() == 5
        with scratch(spark):
            deepest = written(spark.range(7), "deepest").inputFiles()[0]
        assert not Path(deepest.removeprefix("file://")).exists() and inner.count() == 5
        folder = Path(inner.inputFiles()[0].removeprefix("file://")).parent
    assert not folder.exists() and outer.count() == 3
