"""The stored table: merges, appends, failures in between, growth and clean-up."""

from datetime import datetime
from pathlib import Path

import pytest

from sheaf.operators import stored_table as ST

D1, D2 = datetime(2024, 1, 1), datetime(2024, 2, 2)


def batch(spark, data):
    return spark.createDataFrame(data, "id string, title string, created_at timestamp")


def many(spark, n=1000, title="x"):
    return batch(spark, [(str(i), title, D1) for i in range(n)])


def content(spark, path):
    rows = ST.read_table(spark, path).collect()
    found = {r.id: (r.title, r.created_at) for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "table")


def test_merge_rewrites_touched_buckets_only(spark, path):
    first = ST.merge_table(spark, path, many(spark, 200), buckets=8)
    second = ST.merge_table(spark, path, batch(spark, [("7", "y", D2), ("new", "z", D2)]))
    changed = [b for b in first.main.files if first.main.files[b] != second.main.files[b]]
    assert 1 <= len(changed) <= 2
    found = content(spark, path)
    assert len(found) == 201 and found["7"] == ("y", D1) and found["8"] == ("x", D1) and found["new"] == ("z", D2)


def test_a_wrong_bucket_count_or_key_is_refused_and_loses_nothing(spark, path):
    ST.merge_table(spark, path, many(spark), buckets=16)
    before = content(spark, path)
    for wrong in ({"buckets": 64}, {"buckets": 8}, {"key": "title"}):
        with pytest.raises(ValueError):
            ST.merge_table(spark, path, many(spark, 3, "y"), **wrong)
        with pytest.raises(ValueError):
            ST.append_table(spark, path, batch(spark, [("q", "y", D1)]).withColumnRenamed("title", "title"), **wrong)
    assert content(spark, path) == before
    for i in range(2):
        ST.merge_table(spark, path, batch(spark, [(f"m{i}", "y", D2)]))
    assert len(content(spark, path)) == 1002


def test_a_failure_before_the_switch_changes_nothing(spark, path, monkeypatch):
    ST.merge_table(spark, path, many(spark, 50), buckets=4)
    before = content(spark, path)

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(ST, "switch", dies)
        with pytest.raises(RuntimeError):
            ST.merge_table(spark, path, many(spark, 50, "y"))
    assert content(spark, path) == before
    ST.merge_table(spark, path, many(spark, 50, "y"))
    assert set(content(spark, path).values()) == {("y", D1)}


def test_two_writers_cannot_both_win(spark, path):
    ST.merge_table(spark, path, many(spark, 5), buckets=2)
    stale = ST.current(spark, path)
    ST.merge_table(spark, path, many(spark, 1, "y"))
    stale.version += 1
    with pytest.raises(FileExistsError):
        ST.switch(spark, path, stale)
    assert content(spark, path)["0"][0] == "y"


def test_repeated_keys_need_an_order(spark, path):
    rows = batch(spark, [("a", "old", D1), ("a", "new", D2), ("b", "x", D1), (None, "no key", D1)])
    with pytest.raises(ST.DuplicateKeys):
        ST.merge_table(spark, path, rows)
    assert ST.current(spark, path) is None
    numbered = rows.selectExpr("*", "case when title = 'new' then 2 else 1 end as n")
    ST.merge_table(spark, path, numbered, order=["n"])
    assert content(spark, path) == {"a": ("new", D2), "b": ("x", D1)}
    ST.merge_table(spark, path, numbered.selectExpr("id", "upper(title) as title", "created_at", "-n as n"), order=["n"])
    assert content(spark, path)["a"] == ("OLD", D2)  # the first time stays


def test_append(spark, path):
    ST.append_table(spark, path, batch(spark, [("a", "x", D1)]), buckets=4)
    ST.append_table(spark, path, batch(spark, [("b", "x", D1)]).selectExpr("*", "'done' as status"))
    rows = {r.id: r.status for r in ST.read_table(spark, path).collect()}
    assert rows == {"a": "pending", "b": "done"}
    for bad in ([("b", "x", D1)], [("c", "x", D1), ("c", "y", D1)], [(None, "x", D1)]):
        with pytest.raises(ST.DuplicateKeys):
            ST.append_table(spark, path, batch(spark, bad))
    assert ST.read_table(spark, path).count() == 2


def test_buckets_grow_with_the_table(spark, path, monkeypatch):
    small = ST.merge_table(spark, path, many(spark, 300))
    assert small.main.buckets == 1
    monkeypatch.setattr(ST, "BUCKET_BYTES", 1 << 10)
    grown = ST.merge_table(spark, path, batch(spark, [("7", "y", D2)]))
    assert grown.main.buckets > 1 and len(content(spark, path)) == 300 and content(spark, path)["7"] == ("y", D1)


def test_vacuum_and_empty_batches(spark, path):
    ST.merge_table(spark, path, many(spark, 0), buckets=4)
    assert content(spark, path) == {} and ST.read_table(spark, path).columns == ["id", "title", "created_at"]
    for title in "xyz":
        ST.merge_table(spark, path, many(spark, 20, title))
    assert ST.vacuum(spark, path) > 0 and ST.vacuum(spark, path) == 0
    assert set(content(spark, path).values()) == {("z", D1)}
    with pytest.raises(ValueError):
        ST.read_table(spark, path + "-absent")


def numbered(spark, ids, title="x", kind="long"):
    return spark.createDataFrame([(i, title) for i in ids], "id long, title string").selectExpr(f"cast(id as {kind}) as id", "title")


@pytest.mark.parametrize("kind", ["int", "smallint", "string", "decimal(12,0)", "double"])
def test_keys_of_another_type_are_cast_before_they_are_hashed(spark, path, kind):
    ST.merge_table(spark, path, numbered(spark, range(1000)), buckets=16)
    ST.merge_table(spark, path, numbered(spark, [3, 500, 2000], "y").selectExpr(f"cast(id as {kind}) as id", "title"))
    found = {r.id: r.title for r in ST.read_table(spark, path).collect()}
    assert ST.read_table(spark, path).count() == len(found) == 1001
    assert [found[i] for i in (3, 500, 2000, 4)] == ["y", "y", "y", "x"]
    with pytest.raises(ST.DuplicateKeys):
        ST.append_table(spark, path + "-a", numbered(spark, [1, 1]))
    ST.append_table(spark, path + "-a", numbered(spark, range(50)), buckets=4)
    with pytest.raises(ST.DuplicateKeys):
        ST.append_table(spark, path + "-a", numbered(spark, [7]).selectExpr(f"cast(id as {kind}) as id", "title"))
    ST.append_table(spark, path + "-a", numbered(spark, [70]).selectExpr(f"cast(id as {kind}) as id", "title"))
    assert ST.read_table(spark, path + "-a").select("id").distinct().count() == 51


@pytest.mark.parametrize("value", ["1.5D", "'x'", "'007'", "9223372036854775807BD + 1"])
def test_a_cast_that_loses_something_is_refused(spark, path, value):
    ST.merge_table(spark, path, numbered(spark, range(10)), buckets=2)
    with pytest.raises(ST.LossyCast):
        ST.merge_table(spark, path, spark.range(1).selectExpr(f"{value} as id", "'y' as title"))
    assert {r.title for r in ST.read_table(spark, path).collect()} == {"x"}


def test_few_keys_of_a_million_rewrite_few_files(spark, path, monkeypatch):
    monkeypatch.setattr(ST, "FILE_ROWS", 5000)
    rows = spark.range(1_000_000).selectExpr("id * 3 as id", "'x' as title")
    first = ST.merge_table(spark, path, rows, buckets=16)
    files = {f.path for f in first.main.listed()}
    assert len(files) >= 200
    keys = [3 * (i * 99_991 % 1_000_000) for i in range(10)]
    second = ST.merge_table(spark, path, numbered(spark, keys, "y"))
    gone = files - {f.path for f in second.main.listed()}
    assert 1 <= len(gone) <= 10
    fresh = ST.merge_table(spark, path, numbered(spark, [3 * i + 1 for i in range(0, 1000, 100)], "new"))
    assert len({f.path for f in second.main.listed()} - {f.path for f in fresh.main.listed()}) <= 3  # only false alarms
    titles = {r.title: r["count"] for r in ST.read_table(spark, path).groupBy("title").count().collect()}
    assert titles == {"x": 999_990, "y": 10, "new": 10}


def test_loose_buckets_are_put_together(spark, path, monkeypatch):
    monkeypatch.setattr(ST, "LOOSE_FILES", 3)
    for i in range(8):
        last = ST.merge_table(spark, path, numbered(spark, sorted({i, 0}), f"t{i}"), buckets=1 if not i else None)
    assert len(last.main.listed()) <= 5
    assert {r.id: r.title for r in ST.read_table(spark, path).collect()} == {i: f"t{i}" if i else "t7" for i in range(8)}


def pair(spark, path):
    ST.merge_table(spark, path, numbered(spark, range(100)), buckets=4, name="records")
    vectors = spark.range(100).selectExpr("id as proposal_id", "array(cast(id as float), 1f) as embedding")
    return ST.merge_table(spark, path, vectors, "proposal_id", (), 2, name="vectors")


def test_deletion_cascades_in_one_commit(spark, path, monkeypatch):
    pair(spark, path)
    keys = spark.createDataFrame([(5,), (5,), (None,), (17,), (4000,)], "gone int")
    seen = []
    switched = ST.switch

    def look(spark, where, manifest):
        seen.append(tuple(ST.read_table(spark, path, n).count() for n in ("records", "vectors")))
        switched(spark, where, manifest)
        seen.append(tuple(ST.read_table(spark, path, n).count() for n in ("records", "vectors")))

    with monkeypatch.context() as m:
        m.setattr(ST, "switch", look)
        ST.delete_keys(spark, path, keys)
    assert seen == [(100, 100), (98, 98)]
    left = {r.id for r in ST.read_table(spark, path, "records").collect()}
    assert left == {r.proposal_id for r in ST.read_table(spark, path, "vectors").collect()} == set(range(100)) - {5, 17}
    ST.delete_keys(spark, path, spark.createDataFrame([(9000,)], "id long"))
    ST.delete_keys(spark, path, ST.read_table(spark, path, "records").select("id"), {"vectors": "proposal_id"})
    assert [ST.read_table(spark, path, n).count() for n in ("records", "vectors")] == [98, 0]
    with pytest.raises(ValueError):
        ST.delete_keys(spark, path, keys, {"absent": "id"})


def test_an_older_version_is_read_checked_and_restored(spark, path):
    good = pair(spark, path).version
    worse = spark.range(50).selectExpr("id as proposal_id", "array(cast(id as float)) as embedding")
    bad = ST.merge_table(spark, path, worse, "proposal_id", (), name="vectors").version
    ST.delete_keys(spark, path, spark.range(10).toDF("id"))
    fits = ST.vectors_fit("embedding", 2)
    with pytest.raises(ST.DamagedSnapshot):
        ST.restore(spark, path, bad, lambda t: fits(t["vectors"]))
    assert ST.read_table(spark, path, "records").count() == 90  # nothing has changed
    assert ST.read_table(spark, path, "vectors", good).filter("size(embedding) = 2").count() == 100
    back = ST.restore(spark, path, good, lambda t: fits(t["vectors"]))
    assert back.version == bad + 2 and ST.read_table(spark, path, "vectors").filter("size(embedding) = 2").count() == 100
    assert ST.vacuum(spark, path, keep=2) >= 0 and len(ST.versions(spark, path)) == 2
    with pytest.raises(ValueError):
        ST.read_table(spark, path, "records", good)
    for f in ST.manifest_of(spark, path, back.version).tables["records"].listed()[:1]:
        Path(path, f.path).write_bytes(b"PAR1")
    with pytest.raises(ST.DamagedSnapshot):
        ST.restore(spark, path, back.version)


def test_a_file_that_very_many_keys_fall_to_is_taken_without_its_filter(spark, path, monkeypatch):
    """Keys times files would grow with the square of the table. Keys without ranges fall to all files of a bucket."""
    monkeypatch.setattr(ST, "FILE_ROWS", 100)
    monkeypatch.setattr(ST, "PROBED", 500, raising=False)
    rows = spark.range(4000).selectExpr("cast(id as double) as id", "cast(id as string) as text")
    ST.append_missing(spark, path, rows, buckets=2)
    table = ST.current(spark, path).main
    files = {f.path for f in table.listed()}
    assert len(files) >= 40
    asked, bits = [], ST._bits
    monkeypatch.setattr(ST, "_bits", lambda key: asked.append(1) or bits(key))
    assert ST.holding(spark, path, table, spark.range(9000).selectExpr("cast(id as double) as id")) == files
    assert not asked
    assert len(ST.holding(spark, path, table, spark.range(1).selectExpr("cast(id as double) as id"))) < 40
    assert asked
    more = spark.range(2000, 9000).selectExpr("cast(id as double) as id", "'late' as text")
    ST.append_missing(spark, path, more)
    got = [(r.id, r.text) for r in ST.read_table(spark, path).collect()]
    assert sorted(got) == [(float(i), str(i) if i < 4000 else "late") for i in range(9000)]
    version = ST.current(spark, path).version
    ST.append_missing(spark, path, more.limit(0))
    assert ST.current(spark, path).version == version
