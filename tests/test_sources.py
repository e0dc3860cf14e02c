import json
import os
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf import schema as S
from sheaf import session
from sheaf.operators import analytics as A
from sheaf.operators import stored_table
from sheaf.operators.stored_table import read_table
from sheaf.plans import ingest
from sheaf.plans.ingest import run_load
from sheaf.sources import files
from sheaf.sources.files import CORRUPT, good_and_corrupt, land, load_records, union_relaxed
from sheaf.sources.paged import fetch_pages, fetch_plan, parse_items
from sheaf.streaming.incremental import run_incremental

AS_OF = datetime(2025, 1, 1)


def write(path, value):
    path.parent.mkdir(exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value, indent=1), encoding="utf-8")


def test_every_file_shape_in_one_load(spark, tmp_path):
    write(tmp_path / "a.json", {"network": "polkadot", "total_items": 2, "items": [{"id": 1, "title": "a"}, {"id": 2, "title": "b"}]})
    write(tmp_path / "b.json", {"data": [{"id": 3, "title": "c", "onChainInfo": {"status": "Executed"}}]})
    write(tmp_path / "c.json", [{"id": 4, "title": "d"}, {"id": "x5"}])
    write(tmp_path / "d.json", {"id": 6, "title": "single", "network": "kusama"})
    write(tmp_path / "e.json", '{"id": 7, "tit')
    write(tmp_path / "f.json", {"network": "kusama", "items": []})
    write(tmp_path / "g.csv", "id,title,amount\n8,from csv,2.5\n")
    write(tmp_path / "h.txt", "ignored")
    loaded = load_records(spark, [str(tmp_path), str(tmp_path / "missing.json")]).cache()
    good, bad = good_and_corrupt(loaded)
    rows = {r.id: r for r in good.collect()}
    assert set(rows) == {"1", "2", "3", "4", "x5", "6", "8"}
    assert rows["1"].network is None and rows["6"].network == "kusama"
    assert rows["3"].onChainInfo.status == "Executed"
    assert rows["8"].amount == 2.5
    assert [r._origin.file.endswith("e.json") for r in bad.collect()] == [True]


def test_nothing_to_load(spark, tmp_path):
    write(tmp_path / "h.txt", "ignored")
    with pytest.raises(ValueError):
        load_records(spark, [str(tmp_path), "/tmp/not-there/*.json"])


def test_declared_schema_needs_no_inference(spark, tmp_path):
    write(tmp_path / "a.json", {"items": [{"id": "1", "amount": "3"}]})
    row = load_records(spark, [str(tmp_path)], S.ENVELOPE_SCHEMA).first()
    assert (row.id, row.amount, row[CORRUPT]) == ("1", "3", None)


def test_union_relaxed_widens(spark):
    a = spark.createDataFrame([(1, 2)], "x int, y int")
    b = spark.createDataFrame([("t", 2.5)], "x string, y double")
    assert sorted(union_relaxed(a, b).collect()) == [("1", 2.0), ("t", 2.5)]


def test_load_order_follows_files_and_places(spark, tmp_path):
    write(tmp_path / "a.json", {"items": [{"id": "k", "title": "first"}, {"id": "k", "title": "second"}]})
    write(tmp_path / "b.json", [{"id": "k", "title": "third"}])
    rows = load_records(spark, [str(tmp_path)]).orderBy("_origin").collect()
    assert [r.title for r in rows] == ["first", "second", "third"]


def test_land_splits_large_units(spark, tmp_path):
    items = spark.range(25).select(F.lit("kusama").alias("network"), F.lit("Tip").alias("kind"), F.col("id").cast("string").alias("id"), F.col("id").alias("p"))
    land(items, str(tmp_path / "out"), ["network", "kind"], "p", AS_OF, chunk=10)
    files = list((tmp_path / "out").rglob("*.json"))
    sizes = sorted(json.loads(f.read_text())["total_items"] for f in files)
    assert sizes == [5, 10, 10]
    assert sorted(int(r.id) for r in load_records(spark, [str(tmp_path / "out")]).collect()) == list(range(25))


def test_fetch_plan_units(spark):
    plan = fetch_plan(spark)
    assert plan.count() == 2 * (9 + 27)
    assert plan.filter("type = 'ReferendumV2' and origin is null").count() == 0


def test_fetch_pages(spark):
    def fetcher(network, type, origin, limit, page):
        if network == "broken":
            raise OSError("down")
        if type == "Empty":
            return {"items": []}
        total = 7
        ids = range((page - 1) * limit, min(page * limit, total))
        return {"items": [{"id": f"{network}-{i}", "title": type} for i in ids], "totalCount": 5 if type == "Tip" else None}

    plan = fetch_plan(spark, ["polkadot", "broken"], ["Tip", "Bounty", "Empty"])
    pages = fetch_pages(plan, fetcher, limit=3, max_items=6, partitions=3).cache()
    items = parse_items(pages).orderBy("unit_type", "position").collect()
    assert [(r.unit_type, r.position) for r in items] == [("Bounty", i) for i in range(6)] + [("Tip", i) for i in range(5)]
    assert items[0].id == "polkadot-0"
    errors = pages.filter("error is not null").collect()
    down = [r for r in errors if r.network == "broken"]
    assert sorted(r.type for r in down) == ["Bounty", "Empty", "Tip"] and down[0].error == "OSError: down"
    assert [(r.type, r.error) for r in errors if r.network != "broken"] == [("Bounty", "cut after 6 items")]
    whole = parse_items(fetch_pages(plan, fetcher, limit=3)).groupBy("unit_type").count().collect()
    assert {r[0]: r[1] for r in whole} == {"Bounty": 7, "Tip": 5}


def test_paging_goes_as_far_as_the_total(spark):
    plan = fetch_plan(spark, ["polkadot"], ["Tip"])
    fetcher = lambda n, t, o, limit, page: {"items": [{"id": str(i)} for i in range((page - 1) * limit, min(page * limit, 2345))], "totalCount": 2345}
    assert fetch_pages(plan, fetcher, limit=50).count() == 2345


def test_unreadable_files_are_kept_as_rejects(spark, tmp_path):
    write(tmp_path / "in" / "good.json", {"items": [{"id": "a", "network": "dot", "title": "one"}, {"id": "c", "network": "else"}]})
    (tmp_path / "in" / "bad.json").write_text('{"items": [{"id": "b", ')
    paths = [str(tmp_path / n) for n in ("records", "vectors", "rejects")]
    for name in ("first", "second", "second"):
        done = run_load(spark, [str(tmp_path / "in")], *paths[:2], AS_OF, rejects_path=paths[2], load_id=name)
        assert (done.records, done.unreadable, done.deduplicated, done.upserted, done.refused, done.embedded) == (2, 1, 2, 1, 1, 1)
    rejects = spark.read.parquet(paths[2]).collect()
    assert sorted((r["load"], r.reason) for r in rejects) == sorted((n, x) for n in ("first", "second") for x in ("network not allowed", "unreadable"))
    bad = next(r for r in rejects if r.reason == "unreadable")
    assert bad.file.endswith("bad.json") and bad.raw.startswith('{"items"')
    scratch = Path(spark.conf.get("spark.checkpoint.dir"))
    assert not list(scratch.glob("staged-*"))


def test_incremental_runs_merge_each_file_once(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    paths = [str(tmp_path / n) for n in ("records", "vectors", "checkpoint")]

    def run():
        run_incremental(spark, str(inbox), *paths, AS_OF, buckets=4, rejects_path=str(tmp_path / "rejects"))
        return {r.id: r for r in read_table(spark, paths[0]).collect()}

    write(inbox / "1.json", {"items": [{"id": "a", "network": "dot", "title": "one", "createdAt": "2024-01-01"}, {"id": "b", "network": "ksm", "title": "two"}, {"id": "c", "network": "else"}]})
    first = run()
    assert set(first) == {"a", "b"}
    write(inbox / "2.json", {"items": [{"id": "a", "network": "dot", "title": "changed", "createdAt": "2024-06-01"}, {"id": "d", "network": "dot", "title": "new"}]})
    second = run()
    assert set(second) == {"a", "b", "d"}
    assert second["a"].title == "changed" and second["a"].created_at == datetime(2024, 1, 1)
    assert run() == second
    vectors = {r.proposal_id: r.embedding for r in read_table(spark, paths[1]).collect()}
    assert set(vectors) == {"a", "b", "d"} and all(len(v) == 64 for v in vectors.values())
    assert [r.id for r in spark.read.parquet(str(tmp_path / "rejects")).collect()] == ["c"]


def test_load_twice_changes_nothing(spark, tmp_path):
    write(tmp_path / "a.json", {"items": [{"id": str(i), "network": "dot", "title": f"t {i}"} for i in range(20)]})
    records, vectors = str(tmp_path / "r"), str(tmp_path / "v")
    calls = spark.sparkContext.accumulator(0)

    def model(texts):
        calls.add(len(texts))
        return [[float(len(t)), 1.0] for t in texts]

    for n in (1, 2):
        run_load(spark, [str(tmp_path / "a.json")], records, vectors, AS_OF, S.ENVELOPE_SCHEMA, embed_fn=model, buckets=4)
        assert calls.value == 20 * n
    assert read_table(spark, records).count() == 20
    assert read_table(spark, vectors).count() == 20


def test_items_without_a_position_become_several_envelopes(spark):
    items = spark.range(100).selectExpr("'n' as network", "cast(null as long) as position", "id").coalesce(2)
    sizes = [r.total_items for r in files.envelopes(items, ["network"], "position", AS_OF, chunk=10).collect()]
    assert sum(sizes) == 100 and max(sizes) <= 10


@pytest.mark.parametrize("offset", [0, 7, 95, 99, 100, 400])
def test_deep_pages(spark, offset):
    rows = spark.range(100).selectExpr("id", "if(id % 9 = 0, null, timestamp_seconds(id % 4)) as created_at").repartition(5)
    want = [r.id for r in A.page(rows, 8, offset).collect()]
    assert [r.id for r in A.deep_page(rows, 8, offset, 6).collect()] == want


def test_texts_land_as_files_of_their_own(spark, tmp_path):
    texts = ['{"items": [{"id": "é', '{"id": "good", "title": "x"}', "{"]
    files.land_texts(spark.createDataFrame([(t,) for t in texts], "value string").repartition(2), f"{tmp_path}/a")
    good, corrupt = good_and_corrupt(load_records(spark, [f"{tmp_path}/a"], T.StructType().add("id", "string").add("title", "string")))
    assert [r.id for r in good.collect()] == ["good"]
    assert sorted(r[CORRUPT].strip() for r in corrupt.collect()) == sorted([texts[0], texts[2]])


def test_files_are_found_at_any_depth_without_a_call_for_each(spark, tmp_path, monkeypatch):
    for i in range(30):
        (tmp_path / f"a{{1}}/b[{i}]").mkdir(parents=True)
        (tmp_path / f"a{{1}}/b[{i}]/x.json").write_text("{}")
    calls = []
    send = spark.sparkContext._gateway._gateway_client.send_command
    monkeypatch.setattr(spark.sparkContext._gateway._gateway_client, "send_command", lambda c, *a, **k: calls.append(c) or send(c, *a, **k))
    assert not session.holds_files(spark, str(tmp_path), (".csv", ".CSV"))
    assert len(calls) < 200
    assert session.holds_files(spark, str(tmp_path), (".json", ".JSON"))
    (tmp_path / "a{1}/b[7]/y.CSV").write_text("")
    assert session.holds_files(spark, str(tmp_path), (".csv", ".CSV"))


def test_a_load_writes_its_records_once_before_the_merge(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([("1", "en", "a"), ("1", "en", "b"), ("2", "xx", "c")], "id string, network string, title string")
    staged, names = session.staged, []
    for module in (ingest, stored_table):
        monkeypatch.setattr(module, "staged", lambda s, df, name: names.append(name) or staged(s, df, name))
    loaded = load_records(spark, [_as_json(rows, tmp_path)])
    metrics = ingest.load_into(spark, loaded, f"{tmp_path}/t", None, datetime(2025, 1, 1), networks=["en"])
    assert names == ["records", "unreadable"]
    assert (metrics.records, metrics.deduplicated, metrics.upserted, metrics.refused) == (3, 2, 1, 1)
    assert [r.id for r in read_table(spark, f"{tmp_path}/t").collect()] == ["1"]


def _as_json(rows, tmp_path):
    path = tmp_path / "in"
    path.mkdir()
    for i, line in enumerate(rows.toJSON().collect()):
        (path / f"{i}.json").write_text(line)
    return str(path)


def test_batches_of_a_run_are_merged_together_as_if_one_after_the_other(spark, tmp_path, monkeypatch):
    drops = [
        {"items": [{"id": "a", "network": "dot", "title": "one", "createdAt": "2024-01-01"}, {"id": "a", "network": "dot", "title": "again"}, {"id": "x", "network": "else"}]},
        {"items": [{"id": "b", "network": "ksm", "title": "two"}, {"id": "a", "network": "dot", "title": "changed", "createdAt": "2024-06-01"}]},
        '{"items": [{"id": "c", ',
        {"items": [{"id": "b", "network": "ksm", "title": "blank"}, {"id": "x", "network": "dot", "title": "valid now"}]},
        {"items": [{"id": "a", "network": "else", "title": "refused"}, {"id": "d", "network": "dot", "title": "new"}]},
    ]
    for i, drop in enumerate(drops):
        write(tmp_path / "in" / f"{i}.json", drop)
        os.utime(tmp_path / "in" / f"{i}.json", (1_700_000_000 + i,) * 2)

    def model(texts):  # a vector of zeros is none: the one before stays
        return [[0.0 if "blank" in t else float(len(t)), 0.0 if "blank" in t else 1.0] for t in texts]

    def state(place):
        records = {r.id: (r.title, r.network, r.created_at) for r in read_table(spark, f"{place}/records").collect()}
        vectors = {r.proposal_id: tuple(r.embedding) for r in read_table(spark, f"{place}/vectors").collect()}
        rejects = sorted((r["load"], r.reason, r.id) for r in spark.read.parquet(f"{place}/rejects").collect())
        return records, vectors, rejects, sorted(p.name for p in Path(f"{place}/rejects").glob("load=*"))

    want = ingest.LoadMetrics()
    one = tmp_path / "one"
    for i in range(len(drops)):
        loaded = load_records(spark, [str(tmp_path / "in" / f"{i}.json")], S.ENVELOPE_SCHEMA)
        paths = f"{one}/records", f"{one}/vectors"
        want += ingest.load_into(spark, loaded, *paths, AS_OF, model, f"{one}/rejects", buckets=2, load_id=f"batch-{i}")

    merges, merge = [], ingest.merge_table
    monkeypatch.setattr(ingest, "merge_table", lambda *a, **k: merges.append(a[1]) or merge(*a, **k))
    place = tmp_path / "all"
    paths = f"{place}/records", f"{place}/vectors", f"{place}/checkpoint"

    def run(fn):
        return run_incremental(spark, f"{tmp_path}/in", *paths, AS_OF, max_files=1, embed_fn=fn, rejects_path=f"{place}/rejects", buckets=2)

    def down(texts):
        raise OSError("model down")

    with pytest.raises(Exception, match="model down"):
        run(down)
    merges.clear()
    done = run(model)  # what the failed run has parsed is merged now, and only once
    assert merges == [paths[0], paths[1]]
    assert state(place) == state(one)
    got, want = (dict(vars(m), seconds=0) for m in (done, want))
    assert got == want and got["records"] == 9 and got["unreadable"] == 1
    assert run(model).records == 0 and len(merges) == 2
    assert not list(Path(f"{place}/checkpoint/pending").glob("*"))


def test_packed_landings_load_alike(spark, tmp_path):
    items = spark.createDataFrame([("polkadot", i, f"item {i}") for i in range(7)], "network string, position int, title string")
    broken = spark.createDataFrame([('{"items": [{"id": "1"',), ("[",)], "value string")
    for name, gzip in (("plain", False), ("packed", True)):
        files.land(items, f"{tmp_path}/{name}/good", ["network"], "position", AS_OF, chunk=3, gzip=gzip)
        files.land_texts(broken, f"{tmp_path}/{name}/broken", gzip=gzip)
    found = {}
    for name in ("plain", "packed"):
        loaded = files.load_records(spark, [f"{tmp_path}/{name}/good", f"{tmp_path}/{name}/broken"], S.ENVELOPE_SCHEMA)
        good, corrupt = files.good_and_corrupt(loaded)
        found[name] = sorted(r.title for r in good.collect()), sorted(r[files.CORRUPT] for r in corrupt.select(files.CORRUPT, files.ORIGIN).collect())
    assert len(found["plain"][0]) == 7 and len(found["plain"][1]) == 2
    assert found["packed"] == found["plain"]
    landed = [p.name for p in (tmp_path / "packed").rglob("*.json*") if not p.name.startswith(".")]
    assert len(landed) == 5 and all(n.endswith(".json.gz") for n in landed)


def test_unreadable_texts_are_not_copied_on_their_way_to_the_rejects(spark, tmp_path, monkeypatch):
    names, staged = [], ingest.staged
    monkeypatch.setattr(ingest, "staged", lambda spark, df, name: names.append(name) or staged(spark, df, name))
    files.land_texts(spark.createDataFrame([('{"items": [',), ('{"id": "1", "network": "polkadot", "title": "a"}',)], "value string"), f"{tmp_path}/in")
    for rejects in (f"{tmp_path}/rejects", None):
        done = ingest.run_load(spark, [f"{tmp_path}/in"], f"{tmp_path}/{rejects is None}", None, AS_OF, rejects_path=rejects)
        assert (done.unreadable, done.records) == (1, 1)
    raw = [r.raw for r in spark.read.parquet(f"{tmp_path}/rejects").filter("reason = 'unreadable'").collect()]
    assert raw == ['{"items": [\n'] and names == ["records", "records", "unreadable"]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"
