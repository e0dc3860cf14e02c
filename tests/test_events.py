import json
from datetime import datetime

import pytest
from pyspark.sql import types as T

from sheaf.operators.stored_table import DuplicateKeys, append_missing, read_table
from sheaf.streaming import events as E

SCHEMA = T.StructType().add("id", "string").add("at", "timestamp").add("value", "integer")


def land(folder, name, rows):
    folder.mkdir(exist_ok=True)
    lines = [r if isinstance(r, str) else json.dumps(dict(zip(("id", "at", "value"), r, strict=True))) for r in rows]
    (folder / name).write_text("\n".join(lines), encoding="utf-8")


def at(clock):
    return f"2024-05-01T{clock}:00"


def test_repeats_are_dropped_by_state_and_late_rows_are_kept(spark, tmp_path, monkeypatch):
    inbox, path, rejects = tmp_path / "inbox", str(tmp_path / "table"), str(tmp_path / "rejects")
    added = []

    def seen(spark, path, rows, *rest):
        added.append(sorted(r.id for r in rows.collect()))
        return append_missing(spark, path, rows, *rest)

    monkeypatch.setattr(E, "append_missing", seen)

    def run():
        added.clear()
        return E.run_events(
            spark, str(inbox), path, str(tmp_path / "checkpoint"), SCHEMA, "id", "at", "30 minutes", rejects, max_files=1, buckets=2
        )

    def table():
        return sorted((r.id, r.at and r.at.strftime("%H:%M"), r.value) for r in read_table(spark, path).collect())

    land(inbox, "1.json", [("a", at("10:00"), 1), ("b", at("10:05"), 2)])
    assert run() == E.EventMetrics(2, 2, 0, 0)
    land(inbox, "2.json", [("a", at("10:10"), 9), ("c", at("10:06"), 3), ("c", at("10:06"), 3)])
    assert run() == E.EventMetrics(3, 1, 0, 0)
    assert ["c"] in added and not any("a" in ids for ids in added)  # the state of the first run has dropped it
    assert table() == [("a", "10:00", 1), ("b", "10:05", 2), ("c", "10:06", 3)]

    land(inbox, "3.json", [("d", at("12:00"), 4)])  # the watermark moves to 11:30
    run()
    late = [("e", at("10:20"), 6), ("e", at("10:01"), 5), ("a", at("10:00"), 1), ("f", None, 7), ("d", at("12:01"), 4)]
    land(inbox, "4.json", [*late, (None, at("12:02"), 8), '{"id": "g", "at'])
    assert run() == E.EventMetrics(7, 2, 2, 2)
    want = [("a", "10:00", 1), ("b", "10:05", 2), ("c", "10:06", 3), ("d", "12:00", 4), ("e", "10:01", 5), ("f", None, 7)]
    assert table() == want
    refused = spark.read.parquet(rejects).collect()
    assert sorted((r.id, r.value) for r in refused if r.id is None and r.value == 8) == [(None, 8)] and len(refused) == 2

    land(inbox, "5.json", [("h", at("15:00"), 1)])
    run()
    land(inbox, "6.json", [("b", at("15:01"), 9), ("i", at("15:02"), 1)])  # long forgotten by the state, known to the table
    assert run().added == 1
    assert table() == [*want, ("h", "15:00", 1), ("i", "15:02", 1)]
    assert run() == E.EventMetrics()


def test_append_missing(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (None, "lost")], "id long, v string")
    for _ in range(2):
        append_missing(spark, path, rows, buckets=2)
    more = spark.createDataFrame([(2, "changed"), (3, "c")], "id int, v string")
    append_missing(spark, path, more)
    assert sorted(map(tuple, read_table(spark, path).collect())) == [(1, "a"), (2, "b"), (3, "c")]
    with pytest.raises(DuplicateKeys):
        append_missing(spark, path, more.union(more))
    assert read_table(spark, path).count() == 3


def test_times_are_utc(spark, tmp_path):
    land(tmp_path / "in", "1.json", [("a", "2024-05-01T10:00:00+02:00", 1)])
    E.run_events(spark, str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "c"), SCHEMA, "id", "at", "1 hour", buckets=1)
    text = read_table(spark, str(tmp_path / "t")).selectExpr("cast(at as string) as at").first().at
    assert datetime.fromisoformat(text) == datetime(2024, 5, 1, 8)


def test_rows_above_the_watermark_of_their_batch_are_not_looked_at_again(spark, tmp_path, monkeypatch):
    looked, first = [], E._first_of_each
    monkeypatch.setattr(E, "_first_of_each", lambda rows, *a: looked.append(sorted(r.id for r in rows.collect())) or first(rows, *a))
    inbox, path = tmp_path / "in", str(tmp_path / "t")

    def run():
        looked.clear()
        return E.run_events(spark, str(inbox), path, str(tmp_path / "c"), SCHEMA, "id", "at", "1 hour", max_files=1, buckets=1)

    land(inbox, "1.json", [("a", at("10:00"), 1), ("b", at("20:00"), 2), ("a", at("10:00"), 1)])
    assert run() == E.EventMetrics(3, 2, 0, 0) and looked == []
    land(inbox, "2.json", [("c", at("10:00"), 1), ("a", at("10:00"), 9), ("d", at("23:00"), 2)])
    land(inbox, "3.json", [("e", at("19:30"), 1), ("f", at("21:30"), 1)])
    done = run()
    assert (done.received, done.added, done.refused) == (5, 4, 0)
    assert ["a", "c"] in looked
    got = {r.id: r.value for r in read_table(spark, path).collect()}
    assert got == {"a": 1, "b": 2, "c": 1, "d": 2, "e": 1, "f": 1}
    assert run() == E.EventMetrics()


def test_the_watermark_of_the_last_files_counts():
    def told(start, end, watermark):
        return {"sources": [{"startOffset": start, "endOffset": end}], "eventTime": {"watermark": watermark}}

    read = [told(None, {"logOffset": 0}, "1970"), told({"logOffset": 0}, {"logOffset": 1}, "2023")]
    idle = told({"logOffset": 1}, {"logOffset": 1}, "2024")
    assert E._dropped_below([*read, idle]) == "2023"
    assert E._dropped_below([idle]) == "2024" and E._dropped_below([]) is None
