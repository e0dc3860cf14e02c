import base64
import gzip
import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sheaf.llm import warc as W

SCHEMA = "page_id long, url string, html string"
PAGES = [
    (1, "http://a.example/1", "<p>one</p>"),
    (2, "http://a.example/2", "<p>one</p>"),
    (3, "http://a.example/\r\nX-Bad: 1", None),
    (4, None, ""),
    (5, "http://a.example/5", "WARC/1.1\r\n\r\nno header é\r\n\r\n"),
    (6, "http://a.example/6", "long " * 200_000),
    (7, "http://a.example/7", "<p>one</p>"),
    (7, "http://a.example/7", "<p>one</p>"),
    (7, "http://b.example/7", "<p>one</p>"),
    (None, "http://a.example/null", "<p>one</p>"),
    (None, None, "alone"),
    (8, "http://a.example/8", "twice"),
    (8, "http://a.example/8", "twice"),
]


def expected(rows, least=0):
    """(page_id, bytes, digest, type, refers_to) of each row, by going through all rows."""
    groups = {}
    for i, (page, _, html) in enumerate(rows):
        groups.setdefault((html or "").encode(), []).append((page is not None, page or 0, i, page))
    out = []
    for payload, members in groups.items():
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        lead = max(members)
        for m in members:
            first = m == lead or len(payload) < least
            out.append((m[3], len(payload), digest, "response" if first else "revisit", None if first else lead[3]))
    return sorted(out, key=str)


def got(records):
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return sorted((tuple(r) for r in records.select(*names).collect()), key=str)


@pytest.mark.parametrize("least", [0, 8])
def test_awkward_pages_come_back(spark, tmp_path, least):
    pages = spark.createDataFrame(PAGES, SCHEMA).repartition(3)
    pages = pages.selectExpr("*", "1 as record", "'x' as content", "2L as n", "3 as offset", "'f' as file", "'g' as first")
    index, folder = W.write_warc(pages, str(tmp_path / "archives"), least)
    assert got(index) == got(W.read_records(index, folder)) == expected(PAGES, least)
    assert index.select("record_id").distinct().count() == len(PAGES)
    html = {}
    for page, _, text in PAGES:
        html.setdefault(page, set()).add((text or "").encode())
    for r in W.read_records(index, folder).collect():
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) in html[r.page_id]


def test_archives_are_plain_gzip_members(spark, tmp_path):
    index, folder = W.write_warc(spark.createDataFrame(PAGES, SCHEMA), str(tmp_path / "archives"))
    whole = b"".join(gzip.decompress(p.read_bytes()) for p in sorted(Path(folder).glob("*.warc.gz")))
    assert whole.count(b"WARC-Record-ID: ") == len(PAGES) and b"\r\nX-Bad" not in whole
    responses = {r.record_id for r in index.filter("record_type = 'response'").collect()}
    heads = [W.parse_record(W.zlib.decompress(data, 31))[0] for data in _members(index, folder)]
    assert all(h["WARC-Refers-To"][10:-1].replace("-", "") in responses for h in heads if h["WARC-Type"] == "revisit")


def _members(index, folder):
    for r in index.collect():
        yield Path(folder, r.file).read_bytes()[r.offset : r.offset + r.length]


def test_selected_records_are_read_by_joined_ranges(spark, tmp_path, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    index, folder = W.write_warc(pages, str(tmp_path / "archives"))
    some = index.filter("page_id % 3 = 0")
    want = {r.page_id: (r.html or "").encode() for r in pages.filter("page_id % 3 = 0").collect()}
    read = {r.page_id: bytes(r.payload) for r in W.read_records(some, folder).filter("payload IS NOT NULL").collect()}
    assert read and all(want[p] == b for p, b in read.items())
    files, offsets, lengths = ["a"] * 4 + ["b"], [0, 10, 40, 70 + W.GAP_BYTES, 0], [10, 30, 20, 5, 9]
    assert list(W._requests(files, offsets, lengths)) == [(0, 3), (3, 4), (4, 5)]
    assert list(W._requests(["a", "a"], [0, W.REQUEST_BYTES], [W.REQUEST_BYTES, 9])) == [(0, 1), (1, 2)]


def test_archives_are_begun_anew_and_damage_is_seen(spark, tmp_path):
    pages = spark.range(50).selectExpr("id as page_id", "'http://x/' || id as url", "repeat(md5(cast(cast(id as string) as binary)), 40) as html").coalesce(1)
    planned = W.planned_records(pages)
    index = W.write_archives(planned, str(tmp_path / "a"), archive_bytes=500).cache()
    assert index.select("file").distinct().count() > 5
    assert W.read_records(index, str(tmp_path / "a")).count() == 50
    name = index.first().file
    data = bytearray((tmp_path / "a" / name).read_bytes())
    data[len(data) // 2] ^= 255
    (tmp_path / "a" / name).write_bytes(data)
    with pytest.raises(Exception, match="damaged|zlib|Error -3"):
        W.read_records(index, str(tmp_path / "a")).collect()


def test_very_many_copies_and_empty_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "COPIES", 7)
    pages = spark.range(60).selectExpr("least(id, 40L) as page_id", "'u' as url", "if(id < 10, 'other', 'same') as html")
    index, folder = W.write_warc(pages, str(tmp_path / "a"))
    rows = [(min(i, 40), "u", "other" if i < 10 else "same") for i in range(60)]
    assert got(W.read_records(index, folder)) == expected(rows)
    assert index.select("record_id").distinct().count() == 60
    index, folder = W.write_warc(spark.createDataFrame([], SCHEMA), str(tmp_path / "b"))
    assert W.read_records(index, folder).count() == 0


def test_rare_shared_payloads_are_joined(spark, tmp_path):
    """Payloads held by fewer than one of FREQUENT rows go by the plain join."""
    pages = spark.range(4000).selectExpr("id as page_id", "cast(null as string) as url", "cast(id div 2 as string) as html")
    index, folder = W.write_warc(pages, str(tmp_path / "a"))
    assert index.filter("record_type = 'revisit' AND page_id % 2 = 0 AND refers_to = page_id + 1").count() == 2000
    assert index.filter(F.col("record_type") == "response").count() == 2000
