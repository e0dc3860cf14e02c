import hashlib
import math
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
import corpus_pipeline
from sheaf.llm import chat, packing, sharding
from sheaf.llm import queries as registered
from sheaf.llm import url_filter as U
from tests.llm import cases

TURNS = [
    (1, 0, "user", "hi"),
    (1, 1, "assistant", "a\\<|im_end|>\\\\<\\|<||>"),
    (1, 2, "user", None),
    (1, 3, "assistant", ""),
    (1, 3, "assistant", "tie"),
    (1, 3, "assistant", "tie"),
    (1, 4, "user", "trailing <|im_start|>"),
    (2, 0, "we\nird\\n\\<|", "x"),
    (2, None, None, "null turn"),
    (None, 0, "assistant", "no id"),
    (3, 0, "system", "no reply"),
]


def expected_chat(turns):
    out = {}
    for conv in {t[0] for t in turns}:
        own = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, chat_key(t)))
        said = [(r or "", x or "") for _, _, r, x in own]
        loss = "".join(x for r, x in said if r == "assistant")
        out[conv] = (len(own), cases.digest(*[f"{r}\n{x}\n" for r, x in said]), len(loss), cases.digest(loss))
    return out


def chat_key(t):
    return (t[2] or "", t[3] or "")


def test_chat_reads_back(spark):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn int, role string, text string").selectExpr("*", "1 as block", "'x' as formatted")
    formatted = chat.format_conversations(turns)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(formatted).collect()}
    assert got == expected_chat(TURNS)
    for r in chat.written_out(formatted).collect():
        assert r.context.endswith("<|im_start|>assistant\n") and "<|im_end|>" not in r.reply
    examples = chat.expand(formatted).filter("conv_id = 1").orderBy("example").collect()
    whole = formatted.filter("conv_id = 1").first().formatted
    assert [whole[e.context_end : e.reply_end] for e in examples] == [e.reply for e in examples] and len(examples) == 4
    assert chat.read_back(chat.format_conversations(turns.limit(0))).count() == 0


def test_probe_conversation(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    want = expected_chat([tuple(r) for r in turns.select("conv_id", "turn", "role", "text").collect()])
    text = "<|im_end|><|im_start|>assistant ok"
    want |= expected_chat([(-1, 0, "user", text), (-1, 1, "assistant", text)])
    got = registered.op5(spark, sf).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == want


def test_packing_covers_every_token(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary_path("byte_bpe_50k.json"))
    rows = [*cases.DOCS, (30, "a <|endoftext|> b"), (31, "x" * 5000), (32, "   \n\n  tabs\t\t  it's 12345 ")]
    coded = {}
    for d, t in rows:
        coded.setdefault(d, []).append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0])
    pieces = packing.pack(cases.frame(spark, rows, extra=True)).collect()
    assert len({p.sequence_id for p in pieces}) == len(pieces)
    by_doc = {}
    for p in sorted(pieces, key=lambda p: p.start):
        assert p.length == len(p.ids) == 1 << p.bucket <= packing.MAX_TOKENS and p.offset == 0
        assert zlib.crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32
        by_doc.setdefault((p.doc_id, p.doc_tokens), []).append((p.start, p.ids))
    for (d, n), parts in by_doc.items():
        wanted = [c for c in coded[d] if len(c) == n]
        have = {}
        for start, ids in parts:
            have.setdefault(start, []).append(ids)
        joined = [i for start in sorted(have) for i in have[start][0]]
        assert joined == wanted[0] and all(len(x) == len(wanted) for x in have.values())
    assert {d for d, _ in by_doc} == set(coded)
    assert packing.pack(cases.frame(spark, []).limit(0)).count() == 0


def test_slices_encode_alike():
    encode = packing.Encoder(*map(packing.vocabulary_path, ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")))
    text = cases.words(300, 3) + "\n\n  déjà vu, l'été  " * 30
    whole = encode.fast.encode_ordinary(text)
    parts = list(packing.slices(text, 50))
    assert len(parts) > 5 and "".join(parts) == text
    assert [i for p in parts for i in encode.fast.encode_ordinary(p)] == whole
    assert list(packing.slices("x" * 500, 50)) == ["x" * 500]


def test_equal_lengths_are_bucketed(spark):
    docs = cases.frame(spark, extra=True)
    pieces = packing.pack(docs, with_ids=False)
    dealt = packing.bucketed(pieces).withColumn("_at", F.spark_partition_id())
    key = lambda r: (str(r.doc_id), r.start, r.length, r.ids_crc32)
    rows = dealt.collect()
    assert sorted(map(key, rows)) == sorted(map(key, pieces.collect()))
    assert len({r.sequence_id for r in rows}) == len(rows) and all(1 << r.bucket == r.length for r in rows)
    for at in {r["_at"] for r in rows}:
        lengths = [r.length for r in rows if r["_at"] == at]
        assert lengths == sorted(lengths)
    meets = {}
    for r in rows:  # the pieces of a length from one input partition lie together
        meets.setdefault((r.bucket, (r.sequence_id & ((1 << 58) - 1)) >> 33), set()).add(r["_at"])
    assert all(len(p) == 1 for p in meets.values())
    assert packing.bucketed(packing.pack(docs.limit(0))).count() == 0


@pytest.mark.parametrize("n", [0, 1, 5, 1023, 1024, 1025, 4095])
def test_piece_lengths(n):
    parts = packing.piece_lengths(n)
    assert sum(parts) == n and all(p & (p - 1) == 0 and p <= 1024 for p in parts)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 97, 1000, 1025])
def test_feistel_is_a_permutation(spark, n):
    a, b = sharding.grid(n)
    assert a * b >= n and a * b - n < a
    got = [r[0] for r in spark.range(n).select(sharding.permuted(F.col("id"), n)).collect()]
    assert sorted(got) == list(range(n))
    assert n < 97 or got != list(range(n))


def spark_hash(*values):
    """Spark's xxhash64 of ints (4 bytes) and longs (8 bytes) as (value, size); null leaves the hash as it is."""
    h = 42
    for value, size in values:
        if value is not None:
            h = xxhash.xxh64_intdigest(value.to_bytes(size, "little", signed=True), h)
    return h - (1 << 64) if h >> 63 else h


def plain_place(number, n):
    """The cycle walk of one row number."""
    a = math.isqrt(max(n, 1) - 1) + 1
    b = -(-max(n, 1) // a)
    at = number
    while True:
        left, right = divmod(at, b)
        for i in range(sharding.ROUNDS):
            if i % 2 == 0:
                left = (left + spark_hash((sharding.SEED, 4), (i, 4), (right, 8)) % a) % a
            else:
                right = (right + spark_hash((sharding.SEED, 4), (i, 4), (left, 8)) % b) % b
        at = left * b + right
        if at < n:
            return at


@pytest.mark.parametrize("bucket_rows,buckets", [(100_000, 1), (5, 4)])
def test_row_numbers_shards_and_slots(spark, monkeypatch, bucket_rows, buckets):
    """Numbers by bucket, id, checksum and size; shard and slot by the plain walk."""
    monkeypatch.setattr(sharding, "BUCKET_ROWS", bucket_rows)
    n = len(cases.DOCS)
    rows = []
    for d, t in cases.DOCS:
        crc, size = zlib.crc32((t or "").encode()), len((t or "").encode()) + 1
        bucket = spark_hash((d, 8), (crc, 8), (size, 8)) % buckets
        rows.append((bucket, d is not None, d or 0, crc, size, d))
    want = []
    for number, (_, _, _, crc, size, d) in enumerate(sorted(rows, key=lambda r: r[:5])):
        place = plain_place(number, n)
        want.append((d, size, crc, number, place % 4, place // 4))
    got = [(r.doc_id, r.size, r.text_crc32, r.row_number, r.shard, r.slot) for r in sharding.shards(cases.frame(spark), 4).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_shards_are_even_and_reproducible(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 4)
    docs = cases.frame(spark, extra=True)
    got = sharding.shards(docs, 4).collect()
    assert len(got) == len(cases.DOCS)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = sharding.shards(docs.repartition(7), 4).collect()
    key = lambda r: (str(r.doc_id), r.text_crc32, r.shard, r.slot)
    assert sorted(map(key, got)) == sorted(map(key, again))
    text = {r.doc_id: r for r in got}
    assert text[4].size == 1 and text[4].text_crc32 == 0
    assert text[12].size == 801 and text[12].text_crc32 == zlib.crc32(("é" * 400).encode())
    assert sharding.shards(docs.limit(0)).count() == 0


SITES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def plain_site(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    place = re.split("[?#]", rest, maxsplit=1)[0]
    host, slash, path = place.partition("/")
    host, path = host.translate(cases.ASCII_LOWER), slash + path
    fits = [(len(h + p), h + p, v) for v, h, p in SITES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, None))
    return host, path, best[1], best[2]


URLS = [
    None, "", "no scheme", "http://", "HTTP://A.ORG/x", "http://org/", "http://org", "http://xorg/", "http://a.org?x=/y",
    "http://example.org/es/a", "http://Example.ORG/en/1", "http://www.example.org/en/123#q", "http://example.org/en/2",
    "http://notexample.org/es/", "http://x.com/fr/", "http://x.com/FR/", "http://x.com/de/1?a://b", "http://x.com/dex",
    "http://spam-farm.example.com/en/1", "http://spam-farm.example.org/", "http://spam-farmer.com/", "ftp://É.com/de/",
    "http://x.com:80/de/", "http://a.b/c://d.org/e",
]


@pytest.mark.parametrize("broadcast", [U.MAX_BROADCAST_RULES, 0])
def test_url_rules(spark, sf, monkeypatch, broadcast):
    monkeypatch.setattr(U, "MAX_BROADCAST_RULES", broadcast)
    urls = [*URLS, *[r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string").selectExpr("*", "'x' as token", "1 as rank")
    got = {r.page_id: r for r in U.url_verdicts(pages).collect()}
    assert len(got) == len(urls)
    for i, url in enumerate(urls):
        host, path, rule, verdict = plain_site(url)
        own = got[i].rule if got[i].rank == U.SITE_RANK else None
        assert (got[i].host, got[i].path, own) == (host, path, rule), url
        best = next((v for v in (verdict,) if v), None)
        if best is None:
            hit = [r for r in U.PATTERN_RULES if re.search(r.pattern, host + path)]
            best = hit[0].verdict if hit else "allow"
        assert got[i].verdict == best, url
    assert U.url_verdicts(pages.limit(0)).count() == 0


#: URLs that a pattern rule matches, among them those where a literal runs on into other letters.
MATCHING = {
    "spam-farm": ["http://spam-farm.net/", "http://a.spam-farm.net"],
    "cheap-pills": ["http://cheap-pills.net/"],
    "free-casino": ["http://free-casino.net/"],
    "adult-cams": ["http://adult-cams.net/x"],
    "pharmacy offers": [
        "http://www.buy-dietpills.net/offer", "http://buy-diet-pills.net/", "http://x.net/discount-pills", "http://x.net/Buy-DietPILLS/1",
        "http://cheap-sleepingpills.net/", "http://cheap--pills.net/",
    ],
    "casino hosts": ["http://my-casino.net/", "http://casino-royal.net/x"],
    "porn hosts": ["http://a.porn.net/", "http://porn-x.net"],
    "warez paths": ["http://x.net/warez", "http://x.net/free-WAREZ.html"],
    "log-in pages": ["http://x.net/a/wp-login.php", "http://x.net/WP-Login.PHP"],
}
NEAR_MISSES = ["http://buy-dietpillsx.net/", "http://xbuy-dietpills.net/", "http://buy-diet2pills.net/", "http://dietpills.net/buy"]


@pytest.mark.parametrize("broadcast", [U.MAX_BROADCAST_RULES, 0])
def test_every_match_is_fetched(spark, monkeypatch, broadcast):
    monkeypatch.setattr(U, "MAX_BROADCAST_RULES", broadcast)
    assert set(MATCHING) == {r.name for r in U.PATTERN_RULES}
    urls = [*[u for own in MATCHING.values() for u in own], *NEAR_MISSES]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    got = {r.url: r.verdict for r in U.url_verdicts(pages, U.PATTERN_RULES).collect()}
    assert got == {u: "allow" if u in NEAR_MISSES else "block" for u in urls}
    for rule in U.PATTERN_RULES:
        for url in MATCHING[rule.name]:
            host, path = plain_site(url)[:2]
            tokens = set(U.tokens_of(host + path))
            assert re.search(rule.pattern, host + path) and tokens >= set(rule.tokens), url
            assert not rule.one_of or tokens & set(rule.one_of), url


@pytest.mark.parametrize("broadcast", [U.MAX_BROADCAST_RULES, 1000])
def test_a_hundred_thousand_rules_from_a_table(spark, monkeypatch, broadcast):
    """Compared with a plain look-up of every host suffix and path beginning."""
    monkeypatch.setattr(U, "MAX_BROADCAST_RULES", broadcast)
    sites = spark.range(100_000).selectExpr(
        "case when id % 10 = 0 then concat('S', id, '.Example.com') when id % 10 = 1 then concat('a-b', id, '.net') else concat('h', id, '.x', id % 50, '.org') end as host",
        "case id % 4 when 0 then null when 1 then '/' when 2 then concat('/p(', id % 3, ')/') else concat('/v', id % 5) end as path",
        "if(id % 3 = 0, 'allow', 'block') as verdict",
        "id as rank",
    )
    rules = {}
    for r in sites.collect():
        rules.setdefault(r.host.lower(), []).append((r.path or "", r.verdict))
    hosts = sorted(rules)[::97]
    urls = [f"http://{sub}{h}{p}" for h in hosts for sub in ("", "www.", "not") for p in ("", "/", "/p(1)/a", "/p1/", "/v3x/b", "/V3")]
    pages = spark.createDataFrame(list(enumerate([*urls, None, "no scheme"])), "page_id int, url string")
    got = {r.page_id: r for r in U.url_verdicts(pages, U.site_rule_table(sites)).collect()}
    assert len(got) == len(urls) + 2
    hits = 0
    for i, url in enumerate(urls):
        host, path = plain_site(url)[:2]
        labels = host.split(".")
        above = [".".join(labels[k:]) for k in range(len(labels))]
        fits = [(len(h + p), h + p, v) for h in above for p, v in rules.get(h, ()) if path.startswith(p)]
        _, name, verdict = max(fits, default=(0, None, "allow"))
        assert (got[i].rule, got[i].verdict) == (name, verdict), url
        hits += bool(fits)
    assert len(urls) // 4 < hits < len(urls)
    assert {got[len(urls) + k].verdict for k in (0, 1)} == {"allow"}


def test_rules_that_no_url_could_meet_are_refused(spark):
    pages = spark.createDataFrame([(1, "http://a.b/")], "page_id int, url string")
    for host, verdict in (("é", "block"), (None, "block"), ("a.b", "deny"), ("a.b", None)):
        sites = spark.createDataFrame([(host, "/", verdict), ("c.d", "/", "block")], "host string, path string, verdict string")
        with pytest.raises(ValueError):
            U.url_verdicts(pages, U.site_rule_table(sites))
    both = spark.createDataFrame([("a.b", "", "block"), ("A.b", None, "allow")], "host string, path string, verdict string")
    assert [r.verdict for r in U.url_verdicts(pages, U.site_rule_table(both)).collect()] == ["allow"]
    assert U.url_verdicts(pages, U.site_rule_table(both.limit(0))).first().verdict == "allow"


def test_rule_tokens_must_be_whole():
    assert U.site_rule("block", "example.org", "/en/1").tokens == ("example", "org", "en")
    assert U.site_rule("block", "com", "/de/").tokens == ("com", "de")
    with pytest.raises(ValueError):
        U.UrlRule("x", "block", ".*", ())


def test_queries_are_registered():
    names = entry_points.queries()
    for n in range(1, 14):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert "pipeline" in names and len(corpus_pipeline.STAGES) == 5


def test_pipeline_stages_against_plain_versions(spark, sf):
    """Each stage on what the one before kept, restated in Python."""
    from tests.llm.test_text import plain_verdict

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]

    def step(name, frame):
        out = stages[name](spark, frame, sf)
        rows = {r.doc_id: r.text for r in out.collect()}
        return out, rows

    before = {r.doc_id: r.text for r in docs.collect()}
    out, kept = step("quality rules", docs)
    assert out.columns == columns and set(kept) == {d for d, t in before.items() if plain_verdict(t)[2]}
    near = cases.near(kept.items())
    out, left = step("near dedup", out)
    assert out.columns == columns and set(left) == {d for d, (_, c) in near.items() if c == d}
    cut = cases.repeats(left.items())
    out, short = step("suffix-array dedup", out)
    assert out.columns == columns and set(short) == set(left)
    for d, t in short.items():
        n, gone, _, digest = cut[d][0]
        if hashlib.sha256((t or "").encode()).hexdigest() != digest:  # a character lost some of its bytes
            assert gone and n - gone >= len(t.encode()) >= n - gone - 6 * cut[d][0][2]
    out, clean = step("benchmark decontamination", out)
    assert out.columns == columns and set(clean) == {d for d, t in short.items() if not cases.contamination(t, items)[1]}
    packed = stages["packing"](spark, out, sf).collect()
    tokens = {}
    for p in packed:
        tokens[p.doc_id] = tokens.get(p.doc_id, 0) + p.length
    assert tokens == {p.doc_id: p.doc_tokens for p in packed} and set(tokens) == set(clean)
    row = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32)
    assert sorted(map(row, corpus_pipeline.run(spark, sf).collect())) == sorted(map(row, packed))
