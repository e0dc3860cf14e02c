import base64
import math
import random
import re
import string
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
import zstandard

from sheaf.llm import decontaminate as D
from sheaf.llm import language as L
from sheaf.llm import quality_model as Q
from sheaf.llm import quality_rules as R
from tests.llm import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_counts(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    twice = {x for x in windows if windows.count(x) > 1} if len(w) < 2000 else None
    if twice is None:
        seen = {}
        for x in windows:
            seen[x] = seen.get(x, 0) + 1
        twice = {x for x, n in seen.items() if n > 1}
    hit = {i + k for i, x in enumerate(windows) if x in twice for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed


#: The bands again: bytes up to, lowest and highest ratio.
LIMITS = [(256, 0.35, 1.2), (320, 0.3, 0.86), (384, 0.3, 0.83), (512, 0.3, 0.79), (768, 0.3, 0.755), (1024, 0.3, 0.72),
          (1536, 0.25, 0.7), (2048, 0.25, 0.68), (4096, 0.25, 0.66), (16384, 0.2, 0.65), (1 << 60, 0.15, 0.65)]


def in_band(data, whole_chunk=False):
    low, high = (0.12, 0.65) if whole_chunk else next((a, b) for n, a, b in LIMITS if len(data) < n)
    packed = len(zstandard.ZstdCompressor(level=3).compress(data))
    if not low <= packed / len(data) <= high:
        return False
    counts = {b: data.count(bytes([b])) for b in set(data)}
    by_frequency = sum(k * math.log2(len(data) / k) for k in counts.values()) / 8
    return len(data) < 2048 or packed < by_frequency + 35


def plain_verdict(text):
    """ratio, bad_share and kept of a text, chunk by chunk."""
    data = (text or "").encode()
    if not data:
        return 1.0, 0.0, False
    ratio = len(zstandard.ZstdCompressor(level=3).compress(data)) / len(data)
    pieces = [data[i : i + 4096] for i in range(0, len(data), 4096)] if len(data) > 4096 else []
    bad = sum(len(p) for p in pieces if not in_band(p, len(p) == 4096))
    return ratio, bad / len(data), not base_counts(text)[-1] and in_band(data) and 2 * bad < len(data)


@pytest.mark.parametrize("source", ["cases", "table"])
def test_quality_rules(spark, sf, source):
    docs = cases.frame(spark, extra=True) if source == "cases" else spark.read.parquet(f"{sf}/documents.parquet")
    texts = {(r.doc_id, r.text) for r in docs.collect()}
    want = {}
    for d, t in texts:
        want.setdefault(d, []).append(base_counts(t))
    got = R.quality_rules(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) in want[r.doc_id]
    verdicts = {}
    for d, t in texts:
        verdicts.setdefault(d, []).append(plain_verdict(t))
    for r in got:
        assert any(abs(r.ratio - a) < 1e-12 and abs(r.bad_share - b) < 1e-12 and r.kept == k for a, b, k in verdicts[r.doc_id])
    kept = R.quality_filter(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.kept)


def test_compression_bands():
    rng = np.random.default_rng(0)
    pack = R.packer()
    prose = cases.words(2000, 6).encode()
    noise = bytes(rng.integers(33, 126, 9000, dtype=np.uint8))
    assert R.bands(prose, pack)[2] and R.bands(b"", pack)[2]
    assert not R.bands(b"to be or not to be " * 500, pack)[2]
    assert not R.bands(noise, pack)[2]
    # noise in most chunks is found where the whole still looks fine
    mixed = prose[: 3 * R.CHUNK_BYTES] + noise[: R.CHUNK_BYTES]
    assert R.bands(mixed, pack)[:2] == (len(zstandard.ZstdCompressor(level=R.LEVEL).compress(mixed)) / len(mixed), 0.25)


def noise(kind, n, seed):
    """``n`` bytes of base64, hex or random letters in tokens, 50 or more of them."""
    rng = random.Random(seed)
    if kind == "letters":
        return " ".join("".join(rng.choices(string.ascii_lowercase, k=rng.randint(2, 10))) for _ in range(n // 2))[:n].encode()
    raw = rng.randbytes(n)
    coded = base64.b64encode(raw).decode() if kind == "base64" else raw.hex()
    longest = 5 if n < 512 else 8 if n < 1024 else 16 if n < 8000 else 76
    out, at = [], 0
    while at < n:
        size = rng.randint(4, longest)
        out.append(coded[at : at + size])
        at += size
    return " ".join(out)[:n].encode()


SIZES = [300, 330, 400, 511, 512, 767, 1000, 1024, 1535, 2047, 2048, 2500, 3071, 4095, 4096, 4097, 8000, 16_384, 20_000, 50_000, 100_000]


@pytest.mark.parametrize("size", SIZES)
@pytest.mark.parametrize("kind", ["base64", "hex", "letters"])
def test_noise_is_rejected(kind, size):
    if kind != "base64" and size < R.FLOOR_FROM:
        pytest.skip("packs into the range of prose of this length")
    for seed in range(5):
        text = noise(kind, size, seed)
        assert len(text) == size and len(text.split()) >= 50
        assert not R.bands(text, R.packer())[2], (kind, size, seed)


@pytest.mark.parametrize("size", SIZES)
def test_prose_of_every_language_is_kept(size):
    """Documents of the larger table, which are prose but for those that repeat themselves."""
    table = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["lang", "text"])
    prose: dict[str, list[bytes]] = {}
    for lang, text in zip(table["lang"].to_pylist(), table["text"].to_pylist(), strict=True):
        if text and not R.judge(text.encode(), R.packer())[5]:
            prose.setdefault(lang, []).append(" ".join(text.split()).encode())
    assert len(prose) >= 4
    for lang, texts in prose.items():
        laid = b" ".join(texts)
        for at in range(0, min(len(laid) - size, 20 * size) + 1, size):
            text = laid[at : at + size]
            assert R.bands(text, R.packer())[2], (lang, size, at, R.bands(text, R.packer()))


def test_quality_rules_of_an_empty_table(spark):
    assert R.quality_rules(cases.frame(spark, []).limit(0)).count() == 0


ITEMS = [
    (1, cases.words(120, 1)[:300]),
    (2, "one two three"),
    (3, None),
    (4, "!!!"),
    (5, cases.words(25, 7)),
    (5, cases.words(25, 8)),
    (10, "aa aa aa aa aa aa aa aa aa aa aa aa"),
    (11, "ÉCOLE straße ПРИВЕТ"),
    (None, "aa aa"),
]


@pytest.mark.parametrize("broadcast", [D.BROADCAST_BYTES, -1])
def test_contamination(spark, sf, monkeypatch, broadcast):
    monkeypatch.setattr(D, "BROADCAST_BYTES", broadcast)
    rows = [*cases.DOCS, (20, "x " + cases.words(25, 8) + " y"), (21, "Two three. ONE Two (three) four")]
    items = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "1 as at", "'x' as word", "2 as size")
    want = {}
    for d, t in rows:
        want.setdefault(d, []).append(cases.contamination(t, [i for i in ITEMS if i[0] is not None]))
    docs = cases.frame(spark, rows, extra=True)
    got = D.contamination(docs, items).collect()
    assert len(got) == len(rows)
    for r in got:
        n_words, _, found = want[r.doc_id][0]
        assert (r.n_words, r.items) == (n_words, found)
        if r.doc_id != 13:  # the item without an id hits as well
            assert (r.n_words, r.n_hit, r.items) in want[r.doc_id]
        assert r.contaminated == (r.n_hit > 0) and r.n_items == len(r.items)
    kept = D.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == sum(not r.contaminated for r in got)


def test_contamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(not r.contaminated for r in D.contamination(cases.frame(spark), none).collect())
    assert D.contamination(cases.frame(spark, []).limit(0), none).count() == 0


def all_ways(word, p):
    """Probability of a word by listing all ways to cut it."""
    if not word:
        return 1.0
    return sum(p[word[:n]] * all_ways(word[n:], p) for n in range(1, len(word) + 1) if word[:n] in p)


def test_forward_sums_all_segmentations():
    pieces = [L.WORD_MARK, "a", "b", "ab", "ba", L.WORD_MARK + "a", "aba"]
    rng = np.random.default_rng(0)
    p = np.concatenate([rng.dirichlet(np.ones(7), 2).T, np.zeros((1, 2)), np.full((1, 2), L.UNKNOWN)])
    model = L.LanguageModel(["x", "y"], pieces, p)
    words = [L.WORD_MARK + w for w in ("a", "ab", "abab", "bbab", "ababababababababababab")]
    got = model.word_scores(words)
    for k in range(2):
        prob = dict(zip(pieces, p[:7, k], strict=True))
        want = [np.log(all_ways(w, prob)) for w in words]
        assert np.allclose(got[:, k], want)


def test_language_identification(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    model = L.learn(docs, per_language=60)
    lang = {r.doc_id: r.lang for r in docs.collect()}
    got = L.identify(docs, model).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == docs.count() and np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    odd = {r.doc_id: r for r in L.identify(cases.frame(spark, extra=True), model).collect()}
    assert [odd[i].lang_pred for i in (4, 5, 6)] == ["und"] * 3 and odd[4].score == 0
    assert odd[12].lang_pred in model.languages
    empty = L.learn(docs.limit(0))
    assert {r.lang_pred for r in L.identify(cases.frame(spark), empty).collect()} == {"und"}


def test_every_language_is_learned(spark):
    """Rows that share one id, rows that are equal, long texts only, and one row only."""
    ids = [i for i in range(9000) if zlib.crc32(str(i).encode()) % 4 != 2]
    rows = [(ids[0], f"der die das {i}", "de") for i in range(3000)] + [(i, f"the of and {i}", "en") for i in ids[1:3000]]
    rows += [(ids[3001], "le la les des", "fr")] * 2000 + [(i, "el los " * 6000 + str(i), "es") for i in ids[3002:3006]] + [(ids[3007], "il gli", "it")]
    rows += [(None, "x", "nl"), (ids[3008], None, "pt"), (ids[3009], "no language", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    drawn = L.learning_sample(docs, 20, 500).collect()
    counts = {n: sum(r.lang == n for r in drawn) for n in {r.lang for r in drawn}}
    assert counts.keys() == {"de", "en", "fr", "es", "it", "nl"} and max(counts.values()) <= 20
    assert counts["de"] == counts["en"] == counts["fr"] == 20 and max(len(r.text) for r in drawn) <= 500
    assert sorted(map(tuple, drawn)) == sorted(map(tuple, L.learning_sample(docs.repartition(7), 20, 500).collect()))
    model = L.learn(docs, 20, 500)
    assert {"de", "en", "fr", "es", "it", "nl"} == set(model.languages)


def naive_score(model, text):
    """The network one window at a time."""
    halves = max(1, -(-len(text) // Q.HALF))
    padded = text + bytes(halves * Q.HALF + Q.WIDTH - len(text))
    top = []
    for h in range(halves):
        responses = []
        for at in range(h * Q.HALF, (h + 1) * Q.HALF, Q.STRIDE):
            window = np.concatenate([model.embed[b] for b in padded[at : at + Q.WIDTH]]).astype(np.float64)
            responses.append(window @ model.filters)
        top.append(np.max(responses, axis=0))
    chunks = [np.maximum(a, b) for a, b in zip(top, top[1:], strict=False)] or top
    seen = [np.maximum(c + model.bias, 0) for c in chunks]
    value = np.concatenate([np.mean(seen, axis=0), np.max(seen, axis=0)]) @ model.weights + model.offset
    return 1 / (1 + np.exp(-value))


def test_scores_are_those_of_a_plain_convolution():
    model = Q.QualityModel.fresh(5)
    model.bias = np.linspace(-0.5, 0.5, Q.FILTERS).astype(np.float32)
    texts = [b"", b"x", cases.words(20, 1).encode(), cases.words(150, 2).encode(), "é\0".encode() * 300, b"a" * Q.HALF, b"a" * (Q.HALF + 1)]
    assert np.allclose(model.score(texts), [naive_score(model, t) for t in texts], atol=1e-5)


def test_quality_model(spark, sf):
    sf = sf.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = Q.learn(docs, labels, epochs=6)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    got = Q.score_quality(docs, model).collect()
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.9
    odd = Q.score_quality(cases.frame(spark, extra=True), model).collect()
    assert len(odd) == len(cases.DOCS) and all(0 <= r.score <= 1 for r in odd)
    blank = {r.doc_id: r.score for r in odd}
    assert blank[4] == blank[5]
    none = Q.learn(docs, labels.limit(0))
    assert {r.score for r in Q.score_quality(cases.frame(spark), none).collect()} == {0.5}


def test_long_texts_score_as_one_scan():
    model = Q.QualityModel.fresh()
    text = cases.LONG.encode()
    rows = Q.half_chunks(text)
    whole = model.combine(Q.chunks_of(model.scan(rows), model.bias))
    assert np.isclose(model.score([b"", text, b"x"])[1], whole)


def test_gradients_of_the_quality_model():
    model = Q.QualityModel.fresh(3)
    texts = [b"some short text", cases.words(90, 2).encode()]
    rows, y = [Q.half_chunks(t) for t in texts], np.array([1, 0], np.float32)

    def loss():
        p = model.score(texts)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    grads = Q._gradients(model, 0.0, rows, y)
    for param, grad in ((model.filters, grads[1]), (model.weights, grads[3]), (model.embed, grads[0])):
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        old, step = param[at], 1e-2
        param[at] = old + step
        up = loss()
        param[at] = old - step
        down = loss()
        param[at] = old
        assert np.isclose((up - down) / (2 * step), grad[at], rtol=0.1, atol=1e-3)
