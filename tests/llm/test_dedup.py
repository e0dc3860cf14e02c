import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sheaf.llm import near_dedup as N
from sheaf.llm import suffix_dedup as S
from sheaf.llm.components import components
from sheaf.llm.suffix_array import _ordered, common_prefixes, laid_out, suffix_array
from tests.llm import cases


def repeat_rows(docs, **more):
    return [(r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in S.repeated_bytes(docs, **more).collect()]


def agree(rows, got):
    want = cases.repeats(rows)
    assert len(got) == len(rows)
    assert all(row in want[d] for d, row in got)


@pytest.mark.parametrize("shard_anchors", [S.SHARD_ANCHORS, 3])
def test_repeats_of_awkward_documents(spark, shard_anchors):
    """Also with shards so small that every gram is spread over parts and merged."""
    agree(cases.DOCS, repeat_rows(cases.frame(spark, extra=True), shard_anchors=shard_anchors))


@pytest.mark.parametrize("hot", [None, 3])
def test_repeats_of_the_table(spark, sf, monkeypatch, hot):
    """Also with every gram of three documents or more taken for frequent and dealt out."""
    if hot:
        for name, value in (("HOT_ANCHORS", hot), ("HOT_GRAMS", 1 << 40), ("BUCKET_ANCHORS", 3000)):
            monkeypatch.setattr(S, name, value)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    agree([(r.doc_id, r.text) for r in docs.collect()], repeat_rows(docs))


def test_frequent_grams_of_awkward_documents(spark, monkeypatch):
    for name, value in (("HOT_ANCHORS", 2), ("HOT_GRAMS", 1 << 40), ("BUCKET_ANCHORS", 500), ("DOCS_AT_ONCE", 3)):
        monkeypatch.setattr(S, name, value)
    agree(cases.DOCS, repeat_rows(cases.frame(spark, extra=True), shard_anchors=5))


def test_a_line_in_a_third_of_all_documents_is_spread(spark, monkeypatch):
    """One line between unlike texts: no bucket, shard or cut holds more than a few times its bound."""
    for name, value in (("HOT_ANCHORS", 300), ("HOT_GRAMS", 1 << 40), ("BUCKET_ANCHORS", 4000)):
        monkeypatch.setattr(S, name, value)
    rng = np.random.default_rng(1)
    noise = lambda n: bytes(rng.integers(97, 123, n, dtype=np.uint8)).decode()
    line = "this very line stands in a third of all documents, between texts that are unlike"
    rows = [(i, noise(60) + "\n" + line + "\n" + noise(60) if i % 3 == 0 else noise(120)) for i in range(10_000)]
    docs = S._keyed(cases.frame(spark, rows), 4).filter("_doc is not null").select("_doc", "_text", "_tag", "_chunk")
    size = sum(len(t) for _, t in rows)
    in_all = size * 2 // (S.GRAMS + 1)
    buckets = S.parts_for(in_all, S.BUCKET_ANCHORS)
    frequent = S.frequent_grams(docs, len(rows), in_all, 200)
    assert 1 <= len(frequent.grams) <= 30
    held = {}
    packed = S.packed_anchors(docs, buckets, frequent)
    for r in packed.collect():
        held[r.bucket] = held.get(r.bucket, 0) + int(S.unplanes(bytes(r.counts), "<u4").sum())
    assert max(held.values()) <= 2 * S.BUCKET_ANCHORS
    answers = S.shared_anchors(packed, buckets, frequent, 200).collect()
    parts = {}
    for r in answers:
        if r.kind == 1:
            parts[r.shard, r.part] = parts.get((r.shard, r.part), 0) + len(r.docs) // 8
    assert len(parts) > 10 and max(parts.values()) <= 200
    got = repeat_rows(cases.frame(spark, rows), shard_anchors=200)
    first = min(i for i, _ in rows if i % 3 == 0)
    assert {d for d, r in got if r[1] >= len(line)} == {i for i, _ in rows if i % 3 == 0 and i != first}
    assert all(not r[1] for d, r in got if d % 3)


def test_repeats_of_equal_ids_and_empty_tables(spark):
    rows = [(1, "x" * 60), (1, cases.words(40, 9)), (2, cases.words(40, 9)), (2, "y" * 70), (2, "short")]
    agree(rows, repeat_rows(cases.frame(spark, rows)))
    assert repeat_rows(cases.frame(spark, []).limit(0)) == []


def test_cut_keeps_columns_and_whole_characters(spark):
    shared = "é" * 30  # two bytes each
    rows = [(1, "a" + shared), (2, "bb" + shared + "c"), (3, None), (4, "alone")]
    docs = cases.frame(spark, rows, extra=True).selectExpr("*", "length(text) as n_chars")
    out = {r.doc_id: r for r in S.cut_repeats(docs).collect()}
    assert S.cut_repeats(docs).columns == docs.columns
    assert out[1].text == "a" + shared and out[3].text is None and out[4].n_chars == 5
    assert out[2].text == "bbc" and out[2].n_chars == 3


def test_long_texts_are_scanned_in_slices_alike():
    rng = np.random.default_rng(0)
    text = rng.integers(97, 123, 3 * S.SCAN, dtype=np.uint8).tobytes()
    up, down = S.powers(4 * S.SCAN)
    whole = S.anchors(np.frombuffer(text, np.uint8), np.array([len(text)]), up, down)
    parts = [np.concatenate(x) for x in zip(*S.anchors_of([text], *S.powers()), strict=True)][1:]
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts, strict=True))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab\0", max_size=25).map(str.encode), min_size=1, max_size=6))
def test_suffix_array_and_prefixes(strings):
    symbols, owner, end = laid_out(strings)
    order = suffix_array(symbols, owner, end)
    text = [(symbols[p : end[p]].tolist() + [0, owner[p]], p) for p in range(len(symbols))]
    text.sort()
    assert order.tolist() == [p for _, p in text]
    shared = common_prefixes(symbols, end, order)
    for slot in range(1, len(order)):
        a, b = text[slot - 1][0][:-2], text[slot][0][:-2]
        n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert shared[slot] == n


@pytest.mark.parametrize("bits", [9, 40, 62])
def test_keys_are_ordered_with_their_places_in_a_word_or_beside(bits):
    key = np.random.default_rng(0).integers(0, 1 << bits, 3000)
    order = _ordered(key, bits)
    assert sorted(order.tolist()) == list(range(3000)) and (np.diff(key[order]) >= 0).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**31 - 1), max_size=5), min_size=1, max_size=8), st.sampled_from(["<i8", "<u4"]))
def test_rows_of_planes_are_those_of_each_row(rows, kind):
    sizes = [len(r) for r in rows]
    values = np.array([x for r in rows for x in r], np.int64)
    column = S.plane_rows(values, kind, np.cumsum(sizes) - sizes)
    assert column.to_pylist() == [S.planes(np.array(r, np.int64), kind) for r in rows]
    parts = pa.chunked_array([column[:2], column[2:]])
    got, count = S.row_values(parts, kind)
    assert got.tolist() == values.tolist() and count.tolist() == sizes


def test_answers_of_a_chunk_are_taken_in_at_once(monkeypatch):
    """Very many rows of one anchor each, as buckets and shards of a large input give a chunk: one look-up for all."""
    n = 2000
    left = pa.table({"_doc": pa.array(range(n)), "_text": ["x" * 100] * n, "_tag": pa.array([5] * n, pa.int32())})
    rows = S._answers(0, *(np.full(n, 7, np.int32), np.arange(n), np.full(n, 5, np.int32), np.zeros(n, np.int64), np.full(n, 50)), np.arange(n))
    right = pa.table({k: pa.array(v) for k, v in rows.items()})
    assert right.num_rows == n
    calls, look_up = [], S.Chunk.rows
    monkeypatch.setattr(S.Chunk, "rows", lambda self, doc, tag: calls.append(len(doc)) or look_up(self, doc, tag))
    _, gone = S.removed(left, right)
    assert calls == [n]
    assert (gone.reshape(n, 100) == (np.arange(100) < 50)).all()


def near_rows(docs):
    return N.near_duplicates(docs).collect()


def test_near_duplicates_of_awkward_documents(spark):
    want = cases.near(cases.DOCS)
    got = near_rows(cases.frame(spark, extra=True))
    assert len(got) == len(cases.DOCS)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    kept = N.drop_near_copies(cases.frame(spark, extra=True))
    assert kept.columns == cases.frame(spark, extra=True).columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids == sorted([d for d, _ in cases.DOCS if d is None or want[d][1] == d], key=str)


def test_near_duplicates_of_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = cases.near([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_rows(docs)} == want


def test_near_duplicates_of_an_empty_table(spark):
    assert near_rows(cases.frame(spark, []).limit(0)) == []
    assert near_rows(cases.frame(spark, [(1, None), (2, "")])) != []


def test_a_group_of_near_copies_whose_first_is_not_like_all(spark, monkeypatch):
    """Copies edited step by step: neighbours are alike, the ends are not. Blocks of two rows."""
    monkeypatch.setattr(N, "BLOCK", 2)
    base = cases.words(100, 8).split()
    rows = []
    for i in range(12):
        w = list(base)
        for j in range(i):
            w[8 * j % 100] = f"edit{j}"
        rows.append((100 - i, " ".join(w)))
    want = cases.near(rows)
    assert len({c for _, c in want.values()}) == 1
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_rows(cases.frame(spark, rows))} == want


def test_odd_sketches_estimate_similarity():
    rng = np.random.default_rng(2)
    shared, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (900, 150, 150))
    for own, other, likely in ((a, b, True), (rng.integers(0, 2**63, 900, dtype=np.uint64), b, False)):
        x, y = (N.odd_sketch(N.samples_of(np.concatenate([shared, s]))).view(np.uint64) for s in (own, other))
        assert (np.bitwise_count(x ^ y).sum() <= N.MOST_BITS) == likely


def test_components(spark):
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(100 + i, 101 + i) for i in range(20)]
    links += [(500, 500 + i) for i in range(1, 30)]
    parent = {x: x for pair in links for x in pair}
    for _ in range(100):
        for a, b in links:
            parent[a] = parent[b] = min(parent[a], parent[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: p for x, p in parent.items() if x != p}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_copies_beside_a_doc_id_of_unlike_texts(spark, monkeypatch):
    """Texts of one family share all bands but the first, which none share. Each of its documents also
    holds other texts, whose rows must not be taken for the family's."""
    base = cases.words(120, 1).split()
    chain, words = [" ".join(base)], list(base)
    for step in range(8):
        for k in range(3):
            words[(step * 11 + k * 41 + 5) % 120] = f"edit{step}x{k}"
        chain.append(" ".join(words))
    plain, shingler = N.bands_of, N.Shingler()
    family = [N.samples_of(shingler(t.encode())) for t in chain]

    def bands(samples):
        own = plain(samples)
        if max(int((samples == f).sum()) for f in family) == N.SAMPLES:
            own[1:] = np.arange(1, N.BANDS)
            own[0] = samples.view(np.int64).sum()
        return own

    monkeypatch.setattr(N, "bands_of", bands)
    assert {root for _, root in cases.near(list(enumerate(chain))).values()} == {0}
    assert cases.near([(0, chain[0]), (8, chain[8])])[8][1] == 8
    rows = [(i, t) for i, family_text in enumerate(chain) for t in (family_text, *[cases.words(60 + k, 40 + 5 * i + k) for k in range(5)])]
    got = near_rows(cases.frame(spark, rows))
    assert len(got) == len(rows) and {r.component_id for r in got} == {0}


def test_only_classes_with_a_likely_pair_go_on_to_their_texts(spark, monkeypatch):
    """One bucket of unlike texts, of which two are near copies that the bucket's first class does not tie."""
    plain, kept, stored = N.bands_of, [], N.stored

    def bands(samples):
        own = plain(samples)
        own[0], own[1:] = 7, samples.view(np.int64).sum() + np.arange(1, N.BANDS)
        return own

    def noted(df, name):
        out = stored(df, name)
        if name == "open":
            kept.extend(r.node for r in out.select("node").distinct().collect())
        return out

    monkeypatch.setattr(N, "BLOCK", 8)
    monkeypatch.setattr(N, "bands_of", bands)
    monkeypatch.setattr(N, "stored", noted)
    rows = [(i, cases.words(80, 300 + i)) for i in range(30)]
    rows.append((40, rows[20][1] + " more"))
    got = {r.doc_id: r.component_id for r in near_rows(cases.frame(spark, rows))}
    assert got == {i: i for i in range(30)} | {40: 20}
    assert sorted(kept) == [20, 40]
