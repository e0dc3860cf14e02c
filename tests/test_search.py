import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sheaf import schema as S
from sheaf.functions import text as X
from sheaf.functions.vectors import cosine_distance, unit
from sheaf.operators import hybrid as H
from sheaf.operators import text_search as T
from sheaf.operators import vector_index as VI
from sheaf.operators import vector_search as V
from sheaf.operators.filters import cut_scores
from sheaf.schema import SearchFilters

WORDS = ["tax", "taxi", "the", "of", "upgrade", "runtime", "grade", "un", "treasury", "a", "naïve", "x_y", "treasuries"]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    docs = [(i, " ".join(rng.choices(WORDS, k=rng.randint(0, 3))), " ".join(rng.choices(WORDS, k=rng.randint(0, 12)))) for i in range(120)]
    # A third of the records share one title.
    return [(i, "treasury upgrade" if i % 3 == 0 else t, d) for i, t, d in docs]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    rows = [(i, ("kusama" if i % 2 else "polkadot"), "Tip", t, d, None, float(i), "active", None) for i, t, d in corpus]
    schema = (
        "id long, network string, type string, title string, description string, proposer string, "
        "amount_numeric double, status string, created_at timestamp"
    )
    return spark.createDataFrame(rows, schema).repartition(5)


QUERIES = ["tell me about the treasury", "GRADE", "of the", "a", "", "taxi runtime", "missing", "x_", "un upgrade of a", "the of treasury"]


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(list(enumerate(QUERIES)), "query_id int, query string")


def rank(hits):
    return 0.5 * (1 - math.exp(-0.1 * hits))


def lexical_direct(corpus, query, limit=30):
    terms, words = X.key_terms_of(query), set(X.words_of(query))
    found = []
    for i, t, d in corpus:
        own = X.words_of(f"{t} {d}")
        score = rank(sum(w in words for w in own)) if words and words <= set(own) else None
        for term in terms:
            if term in t.lower():
                score = max(score or 0, 0.8)
            elif term in d.lower():
                score = max(score or 0, 0.6)
        if score is not None:
            found.append((i, round(score, 9)))
    return sorted(found, key=lambda r: (-r[1], r[0]))[:limit]


def ordered(rows, score):
    return [(r.id, round(r[score], 9)) for r in sorted(rows, key=lambda r: r.position)]


@pytest.mark.parametrize("limit", [3, 30])
def test_lexical_batch_agrees_with_brute_force(corpus, docs, queries, limit):
    rows = T.lexical_search(queries, docs, limit=limit).collect()
    for q, text in enumerate(QUERIES):
        assert ordered([r for r in rows if r.query_id == q], "rank_score") == lexical_direct(corpus, text, limit), text


def test_lexical_batch_with_index_and_filter(corpus, docs, queries):
    wanted = SearchFilters(network="kusama", min_amount=10.0)
    rows = T.lexical_search(queries, docs, wanted, index=T.postings(docs)).collect()
    part = [c for c in corpus if c[0] % 2 and c[0] >= 10]
    for q, text in enumerate(QUERIES):
        assert ordered([r for r in rows if r.query_id == q], "rank_score") == lexical_direct(part, text), text


@pytest.mark.parametrize("text", QUERIES[:6])
def test_lexical_one_agrees_with_batch(corpus, docs, text):
    assert ordered(T.lexical_search_one(text, docs).collect(), "rank_score") == lexical_direct(corpus, text)


def test_fulltext_agrees_with_brute_force(corpus, docs, queries):
    rows = T.fulltext_search(queries, docs).collect()
    for q, text in enumerate(QUERIES):
        words = set(X.words_of(text))
        found = []
        for i, t, d in corpus:
            own = X.words_of(f"{t} {d}")
            if words and words <= set(own):
                found.append((i, round(rank(sum(w in words for w in own)), 9)))
        expected = sorted(found, key=lambda r: (-r[1], r[0]))[:10]
        assert ordered([r for r in rows if r.query_id == q], "rank") == expected, text
        assert ordered(T.fulltext_search_one(text, docs).collect(), "rank") == expected, text


def similarity(a, b):
    a, b = set(X.trigrams_of(a)), set(X.trigrams_of(b))
    return len(a & b) / len(a | b) if a | b else 0.0


def test_fuzzy_agrees_with_brute_force(spark):
    rng = random.Random(4)
    names = ["".join(rng.choices("abc ", k=rng.randint(0, 9))) for _ in range(150)] + ["abc abc"] * 75
    rows = [(i, n, names[-i - 1] if i % 2 else None) for i, n in enumerate(names)]
    docs = spark.createDataFrame(rows, "id int, title string, proposer string")
    asked = ["abc", "cab bac", "", "aabbcc", "b", "zzz", "a b c abc"]
    found = T.fuzzy_search(spark.createDataFrame(list(enumerate(asked)), "query_id int, query string"), docs, limit=7).collect()
    for q, text in enumerate(asked):
        scored = [(i, max(similarity(t, text), similarity(p or "", text))) for i, t, p in rows]
        expected = sorted([(i, round(s, 9)) for i, s in scored if s >= 0.3], key=lambda r: (-r[1], r[0]))[:7]
        assert ordered([r for r in found if r.query_id == q], "similarity") == expected, text
        assert ordered(T.fuzzy_search_one(text, docs, limit=7).collect(), "similarity") == expected, text


def test_equal_queries_are_compared_once(spark, monkeypatch):
    """A table of 300 queries of three texts asks with three texts, and every query gets its rows."""
    asked_of, column = [], T._fuzzy_column
    monkeypatch.setattr(T, "_fuzzy_column", lambda texts, *a: asked_of.append(texts.count()) or column(texts, *a))
    docs = spark.createDataFrame([(i, f"title {i}", None) for i in range(20)], "id int, title string, proposer string")
    asked = spark.createDataFrame([(i, f"title {i % 3}") for i in range(300)], "query_id int, query string")
    found = T.fuzzy_search(asked, docs, limit=4).collect()
    assert asked_of == [3, 3] and len(found) == 1200
    rows = {q: sorted((r.position, r.id, r.similarity) for r in found if r.query_id == q) for q in range(300)}
    assert all(rows[q] == rows[q % 3] and rows[q][0][1] == q % 3 for q in range(300))


def test_sets_of_trigrams_are_found_by_few(spark):
    """Of sets of 16 that must share 8, each is listed under no more than 9, fewer where one side alone has some."""
    own = F.array(*[F.struct(F.lit(i).alias("df"), F.lit(f"g{i:02d}").alias("gram"), F.lit(1).alias("times")) for i in range(16)])
    for held, listed in ((16, 9), (9, 2), (8, 1), (7, 0)):
        rows = spark.range(1).select(F.lit(16).alias("_n"), F.slice(own, 1, held).alias("_own"))
        assert T._indexed(rows, "_n", [16], 0.3, F.lit(0)).count() == listed


@pytest.mark.parametrize("salted", [1, 4096])
def test_fuzzy_finds_all_sizes(spark, monkeypatch, salted):
    """Texts from one to many words, also with every trigram dealt out to parts."""
    monkeypatch.setattr(T, "SALTED_ROWS", salted)
    rng = random.Random(8)
    text = lambda: " ".join("".join(rng.choices("abcd1é", k=rng.randint(1, 5))) for _ in range(rng.choice([1, 1, 2, 3, 8])))
    rows = [(i, text()) for i in range(120)]
    asked = [text() for _ in range(40)]
    docs = spark.createDataFrame(rows, "id int, title string")
    found = T.fuzzy_search(spark.createDataFrame(list(enumerate(asked)), "query_id int, query string"), docs, columns=("title",), limit=200).collect()
    want = {(q, i, round(x, 9)) for q, a in enumerate(asked) for i, t in rows if (x := similarity(t, a)) >= 0.3}
    assert {(r.query_id, r.id, round(r.similarity, 9)) for r in found} == want and len(found) == len(want)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(2)
    made = rng.normal(size=(90, 8))
    made[30:60] = made[30]  # a third of the vectors are the same
    made[7] = 0
    return made.astype(np.float32)


def embedding_table(spark, vectors):
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(500, [1.0] * 8), (90, None), (91, [1.0, 2.0])]
    return spark.createDataFrame(rows, "proposal_id long, embedding array<float>").repartition(4)


def nearest(vectors, query, limit, keep=lambda i: True):
    found = []
    for i, v in enumerate(vectors.astype(np.float64)):
        if np.any(v) and keep(i):
            d = 1 - v @ query / np.linalg.norm(v) / np.linalg.norm(query)
            found.append((round(float(d), 9) + 0.0, i))
    return [i for _, i in sorted(found)[:limit]]


@pytest.mark.parametrize("block", [100, 6])
def test_vector_search_agrees_with_brute_force(spark, docs, vectors, block):
    asked = vectors[np.r_[0:5, 28:40, 7:8]]
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id int, vector array<float>")
    found = V.vector_search(q, docs, embedding_table(spark, vectors), limit=12, block=block, part_rows=20).collect()
    for i, v in enumerate(asked):
        got = [r.id for r in sorted(found, key=lambda r: r.position) if r.query_id == i]
        assert got == (nearest(vectors, v.astype(np.float64), 12) if np.any(v) else [])


def test_vector_search_one_with_filter(spark, docs, vectors):
    found = V.vector_search_one(vectors[1].tolist(), docs, embedding_table(spark, vectors), SearchFilters(network="kusama"), 9)
    got = [r.id for r in found.orderBy("position").collect()]
    assert got == nearest(vectors, vectors[1].astype(np.float64), 9, lambda i: i % 2 == 1)


def test_approx_search_finds_the_query_itself_and_only_true_distances(spark, docs, vectors):
    q = spark.createDataFrame([(i, vectors[i].tolist()) for i in (0, 3, 35)], "query_id int, vector array<float>")
    e = embedding_table(spark, vectors)
    found = V.approx_search(q, docs, e, 8, limit=200, tables=3, bits=3, salts=4).collect()
    exact = {(r.query_id, r.id): r.distance for r in V.vector_search(q, docs, e, limit=200).collect()}
    assert {r.query_id for r in found if r.id == r.query_id} == {0, 3, 35}
    assert {r.id for r in found if r.query_id == 35} >= set(range(30, 60))
    assert len({(r.query_id, r.id) for r in found}) == len(found)
    assert all(abs(exact[(r.query_id, r.id)] - r.distance) < 1e-6 for r in found)


def test_cosine_edges(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([1.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 2.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(cosine_distance(F.col("a"), F.col("b"))).collect()] == [1.0, None, None]
    assert df.select(unit(F.col("b"))).first()[0] == [0.0, 1.0]


def ranked(spark, ids):
    return spark.createDataFrame([(0, i, p + 1) for p, i in enumerate(ids)], "query_id int, id int, position int")


def test_fusion_scores_and_cut(spark):
    lexical, near = ranked(spark, range(30)), ranked(spark, [*range(100, 149), 5])
    rows = {r.id: r for r in H.fuse_rrf(lexical, near, vector_weight=4.0).collect()}
    assert len(rows) == 79
    assert rows[5].rrf_score == pytest.approx(1 / 66 + 4 / 110) and rows[0].rrf_score == pytest.approx(1 / 61)
    kept = {i for i, r in rows.items() if r.rrf_score >= S.RRF_CUT}
    assert kept == {*range(100, 128), 5}


def test_cut_results_slices_before_the_threshold(spark):
    df = spark.createDataFrame([(0, i, i, 1.0 - 0.1 * i) for i in range(1, 9)], "query_id int, id int, rank int, rrf_score double")
    assert [r.id for r in H.cut_results(df, top_k=4, min_score=0.65, cap=5).orderBy("rank").collect()] == [1, 2, 3]
    assert H.cut_results(df, top_k=8, min_score=0.0, cap=5).count() == 5


def test_display_fallback(spark):
    df = spark.createDataFrame([("x", 1, 0.01), ("x", 2, 0.005), ("x", 3, 0.001), ("y", 1, 0.5), ("y", 2, 0.01)], "query_id string, rank int, score double")
    assert sorted((r[0], r[1]) for r in cut_scores(df, 0.015, 5, 2).collect()) == [("x", 1), ("x", 2), ("y", 1)]


def rerank_input(spark, n=4):
    rows = [(0, "q", i, f"t{i}", "d", i, 0.05) for i in range(1, n + 1)]
    return spark.createDataFrame(rows, "query_id int, query string, id int, title string, description string, rank int, rrf_score double")


def test_rerank_orders_head_and_keeps_tail(spark):
    scores = {"t1\nd": 0.6, "t2\nd": 0.4, "t3\nd": 0.9}
    out = H.rerank(rerank_input(spark), lambda q, ds: [scores[d] for d in ds], head=3).orderBy("rank").collect()
    assert [r.id for r in out] == [3, 1, 4]


def test_rerank_failure_or_absence_keeps_the_order(spark):
    def broken(query, documents):
        raise RuntimeError("no service")

    for scorer in (broken, None):
        out = H.rerank(rerank_input(spark), scorer, head=3).orderBy("rank").collect()
        assert [r.id for r in out] == [1, 2, 3, 4]


def test_hybrid_batch_of_one_equals_single(spark, docs, vectors):
    e = embedding_table(spark, vectors)
    q = spark.createDataFrame([(0, "treasury taxi", vectors[3].tolist()), (1, "  ", vectors[3].tolist())], "query_id int, query string, vector array<float>")
    batch = H.hybrid_search(q, docs, e).orderBy("rank").collect()
    single = H.hybrid_search_one("treasury taxi", vectors[3].tolist(), docs, e).orderBy("rank").collect()
    assert batch == single and 0 < len(single) <= 5 and {r.query_id for r in batch} == {0}
    assert H.hybrid_search_one(" ", vectors[3].tolist(), docs, e).count() == 0
    with pytest.raises(ValueError):
        H.hybrid_search(q, docs, e, top_k=0)


def many_records(spark, n=3000):
    words = ["alpha", "alphabet", "beta", "gamma", "delta", "the", "of", "x", "été", "zz9"]
    rows = [(i, words[i % 7], " ".join(words[(i * k + k) % 10] for k in range(1, 6))) for i in range(n)]
    return spark.createDataFrame([*rows, (n, None, None), (n + 1, "", "")], "id long, title string, description string").repartition(3)


@pytest.mark.parametrize("batch", [10_000, 50])
def test_words_sent_to_tasks_and_words_joined_agree(spark, monkeypatch, batch):
    docs = many_records(spark)
    queries = spark.createDataFrame(
        [(1, "alpha"), (2, "the of"), (3, "Beta gamma"), (4, "nowhere"), (5, ""), (6, None), (7, "été zz9 x"), (8, "alph")], "query_id int, query string"
    )
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        sent = [sorted(map(tuple, f(queries, docs, limit=7).collect())) for f in (T.lexical_search, T.fulltext_search)]
        monkeypatch.setattr(T, "MAX_WORDS", 1)
        joined = [sorted(map(tuple, f(queries, docs, limit=7).collect())) for f in (T.lexical_search, T.fulltext_search)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert sent[0] == joined[0] and len(sent[0]) == 7 * 5  # queries 1, 2, 3, 7, 8
    assert [(q, i, round(r, 9), p) for q, i, r, p in sent[1]] == [(q, i, round(r, 9), p) for q, i, r, p in joined[1]]
    none = queries.limit(0)
    monkeypatch.undo()
    assert T.lexical_search(none, docs).count() == T.fulltext_search(none, docs).count() == 0
    assert T.lexical_search(queries, docs.limit(0)).count() == T.fulltext_search(queries, docs.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["smallint", "string", "date", "decimal(9,2)", "binary"])
def test_ids_of_any_type_are_searched(spark, kind):
    rows = spark.range(40).selectExpr("cast(id as int) as n", "array(cast(id % 7 + 1 as float), 1f) as embedding")
    made = {"date": "date_add(date'2020-01-01', n)", "binary": "cast(lpad(n, 3, '0') as binary)", "string": "lpad(n, 3, '0')"}.get(kind, f"cast(n as {kind})")
    rows = rows.selectExpr("n", f"{made} as proposal_id", "embedding")
    q = rows.filter("n < 5").select(F.col("proposal_id").alias("query_id"), F.col("embedding").alias("vector"))
    found = V.vector_search(q, rows.select(F.col("proposal_id").alias("id")), rows, limit=3, block=2, part_rows=7)
    assert found.schema["id"].dataType == rows.schema["proposal_id"].dataType
    place = {r.proposal_id if kind != "binary" else bytes(r.proposal_id): r.n for r in rows.collect()}
    key = (lambda x: bytes(x)) if kind == "binary" else (lambda x: x)
    got = sorted((place[key(r.query_id)], r.position, place[key(r.id)]) for r in found.collect())
    assert got == [(q, p + 1, q + 7 * p) for q in range(5) for p in range(3)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.floats(-3, 3, allow_nan=False), min_size=1, max_size=7), st.integers(1, 40))
def test_crossings_come_in_order_of_their_margins(margins, probes):
    m = np.array(margins)
    found = VI.crossings(m, probes)
    cost = lambda mask: sum(x * x for i, x in enumerate(margins) if mask >> i & 1)
    every = sorted(cost(mask) for mask in range(1 << len(margins)))
    assert len(found) == len(set(found)) == min(probes, 1 << len(margins)) and found[0] == 0
    assert np.allclose([cost(x) for x in found], every[: len(found)])


def test_probed_search_finds_nine_of_ten(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("proposal_id"), "embedding")
    index = VI.build_signatures(e, str(tmp_path / "sig"), 64)
    assert VI.open_signatures(spark, index.path) == index and index.rows == e.filter("size(embedding) = 64").count()
    docs = e.select(F.col("proposal_id").alias("id"))
    q = e.filter("proposal_id % 20 = 0").select(F.col("proposal_id").alias("query_id"), F.col("embedding").alias("vector"))
    exact = V.vector_search(q, docs, e, limit=50).cache()
    found = VI.probed_search(q, docs, index, limit=50).cache()
    assert VI.recall(found, exact) >= 0.9
    near = found.join(exact.select("query_id", "id", F.col("distance").alias("d")), ["query_id", "id"])
    assert near.filter(F.abs(F.col("d") - F.col("distance")) > 1e-9).count() == 0
    assert found.filter("query_id = id AND position = 1").count() == q.count()
    one = VI.recall(VI.probed_search(q, docs, index, limit=50, probes=1), exact)
    assert one < VI.recall(found, exact)


@pytest.mark.parametrize("rows,asked", [(50_000, 4096), (20, 5)])
def test_probed_search_in_parts_and_without_rows(spark, tmp_path, monkeypatch, docs, vectors, rows, asked):
    monkeypatch.setattr(VI, "PART_ROWS", rows)
    monkeypatch.setattr(VI, "PART_QUERIES", asked)
    e = embedding_table(spark, vectors)
    index = VI.build_signatures(e, str(tmp_path / "sig"), 8, bits=3)
    q = spark.createDataFrame([(i, vectors[i].tolist()) for i in range(40)], "query_id int, vector array<float>")
    every = VI.probed_search(q, docs, index, limit=9, probes=8)  # all eight buckets
    exact = V.vector_search(q, docs, e, limit=9)
    assert sorted(map(tuple, every.collect())) == sorted(map(tuple, exact.collect()))
    assert VI.probed_search(q.limit(0), docs, index).count() == VI.probed_search(q, docs.limit(0), index).count() == 0
    empty = VI.build_signatures(e.limit(0), str(tmp_path / "none"), 8)
    assert empty.rows == 0 and VI.probed_search(q, docs, empty).count() == 0


def test_tasks_hold_few_texts_at_a_time(spark):
    """A batch of Spark's is taken apart before its words become Python objects; results do not change."""
    whole = pa.RecordBatch.from_pydict({"id": list(range(2 * T.HELD_ROWS + 3))})
    parts = list(T._slices(iter([whole])))
    assert max(b.num_rows for b in parts) <= T.HELD_ROWS and [x for b in parts for x in b.column("id").to_pylist()] == list(range(whole.num_rows))
    docs = spark.range(3 * T.HELD_ROWS).select(
        "id", F.concat(F.lit("t"), F.col("id") % 7).alias("title"), F.concat_ws(" ", F.lit("blue sky"), F.repeat(F.lit("blue "), (F.col("id") % 300).cast("int"))).alias("description")
    ).coalesce(1)
    asked = spark.createDataFrame([(1, "blue t3"), (2, "sky")], "query_id int, query string")
    for search in (T.fulltext_search, T.lexical_search):
        direct, joined = search(asked, docs), search(asked, docs, index=T.postings(docs))
        assert sorted(map(tuple, direct.collect())) == sorted(map(tuple, joined.collect()))


def test_words_are_not_shuffled(spark):
    docs = spark.range(20).select("id", F.lit("a title").alias("title"), F.lit("some more words").alias("description"), F.lit("p").alias("proposer"))
    plan = T.postings(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(id" in plan  # texts by id, and no words


def test_probes_are_not_broadcast(spark):
    docs = spark.range(20).select("id", F.lit("a title").alias("title"), F.lit("some more words").alias("description"), F.lit("p").alias("proposer"))
    asked = docs.select(F.col("id").alias("query_id"), F.col("title").alias("query"))
    plan = T.fuzzy_search(asked, docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"BroadcastHashJoin \[(_gram#\w+, _salt|value)", plan)
