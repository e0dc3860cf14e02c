import math
import random
import re

import numpy as np
import pytest

from sheaf.llm import lexical_tree as X
from tests.llm import cases

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(cases.ASCII_LOWER))


def plain_search(docs, items, top=10):
    """Every document scored for every item."""
    split = [(d, terms(t)) for d, t in docs]
    split = [(d, w) for d, w in split if w]
    n_docs, n_terms = len(split), sum(len(w) for _, w in split)
    df = {}
    for _, w in split:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, wanted in asked.items():
        found = []
        for d, w in split:
            m = 100 - 90 + (90 * len(w) * n_docs) // n_terms
            score = 0
            for t in wanted.intersection(w):
                tf = w.count(t)
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        found = sorted(found, key=lambda x: x[:3])[:top]
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(found)]
    return sorted(out, key=str)


def rows(found):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in found.collect()), key=str)


ITEMS = [(1, "the quiet RIVER turned"), (2, None), (3, ""), (3, "one three"), (3, "one"), (None, "aa é école"), (4, "nothing here at all zzz"), (5, cases.words(60, 1))]


@pytest.mark.parametrize("leaf,shard,block", [(64, 1 << 14, 1 << 20), (1, 3, 16), (2, 1 << 14, 1 << 20)])
def test_awkward_documents(spark, monkeypatch, leaf, shard, block):
    """Also split down to single documents, in tiny shards, and in a block an item."""
    monkeypatch.setattr(X, "LEAF", leaf)
    monkeypatch.setattr(X, "SHARD_DOCS", shard)
    docs = [(d, t) for d, t in cases.DOCS if d not in (10, 11)] + [(20, cases.words(2000, 8)), (21, "É ecole école")]
    items = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "1 as rank", "2L as doc_id", "'s' as score")
    got = rows(X.ranked_search(cases.frame(spark, docs, extra=True), items, block_bytes=block))
    assert got == plain_search(docs, ITEMS)


def test_the_table(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "benchmark"))
    want = plain_search([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.limit(12).collect()])
    assert rows(X.ranked_search(docs, items.limit(12))) == want


def test_ties_copies_and_empty_tables(spark):
    docs = [(i, "common word") for i in range(200)] + [(500, "common"), (None, "common word"), (3, "common word"), (501, "other text")]
    items = [(1, "word"), (2, "common"), (3, "other")]
    frames = spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")
    assert rows(X.ranked_search(*frames)) == plain_search(docs, items)
    assert X.ranked_search(frames[0].limit(0), frames[1]).count() == 0
    empty = X.ranked_search(frames[0], frames[1].limit(0))
    assert empty.count() == 0 and empty.columns == ["item_id", "rank", "doc_id", "score"]


def test_bounds_hold_and_subtrees_are_left_out(monkeypatch):
    """No document scores above the bound of a node that holds it, and most documents are never scored."""
    monkeypatch.setattr(X, "LEAF", 4)
    rng = random.Random(2)
    size, n = 60, 800
    vectors = [sorted(rng.sample(range(size), rng.choice((2, 5, 20)))) for _ in range(n)]
    tfs = [[rng.choice((1, 1, 2, 9)) for _ in v] for v in vectors]
    lengths = np.array([len(v) for v in vectors])
    n_terms = np.array([sum(t) + rng.randrange(400) for t in tfs])
    df = np.bincount(np.concatenate([np.array(v) for v in vectors]), minlength=size)
    rank = np.empty(size, np.int64)
    rank[np.lexsort((np.arange(size), -df))] = np.arange(size)
    w = X.Weights(n, int(n_terms.sum()), rank, np.array([int(1000 * math.log((2 * n + 2) / (2 * k + 1))) for k in df]))
    tree = X.Tree(np.arange(n), n_terms, lengths, np.concatenate([np.array(v) for v in vectors]), np.concatenate([np.array(t) for t in tfs]), w)
    m = w.lengths(n_terms)
    score = lambda i, q: sum(int(w.shares(np.array([t]), np.array([k]), m[i : i + 1])[0]) for t, k in zip(vectors[i], tfs[i], strict=True) if t in q)
    for _ in range(10):
        q = set(rng.sample(range(size), 4))
        wanted = np.zeros(size, bool)
        wanted[list(q)] = True
        best = []
        tree.search(np.array(sorted(q)), wanted, best, 5)
        want = sorted(((score(i, q), -i) for i in range(n) if score(i, q)), reverse=True)[:5]
        assert sorted(best, reverse=True) == want
    nodes = sum(not c for c in tree.children)
    assert nodes > 100 and sum(z - a for a, z, c in zip(tree.low, tree.high, tree.children, strict=True) if not c) == n
