import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sheaf.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string"


def code(role, text):
    return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest(), len(text.encode())


def sequences(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            convs[conv].append((turn is not None, turn or 0, code(role, text), (role, text)))
    return {c: [x[-1] for x in sorted(t)] for c, t in convs.items()}


def rebuild(convs):
    out = {}
    for c, turns in convs.items():
        h = (zlib.crc32(str(c).encode()) & 0xFFFFFFFF) % 9
        out[c] = convs.get(c - int(c - 5 * int(c / 5)), [])[:h] + turns[h:]
    return out


def plain_trie(convs):
    """All nodes by listing every prefix of every conversation."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    below = {}
    for node in sorted(members, key=len, reverse=True):
        saved = (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
        below[node] = (sum(below[k][0] for k in kids[node]) or 1, saved + sum(below[k][1] for k in kids[node]))
    out = []
    for node, held in members.items():
        text = ",".join(map(str, sorted(ends[node])))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(held), len(node), parent, len(held), len(kids[node]), *below[node], hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select(*P.RESULT).collect()), key=str)


def generated(n, seed, words=3, longest=6):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randrange(1, longest)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["", "é", "long text " * 3, "x"][: words + 1])))
    return rows


AWKWARD = [
    (0, 0, "user", "hello"),
    (0, 1, "assistant", "there"),
    (1, None, None, None),
    (1, None, None, None),
    (1, 0, "user", "hello"),
    (2, 0, "user", "hello"),
    (2, 0, "user", "hello"),
    (2, 0, "assistant", "a tie"),
    (-3, 0, "user", "below zero"),
    (None, 0, "user", "nobody"),
    (7, 5, "us", "er"),
    (8, 5, "use", "r"),
    (10, 1, "user", "very long " * 100_000),
    (11, 1, "user", "very long " * 100_000),
    *[(12, t, "user", f"turn {t % 3}") for t in range(700)],
    *[(13, t, "user", f"turn {t % 3}") for t in range(650)],
]


@pytest.mark.parametrize("shard_bytes", [P.SHARD_BYTES, 40])
def test_awkward_conversations(spark, shard_bytes):
    df = spark.createDataFrame(AWKWARD, SCHEMA).repartition(3).selectExpr("*", "1 as codes", "'p' as path", "2 as node", "3 as depth", "4 as h", "5 as base")
    convs = P.coded(df)
    plain = sequences(AWKWARD)
    assert got(P.prefix_trie(convs, shard_bytes)) == plain_trie(plain)
    assert got(P.prefix_trie(P.rebuilt(convs), shard_bytes)) == plain_trie(rebuild(plain))


@pytest.mark.parametrize("shard_bytes", [P.SHARD_BYTES, 200])
def test_the_table(spark, sf, shard_bytes):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    plain = sequences([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
    assert got(P.prefix_trie(P.rebuilt(P.coded(df)), shard_bytes)) == plain_trie(rebuild(plain))


def test_copies_over_many_shards(spark, monkeypatch):
    """A third of all conversations are copies, another third share their first turn."""
    monkeypatch.setattr(P, "PIECE", 5)
    rows = [(c, t, "user", "same") for c in range(150) for t in range(2)]
    rows += [r for c in range(150, 300) for r in ((c, 0, "user", "same"), (c, 1, "user", f"own {c % 70}"))]
    rows += [(c + 300, *r) for c, *r in generated(150, 3)]
    convs = P.coded(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert got(P.prefix_trie(convs, 300)) == plain_trie(sequences(rows))


def test_without_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert got(P.prefix_trie(P.rebuilt(P.coded(empty)))) == []
    nobody = spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)
    assert got(P.prefix_trie(P.coded(nobody))) == []


def test_a_turnless_conversation_is_a_member_of_the_root(spark):
    lone = next(c for c in range(1, 50) if c % 5 and (zlib.crc32(str(c).encode()) & 0xFFFFFFFF) % 9 > 1)
    rows = [(lone, 0, "user", "lost")]
    out = got(P.prefix_trie(P.rebuilt(P.coded(spark.createDataFrame(rows, SCHEMA)))))
    assert out == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=5), min_size=1, max_size=20))
def test_tree_nodes_are_the_distinct_prefixes(paths):
    tree = P.TernaryTree()
    ordered = sorted(map(tuple, set(map(tuple, paths))))
    ends = {}
    for i in P.median_first(len(ordered)):
        ends[ordered[i]] = tree.put(list(ordered[i]))
    listed = tree.listed()
    up = {n: p for n, p, _ in listed}
    words = {}
    for node, parent, depth in listed:
        words[node] = (*words[parent], tree.turn[node]) if parent >= 0 else ()
        assert len(words[node]) == depth
    assert len(set(words.values())) == len(words) == len(up)
    assert set(words.values()) == {p[:d] for p in ordered for d in range(len(p) + 1)} | {()}
    assert all(words[n] == p for p, n in ends.items())


def test_median_first_keeps_sibling_trees_shallow():
    order = list(P.median_first(1000))
    assert sorted(order) == list(range(1000))
    tree = P.TernaryTree()
    for i in order:
        tree.put([i])
    deepest, waiting = 0, [(tree.down[0], 1)]
    while waiting:
        node, depth = waiting.pop()
        if node:
            deepest = max(deepest, depth)
            waiting += [(tree.low[node], depth + 1), (tree.high[node], depth + 1)]
    assert deepest <= 10
