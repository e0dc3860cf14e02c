"""Small tables with the awkward cases, and plain restatements to compare with."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

CLASHING = "n_words long, score double, kept boolean, hits string, _key long, _row string, chunk int, bucket int, node long, text_a string"
PROSE = "the quiet river turned past old mills and a row of slow green barges near dawn while herons stood"


def words(n: int, seed: int = 0) -> str:
    return " ".join(f"{PROSE.split()[(i * 7 + seed * 3 + i * i) % 19]}{(i * 31 + seed * 17) % 97}" for i in range(n))


LONG = words(30_000, 5)
DOCS = [
    (1, words(120, 1)),
    (2, words(120, 1)),  # an exact copy
    (3, words(120, 1).replace("river", "stream", 1) + " end."),
    (4, None),
    (5, ""),
    (6, " \n\t "),
    (7, "one two three"),
    (8, "one two three"),
    (9, words(300, 2)),
    (9, words(300, 2)),  # a repeated row
    (10, LONG),
    (11, LONG[:200_000] + " tail"),
    (12, "é" * 400),
    (13, "aa " * 500),
    (14, words(80, 3) + "\n" + words(60, 1)),
    (15, "ÉCOLE Straße ПРИВЕТ мир \x00 nul\x00 " + words(60, 4)),
    (None, words(120, 1)),
]


def frame(spark, rows=DOCS, extra: bool = False):
    docs = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string").repartition(3)
    if extra:
        names = [x.strip() for x in CLASHING.split(",")]
        docs = docs.selectExpr("doc_id", "text", *[f"cast(null as {x.split()[1]}) as {x.split()[0]}" for x in names])
    return docs


def repeats(rows, length=50):
    """doc_id to the rows (n_bytes, n_removed, n_spans, digest) that the definition gives."""
    least: dict[bytes, int] = {}
    coded = [(d, (t or "").encode()) for d, t in rows]
    for d, b in coded:
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if d is not None and least.get(w, d) >= d:
                least[w] = d
    out = defaultdict(list)
    for d, b in coded:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if d is not None and least[b[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[d].append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER))
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def near(rows):
    """doc_id to (n_shingles, component) by comparing all pairs of distinct sets."""
    sets = {d: shingles(t) for d, t in rows if d is not None}
    groups = defaultdict(list)
    for d, s in sorted(sets.items()):
        groups[s].append(d)
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def join(a, b):
        a, b = sorted((root(a), root(b)))
        parent[b] = a

    reps = []
    for s, ids in groups.items():
        if s:
            reps.append((ids[0], s))
            for d in ids:
                join(ids[0], d)
    holders = defaultdict(list)
    for d, s in reps:
        for x in s:
            holders[x].append(d)
    by_id = dict(reps)
    for d, s in reps:
        shared = defaultdict(int)
        for x in s:
            for e in holders[x]:
                if e < d:
                    shared[e] += 1
        for e, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(by_id[e]) - n):
                join(d, e)
    return {d: (len(s), root(d)) for d, s in sets.items()}


BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(text, items, window=10):
    """n_words, n_hit and the ids of items that the text holds."""
    w = BENCH_WORD.findall((text or "").translate(ASCII_LOWER))
    hit, found = set(), set()
    for item_id, item in items:
        x = BENCH_WORD.findall((item or "").translate(ASCII_LOWER))
        size = min(window, len(x))
        windows = {tuple(x[i : i + size]) for i in range(len(x) - size + 1)} if x else set()
        for i in range(len(w) - size + 1):
            if windows and tuple(w[i : i + size]) in windows:
                hit.update(range(i, i + size))
                found.add(str(item_id))
    return len(w), len(hit), sorted(found)


def digest(*parts) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()
