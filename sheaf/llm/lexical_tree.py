"""Exact ranked lexical search over document tries.

The terms of a block of items are the vocabulary. A document is restricted to them: a vector of
(term, tf), ordered by the terms' document frequency, most frequent first. Documents that agree on
their most frequent terms share the beginning of a path, so a shard of documents is a trie.

1. One pass over the texts gives each document's number of terms and its restricted vector, which are
   stored, and N, L and df are summed from them over all documents.
2. Each task builds tries of its documents, shard by shard. A trie is split until a node holds at most
   :data:`LEAF` documents or their vectors' terms are equal. Every node knows the largest tf of each term
   below it and the smallest m; a term's share with both bounds what any document below can score.
3. An item is searched depth first, the most promising child first. A subtree whose bound is below the
   item's tenth score so far cannot matter and is left out; equal bounds are searched, as ties go to
   the smaller doc_id. Shares grow with tf and fall with m also after rounding, so no document is lost.
   A task's next shard begins with the scores that the last one left.
4. Tasks give their best ten of an item; these are cut by item and salt, and then by item.

Items are taken in blocks of bounded text, chosen by hash, so that a vocabulary sent to the tasks has a
bound (one item's own text, if that is larger) and any number of items can be asked; each block is one
pass. Documents are neither shuffled nor compared with each other.

A null or empty text has no terms: such a document does not count in N and is never found, such an
item finds nothing. Rows that repeat a doc_id are documents each. Rows that repeat an item_id are one
item with the terms of all; a null item_id is an item too. At equal scores a null doc_id comes last.
Terms of an item count once. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from sheaf.llm.common import as_batch, as_bytes, fields, parts_for, stored
from sheaf.session import union_all

TOP = 10
#: Documents below which a node is not split, and what a task's trie may hold at most.
LEAF = 64
SHARD_DOCS, SHARD_ENTRIES = 16_384, 2 << 20
#: Bytes of item texts that are asked in one pass over the documents.
BLOCK_BYTES = 1 << 20
#: Parts in which an item's results are cut before they meet.
SALTS = 64
#: Maps A-Z to a-z and every ASCII byte that is neither letter nor digit to a blank.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

VECTOR = fields(
    ("doc_id", T.LongType()),
    ("n", T.LongType()),
    ("terms", T.ArrayType(T.IntegerType())),
    ("tfs", T.ArrayType(T.LongType())),
)
FOUND = fields(("item", T.IntegerType()), ("doc_id", T.LongType()), ("score", T.LongType()), ("salt", T.IntegerType()))


def terms_of(text: bytes) -> list[bytes]:
    """Terms in order: runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased."""
    return text.translate(TERM_BYTES).split()


def restricted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Each document's number of terms and its (term, tf) within the vocabulary, terms ascending."""
    arrow = to_arrow_schema(VECTOR)
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = known.value
        for batch in batches:
            n, terms, tfs = [], [], []
            for text in as_bytes(batch.column("text")):
                words = terms_of(text)
                own = sorted((ids[w], k) for w, k in Counter(words).items() if w in ids)
                n.append(len(words))
                terms.append([t for t, _ in own])
                tfs.append([k for _, k in own])
            yield as_batch({"doc_id": batch.column("doc_id").to_pylist(), "n": n, "terms": terms, "tfs": tfs}, arrow)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, VECTOR)


class Weights(NamedTuple):
    """What scores need of the whole corpus: its size, its terms, and each term's rank and weight."""

    n_docs: int
    n_terms: int
    rank: np.ndarray  # of each term by df, the most frequent first
    weight: np.ndarray

    def lengths(self, n: np.ndarray) -> np.ndarray:
        """m of documents with n terms."""
        return 100 - 90 + (90 * n * self.n_docs) // max(1, self.n_terms)

    def shares(self, terms: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
        """What a term adds to the score of a document."""
        return self.weight[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def corpus_weights(vectors: DataFrame, size: int) -> Weights:
    """Sums over all documents. The result has one number a term of the vocabulary."""
    n_docs, n_terms = vectors.filter("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(size, np.int64)
    for term, k in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        df[term] = k
    rank = np.empty(size, np.int64)
    rank[np.lexsort((np.arange(size), -df))] = np.arange(size)
    weight = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(k) + 1))) for k in df]
    return Weights(n_docs, n_terms, rank, np.array(weight, np.int64))


class Tree:
    """A trie of documents, as rows of arrays.

    Documents are sorted by path, so a node is a range of them. ``entry_*`` hold the (node, term, largest
    share) of all nodes, by term; ``doc_*`` the (document, term, share) of all documents, by document.
    """

    def __init__(self, doc_ids: np.ndarray, n: np.ndarray, lengths: np.ndarray, terms: np.ndarray, tfs: np.ndarray, w: Weights):
        starts = np.cumsum(lengths) - lengths
        row = np.repeat(np.arange(len(lengths)), lengths)
        by = np.lexsort((w.rank[terms], row))  # most frequent terms first
        terms, tfs = terms[by], tfs[by]
        coded = w.rank[terms].astype(">u4").tobytes()
        paths = [coded[4 * a : 4 * (a + k)] for a, k in zip(starts.tolist(), lengths.tolist(), strict=True)]
        order = sorted(range(len(paths)), key=paths.__getitem__)
        self.paths = [paths[i] for i in order]
        take = np.concatenate([np.arange(starts[i], starts[i] + lengths[i]) for i in order]) if order else np.empty(0, np.int64)
        self.ids, m, lengths = doc_ids[order], w.lengths(n[order]), lengths[order]
        self.doc_terms, tfs = terms[take], tfs[take]
        self.doc_starts = np.concatenate([[0], np.cumsum(lengths)])
        rows = np.repeat(np.arange(len(lengths)), lengths)
        self.doc_shares = w.shares(self.doc_terms, tfs, m[rows])
        self.doc_rows = rows
        self._split()
        self._bound(w, tfs, m)

    def _split(self) -> None:
        """Nodes from the root down; children hold a range of their parent's documents."""
        self.low, self.high, self.children = [0], [len(self.paths)], [[]]
        waiting = [(0, 0)]  # node and bytes of path that its documents share
        while waiting:
            node, depth = waiting.pop()
            lo, hi = self.low[node], self.high[node]
            if hi - lo <= LEAF:
                continue
            first, last = self.paths[lo], self.paths[hi - 1]
            while first[depth : depth + 4] == last[depth : depth + 4] and depth < len(last):
                depth += 4
            if depth < len(last):
                cuts = [lo]
                for i in range(lo + 1, hi):
                    if self.paths[i][depth : depth + 4] != self.paths[i - 1][depth : depth + 4]:
                        cuts.append(i)
            else:  # equal paths: no term tells them apart
                cuts = list(range(lo, hi, LEAF))
            for a, z in zip(cuts, [*cuts[1:], hi], strict=True):
                self.children[node].append(len(self.low))
                # documents that end here share all of their path; blocks of equal ones are leaves
                if depth < len(last):
                    waiting.append((len(self.low), depth + 4 if self.paths[a][depth:] else depth))
                self.low.append(a)
                self.high.append(z)
                self.children.append([])

    def _bound(self, w: Weights, tfs: np.ndarray, m: np.ndarray) -> None:
        """The largest tf of each term and the smallest m below each node, as bounds of shares."""
        nodes, terms, most, least = [], [], [], []
        for node, (a, z) in enumerate(zip(self.low, self.high, strict=True)):
            at = slice(self.doc_starts[a], self.doc_starts[z])
            if not z - a or at.start == at.stop:
                continue
            by = np.argsort(self.doc_terms[at], kind="stable")
            sorted_terms = self.doc_terms[at][by]
            heads = np.flatnonzero(np.diff(sorted_terms, prepend=-1))
            terms.append(sorted_terms[heads])
            most.append(np.maximum.reduceat(tfs[at][by], heads))
            nodes.append(np.full(len(heads), node))
            least.append(np.full(len(heads), m[a:z].min()))
        none = np.empty(0, np.int64)
        nodes, terms, most, least = (np.concatenate(x) if x else none for x in (nodes, terms, most, least))
        by = np.argsort(terms, kind="stable")
        self.entry_nodes = nodes[by]
        self.entry_shares = w.shares(terms, most, least)[by]
        self.entry_starts = np.searchsorted(terms[by], np.arange(len(w.weight) + 1))

    def search(self, terms: np.ndarray, wanted: np.ndarray, best: list[tuple[int, int]], top: int) -> None:
        """Put the documents that belong to the ``top`` best into the heap of (score, -doc_id).

        ``wanted`` marks the terms in the vocabulary."""
        bounds = np.zeros(len(self.low), np.int64)
        for t in terms:
            at = slice(self.entry_starts[t], self.entry_starts[t + 1])
            bounds[self.entry_nodes[at]] += self.entry_shares[at]
        limits = bounds.tolist()
        waiting = [0]
        while waiting:
            node = waiting.pop()
            if not limits[node] or len(best) == top and limits[node] < best[0][0]:
                continue
            if self.children[node]:  # the most promising is taken next
                waiting += sorted((c for c in self.children[node] if limits[c]), key=limits.__getitem__)
                continue
            a, z = self.low[node], self.high[node]
            at = slice(self.doc_starts[a], self.doc_starts[z])
            shares = np.where(wanted[self.doc_terms[at]], self.doc_shares[at], 0)
            sums = np.concatenate([[0], np.cumsum(shares)])
            scores = np.diff(sums[self.doc_starts[a : z + 1] - at.start])
            least = best[0][0] if len(best) == top else 1
            for i in np.flatnonzero(scores >= max(least, 1)):
                found = (int(scores[i]), -int(self.ids[a + i]))
                if len(best) < top:
                    heapq.heappush(best, found)
                elif found > best[0]:
                    heapq.heapreplace(best, found)


#: Stands for a null doc_id while results are ordered; it comes after all others.
NO_ID = (1 << 63) - 1


def search_block(docs: DataFrame, items: list[list[bytes]], top: int = TOP) -> DataFrame:
    """The best documents of each task for items given by their terms; ``item`` is the place in the list."""
    vocabulary = {t: i for i, t in enumerate(sorted({t for item in items for t in item}))}
    vectors = stored(restricted(docs, vocabulary), "lexical-vectors")
    weights = corpus_weights(vectors, len(vocabulary))
    asked = [np.array(sorted({vocabulary[t] for t in item}), np.int64) for item in items]
    context = docs.sparkSession.sparkContext
    shipped = context.broadcast((weights, asked))
    arrow = to_arrow_schema(FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, queries = shipped.value
        best: list[list] = [[] for _ in queries]
        wanted = np.zeros(len(w.weight), bool)
        for shard in _shards(batches):
            tree = Tree(*shard, w)
            for terms, heap in zip(queries, best, strict=True):
                wanted[terms] = True
                tree.search(terms, wanted, heap, top)
                wanted[terms] = False
        salt = _salt()
        rows = [(i, None if -d == NO_ID else -d, s, salt) for i, heap in enumerate(best) for s, d in heap]
        if rows:
            yield as_batch(dict(zip(FOUND.names, zip(*rows, strict=True), strict=True)), arrow)

    return vectors.filter(F.size("terms") > 0).mapInArrow(run, FOUND)


def _salt() -> int:
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId() % SALTS if context else 0


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Documents of a task in shards of bounded size: ids, number of terms, entries of each, terms, tfs."""
    held, docs, entries = [], 0, 0
    for batch in batches:
        ends = np.cumsum(batch.column("terms").value_lengths().to_numpy())
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            stop = min(batch.num_rows, at + SHARD_DOCS - docs, int(np.searchsorted(ends, before + SHARD_ENTRIES - entries, "right")))
            stop = max(stop, at + (not held))  # one document at least, however long
            if stop > at:
                held.append(batch.slice(at, stop - at))
                docs, entries, at = docs + stop - at, entries + ends[stop - 1] - before, stop
            if at < batch.num_rows:
                yield _joined(held)
                held, docs, entries = [], 0, 0
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> tuple:
    table = pa.Table.from_batches(held).combine_chunks()
    terms = table.column("terms").combine_chunks()
    ids = table.column("doc_id").fill_null(NO_ID).to_numpy()
    lengths = terms.value_lengths().to_numpy().astype(np.int64)
    tfs = table.column("tfs").combine_chunks().flatten().to_numpy()
    return ids, table.column("n").to_numpy(), lengths, terms.flatten().to_numpy().astype(np.int64), tfs


def item_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple]]:
    """Items as (item_id, terms) in blocks of bounded text."""
    texts = items.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = parts_for(total, block_bytes)
    for part in range(parts):
        mine: dict[int | None, set[bytes]] = {}
        for item, text in texts.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).collect():
            mine.setdefault(item, set()).update(terms_of(text.encode()))
        if mine:
            yield [(item, sorted(terms)) for item, terms in mine.items()]


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score`` of each item's best documents with a score above 0."""
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType
    out = []
    for block in item_blocks(items, block_bytes):
        found = search_block(docs, [terms for _, terms in block], top)
        names = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", kind)])
        named = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], names)
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        cut = found.withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).filter(F.col("rank") <= top)
        rank = F.row_number().over(Window.partitionBy("item").orderBy(*order))
        best = cut.withColumn("rank", rank).filter(F.col("rank") <= top)
        best = best.join(F.broadcast(named), "item")  # one row an item of the block
        out.append(best.select("item_id", "rank", "doc_id", "score"))
    if not out:
        empty = T.StructType([T.StructField("item_id", kind), *fields(("rank", T.IntegerType()), ("doc_id", T.LongType()), ("score", T.LongType())).fields])
        return spark.createDataFrame([], empty)
    return union_all(*out)
