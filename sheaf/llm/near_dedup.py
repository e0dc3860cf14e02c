"""Near-duplicate documents by MinHash bands and odd sketches.

A document is the set of its distinct five-word shingles, A-Z lower-cased. Its MinHash samples serve
twice: runs of :data:`ROWS` samples are band keys, and all samples together are folded into an odd sketch,
a bitmap in which each sample flips one bit. Two sketches' XOR holds the parity of the samples in
which the sets differ, so its population count estimates a high similarity closely.

1. Documents of one shingle set are one class, known by a 128-bit hash; only classes go on.
2. Classes that share a band key are candidates. Each is first paired with the smallest class of
   its bucket alone, pairs whose sketches put them well below the threshold are dropped, and the
   rest is confirmed on the full sets.
3. Buckets whose classes are not all connected by then are gone through once more, in blocks of
   bounded size: unconnected classes that the sketches let through are confirmed within the task,
   which gives out links only. So no pair that shares a band is passed over, while a group of near
   copies that are linked costs one pair a member, not the square of its size.
4. Confirmed links give components, whose smallest doc_id is every member's component_id.

A pair of similarity 0.75 shares none of the 30 bands of 5 with probability 0.0003, and most groups are
tied by more than one pair. The sketch cut at :data:`SKETCH_FLOOR` drops 0.00001 of such pairs (400,000
simulated ones), so both together miss 0.0003. Band rows are (key, id), both numbers; full texts are fetched for candidates only.

A document without words has an empty set and is linked with nothing. Fewer than five words are one
shingle. Rows that repeat a doc_id are one document: a link of one is a link of all. As such rows may
belong to several classes, a class is known by its smallest doc_id and that row's text (``tag``). A null doc_id is
linked with nothing, has no component and is kept. Extra columns pass through the filter.
"""

from __future__ import annotations

from collections.abc import Callable
from math import exp

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sheaf.llm.common import as_batch, as_bytes, fields, fold_values, per_batch, stored
from sheaf.llm.components import components
from sheaf.session import union_all

SHINGLE = 5
THRESHOLD_PERCENT = 75
BANDS, ROWS = 30, 5
SAMPLES = BANDS * ROWS
SKETCH_BITS = 512
#: Estimated similarity below which a candidate is not confirmed.
SKETCH_FLOOR = 0.55
#: Classes of a bucket, and shingles of them, that are compared in one block.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 20
#: Words whose hashes a worker remembers.
CACHE_WORDS = 1 << 20

_rng = np.random.default_rng(5)
_SCALE = _rng.integers(0, 2**63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _rng.integers(0, 2**63, SAMPLES, dtype=np.uint64)
_PLACE = fold_values(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STEP = np.uint64(0xD6E8FEB86659FD93)

SIGNATURE = fields(
    ("tag", T.LongType()),
    ("n_shingles", T.LongType()),
    ("k1", T.LongType()),
    ("k2", T.LongType()),
    ("bands", T.ArrayType(T.LongType())),
    ("sketch", T.ArrayType(T.LongType())),
)
#: Differing bits that stand for SKETCH_FLOOR: each differing sample flips two bits.
MOST_BITS = int(SKETCH_BITS / 2 * (1 - exp(-4 * SAMPLES * (1 - SKETCH_FLOOR) / SKETCH_BITS)))


class Shingler:
    """Shingle sets as sorted 64-bit hashes. Hashes of words are remembered."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.lower().split()  # of bytes: A-Z and the ASCII blanks only
        if not words:
            return np.empty(0, np.uint64)
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        for w in set(words).difference(self.known):
            self.known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        n = min(SHINGLE, len(h))
        out = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            out = out * _STEP + h[i : i + len(out)]
        return np.unique(fold_values(out))


def samples_of(shingles: np.ndarray) -> np.ndarray:
    """The MinHash samples of a non-empty set."""
    least = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 512):
        block = shingles[at : at + 512, None] * _SCALE + _SHIFT
        np.minimum(least, block.min(axis=0), out=least)
    return least


def bands_of(samples: np.ndarray) -> np.ndarray:
    rows = samples.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        key = fold_values(key * _STEP + rows[:, i])
    return key.view(np.int64)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity bitmap of the (number, value) samples as words of 64 bits."""
    bit = fold_values(samples ^ _PLACE) % np.uint64(SKETCH_BITS)
    flips = np.bincount(bit.astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id and the columns of :data:`SIGNATURE`; an empty set has no bands and no sketch. ``tag``
    tells the texts of one doc_id apart."""
    schema = T.StructType([docs.schema["doc_id"], *SIGNATURE.fields])
    shinglers: list[Shingler] = []

    def one(text: bytes, done: dict) -> tuple:
        shingler = shinglers[0] if shinglers else shinglers.append(Shingler()) or shinglers[0]
        s = shingler(text)
        if not len(s):
            return 0, 0, 0, None, None
        key = xxhash.xxh3_128_digest(s.tobytes())
        if key not in done:
            samples = samples_of(s)
            done[key] = bands_of(samples), odd_sketch(samples)
        k1, k2 = np.frombuffer(key, np.int64).tolist()
        return len(s), k1, k2, *done[key]

    def run(batch: pa.RecordBatch) -> dict:
        done: dict = {}
        rows = [one(t, done) for t in as_bytes(batch.column(1))]
        return {"doc_id": batch.column(0), "tag": batch.column(2)} | dict(zip(SIGNATURE.names[1:], zip(*rows, strict=True), strict=True))

    return per_batch(docs.select("doc_id", "text", _tag()), run, schema)


def _tag() -> Column:
    return F.xxhash64("text").alias("tag")


def likely(n: Column, sketch: Column, other_n: Column, other_sketch: Column) -> Column:
    """Whether sizes allow the threshold and sketches put a pair near or above it."""
    sizes = (F.least(n, other_n) * 100) >= (F.greatest(n, other_n) * THRESHOLD_PERCENT)
    bits = F.aggregate(
        F.zip_with(sketch, other_sketch, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x
    )
    return sizes & (bits <= MOST_BITS)


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs of classes (a, tag_a, b, tag_b) whose full sets reach the threshold, as links (a, b).
    ``texts``: node, tag, text."""
    left = texts.select(F.col("node").alias("a"), F.col("tag").alias("tag_a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("tag").alias("tag_b"), F.col("text").alias("text_b"))
    both = pairs.join(left, ["a", "tag_a"]).join(right, ["b", "tag_b"]).select("a", "b", "text_a", "text_b")
    schema = fields(("a", pairs.schema["a"].dataType), ("b", pairs.schema["b"].dataType))

    def run(batch: pa.RecordBatch) -> dict:
        shingler = Shingler()
        sets: dict[bytes, np.ndarray] = {}

        def of(text: bytes) -> np.ndarray:
            if text not in sets:
                if len(sets) >= 64:
                    sets.clear()
                sets[text] = shingler(text)
            return sets[text]

        keep = []
        for x, y in zip(as_bytes(batch.column(2)), as_bytes(batch.column(3)), strict=True):
            x, y = of(x), of(y)
            shared = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * shared >= THRESHOLD_PERCENT * (len(x) + len(y) - shared))
        kept = batch.filter(pa.array(keep, pa.bool_()))
        return {"a": kept.column(0), "b": kept.column(1)}

    return per_batch(both, run, schema)


def unconnected_links(buckets: DataFrame, classes: DataFrame, texts: DataFrame, found: DataFrame) -> DataFrame:
    """Links (a, b) between classes that share a bucket and are not connected by ``found`` (node, root).

    ``buckets``: key, band, node, tag. Buckets meet in blocks of bounded rows and bytes. Within a block a pair is
    looked at if its roots differ, its sizes and sketches allow the threshold and this is the first
    bucket that both share. A first pass over the blocks, without texts, keeps the classes that have such a
    pair; only their texts are fetched. The second confirms on the full sets right in the block, and what is
    linked counts as connected from then on. So a task gives classes or links, never candidates."""
    rooted = buckets.join(found, "node", "left").select("key", "band", "node", "tag", F.coalesce("root", "node").alias("root"))
    known = classes.select("node", "tag", "n", "sketch", "bands")
    sized = rooted.join(known.select("node", "tag", "n"), ["node", "tag"])
    open_keys = sized.groupBy("key").agg(
        F.count("*").alias("size"), F.sum("n").alias("shingles"), F.min("root").alias("lo"), F.max("root").alias("hi")
    )
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    open_keys = open_keys.filter("lo < hi and size > 2").select("key", blocks.alias("blocks"))
    own = F.pmod(F.xxhash64("node", "tag"), F.col("blocks")).cast("int")
    rows = rooted.join(open_keys, "key").select("key", "band", "node", "tag", "root", own.alias("own"), "blocks")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = rows.select("key", "band", "node", "tag", "root", "own", other).join(known, ["node", "tag"])
    rows = rows.select(
        "key", "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "tag", "root", "n", "sketch", "bands"
    )
    node = classes.schema["node"].dataType
    schema = fields(("a", node), ("b", node))
    arrow = to_arrow_schema(schema)

    def columns(group: pa.Table) -> tuple[np.ndarray, ...]:
        root, n, own = (group[c].to_numpy() for c in ("root", "n", "own"))
        bits = np.array(group["sketch"].to_pylist(), np.int64).view(np.uint64)
        return root, n, own, bits, np.array(group["bands"].to_pylist(), np.int64)

    def partners(group: pa.Table, at: int, root: np.ndarray, n: np.ndarray, own: np.ndarray, bits: np.ndarray, bands: np.ndarray) -> np.ndarray:
        """The later rows of the block, or those of its other half, that ``at`` may be linked with."""
        i, j = group["i"][0].as_py(), group["j"][0].as_py()
        if i == j:
            cut = np.arange(at + 1, len(root))
        elif own[at] == i:
            cut = np.flatnonzero(own == j)
        else:
            return np.empty(0, np.int64)
        cut = cut[root[cut] != root[at]]
        cut = cut[100 * np.minimum(n[cut], n[at]) >= THRESHOLD_PERCENT * np.maximum(n[cut], n[at])]
        cut = cut[np.bitwise_count(bits[cut] ^ bits[at]).sum(axis=1) <= MOST_BITS]
        return cut[(bands[cut] == bands[at]).argmax(axis=1) == group["band"][0].as_py()]

    def sift(group: pa.Table, _: Shingler) -> pa.RecordBatch | None:
        held = columns(group)
        paired = np.zeros(group.num_rows, bool)
        for at in range(group.num_rows):
            cut = partners(group, at, *held)
            paired[cut] = True
            paired[at] |= len(cut) > 0
        return group.filter(pa.array(paired)).combine_chunks().to_batches()[0] if paired.any() else None

    def compare(group: pa.Table, shingler: Shingler) -> pa.RecordBatch | None:
        node = group["node"].to_numpy()
        root, n, own, bits, bands = columns(group)
        texts = as_bytes(group["text"].combine_chunks())
        sets: dict[int, np.ndarray] = {}
        root = root.copy()
        links = []

        def shingles(row: int) -> np.ndarray:
            if row not in sets:
                sets[row] = shingler(texts[row])
            return sets[row]

        for at in range(len(node)):
            cut = partners(group, at, root, n, own, bits, bands)
            for lo in range(0, len(cut), 256):
                some = cut[lo : lo + 256]
                some = some[root[some] != root[at]]
                if not len(some):
                    continue
                mine, theirs = shingles(at), [shingles(x) for x in some.tolist()]
                laid = np.concatenate(theirs)
                met = mine[np.minimum(np.searchsorted(mine, laid), len(mine) - 1)] == laid
                size = np.array([len(x) for x in theirs])
                shared = np.add.reduceat(met, np.cumsum(size) - size, dtype=np.int64)
                for x in some[100 * shared >= THRESHOLD_PERCENT * (len(mine) + size - shared)].tolist():
                    links.append((min(node[at], node[x]), max(node[at], node[x])))
                    root[root == root[x]] = root[at]
        if links:
            a, b = zip(*links, strict=True)
            return as_batch({"a": a, "b": b}, arrow)
        return None

    met = _by_block(rows, sift, rows.schema)
    met = stored(met, "open").join(texts, ["node", "tag"])
    return _by_block(met, compare, schema).distinct()


def _by_block(rows: DataFrame, work: Callable[[pa.Table, Shingler], pa.RecordBatch | None], schema: T.StructType) -> DataFrame:
    """``work`` of every block (key, i, j) of ``rows``, one block at a time in memory."""

    def run(batches):
        shingler = Shingler()
        waiting: list[pa.Table] = []
        for batch in batches:
            table = pa.Table.from_batches([batch])
            marks = np.stack([table[c].to_numpy() for c in ("key", "i", "j")], axis=1)
            ends = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *ends], [*ends, len(marks)], strict=True):
                piece = table.slice(lo, hi - lo)
                if waiting and any(waiting[-1][c][0] != piece[c][0] for c in ("key", "i", "j")):
                    if (out := work(pa.concat_tables(waiting), shingler)) is not None:
                        yield out
                    waiting = []
                waiting.append(piece)
        if waiting and (out := work(pa.concat_tables(waiting), shingler)) is not None:
            yield out

    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, schema)


def near_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Signatures without bands (doc_id, n_shingles, first_id: the class) and the roots (node, root)
    of the classes that are linked with others."""
    docs = docs.select("doc_id", "text")
    signed = stored(signatures(docs), "signatures")
    named = signed.filter("doc_id is not null and n_shingles > 0")
    classes = named.groupBy("k1", "k2").agg(
        F.min(F.struct("doc_id", "tag")).alias("of"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")
    )
    classes = stored(classes.select("k1", "k2", F.col("of.doc_id").alias("node"), "of.tag", "n", "bands", "sketch"), "classes")
    members = classes.select("node", "tag", F.posexplode("bands").alias("band", "key"))
    shared = members.groupBy("key").agg(F.min(F.struct("node", "tag")).alias("first"), F.max("node").alias("last")).filter("first.node < last")
    buckets = stored(members.join(shared.select("key", "first"), "key"), "buckets")

    a, b = (
        classes.select(F.col("node").alias(x), F.col("tag").alias(f"tag_{x}"), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))
        for x in ("a", "b")
    )
    star = buckets.filter("first.node < node").select(
        F.col("first.node").alias("a"), F.col("first.tag").alias("tag_a"), F.col("node").alias("b"), F.col("tag").alias("tag_b")
    )
    looked = star.distinct().join(a, ["a", "tag_a"]).join(b, ["b", "tag_b"])
    near = likely(F.col("n_a"), F.col("sketch_a"), F.col("n_b"), F.col("sketch_b"))
    tried = stored(looked.filter(near).select("a", "tag_a", "b", "tag_b"), "pairs")
    candidates = buckets.select(F.col("node").alias("doc_id"), "tag").distinct()
    texts = docs.select("doc_id", "text", _tag()).join(candidates, ["doc_id", "tag"], "left_semi")
    texts = stored(texts.select(F.col("doc_id").alias("node"), "tag", "text").distinct(), "texts")
    links = stored(confirmed(tried, texts), "links")
    again = _same_document(signed, classes)
    found = components(union_all(links, again))

    more = stored(unconnected_links(buckets.select("key", "band", "node", "tag"), classes, texts, found), "links")
    if not more.isEmpty():
        found = components(union_all(links, more, again))
    of = classes.select("k1", "k2", F.col("node").alias("first_id"))
    rows = signed.select("doc_id", "n_shingles", "k1", "k2")
    return rows.join(of, ["k1", "k2"], "left").select("doc_id", "n_shingles", "first_id"), found


def _same_document(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between classes that rows of one doc_id belong to."""
    of = classes.select("k1", "k2", F.col("node").alias("first_id"))
    rows = signed.filter("doc_id is not null and n_shingles > 0").select("doc_id", "k1", "k2").join(of, ["k1", "k2"])
    spread = rows.groupBy("doc_id").agg(F.min("first_id").alias("a"), F.max("first_id").alias("b")).filter("a < b")
    each = rows.join(spread.select("doc_id", "a"), "doc_id")
    return each.filter("first_id > a").select("a", F.col("first_id").alias("b"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and class_id (smallest id of the same set) of every row."""
    rows, found = near_classes(docs)
    rooted = rows.join(found.select(F.col("node").alias("first_id"), "root"), "first_id", "left")
    usable = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    component = F.when(usable, F.coalesce("root", "first_id")).otherwise(F.col("doc_id"))
    return rooted.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
        F.when(usable, F.col("first_id")).otherwise(F.col("doc_id")).alias("class_id"),
    )


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The documents without those that a smaller doc_id of their component stands for."""
    gone = near_duplicates(docs).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
