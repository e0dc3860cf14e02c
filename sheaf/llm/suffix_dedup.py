"""Repeated passages across documents, found with suffix arrays.

Texts are UTF-8 bytes. A byte goes if some string of :data:`LENGTH` bytes covers it that also starts in a
document of smaller doc_id; strings are judged on the input and never reach over a document's end.

1. Winnowing. Of the :data:`GRAM`-byte grams in each window of LENGTH bytes the one of smallest hash is an
   anchor, so equal windows have equal anchors at equal places. Each task packs its anchors by hash
   bucket: the gram's hash, a hash of the anchor's surroundings (all windows that can hold it), place
   and document. An anchor whose gram no other document has needs no further look.
2. Collapsing. Anchors with equal surroundings differ in nothing that matters; all but those of the
   smallest doc_id are covered whole. A gram's anchors meet in one bucket for that, unless the gram is
   frequent: frequent grams are collapsed within each batch first, and what is left is dealt out by
   gram and surroundings, so that a line that a third of all documents hold is spread over as many
   tasks as its anchors need. What is left are first occurrences of grams that stand in
   unlike surroundings: where shared passages begin, end or were edited.
3. Suffix arrays. The surroundings of those anchors are dealt to shards by gram. Each shard sorts its
   suffixes by Larsson-Sadakane refinement and takes common prefixes by Kasai's observation; runs
   with LENGTH or more in common are equal windows, of which all but the smallest doc_id's go.
4. Merging. A gram with more surroundings than a shard may hold is spread over several shards. Each
   gives its sorted distinct windows with their smallest doc_id; these are merged by binary search,
   in as many cuts as the gram's surroundings ask for, and a window whose doc_id is beaten elsewhere goes too.
5. Each chunk of documents joins its covered places and cuts them out.

Which grams are frequent is estimated from one of :data:`SAMPLE_SHARE` documents, and only decides where
anchors meet, never what is removed. There are at most :data:`HOT_GRAMS` of them, which bounds what is sent to tasks.
Anchors are compared by 32 bits of gram hash beyond the bucket's and 48 bits of surroundings; those of
frequent grams by the gram itself and 64 bits.
Texts are shuffled once, by chunk of documents; both passes over them share that exchange.

Null and short texts keep all bytes. Rows that repeat a doc_id never remove each other's bytes. A
null doc_id has no order: such rows neither lose bytes nor make others lose any. Extra columns pass
through :func:`cut_repeats`.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sheaf.llm.common import as_batch, as_bytes, fields, fold_values, parts_for, ragged, stored
from sheaf.llm.suffix_array import common_prefixes, laid_out_bytes, suffix_array
from sheaf.session import union_all

LENGTH = 50
GRAM = 20
#: Grams in a window, and bytes that an anchor's windows reach to its left and right.
GRAMS = LENGTH - GRAM + 1
LEFT, RIGHT = GRAMS - 1, GRAM + GRAMS - 1
#: Bytes scanned at once, and what a slice of a long text sees of its neighbours.
SCAN, MARGIN = 1 << 18, 128
#: Anchors a bucket and surroundings a shard are meant to hold.
BUCKET_ANCHORS, SHARD_ANCHORS = 600_000, 12_000
#: One of so many documents, but SAMPLE_DOCS at least, is searched for frequent grams. Frequent is a gram
#: with HOT_ANCHORS anchors or more, and more than one of HOT_GRAMS of all anchors.
SAMPLE_SHARE, SAMPLE_DOCS = 1024, 8192
HOT_ANCHORS, HOT_GRAMS = 150_000, 1_000_000
#: Bits of a part's number; above them is the logarithm of the number of cuts.
PART_BITS, BUCKET_PARTS = 26, 1 << 12
#: Documents whose anchors are packed together, and bytes of text in a chunk.
DOCS_AT_ONCE, CHUNK_BYTES = 2048, 8 << 20

_BASE = 0x9E3779B97F4A7C15
_VALUES = np.random.default_rng(3).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

PACKED = fields(
    ("bucket", T.LongType()),
    ("docs", T.BinaryType()),
    ("tags", T.BinaryType()),
    ("chunks", T.BinaryType()),
    ("counts", T.BinaryType()),
    ("grams", T.BinaryType()),
    ("around", T.BinaryType()),
    ("places", T.BinaryType()),
)
#: Answers for a chunk: kind 0 are ranges to remove, kind 1 are anchors for a shard.
ANSWER = fields(
    ("chunk", T.IntegerType()),
    ("kind", T.IntegerType()),
    ("docs", T.BinaryType()),
    ("tags", T.BinaryType()),
    ("begin", T.BinaryType()),
    ("end", T.BinaryType()),
    ("shard", T.LongType()),
    ("part", T.IntegerType()),
)
SURROUNDINGS = fields(
    ("shard", T.LongType()),
    ("part", T.IntegerType()),
    ("chunk", T.IntegerType()),
    ("docs", T.BinaryType()),
    ("tags", T.BinaryType()),
    ("begin", T.BinaryType()),
    ("sizes", T.BinaryType()),
    ("text", T.BinaryType()),
)
#: Sorted distinct windows of one part of a shard, on their way to be merged.
RUN = fields(
    ("shard", T.LongType()),
    ("part", T.IntegerType()),
    ("cut", T.IntegerType()),
    ("windows", T.BinaryType()),
    ("docs", T.BinaryType()),
    ("tags", T.BinaryType()),
    ("chunks", T.BinaryType()),
    ("begin", T.BinaryType()),
)


def planes(values: np.ndarray, kind: str) -> bytes:
    """Numbers as bytes, equal byte places together, which packs better in a shuffle."""
    raw = np.ascontiguousarray(values, kind)
    return raw.view(np.uint8).reshape(len(raw), raw.itemsize).T.tobytes()


def unplanes(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


def plane_rows(values: np.ndarray, kind: str, cuts: np.ndarray) -> pa.Array:
    """A binary column of rows that begin at ``cuts``, each as :func:`planes` would give it. All rows are made at
    once: their number grows with batches times buckets, and chunks times shards."""
    raw = np.ascontiguousarray(values, kind)
    width = raw.itemsize
    sizes = np.diff(np.append(cuts, len(raw)))
    step = np.repeat(sizes, sizes)
    at = np.arange(len(raw)) + np.repeat(cuts * (width - 1), sizes)
    out = np.empty(len(raw) * width, np.uint8)
    for k, plane in enumerate(raw.view(np.uint8).reshape(len(raw), width).T):
        out[at + k * step] = plane
    return binary_rows(out, sizes * width)


def binary_rows(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary column of rows of the given sizes, laid end to end."""
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def joined_rows(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, laid end to end, and the size of each row."""
    parts, sizes = [np.empty(0, np.uint8)], [np.empty(0, np.int64)]
    for part in column.chunks:
        if len(part):
            _, offsets, data = part.buffers()
            stops = np.frombuffer(offsets, np.int32)[part.offset : part.offset + len(part) + 1].astype(np.int64)
            sizes.append(np.diff(stops))
            if stops[-1] > stops[0]:
                parts.append(np.frombuffer(data, np.uint8)[stops[0] : stops[-1]])
    return np.concatenate(parts), np.concatenate(sizes)


def row_values(column: pa.ChunkedArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows of a column of :func:`planes`, and how many each row has."""
    data, sizes = joined_rows(column)
    width = np.dtype(kind).itemsize
    sizes = sizes // width
    step = np.repeat(sizes, sizes)
    at = np.arange(len(step)) + np.repeat((np.cumsum(sizes) - sizes) * (width - 1), sizes)
    out = np.empty((len(step), width), np.uint8)
    for k in range(width):
        out[:, k] = data[at + k * step]
    return out.view(kind).ravel(), sizes


def powers(n: int = SCAN + 4 * MARGIN + 1) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 2**64)):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    out, have = values, 1
    while have * 2 <= width:
        out, have = best(out[:-have], out[have:]), have * 2
    rest = width - have
    return best(out[:-rest], out[rest:]) if rest else out


def anchors(data: np.ndarray, ends: np.ndarray, up: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of anchors in texts laid end to end, gram hashes and hashes of their surroundings.
    ``ends``: where each text ends; ``up`` and ``down``: as of :func:`powers`."""
    n = len(data)
    none = np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    if n < LENGTH:
        return none
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUES[data] * up[:n], out=total[1:])
    gram = fold_values((total[GRAM:] - total[:-GRAM]) * down[: n - GRAM + 1])
    sizes = np.diff(ends, prepend=0)
    end = np.repeat(ends, sizes)
    least = _sliding(gram, GRAMS, np.minimum)
    least[np.arange(len(least)) + LENGTH > end[: len(least)]] = 0
    gap = np.zeros(GRAMS - 1, np.uint64)
    chosen = _sliding(np.concatenate([gap, least, gap]), GRAMS, np.maximum)
    place = np.flatnonzero((chosen == gram) & (gram != 0))
    start = np.repeat(ends - sizes, sizes)
    lo = np.maximum(place - LEFT, start[place])
    hi = np.minimum(place + RIGHT, end[place])
    shape = ((place - lo) * 256 + (hi - place)).astype(np.uint64)
    around = fold_values(fold_values((total[hi] - total[lo]) * down[lo]) + shape)
    return place, gram[place], around


def anchors_of(texts: list[bytes], up: np.ndarray, down: np.ndarray):
    """(text numbers, places, gram hashes, surroundings) of many texts, in blocks of bounded size."""
    block, held = [], 0

    def scan(some: list[tuple[int, int, bytes, int, int]]):
        """some: (text number, offset, slice, first and last place that count)."""
        data = np.frombuffer(b"".join(s for _, _, s, _, _ in some), np.uint8)
        ends = np.cumsum([len(s) for _, _, s, _, _ in some])
        place, gram, around = anchors(data, ends, up, down)
        which = np.searchsorted(ends, place, side="right")
        begin = ends - np.array([len(s) for _, _, s, _, _ in some])
        number, offset, lo, hi = (np.array([x[k] for x in some]) for k in (0, 1, 3, 4))
        at = place - begin[which] + offset[which]
        own = (at >= lo[which]) & (at < hi[which])
        return number[which][own], at[own], gram[own], around[own]

    for i, text in enumerate(texts):
        if len(text) < LENGTH:
            continue
        if len(text) > SCAN:
            for at in range(0, len(text), SCAN):
                lo = max(at - MARGIN, 0)
                yield scan([(i, lo, text[lo : at + SCAN + MARGIN], at, at + SCAN)])
            continue
        if held + len(text) > SCAN:
            yield scan(block)
            block, held = [], 0
        block.append((i, 0, text, 0, len(text)))
        held += len(text)
    if block:
        yield scan(block)


class Frequent(NamedTuple):
    """Frequent grams in order, the logarithm of the cuts of each, and the buckets they are dealt to."""

    grams: np.ndarray
    cuts: np.ndarray
    spread: int

    def of(self, gram: np.ndarray) -> np.ndarray:
        """The number of each gram, -1 if it is not frequent."""
        at = np.searchsorted(self.grams, gram)
        at[at == len(self.grams)] = 0
        return np.where(self.grams[at] == gram, at, -1) if len(self.grams) else np.full(len(gram), -1)


def _cuts(surroundings: int, shard_anchors: int) -> int:
    return parts_for(surroundings, shard_anchors, 2).bit_length() - 1


def frequent_grams(docs: DataFrame, rows: int, anchors_in_all: int, shard_anchors: int) -> Frequent:
    """Grams of which a sample of ``docs`` (doc_id, text, _tag, _chunk) promises very many anchors."""
    share = min(1.0, max(1 / SAMPLE_SHARE, SAMPLE_DOCS / max(1, rows)))
    schema = fields(("gram", T.LongType()))
    arrow = to_arrow_schema(schema)

    def run(batches):
        up, down = powers()
        for batch in (b.slice(at, DOCS_AT_ONCE) for b in batches for at in range(0, b.num_rows, DOCS_AT_ONCE)):
            for _, _, gram, _ in anchors_of(as_bytes(batch.column(0)), up, down):
                yield as_batch({"gram": gram.view(np.int64)}, arrow)

    drawn = docs.filter(F.pmod(F.xxhash64(F.lit(11), "_doc", "_tag"), F.lit(1 << 30)) < int(share * (1 << 30)))
    least = max(HOT_ANCHORS, anchors_in_all // HOT_GRAMS) * share
    counts = drawn.select("_text").mapInArrow(run, schema).groupBy("gram").count().filter(F.col("count") >= least)
    found = counts.collect()  # HOT_GRAMS at most, give or take the sample's error
    grams = np.array([r["gram"] for r in found], np.int64).view(np.uint64)
    number = np.array([int(r["count"] / share) for r in found], np.int64)
    order = np.argsort(grams)
    cuts = np.array([_cuts(int(n), shard_anchors) for n in number[order]], np.int64)
    spread = min(parts_for(int(number.sum()), BUCKET_ANCHORS), (1 << PART_BITS) // BUCKET_PARTS // 2)
    return Frequent(grams[order], cuts, spread)


def packed_anchors(docs: DataFrame, buckets: int, frequent: Frequent) -> DataFrame:
    """Anchors of ``docs`` (doc_id, text, _tag, _chunk), a row per input batch and bucket.

    Buckets from ``buckets`` on are those of frequent grams, whose rows hold the gram's number for its
    hash. Negative ones hold anchors that are covered by another one of their batch."""
    arrow = to_arrow_schema(PACKED)
    shift = np.uint64(64 - max(buckets.bit_length() - 1, 1))
    shipped = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        hot = shipped.value
        up, down = powers()
        for batch in (b.slice(at, DOCS_AT_ONCE) for b in batches for at in range(0, b.num_rows, DOCS_AT_ONCE)):
            found = list(anchors_of(as_bytes(batch.column(1)), up, down))
            if not found:
                continue
            number, place, gram, around = (np.concatenate(x) for x in zip(*found, strict=True))
            doc, tag, chunk = (batch.column(k).to_numpy() for k in (0, 2, 3))
            # anchors are smallest hashes, so their own leading bits are mostly zero: mixed once more
            bucket = (fold_values(gram) >> shift).astype(np.int64) if buckets > 1 else np.zeros(len(gram), np.int64)
            which = hot.of(gram)
            if (own := np.flatnonzero(which >= 0)).size:
                own = own[np.lexsort((doc[number[own]], around[own], which[own]))]
                new = (np.diff(which[own], prepend=-1) != 0) | (np.diff(around[own], prepend=np.uint64(0)) != 0)
                new[0] = True
                first = doc[number[own]][np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))]
                dealt = fold_values(around ^ gram)[own] % np.uint64(hot.spread)
                covered = doc[number[own]] > first
                bucket[own] = np.where(covered, -1 - dealt.astype(np.int64), buckets + dealt.astype(np.int64))
            order = np.argsort(bucket, kind="stable")
            new = np.diff(bucket[order], prepend=bucket[order[0]] - 1) != 0
            texts = number[order]
            cuts, first = np.flatnonzero(new), np.flatnonzero(new | (np.diff(texts, prepend=-1) != 0))
            b, sizes = bucket[order[cuts]], np.diff([*cuts, len(order)])
            of_first = np.searchsorted(first, cuts)
            # buckets below 0 hold neither grams nor surroundings; all others come behind them
            own = order[int(sizes[b < 0].sum()) :]
            dealt = order[int(sizes[b < buckets].sum()) :]
            shown = gram[own].astype("<u4")  # the hash's lower bits
            shown[len(own) - len(dealt) :] = which[dealt]
            near = around[own].astype("<u8").view(np.uint8).reshape(-1, 8)
            near = np.concatenate([near[: len(own) - len(dealt), :6].ravel(), near[len(own) - len(dealt) :].ravel()])
            yield as_batch(
                {
                    "bucket": b,
                    "docs": plane_rows(doc[texts[first]], "<i8", of_first),
                    "tags": plane_rows(tag[texts[first]], "<i4", of_first),
                    "chunks": plane_rows(chunk[texts[first]], "<i4", of_first),
                    "counts": plane_rows(np.diff([*first, len(order)]), "<u4", of_first),
                    "grams": binary_rows(shown.view(np.uint8), sizes * np.where(b < 0, 0, 4)),
                    "around": binary_rows(near, sizes * np.where(b < 0, 0, np.where(b < buckets, 6, 8))),
                    "places": plane_rows(place[order], "<u4", cuts),
                },
                arrow,
            )

    return docs.mapInArrow(run, PACKED)


def _wide(data: np.ndarray, width: int) -> np.ndarray:
    """Numbers of ``width`` bytes, the lowest first."""
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = data.reshape(-1, width)
    return out.view("<u8").ravel()


def _by(*keys: np.ndarray) -> np.ndarray:
    """What sorts by the keys, the last one first; equal ones stay as they stand. Keys of one value are left out, and
    a single one of at most 32 bits is sorted with the places in the same word."""
    keys = tuple(k for k in keys if len(k) and k.min() != k.max())
    n = len(keys[0]) if keys else 0
    if len(keys) != 1 or not 0 <= int(keys[0].min()) <= int(keys[0].max()) < 1 << 32 or n >= 1 << 31:
        return np.lexsort(keys) if keys else None
    packed = keys[0].astype(np.int64) << 31 | np.arange(n)
    packed.sort()
    return packed & ((1 << 31) - 1)


def _answers(kind: int, chunk, doc, tag, begin, end, shard=None, part=None) -> dict:
    """Rows of ANSWER, one for each chunk, shard and part, whose anchors stand as they are given."""
    shard = np.zeros(len(doc), np.int64) if shard is None else shard
    part = np.zeros(len(doc), np.int32) if part is None else part
    if (order := _by(part, shard, chunk)) is not None:
        chunk, doc, tag, begin, end, shard, part = (x[order] for x in (chunk, doc, tag, begin, end, shard, part))
    new = np.ones(len(doc), bool)
    new[1:] = (np.diff(chunk) != 0) | (np.diff(shard) != 0) | (np.diff(part) != 0)
    lo = np.flatnonzero(new)
    return {
        "chunk": chunk[lo],
        "kind": np.full(len(lo), kind),
        "docs": plane_rows(doc, "<i8", lo),
        "tags": plane_rows(tag, "<i4", lo),
        "begin": plane_rows(begin, "<u4", lo),
        "end": plane_rows(end, "<u4", lo),
        "shard": shard[lo],
        "part": part[lo],
    }


def shared_anchors(packed: DataFrame, buckets: int, frequent: Frequent, shard_anchors: int = SHARD_ANCHORS) -> DataFrame:
    """For each bucket: anchors that are covered whole (kind 0) and those for the shards (kind 1)."""
    arrow = to_arrow_schema(ANSWER)
    shipped = packed.sparkSession.sparkContext.broadcast(frequent)

    def run(group: pa.Table) -> pa.Table:
        bucket = group["bucket"][0].as_py()
        hot = bucket >= buckets
        count = row_values(group["counts"], "<u4")[0]
        doc, tag, chunk = (np.repeat(row_values(group[c], k)[0], count) for c, k in (("docs", "<i8"), ("tags", "<i4"), ("chunks", "<i4")))
        place = row_values(group["places"], "<u4")[0].astype(np.int64)
        if bucket < 0:  # known to be covered
            return pa.Table.from_batches([as_batch(_answers(0, chunk, doc, tag, place, place), arrow)], arrow)
        gram = joined_rows(group["grams"])[0].view("<u4").astype(np.int64)
        around = _wide(joined_rows(group["around"])[0], 8 if hot else 6)
        order = np.arange(len(gram)) if (by := _by(gram)) is None else by
        if not hot:  # only grams of two documents or more
            starts = np.flatnonzero(np.diff(gram[order], prepend=-1))
            sizes = np.diff([*starts, len(order)])
            ranked = doc[order]
            several = np.minimum.reduceat(ranked, starts) < np.maximum.reduceat(ranked, starts)
            order = order[np.repeat(several, sizes)]
        if not len(order):
            return arrow.empty_table()
        order = order[np.lexsort((doc[order], around[order], gram[order]))]
        g, a, d = gram[order], around[order], doc[order]
        new_gram = np.diff(g, prepend=-1) != 0
        new = new_gram.copy()
        new[1:] |= a[1:] != a[:-1]
        first = d[np.maximum.accumulate(np.where(new, np.arange(len(d)), 0))]
        covered = d > first
        group_of = np.cumsum(new_gram) - 1
        unlike = np.bincount(group_of, weights=new)[group_of] > 1
        out = []

        def deal(shard: np.ndarray, part: np.ndarray) -> None:
            own = order[edge]
            out.append(as_batch(_answers(1, chunk[own], doc[own], tag[own], place[own], place[own], shard, part), arrow))

        if covered.any():
            own = np.sort(order[covered])  # as they came: a document's places together
            out.append(as_batch(_answers(0, chunk[own], doc[own], tag[own], place[own], place[own]), arrow))
        edge = ~covered & (unlike | hot)  # other buckets hold more surroundings of a frequent gram
        if edge.any():
            own_group = group_of[edge]
            at = np.flatnonzero(np.diff(own_group, prepend=-1))
            size = np.diff([*at, len(own_group)])
            inside = np.arange(len(own_group)) - np.repeat(at, size)
            if hot:
                which = g[edge][at].astype(np.int64)
                number = 1 + (bucket - buckets) * BUCKET_PARTS + inside // max(shard_anchors, -(-int(size.max()) // (BUCKET_PARTS - 1)))
                deal(np.repeat(-1 - which, size), (np.repeat(shipped.value.cuts[which], size) << PART_BITS | number).astype(np.int32))
            else:
                large = size > shard_anchors
                # small groups share shards in turn, a large one has a shard of its own in several parts
                fill = np.cumsum(np.where(large, 0, size)) // shard_anchors
                shard = np.where(large, (1 << 30) + np.arange(len(size)), fill)
                cuts = np.zeros(len(size), np.int64)
                cuts[large] = [_cuts(int(n), shard_anchors) for n in size[large]]
                part = np.where(np.repeat(large, size), np.repeat(cuts, size) << PART_BITS | 1 + inside // shard_anchors, 0)
                deal((bucket << 32) + np.repeat(shard, size), part.astype(np.int32))
        return pa.Table.from_batches(out, arrow)

    return packed.groupBy("bucket").applyInArrow(run, ANSWER)


class Chunk:
    """The texts of a chunk, and where a (doc_id, tag) stands in it."""

    def __init__(self, docs: pa.Table):
        self.texts = as_bytes(docs["_text"].combine_chunks())
        size = np.array([len(t) for t in self.texts], np.int64)
        self.begin = np.cumsum(size) - size
        self.size = size
        doc = docs["_doc"].combine_chunks()
        self.known = doc.is_valid().to_numpy(zero_copy_only=False)
        doc = doc.fill_null(0).to_numpy()
        self.docs = np.unique(doc)
        keys = self._keys(doc, docs["_tag"].to_numpy())
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    def _keys(self, doc: np.ndarray, tag: np.ndarray) -> np.ndarray:
        """(doc_id, tag) as one number; tags have 31 bits."""
        return np.searchsorted(self.docs, doc) << 31 | tag.astype(np.int64)

    def rows(self, doc: np.ndarray, tag: np.ndarray) -> np.ndarray:
        """The row of each (doc_id, tag); of equal rows the first."""
        return self.order[np.searchsorted(self.keys, self._keys(doc, tag))]

    def same_as(self) -> np.ndarray:
        """For each row the first row of equal (doc_id, tag)."""
        new = np.ones(len(self.order), bool)
        new[1:] = self.keys[1:] != self.keys[:-1]
        out = np.empty(len(self.order), np.int64)
        out[self.order] = self.order[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        return out


def _unpacked(rows: pa.Table) -> tuple[np.ndarray, ...]:
    """docs, tags, begin and end of all answers, one after the other."""
    kinds = (("docs", "<i8"), ("tags", "<i4"), ("begin", "<u4"), ("end", "<u4"))
    return tuple(row_values(rows[c], k)[0].astype(np.int64) for c, k in kinds)


def surroundings(docs: DataFrame, answers: DataFrame) -> DataFrame:
    """The text around the anchors that go to shards, a row per chunk, shard and part."""
    arrow = to_arrow_schema(SURROUNDINGS)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return arrow.empty_table()
        chunk = Chunk(left)
        doc, tag, place, _ = _unpacked(right)
        count = joined_rows(right["docs"])[1] // 8
        cuts = np.cumsum(count) - count
        at = chunk.rows(doc, tag)
        lo = np.maximum(place - LEFT, 0)
        size = np.minimum(place + RIGHT, chunk.size[at]) - lo
        texts = np.frombuffer(b"".join(chunk.texts), np.uint8)
        piece, inside = ragged(size)
        pieces = texts[(chunk.begin[at] + lo)[piece] + inside]
        passed = {c: right[c].combine_chunks() for c in ("shard", "part", "chunk", "docs", "tags")}
        out = passed | {
            "begin": plane_rows(lo, "<u4", cuts),
            "sizes": binary_rows(size.astype(np.uint8), count),
            "text": binary_rows(pieces, np.add.reduceat(size, cuts)),
        }
        return pa.Table.from_batches([pa.RecordBatch.from_arrays([out[f.name] for f in arrow], schema=arrow)], arrow)

    edges = answers.filter("kind = 1")
    return docs.groupBy("_chunk").cogroup(edges.groupBy("chunk")).applyInArrow(run, SURROUNDINGS)


class Shard:
    """Surroundings of one shard, their suffix array and their groups of equal windows."""

    def __init__(self, group: pa.Table):
        sizes, counts = joined_rows(group["sizes"])
        sizes = sizes.astype(np.int64)
        self.doc, self.tag, begin = (row_values(group[c], k)[0] for c, k in (("docs", "<i8"), ("tags", "<i4"), ("begin", "<u4")))
        self.begin = begin.astype(np.int64)
        self.chunk = np.repeat(group["chunk"].to_numpy(), counts)
        self.symbols, self.owner, end = laid_out_bytes(joined_rows(group["text"])[0], sizes)
        order = suffix_array(self.symbols, self.owner, end)
        shared = common_prefixes(self.symbols, end, order)
        long = end[order] - order >= LENGTH
        self.order = order[long]
        # a shorter suffix in between ends earlier, so it parts no two equal windows
        new = shared[long] < LENGTH
        self.first_of_string = np.concatenate([[0], np.cumsum(sizes + 1)])
        self.head = np.flatnonzero(new)
        docs = self.doc[self.owner[self.order]]
        least = np.minimum.reduceat(docs, self.head) if len(docs) else docs
        self.least = np.repeat(least, np.diff([*self.head, len(docs)]))
        self.docs = docs

    def places(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Surroundings and place in the document of windows, by their slots."""
        at = self.order[which]
        owner = self.owner[at]
        return owner, self.begin[owner] + at - self.first_of_string[owner]


def _ranges(chunk, doc, tag, place) -> dict:
    """Windows at the given places as answers of merged ranges."""
    order = np.lexsort((place, tag, doc))
    chunk, doc, tag, place = (x[order] for x in (chunk, doc, tag, place))
    new = np.ones(len(place), bool)
    new[1:] = (np.diff(doc) != 0) | (np.diff(tag) != 0) | (np.diff(place) > LENGTH)
    last = np.append(np.flatnonzero(new)[1:] - 1, len(place) - 1)
    return _answers(0, chunk[new], doc[new], tag[new], place[new], place[last] + LENGTH)


def shard_repeats(texts: DataFrame) -> DataFrame:
    """Ranges that a shard alone decides (as ANSWER), and for parts of a hot gram their runs."""
    schema = T.StructType([T.StructField("answer", ANSWER), T.StructField("run", RUN)])
    arrow = to_arrow_schema(schema)

    def run(group: pa.Table) -> pa.Table:
        shard = Shard(group)
        out = []

        def put(name: str, rows: dict) -> None:
            kind = arrow.field(name).type
            held = pa.StructArray.from_arrays([pa.array(rows[f.name], f.type) for f in kind], fields=list(kind))
            both = [held if f.name == name else pa.nulls(len(held), f.type) for f in arrow]
            out.append(pa.RecordBatch.from_arrays(both, schema=arrow))

        beaten = np.flatnonzero(shard.docs > shard.least)
        if len(beaten):
            owner, place = shard.places(beaten)
            put("answer", _ranges(shard.chunk[owner], shard.doc[owner], shard.tag[owner], place))
        part = group["part"][0].as_py()
        rest = np.flatnonzero(shard.docs == shard.least) if part else beaten[:0]
        if len(rest):
            at = shard.order[rest]
            windows = (shard.symbols[at[:, None] + np.arange(LENGTH)] - 1).astype(np.uint8)
            owner, place = shard.places(rest)
            # cut by the windows' own hash, so that equal windows of all parts meet
            cut = _window_cut(windows, 1 << (part >> PART_BITS))
            order = np.argsort(cut, kind="stable")
            lo = np.flatnonzero(np.diff(cut[order], prepend=-1))
            o = owner[order]
            put("run", {
                "shard": np.full(len(lo), group["shard"][0].as_py()), "part": np.full(len(lo), part), "cut": cut[order][lo],
                "windows": binary_rows(windows[order].ravel(), np.diff([*lo, len(order)]) * LENGTH),
                "docs": plane_rows(shard.doc[o], "<i8", lo), "tags": plane_rows(shard.tag[o], "<i4", lo),
                "chunks": plane_rows(shard.chunk[o], "<i4", lo), "begin": plane_rows(place[order], "<u4", lo),
            })
        return pa.Table.from_batches(out, arrow)

    return texts.groupBy("shard", "part").applyInArrow(run, schema)


def _window_cut(windows: np.ndarray, cuts: int) -> np.ndarray:
    mixed = np.zeros(len(windows), np.uint64)
    for i in range(0, LENGTH, 5):
        mixed = fold_values(mixed + _VALUES[windows[:, i]])
    return (mixed % np.uint64(cuts)).astype(np.int64)


def merged_repeats(runs: DataFrame) -> DataFrame:
    """Windows of one part that a smaller doc_id of another part has, as ANSWER."""
    arrow = to_arrow_schema(ANSWER)

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        sorted_runs = []
        for r in rows:
            raw = np.frombuffer(r["windows"], np.uint8).reshape(-1, LENGTH)
            closed = np.ones((len(raw), LENGTH + 1), np.uint8)  # else trailing zero bytes would be lost
            closed[:, :LENGTH] = raw
            sorted_runs.append((closed.view(f"S{LENGTH + 1}").ravel(), unplanes(r["docs"], "<i8")))
        merged, least = sorted_runs[0][0][:0], sorted_runs[0][1][:0]
        for windows, doc in sorted_runs:
            each, at = np.unique(windows, return_index=True)
            own = np.minimum.reduceat(doc, at) if len(at) else doc
            slot = np.searchsorted(merged, each)
            met = np.zeros(len(each), bool)
            inner = slot < len(merged)
            met[inner] = merged[slot[inner]] == each[inner]
            np.minimum.at(least, slot[met], own[met])
            merged = np.insert(merged, slot[~met], each[~met])
            least = np.insert(least, slot[~met], own[~met])
        out = []
        for r, (windows, doc) in zip(rows, sorted_runs, strict=True):
            beaten = doc > least[np.searchsorted(merged, windows)]
            if beaten.any():
                tag, chunk, place = unplanes(r["tags"], "<i4"), unplanes(r["chunks"], "<i4"), unplanes(r["begin"], "<u4").astype(np.int64)
                out.append(as_batch(_ranges(chunk[beaten], doc[beaten], tag[beaten], place[beaten]), arrow))
        return pa.Table.from_batches(out, arrow)

    return runs.groupBy("shard", "cut").applyInArrow(run, ANSWER)


def removed(left: pa.Table, right: pa.Table) -> tuple[Chunk, np.ndarray]:
    """The chunk, and for each byte of its texts laid end to end whether it goes."""
    chunk = Chunk(left)
    total = int(chunk.size.sum())
    change = np.zeros(total + 1, np.int32)
    if right.num_rows:
        doc, tag, begin, end = _unpacked(right)
        at = chunk.rows(doc, tag)
        anchor = begin == end
        lo = np.where(anchor, np.maximum(begin - LEFT, 0), begin)
        hi = np.where(anchor, np.minimum(begin + RIGHT, chunk.size[at]), end)
        np.add.at(change, chunk.begin[at] + lo, 1)
        np.add.at(change, chunk.begin[at] + hi, -1)
    return chunk, np.cumsum(change[:-1], out=change[:-1]) > 0


def _sums(marks: np.ndarray, chunk: Chunk) -> np.ndarray:
    """How many bytes of each text are marked."""
    total = np.zeros(len(marks) + 1, np.int64)
    np.cumsum(marks, out=total[1:])
    return total[chunk.begin + chunk.size] - total[chunk.begin]


def _keyed(docs: DataFrame, chunks: int) -> DataFrame:
    """Rows with their chunk and a tag that tells rows of one doc_id and unlike texts apart."""
    key = F.xxhash64(docs["doc_id"], docs["text"])
    return docs.select(
        docs["doc_id"].cast("bigint").alias("_doc"),
        docs["text"].alias("_text"),
        F.shiftrightunsigned(key, 33).cast("int").alias("_tag"),
        F.pmod(key, F.lit(chunks)).cast("int").alias("_chunk"),
        F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("_row"),
    )


def _located(docs: DataFrame, shard_anchors: int) -> tuple[DataFrame, DataFrame]:
    """Keyed documents and the ranges to remove, by chunk."""
    rows, size = docs.agg(F.count("doc_id"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    chunks = parts_for(size, CHUNK_BYTES)
    in_all = size * 2 // (GRAMS + 1)
    buckets = parts_for(in_all, BUCKET_ANCHORS)
    keyed = _keyed(docs, chunks)
    ordered = keyed.filter("_doc is not null").select("_doc", "_text", "_tag", "_chunk")
    frequent = frequent_grams(ordered, rows, in_all, shard_anchors)
    answers = stored(shared_anchors(packed_anchors(ordered, buckets, frequent), buckets, frequent, shard_anchors), "anchors")
    texts = surroundings(keyed, answers)
    found = shard_repeats(texts)
    found = stored(found, "repeats")
    alone = found.filter("answer is not null").select("answer.*")
    merged = merged_repeats(found.filter("run is not null").select("run.*"))
    return keyed, union_all(answers.filter("kind = 0"), alone, merged)


def repeated_bytes(docs: DataFrame, shard_anchors: int = SHARD_ANCHORS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    keyed, ranges = _located(docs.select("doc_id", "text"), shard_anchors)
    schema = T.StructType(
        [
            docs.schema["doc_id"],
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("n_spans", T.LongType()),
            T.StructField("kept_sha256", T.StringType()),
        ]
    )
    arrow = to_arrow_schema(schema)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return arrow.empty_table()
        chunk, gone = removed(left, right)
        same = chunk.same_as()
        start = np.zeros(len(gone), bool)
        start[1:] = gone[1:] & ~gone[:-1]
        start[chunk.begin[chunk.size > 0]] = gone[chunk.begin[chunk.size > 0]]
        taken, spans = (_sums(x, chunk) for x in (gone, start))
        digest = []
        for i in same.tolist():
            text = chunk.texts[i]
            if taken[i]:
                text = np.frombuffer(text, np.uint8)[~gone[chunk.begin[i] : chunk.begin[i] + len(text)]]
            digest.append(hashlib.sha256(text).hexdigest())
        ids = left["_row"].combine_chunks().field("doc_id")
        out = {"doc_id": ids, "n_bytes": chunk.size, "n_removed": taken[same], "n_spans": spans[same], "kept_sha256": digest}
        return pa.Table.from_batches([as_batch(out, arrow)], arrow)

    return keyed.groupBy("_chunk").cogroup(ranges.groupBy("chunk")).applyInArrow(run, schema)


def cut_repeats(docs: DataFrame, shard_anchors: int = SHARD_ANCHORS) -> DataFrame:
    """The documents without their repeated bytes. A character of which bytes went is left out, and
    a column ``n_chars`` is brought up to date. Documents that lose nothing stay as they are."""
    keyed, ranges = _located(docs, shard_anchors)
    arrow = to_arrow_schema(docs.schema)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return arrow.empty_table()
        chunk, gone = removed(left, right)
        old = left["_text"].to_pylist()
        texts = []
        for row, i in enumerate(chunk.same_as().tolist()):
            own = gone[chunk.begin[i] : chunk.begin[i] + chunk.size[i]]
            if own.any():
                texts.append(np.frombuffer(chunk.texts[i], np.uint8)[~own].tobytes().decode("utf-8", "ignore"))
            else:
                texts.append(old[row])
        rest = left["_row"].combine_chunks()
        out = {n: rest.field(n) for n in rest.type.names} | {"text": pa.array(texts, pa.string())}
        if "n_chars" in out and pa.types.is_integer(arrow.field("n_chars").type):
            counts = [None if new is None else len(new) if new != was else n for new, was, n in zip(texts, old, out["n_chars"].to_pylist(), strict=True)]
            out["n_chars"] = pa.array(counts, arrow.field("n_chars").type)
        return pa.Table.from_batches([as_batch(out, arrow)], arrow)

    return keyed.groupBy("_chunk").cogroup(ranges.groupBy("chunk")).applyInArrow(run, docs.schema)
