"""Packing by power-of-two decomposition.

A document's tokens (its ids, then id 0) are cut into pieces whose lengths are the powers of two of
its length in binary, longest first, after as many whole sequences as fit. Each piece is a sequence
of its own, and sequences of equal length share a bucket. So no sequence crosses documents, every
token lies in exactly one piece and there is no padding at all.

Documents are cut where they are read; :func:`bucketed` then shuffles the pieces by length. A sequence id is the bucket, the partition and a running number
in it, so it is unique and the same when a lost partition is computed again from the same files.

Token ids are those of the byte-level vocabulary file read by ``tokenizers``. The ids come from
``tiktoken`` over the same vocabulary and pattern, which gives the same ids at five times the speed
(a test compares both). Texts that hold a special token's string go to ``tokenizers`` itself. Long texts
are encoded in slices cut before a blank between two letters, where the pattern always parts words.
A null text is empty and has one token, id 0. Repeated rows are packed each on their own.
"""

from __future__ import annotations

import base64
import zlib
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sheaf.llm.common import as_batch, fields, ragged

MAX_TOKENS = 1024
END_ID = 0
#: Characters after which a long text is cut for encoding, at the next safe place.
SLICE_CHARS = 1 << 18
#: Documents encoded before their pieces are handed on.
DOCS_AT_ONCE = 256

PIECES = fields(
    ("start", T.LongType()),
    ("length", T.LongType()),
    ("ids_crc32", T.LongType()),
    ("doc_tokens", T.LongType()),
    ("bucket", T.IntegerType()),
    ("ids", T.ArrayType(T.IntegerType())),
)
_SAFE_CUT = regex.compile(r"(?<=\p{L})(?= \p{L})")


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Token ids of texts: the tokenizer of the vocabulary file, and the same vocabulary as ranks."""

    def __init__(self, bpe_json: str, bpe_ranks: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(bpe_ranks, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.exact = Tokenizer.from_file(bpe_json)
        self.fast = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = [t.content for t in self.exact.get_added_tokens_decoder().values()]

    def __call__(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            return self.exact.encode(text, add_special_tokens=False).ids
        if len(text) <= SLICE_CHARS:
            return self.fast.encode_ordinary(text)
        return [i for part in slices(text) for i in self.fast.encode_ordinary(part)]


def slices(text: str, size: int = SLICE_CHARS):
    """The text in slices that are encoded alike alone and together."""
    at = 0
    while len(text) - at > size:
        cut = _SAFE_CUT.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def piece_lengths(n: int, longest: int = MAX_TOKENS) -> list[int]:
    """Lengths of a document's pieces: whole sequences, then the rest in binary."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def pack(docs: DataFrame, bpe_json: str | None = None, bpe_ranks: str | None = None, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, bucket (log2 of the length),
    sequence_id, offset (always 0) and, if wanted, its token ids."""
    bpe_json = bpe_json or vocabulary_path("byte_bpe_50k.json")
    bpe_ranks = bpe_ranks or vocabulary_path("byte_bpe_50k.tiktoken")
    columns = [f for f in PIECES.fields if with_ids or f.name != "ids"]
    schema = T.StructType([docs.schema["doc_id"], *columns])
    arrow = to_arrow_schema(schema)

    def cut(encode: Encoder, doc_ids: list, texts: list[str | None]) -> pa.RecordBatch:
        coded = [np.array([*encode(t or ""), END_ID], "<u4") for t in texts]
        lengths = [piece_lengths(len(c)) for c in coded]
        counts = np.array([len(x) for x in lengths])
        length = np.concatenate(lengths)
        row, _ = ragged(counts)
        tokens = np.array([len(c) for c in coded])
        starts = np.cumsum(length) - length - (np.cumsum(tokens) - tokens)[row]
        ids = np.concatenate(coded)
        ends = np.cumsum(length)
        view = memoryview(ids).cast("B")
        crcs = [zlib.crc32(view[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), length.tolist(), strict=True)]
        out = {
            "doc_id": [doc_ids[r] for r in row],
            "start": starts,
            "length": length,
            "ids_crc32": crcs,
            "doc_tokens": tokens[row],
            "bucket": np.log2(length).astype(np.int32),
        }
        if with_ids:
            out["ids"] = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(ids.astype(np.int32)))
        return as_batch(out, arrow)

    def run(batches):
        encode = Encoder(bpe_json, bpe_ranks)
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1), strict=True)
            while some := [(i, t.as_py()) for i, t in islice(rows, DOCS_AT_ONCE)]:
                yield cut(encode, *map(list, zip(*some, strict=True)))

    pieces = docs.select("doc_id", "text").mapInArrow(run, schema)
    number = F.shiftleft(F.col("bucket").cast("bigint"), 58) + F.monotonically_increasing_id()
    return pieces.withColumn("sequence_id", number).withColumn("offset", F.lit(0).cast("bigint"))


def bucketed(pieces: DataFrame) -> DataFrame:
    """Pieces dealt by length, equal lengths next to each other. The pieces of one length are spread by the
    input partition they come from, so that the most frequent length does not meet in one task however
    many there are."""
    origin = F.shiftright(F.col("sequence_id").bitwiseAND(F.lit((1 << 58) - 1)), 33)
    return pieces.repartition("bucket", origin).sortWithinPartitions("bucket", "sequence_id")
