"""Quality rules by compression bands.

A text is packed with zstandard as a whole and in fixed chunks. Text that shrinks far more than
prose repeats itself; text that hardly shrinks is noise or encoded data. What counts as too much
or too little depends on the length, as short texts shrink less. Counted rules on words come
first; a text that fails them is out whatever its ratios.

Base64 cannot pack below 6/8 and is told from prose by its ratio. Hex and random letters have small
alphabets and pack into prose's range; what tells them is that nothing repeats, so they pack no
better than coding each byte by its own frequency would (:func:`floor_bytes`), plus the frame and
its table. From :data:`FLOOR_FROM` bytes on, a text or chunk that packs so badly is out, whatever its
alphabet. Below that prose repeats too little to be told from hex or random letters, which stay.

Every text is judged alone in the task that reads it, so nothing is shuffled. A null text counts
as empty: no words, hence failed. Repeated rows get equal verdicts. All columns of the input pass
through :func:`quality_filter`, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sheaf.llm.common import as_bytes, fields, per_batch

#: (bytes up to, lowest ratio kept, highest ratio kept); ratio is packed size by size.
BANDS = (
    (256, 0.35, 1.20),
    (320, 0.30, 0.86),
    (384, 0.30, 0.83),
    (512, 0.30, 0.79),
    (768, 0.30, 0.755),
    (1024, 0.30, 0.72),
    (1536, 0.25, 0.70),
    (2048, 0.25, 0.68),
    (4096, 0.25, 0.66),
    (16384, 0.20, 0.65),
    (None, 0.15, 0.65),
)
CHUNK_BYTES = 4096
#: Lowest and highest ratio of a whole chunk; a shorter last chunk is held to its length's band.
CHUNK_BAND = (0.12, 0.65)
#: Bytes from which packed size is held against the floor, and bytes above it that are still noise.
#: Noise needs 38 or more for its table; prose of 2 KB measured 30 at most, and less as it grows.
FLOOR_FROM, FRAME_BYTES = 2048, 35
_COUNTED = 1 << 20
#: A text goes if chunks outside their band hold at least this share of its bytes.
BAD_SHARE = 0.5
LEVEL = 3
MIN_WORDS = 50
SYMBOLS = b"#*$%&|<>"
_BLANKS = b" \t\n\x0b\x0c\r"

SCHEMA = fields(
    ("n_words", T.LongType()),
    ("word_chars", T.LongType()),
    ("n_symbols", T.LongType()),
    ("n_dup_lines", T.LongType()),
    ("n_repeat_words", T.LongType()),
    ("base_failed", T.BooleanType()),
    ("ratio", T.DoubleType()),
    ("bad_share", T.DoubleType()),
    ("kept", T.BooleanType()),
)


def packer() -> Callable[[bytes], bytes]:
    return zstandard.ZstdCompressor(level=LEVEL).compress


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found twice or more in the same text."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    pairs = ids[:-1] * len(seen) + ids[1:]
    if len(seen) < 1 << 20:
        windows = pairs[:-1] * len(seen) + ids[2:]
    else:  # the product of three would not fit
        windows = np.unique(pairs, return_inverse=True)[1][:-1] * len(seen) + ids[2:]
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    again = np.zeros(n - 2, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    hit = np.zeros(n, bool)
    hit[:-2] |= again
    hit[1:-1] |= again
    hit[2:] |= again
    return int(hit.sum())


def dup_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip(_BLANKS)]
    return len(lines) - len(set(lines))


def floor_bytes(text: bytes) -> float:
    """Size of a text if each byte were coded by its frequency alone."""
    codes = np.frombuffer(text, np.uint8)
    counts = np.zeros(256, np.int64)
    for at in range(0, len(codes), _COUNTED):
        counts += np.bincount(codes[at : at + _COUNTED], minlength=256)
    counts = counts[counts > 0]
    return float((counts * np.log2(len(text) / counts)).sum()) / 8


def within(text: bytes, packed: int, low: float, high: float) -> bool:
    """Whether a ratio lies in a band and, from :data:`FLOOR_FROM` bytes on, packing found repeats."""
    n = len(text)
    return low <= packed / n <= high and (n < FLOOR_FROM or packed < floor_bytes(text) + FRAME_BYTES)


def within_band(text: bytes, packed: int) -> bool:
    """:func:`within` for the band of the text's length; no bytes are within any."""
    _, low, high = BANDS[bisect_right([b[0] for b in BANDS[:-1]], len(text))]
    return not text or within(text, packed, low, high)


def bands(text: bytes, pack: Callable[[bytes], bytes]) -> tuple[float, float, bool]:
    """Ratio of the whole, share of bytes in chunks outside their band, and the verdict."""
    n = len(text)
    if not n:
        return 1.0, 0.0, True
    whole = len(pack(text))
    bad = 0
    for at in range(0, n, CHUNK_BYTES) if n > CHUNK_BYTES else ():
        piece = text[at : at + CHUNK_BYTES]
        packed = len(pack(piece))
        fine = within(piece, packed, *CHUNK_BAND) if len(piece) == CHUNK_BYTES else within_band(piece, packed)
        bad += 0 if fine else len(piece)
    return whole / n, bad / n, within_band(text, whole) and bad < BAD_SHARE * n


def judge(text: bytes, pack: Callable[[bytes], bytes]) -> tuple:
    """One text's row of :data:`SCHEMA`."""
    words = text.split()
    n = len(words)
    n_bytes = sum(map(len, words))
    # code points in words: all bytes of words but UTF-8 continuation bytes
    codes = np.frombuffer(text, np.uint8)
    word_chars = n_bytes - int(np.count_nonzero((codes & 0xC0) == 0x80))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    repeated = repeat_words(words)
    failed = n < MIN_WORDS or 100 * repeated > 50 * n
    ratio, share, fine = bands(text, pack)
    return n, word_chars, symbols, dup_lines(text), repeated, failed, ratio, share, fine and not failed


def quality_rules(docs: DataFrame) -> DataFrame:
    """Counts, ratios and verdict of every document: doc_id and the columns of :data:`SCHEMA`."""
    schema = T.StructType([docs.schema["doc_id"], *SCHEMA.fields])

    def run(batch: pa.RecordBatch) -> dict:
        pack = packer()
        rows = list(zip(*[judge(t, pack) for t in as_bytes(batch.column(1))], strict=True))
        return {"doc_id": batch.column(0)} | dict(zip(SCHEMA.names, rows, strict=True))

    return per_batch(docs.select("doc_id", "text"), run, schema)


def quality_filter(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    place = docs.columns.index("text")
    arrow = to_arrow_schema(docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = packer()
        for batch in batches:
            keep = pa.array([judge(x, pack)[-1] for x in as_bytes(batch.column(place))], pa.bool_())
            yield pa.RecordBatch.from_arrays(batch.filter(keep).columns, schema=arrow)

    return docs.mapInArrow(run, docs.schema)


def summary(judged: DataFrame) -> DataFrame:
    """Documents and kept documents by failed rule, as a report."""
    why = F.when(F.col("base_failed"), "words").when(~F.col("kept"), "ratio").otherwise("kept")
    return judged.groupBy(why.alias("verdict")).agg(F.count("*").alias("documents"))
