"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are embedded and scanned by learned filters of :data:`WIDTH` bytes at every second
byte. Filter responses are max-pooled within chunks of :data:`CHUNK` bytes that overlap by half and
together cover the whole text; the pooled chunks are rectified and combined, by their mean and their
maximum, into one logistic probability. A chunk is two half chunks, so each half is scanned once.

Learning takes labelled rows that are not held out, at most ``per_label`` of each label and none
longer than ``max_bytes``, chosen by a hash of the id; it runs on the driver over that bounded sample.
Scoring streams over whole texts in the tasks that read them: long texts go through in blocks, so
memory does not grow with a text's length. Nothing is shuffled for scoring.

A null text is empty: one chunk of padding, which has a score like any other. Equal texts have equal
scores. Without any label to learn from, every score is 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.llm.common import as_bytes, learning_split, per_batch
from sheaf.session import union_all

CHUNK, WIDTH, STRIDE = 512, 8, 2
HALF = CHUNK // 2
DIM, FILTERS = 8, 24
THRESHOLD = 0.7
#: Half chunks scanned at once.
BLOCK = 64
_SPAN = HALF + WIDTH - STRIDE
_TAPS = WIDTH // STRIDE
_PLACES = HALF // STRIDE


def half_chunks(text: bytes) -> np.ndarray:
    """A text in rows of half a chunk, each with the bytes that its last windows reach into;
    padded with zeros at the end."""
    rows = max(1, -(-len(text) // HALF))
    padded = np.zeros(rows * HALF + _SPAN - HALF, np.uint8)
    padded[: len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.as_strided(padded, (rows, _SPAN), (HALF, 1))


@dataclass
class QualityModel:
    embed: np.ndarray  # 256 x DIM
    filters: np.ndarray  # WIDTH * DIM x FILTERS
    bias: np.ndarray  # FILTERS
    weights: np.ndarray  # 2 * FILTERS: for the mean and for the maximum over chunks
    offset: float

    @classmethod
    def fresh(cls, seed: int = 1) -> QualityModel:
        rng = np.random.default_rng(seed)
        return cls(
            rng.normal(0, 0.5, (256, DIM)).astype(np.float32),
            rng.normal(0, (WIDTH * DIM) ** -0.5, (WIDTH * DIM, FILTERS)).astype(np.float32),
            np.zeros(FILTERS, np.float32),
            rng.normal(0, 0.3, 2 * FILTERS).astype(np.float32),
            0.0,
        )

    def scan(self, rows: np.ndarray, with_place: bool = False):
        """Highest response of each filter in each half chunk, and where it is."""
        n = len(rows)
        steps = self.embed[rows].reshape(n * (_SPAN // STRIDE), STRIDE * DIM)
        taps = self.filters.reshape(_TAPS, STRIDE * DIM, FILTERS).transpose(1, 0, 2).reshape(STRIDE * DIM, _TAPS * FILTERS)
        parts = (steps @ taps).reshape(n, _SPAN // STRIDE, _TAPS, FILTERS)
        out = parts[:, :_PLACES, 0].copy()
        for j in range(1, _TAPS):
            out += parts[:, j : j + _PLACES, j]
        if with_place:
            return out.max(axis=1), out.argmax(axis=1)
        return out.max(axis=1)

    def pooled(self, text: bytes) -> np.ndarray:
        """Rectified chunk responses of one text: chunks x filters."""
        rows = half_chunks(text)
        halves = np.concatenate([self.scan(rows[i : i + BLOCK]) for i in range(0, len(rows), BLOCK)])
        return chunks_of(halves, self.bias)

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Probability of good quality for each text. Short texts share their scans."""
        out = np.empty(len(texts))
        waiting: list[tuple[int, np.ndarray]] = []
        held = 0

        def flush():
            nonlocal waiting, held
            if not waiting:
                return
            halves = self.scan(np.concatenate([r for _, r in waiting]))
            at = 0
            for i, r in waiting:
                out[i] = self.combine(chunks_of(halves[at : at + len(r)], self.bias))
                at += len(r)
            waiting, held = [], 0

        for i, text in enumerate(texts):
            if len(text) > HALF * BLOCK:
                out[i] = self.combine(self.pooled(text))
                continue
            rows = half_chunks(text)
            if held + len(rows) > BLOCK:
                flush()
            waiting.append((i, rows))
            held += len(rows)
        flush()
        return out

    def combine(self, chunks: np.ndarray) -> float:
        value = np.concatenate([chunks.mean(axis=0), chunks.max(axis=0)]) @ self.weights + self.offset
        return float(1 / (1 + np.exp(-np.clip(value, -30, 30))))


def chunks_of(halves: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Overlapping chunks from half chunks: each with its next; a single half is its own chunk."""
    pairs = np.maximum(halves[:-1], halves[1:]) if len(halves) > 1 else halves
    return np.maximum(pairs + bias, 0)


def fit(texts: list[bytes], labels: list[int], epochs: int = 8, batch: int = 24, rate: float = 0.01, seed: int = 1) -> QualityModel:
    """Learn a model by Adam on the logistic loss."""
    model = QualityModel.fresh(seed)
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():  # nothing to tell apart
        model.weights[:] = 0
        model.offset = 0.0 if not len(y) else float(4 * (2 * y[0] - 1))
        return model
    rows = [half_chunks(t) for t in texts]
    params = [model.embed, model.filters, model.bias, model.weights, np.zeros(1, np.float32)]
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    rng = np.random.default_rng(seed)
    step, total = 0, epochs * -(-len(y) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            some = order[at : at + batch]
            grads = _gradients(model, params[4][0], [rows[i] for i in some], y[some])
            step += 1
            pace = rate * (1 - step / (total + 1))
            for p, m, v, g in zip(params, first, second, grads, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model.offset = float(params[4][0])
    return model


def _gradients(model: QualityModel, offset: float, rows: list[np.ndarray], y: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean loss. Max-pooling passes a gradient to the winning window only."""
    counts = [len(r) for r in rows]
    laid = np.concatenate(rows)
    scans = [model.scan(laid[i : i + BLOCK], with_place=True) for i in range(0, len(laid), BLOCK)]
    halves, places = (np.concatenate(x) for x in zip(*scans, strict=True))
    down = np.zeros_like(halves)  # loss by half-chunk response
    d_weights, d_offset = np.zeros_like(model.weights), np.zeros(1, np.float32)
    at = 0
    every = np.arange(FILTERS)
    for n, target in zip(counts, y, strict=True):
        own = halves[at : at + n]
        chunks = chunks_of(own, model.bias)
        pooled = np.concatenate([chunks.mean(axis=0), chunks.max(axis=0)])
        p = 1 / (1 + np.exp(-np.clip(pooled @ model.weights + offset, -30, 30)))
        d = np.float32((p - target) / len(y))
        d_weights += d * pooled
        d_offset += d
        d_chunks = np.repeat(d * model.weights[None, :FILTERS] / len(chunks), len(chunks), axis=0)
        d_chunks[chunks.argmax(axis=0), every] += d * model.weights[FILTERS:]
        d_chunks *= chunks > 0
        if n == 1:
            down[at] += d_chunks[0]
        else:
            left = own[:-1] >= own[1:]
            down[at : at + n - 1] += d_chunks * left
            down[at + 1 : at + n] += d_chunks * ~left
        at += n
    reach = STRIDE * places[:, :, None] + np.arange(WIDTH)
    window = np.take_along_axis(laid[:, None, :], reach, axis=2)  # rows x filters x WIDTH
    seen = model.embed[window].reshape(len(laid), FILTERS, WIDTH * DIM)
    d_filters = np.einsum("nf,nfk->kf", down, seen)
    per_byte = down[:, :, None] * model.filters.T[None]
    d_embed = np.stack(
        [
            np.bincount(window.ravel(), weights=per_byte.reshape(-1, WIDTH, DIM)[:, :, i].ravel(), minlength=256)
            for i in range(DIM)
        ],
        axis=1,
    )
    return [d_embed.astype(np.float32), d_filters, down.sum(axis=0), d_weights, d_offset]


def learning_sample(docs: DataFrame, labels: DataFrame, per_label: int, max_bytes: int, seed: int = 11) -> DataFrame:
    """text and quality of at most ``per_label`` rows a label, by a hash of the id."""
    known = labels.select(F.col("doc_id").alias("_of"), F.col("quality").cast("int").alias("quality"))
    known = known.filter(F.col("quality").isin(0, 1) & ~learning_split(F.col("_of")))
    draw = F.xxhash64(F.lit(seed), "_of")
    each = [known.filter(F.col("quality") == q).orderBy(draw, "_of").limit(per_label) for q in (0, 1)]
    chosen = union_all(*each)
    own = docs.select("doc_id", "text").filter(F.octet_length("text") <= max_bytes)
    return own.join(F.broadcast(chosen), F.col("doc_id") == F.col("_of")).select("doc_id", "text", "quality")


def learn(docs: DataFrame, labels: DataFrame, per_label: int = 1500, max_bytes: int = 8192, epochs: int = 10) -> QualityModel:
    """A model of a bounded sample of labelled rows, at most 2 * per_label of them."""
    sample = learning_sample(docs, labels, per_label, max_bytes).orderBy("doc_id", "text").limit(2 * per_label).toArrow()
    return fit(as_bytes(sample["text"].combine_chunks()), sample["quality"].to_pylist(), epochs)


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType())])

    def run(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column(0), "score": model.score(as_bytes(batch.column(1)))}

    scored = per_batch(docs.select("doc_id", "text"), run, schema)
    return scored.select(
        "doc_id",
        learning_split(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
