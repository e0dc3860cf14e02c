"""Language identification by segmentation-marginalised unigrams.

For every language each piece of a fixed public vocabulary has a probability. A word's probability is
the sum over all ways to cut it into pieces of the product of the pieces' probabilities; a forward
pass over the word's letters gives it without listing the ways. A text is its words in a row, so its
log probability is the sum of theirs: pieces never reach over a word's start, as the vocabulary
marks it. The language of highest probability wins, ties by name; the score is its share among
all languages, each taken to be equally likely beforehand.

Words are runs of letters, lower-cased, each begun by the vocabulary's word mark; digits, signs and
blanks say nothing about a language. Runs beyond :data:`RUN_LETTERS` are scored in slices of that
length, all of them. Letters that the vocabulary lacks have one fixed small probability everywhere.
A text that is null or has no letter is ``und`` with score 0.

The piece probabilities are learned by expectation-maximisation over the words of a bounded sample
(``per_language`` documents of each language, none longer than ``max_chars``), chosen by a hash of the
id. Scoring covers every text whole, in the task that reads it, and keeps each worker's word scores
in a cache of bounded size. Only the model, pieces times languages, is sent to the tasks.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.llm.common import learning_split, per_batch
from sheaf.llm.packing import vocabulary_path

WORD_MARK = "▁"
RUN_LETTERS = 64
#: Probability of a letter that the vocabulary lacks, and the count added to every piece.
UNKNOWN, SMOOTHING = 1e-9, 0.01
ROUNDS = 5
CACHE_WORDS = 400_000
DOCS_AT_ONCE = 256
UNDETERMINED = "und"
_LETTERS = re.compile(r"[^\W\d_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def vocabulary_pieces(path: str | None = None) -> list[str]:
    """The normal pieces of a sentencepiece model file, in the order of their ids."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path or vocabulary_path("piece_bpe_32k.model"))
    ids = range(model.get_piece_size())
    return [model.id_to_piece(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


def words_of(text: str) -> list[str]:
    """Marked runs of letters; a long run is given in slices, the first of them marked."""
    out = []
    for run in _LETTERS.findall(text.lower()):
        if len(run) <= RUN_LETTERS:
            out.append(WORD_MARK + run)
        else:
            out.append(WORD_MARK + run[:RUN_LETTERS])
            out += [run[i : i + RUN_LETTERS] for i in range(RUN_LETTERS, len(run), RUN_LETTERS)]
    return out


class Lattice:
    """The pieces inside words: for every start and length the piece's number, or none."""

    def __init__(self, pieces: list[str]):
        self.longest = max(map(len, pieces))
        hashes = np.array([self._hash(p) for p in pieces], np.uint64)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.none = len(pieces)
        self.unknown = len(pieces) + 1

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + ord(c) + 1) % 2**64
        return h

    def groups(self, words: list[str]):
        """Words of equal length together: their places in the list and their code points."""
        sizes = np.array([len(w) for w in words])
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            joined = "".join([words[i] for i in at]).encode("utf-32-le")
            yield at, np.frombuffer(joined, "<u4").reshape(len(at), size)

    def numbers(self, codes: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        """(start, length) to piece numbers, where any word has a piece; single letters always."""
        n, size = codes.shape
        codes = codes.astype(np.uint64) + np.uint64(1)
        out = {}
        for start in range(size):
            h = np.zeros(n, np.uint64)
            for length in range(1, min(self.longest, size - start) + 1):
                h = h * _BASE + codes[:, start + length - 1]
                at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                found = self.hashes[at] == h
                missing = self.unknown if length == 1 else self.none
                if length == 1 or found.any():
                    out[start, length] = np.where(found, self.order[at], missing)
        return out


def forward(numbers: dict, size: int, p: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Scaled forward sums at each place (rows: words, columns: languages) and the log scale."""
    n, k = len(next(iter(numbers.values()))), p.shape[1]
    alpha = [np.ones((n, k))]
    log = np.zeros((n, k))
    for end in range(1, size + 1):
        total = np.zeros((n, k))
        for length in range(1, end + 1):
            piece = numbers.get((end - length, length))
            if piece is not None:
                total += alpha[end - length] * p[piece]
        if end % 16 == 0:  # long words would fall below what a float can hold
            scale = total.copy()
            log += np.log(scale)
            alpha = [a / scale for a in alpha]
            total = np.ones((n, k))
        alpha.append(total)
    return alpha, log


@dataclass
class LanguageModel:
    """Languages by name, the vocabulary, and p[piece, language] with a row for no piece (0) and
    one for an unknown letter."""

    languages: list[str]
    pieces: list[str]
    p: np.ndarray

    @cached_property
    def lattice(self) -> Lattice:
        return Lattice(self.pieces)

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log probability of each word (rows) in each language (columns)."""
        out = np.empty((len(words), len(self.languages)))
        for at, codes in self.lattice.groups(words):
            alpha, log = forward(self.lattice.numbers(codes), codes.shape[1], self.p)
            out[at] = np.log(alpha[-1]) + log
        return out

    def __getstate__(self):
        return {"languages": self.languages, "pieces": self.pieces, "p": self.p}


def fit(texts: list[str], langs: list[str], pieces: list[str], rounds: int = ROUNDS) -> LanguageModel:
    """Learn piece probabilities of every language in ``langs`` by expectation-maximisation."""
    names = sorted(set(langs))
    place = {name: i for i, name in enumerate(names)}
    seen: dict[str, int] = {}
    rows, cols = [], []
    for text, lang in zip(texts, langs, strict=True):
        found = [seen.setdefault(w, len(seen)) for w in words_of(text)]
        rows += found
        cols += [place[lang]] * len(found)
    k, v = len(names), len(pieces)
    times = np.zeros((len(seen), k))
    np.add.at(times, (np.array(rows, int), np.array(cols, int)), 1)
    p = np.full((v + 2, k), 1.0 / max(v, 1))
    p[v], p[v + 1] = 0, UNKNOWN
    model = LanguageModel(names, pieces, p)
    words = list(seen)
    cut = [(at, codes.shape[1], model.lattice.numbers(codes)) for at, codes in model.lattice.groups(words)] if words else []
    for _ in range(rounds):
        counts = np.full((v + 2, k), SMOOTHING)
        for at, size, numbers in cut:
            _expect(numbers, size, times[at], p, counts)
        counts[v:] = 0
        p = counts / np.maximum(counts.sum(axis=0), 1e-300)
        p[v], p[v + 1] = 0, UNKNOWN
    return LanguageModel(names, pieces, p)


def _expect(numbers: dict, size: int, times: np.ndarray, p: np.ndarray, counts: np.ndarray) -> None:
    """Add each piece's expected uses in words that occur ``times``; places are rescaled as needed."""
    alpha, logs = _scaled(numbers, size, p, range(1, size + 1), lambda at, length: (at - length, length), lambda at, length: at - length)
    beta, back = _scaled(
        numbers, size, p, range(size - 1, -1, -1), lambda at, length: (at, length), lambda at, length: at + length
    )
    whole = np.log(alpha[size]) + logs[size]
    for (start, length), piece in numbers.items():
        end = start + length
        weight = np.exp(logs[start] + back[end] - whole) * alpha[start] * beta[end] * p[piece] * times
        for lang in range(p.shape[1]):
            counts[:, lang] += np.bincount(piece, weights=weight[:, lang], minlength=len(p))


def _scaled(numbers: dict, size: int, p: np.ndarray, places, key, other):
    """Forward or backward sums, each place scaled to 1 with its log kept beside it."""
    n, k = len(next(iter(numbers.values()))), p.shape[1]
    first = 0 if places.step > 0 else size
    value, log = {first: np.ones((n, k))}, {first: np.zeros((n, k))}
    for at in places:
        terms = [(other(at, m), numbers.get(key(at, m))) for m in range(1, size + 1)]
        terms = [(o, piece) for o, piece in terms if piece is not None and o in value]
        base = np.max([log[o] for o, _ in terms], axis=0)
        total = sum(value[o] * np.exp(log[o] - base) * p[piece] for o, piece in terms)
        value[at], log[at] = np.ones((n, k)), base + np.log(np.maximum(total, 1e-300))
    return value, log


def learning_sample(docs: DataFrame, per_language: int, max_chars: int, seed: int = 7) -> DataFrame:
    """text and lang of at most ``per_language`` documents a language, by a hash of id and text.

    Of a longer text a piece of ``max_chars`` characters is taken, from a place that the hash gives, so that a
    language of long texts only is learned too. The text that its language's smallest hash belongs to is
    always drawn, so no language is left out, however its rows repeat ids or texts."""
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 30))
    begin = F.col("_draw") % F.greatest(F.lit(1), F.length("text") - max_chars + 1) + 1
    usable = docs.select("doc_id", "text", "lang").filter(
        ~learning_split(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()
    )
    usable = usable.withColumn("_draw", draw)
    counts = usable.groupBy("lang").agg(F.count("*").alias("n"), F.min("_draw").alias("least")).collect()  # a row a language
    if not counts:
        return usable.select("text", "lang").limit(0)
    # a thinned set first, so that about twice the sample is ranked and no more
    share = [(r.lang, max(int(min(1.0, 2 * per_language / r.n) * (1 << 30)), r.least + 1)) for r in counts]
    below = F.create_map(*[F.lit(x) for pair in share for x in pair])[F.col("lang")]
    thin = usable.filter(F.col("_draw") < below).withColumn("text", F.substring(F.col("text"), begin.cast("int"), F.lit(max_chars)))
    ranked = thin.withColumn("_place", F.row_number().over(Window.partitionBy("lang").orderBy("_draw", "doc_id", "text")))
    return ranked.filter(F.col("_place") <= per_language).select("text", "lang")


def learn(docs: DataFrame, per_language: int = 300, max_chars: int = 20_000, vocabulary: str | None = None) -> LanguageModel:
    """A model of the languages in a bounded sample of the rows that are not held out."""
    rows = learning_sample(docs, per_language, max_chars).orderBy("lang", "text").toArrow()
    return fit(rows["text"].to_pylist(), rows["lang"].to_pylist(), vocabulary_pieces(vocabulary))


class Scorer:
    """Scores texts with a model; words seen before come from a bounded cache."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.known: dict[str, int] = {}
        self.scores = np.empty((0, len(model.languages)))

    def _learn_words(self, words: list[str]) -> None:
        if len(self.known) > CACHE_WORDS:
            self.known, self.scores = {}, self.scores[:0]
        new = list(set(words).difference(self.known))
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.scores = np.concatenate([self.scores, self.model.word_scores(new)])

    def __call__(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        split = [words_of(t) if t else [] for t in texts]
        words = [w for s in split for w in s]
        k = len(self.model.languages)
        total = np.zeros((len(texts), k))
        if words and k:
            self._learn_words(words)
            ids = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
            doc = np.repeat(np.arange(len(texts)), [len(s) for s in split])
            for lang in range(k):
                total[:, lang] = np.bincount(doc, weights=self.scores[ids, lang], minlength=len(texts))
        lettered = np.array([k > 0 and bool(t) and any(map(str.isalpha, t)) for t in texts], bool)
        best = total.argmax(axis=1) if k else np.zeros(len(texts), int)
        share = np.exp(total - total.max(axis=1, keepdims=True)) if k else np.ones((len(texts), 1))
        score = np.where(lettered, 1 / share.sum(axis=1), 0.0)
        return [self.model.languages[b] if ok else UNDETERMINED for b, ok in zip(best, lettered, strict=True)], score


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    schema = T.StructType(
        [docs.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    )
    scorers: list[Scorer] = []

    def run(batch: pa.RecordBatch) -> dict:
        scorer = scorers[0] if scorers else scorers.append(Scorer(model)) or scorers[0]
        texts = batch.column(1)
        names, scores = [], []
        for at in range(0, len(texts), DOCS_AT_ONCE):
            n, s = scorer(texts.slice(at, DOCS_AT_ONCE).to_pylist())
            names += n
            scores.append(s)
        return {"doc_id": batch.column(0), "lang_pred": names, "score": np.concatenate(scores)}

    predicted = per_batch(docs.select("doc_id", "text"), run, schema)
    return predicted.select("doc_id", learning_split(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
