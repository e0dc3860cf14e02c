"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

A window is ``window`` consecutive words of a benchmark item, or the whole item if it is shorter. A
document holds a window if the same words stand in it in a row; all its words that stand in any such
place are hit.

A window of n words is held only where all n are, so the overlap asked for is n and the prefix that
has to be joined is one token: its rarest over all documents, ties by the word itself. Each place of
a rarest token in a document fixes where the window would begin (positional bound), the place must
lie in the text with room for the whole window (length bound), and only then are the words compared
one by one. Windows of an item that share their rarest token are one entry of the index.

Counting and probing read the documents without a shuffle of texts; the index is broadcast if the
benchmark's text is below :data:`BROADCAST_BYTES`, else Spark joins by word. Only documents that
probing found are verified. Documents are keyed by a hash of id and text; as each place is compared
with the document's own words, a collision costs time and changes nothing.

A null or empty text has no words and hits nothing; an item without words has no windows. Repeated
rows are judged alike, repeated item ids count once; an item without an id hits words but is not
named. Extra columns pass through the filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import ascii_lower

WINDOW = 10
BROADCAST_BYTES = 8 << 20
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text with A-Z lower-cased. Texts of ASCII only take the quicker way."""
    text = F.coalesce(text, F.lit(""))
    plain = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(ascii_lower(text))
    return F.array_remove(F.split(plain, _BETWEEN), "")


def _sent(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def window_index(items: DataFrame, doc_words: DataFrame, window: int, small: bool) -> DataFrame:
    """word, item_id, item_words, size, at, starts: the windows (their places in the item) whose
    rarest word is ``word`` at place ``at`` of the item. ``doc_words`` has a row per document word."""
    read = items.select("item_id", words_of(F.col("text")).alias("item_words")).filter(F.size("item_words") > 0).distinct()
    size = F.least(F.size("item_words"), F.lit(window))
    read = read.withColumn("size", size)
    places = read.select("item_id", "item_words", "size", F.posexplode("item_words").alias("at", "word"))
    wanted = places.select("word").distinct()
    counts = doc_words.join(_sent(wanted, small), "word").groupBy("word").agg(F.count("*").alias("n"))
    first = F.greatest(F.col("at") - F.col("size") + 1, F.lit(0))
    last = F.least(F.col("at"), F.size("item_words") - F.col("size"))
    inside = places.join(counts, "word", "left").select(
        "item_id",
        "item_words",
        "size",
        F.explode(F.sequence(first, last)).alias("start"),
        F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "at").alias("token"),
    )
    rarest = inside.groupBy("item_id", "item_words", "size", "start").agg(F.min("token").alias("token"))
    held = rarest.filter(F.col("token.n") > 0)  # a word that no document has
    return held.groupBy(F.col("token.word").alias("word"), "item_id", "item_words", "size", F.col("token.at").alias("at")).agg(
        F.array_sort(F.collect_list("start")).alias("starts")
    )


def _with_hits(docs: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """_row (all columns), n_words and hits (array of at, size, item_id) for every document."""
    items = benchmark.select("item_id", "text")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    small = size <= BROADCAST_BYTES
    keyed = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("_row"),
        docs["text"].alias("_text"),
        F.xxhash64(docs["doc_id"], docs["text"]).alias("_key"),
    )
    plain = docs.select(F.explode(words_of(docs["text"])).alias("word"))
    index = window_index(items, plain, window, small)
    places = keyed.select("_key", F.posexplode(words_of(F.col("_text"))).alias("pos", "word"))
    found = places.join(_sent(index, small), "word")
    found = found.filter(F.col("pos") >= F.col("at") - F.element_at("starts", -1))
    candidate = F.struct("pos", "item_id", "item_words", "size", "at", "starts")
    by_doc = found.groupBy("_key").agg(F.collect_set(candidate).alias("_found"))
    both = keyed.join(by_doc, "_key", "left").select("_row", "_text", "_found")

    def held(c: Column, words: Column) -> Column:
        begin = lambda s: c["pos"] - c["at"] + s
        fits = lambda s: (begin(s) >= 0) & (begin(s) + c["size"] <= F.size(words))
        equal = lambda s: F.slice(words, F.greatest(begin(s), F.lit(0)) + 1, c["size"]) == F.slice(c["item_words"], s + 1, c["size"])
        kept = F.filter(c["starts"], lambda s: fits(s) & equal(s))
        return F.transform(kept, lambda s: F.struct(begin(s).alias("at"), c["size"].alias("size"), c["item_id"].alias("item_id")))

    def judged(words: Column) -> Column:
        hits = F.when(F.col("_found").isNotNull(), F.flatten(F.transform("_found", lambda c: held(c, words))))
        return F.struct(F.size(words).cast("bigint").alias("n_words"), hits.alias("hits"))

    # words are bound to a lambda's variable: an expression put in their place by the optimizer
    # would split the text again for every candidate
    checked = F.get(F.transform(F.array(words_of(F.col("_text"))), judged), F.lit(0))
    return both.select("_row", checked.alias("_checked")).select("_row", "_checked.n_words", "_checked.hits")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted as strings), contaminated for every document."""
    found = _with_hits(docs.select("doc_id", "text"), benchmark, window)
    places = F.flatten(F.transform("hits", lambda h: F.sequence(h["at"], h["at"] + h["size"] - 1)))
    items = F.array_sort(F.array_distinct(F.array_compact(F.transform("hits", lambda h: h["item_id"].cast("string")))))
    counted = found.select(
        F.col("_row.doc_id").alias("doc_id"),
        "n_words",
        F.coalesce(F.size(F.array_distinct(places)), F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce(items, F.array().cast("array<string>")).alias("items"),
    )
    counted = counted.withColumn("n_hit", F.greatest("n_hit", F.lit(0)))
    return counted.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without any window of the benchmark, with all their columns."""
    found = _with_hits(docs, benchmark, window)
    return found.filter(F.coalesce(F.size("hits"), F.lit(0)) <= 0).select("_row.*")
