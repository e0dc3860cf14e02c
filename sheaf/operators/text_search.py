"""Keyword, full-text and trigram search, for one literal query or a table of queries."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from typing import Protocol

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf import schema as S
from sheaf.functions import text as X
from sheaf.operators.filters import apply_filters
from sheaf.schema import SearchFilters
from sheaf.session import at_most, broadcast_if, union_all, written

#: Distinct query words that are sent to the tasks. Beyond it, words and records are joined.
MAX_WORDS = 50_000
#: Records whose texts and words a task holds as Python objects at a time, however large Spark's batches are.
HELD_ROWS = 256
#: Values of a trigram that are compared in one part, and the smallest sizes of the classes that numbers of trigrams fall to.
SALTED_ROWS = 4096
SIZE_CLASSES = [1, 2, 3, *[int(2 ** (i / 2)) for i in range(4, 41)]]


def _top(df: DataFrame, score: str, limit: int) -> DataFrame:
    """Best rows of one query: a distributed top-k, then numbers for ``limit`` rows."""
    order = [F.col(score).desc(), F.col("id").asc()]
    best = df.orderBy(*order).limit(limit)
    return best.withColumn("position", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def _top_per_query(df: DataFrame, score: str, limit: int, key: str = "query_id") -> DataFrame:
    window = Window.partitionBy(key).orderBy(F.col(score).desc(), F.col("id").asc())
    return df.withColumn("position", F.row_number().over(window)).filter(F.col("position") <= limit)


# --- one query ---------------------------------------------------------------------------------


def lexical_search_one(
    query: str, docs: DataFrame, filters: SearchFilters | None = None, limit: int = S.LEXICAL_LIMIT
) -> DataFrame:
    """``(id, rank_score, position)`` of the best records for one query.

    A record matches when it holds every query word, or any key term as part of its title or
    description. A key term in the title scores 0.8, in the description 0.6; the full-text rank
    stays below both. One scan, no shuffle before the top-k.
    """
    terms = X.key_terms_of(query)
    words = list(dict.fromkeys(X.words_of(query)))
    rows = apply_filters(docs, filters)
    if terms:
        # Whoever holds every word also holds a key term, so it scores 0.6 or more already and
        # the full-text rank (below 0.5) can be left out.
        in_title = X.contains_any(F.coalesce(F.lower("title"), F.lit("")), terms)
        in_text = X.contains_any(F.coalesce(F.lower("description"), F.lit("")), terms)
        score = F.when(in_title, F.lit(S.TITLE_SCORE)).when(in_text, F.lit(S.DESCRIPTION_SCORE))
    elif words:
        score = _fulltext_score(words)
    else:
        score = F.lit(None).cast("double")
    scored = rows.select("id", score.alias("rank_score")).filter(F.col("rank_score").isNotNull())
    return _top(scored, "rank_score", limit)


def _fulltext_score(words: list[str]) -> Column:
    query = F.array(*[F.lit(w) for w in words])
    doc = X.tokens(X.document(F.col("title"), F.col("description")))
    # The words occur in the text at all: a cheap check before it is split into words.
    text = F.lower(X.document(F.col("title"), F.col("description")))
    present = reduce(lambda a, b: a & b, [F.contains(text, F.lit(w)) for w in words])
    return F.when(present & X.matches_all(doc, query), X.fulltext_rank(X.occurrences(doc, query)))


def fulltext_search_one(query: str, docs: DataFrame, limit: int = S.TOP_K) -> DataFrame:
    """Records holding every query word, best full-text rank first."""
    words = list(dict.fromkeys(X.words_of(query)))
    score = _fulltext_score(words) if words else F.lit(None).cast("double")
    scored = docs.select("id", score.alias("rank")).filter(F.col("rank").isNotNull())
    return _top(scored, "rank", limit)


def fuzzy_search_one(
    query: str,
    docs: DataFrame,
    columns: tuple[str, ...] = ("title", "proposer"),
    limit: int = S.TOP_K,
    cut: float = S.TRIGRAM_CUT,
) -> DataFrame:
    """Records with a column whose trigram similarity to the query reaches ``cut``."""
    wanted = X.trigrams_of(query)
    if not wanted:
        return _top(docs.select("id", F.lit(None).cast("double").alias("similarity")).filter(F.lit(False)), "similarity", limit)
    grams = F.array(*[F.lit(g) for g in wanted])
    each = [X.similarity(X.trigrams(F.coalesce(F.col(c), F.lit(""))), grams) for c in columns]
    score = F.greatest(*each) if len(each) > 1 else each[0]
    scored = docs.select("id", score.alias("similarity")).filter(F.col("similarity") >= cut)
    return _top(scored, "similarity", limit)


# --- postings ----------------------------------------------------------------------------------


def _tokens(column: str) -> Column:
    return F.coalesce(X.tokens(F.col(column)), F.array().cast("array<string>"))


def _words(docs: DataFrame) -> DataFrame:
    """``(token, id, in_title)`` of every word, from one scan, dealt out by id. Each word is a row of generated code."""
    sides = [F.struct(X.tokens(F.col(c)).alias("words"), F.lit(c == "title").alias("in_title")) for c in ("title", "description")]
    both = docs.repartition("id").select("id", F.explode(F.array(*sides)).alias("_side"))
    return both.select(F.explode("_side.words").alias("token"), "id", "_side.in_title")


def _distinct_words(docs: DataFrame) -> DataFrame:
    """``(token, id, in_title)`` of every distinct word of a record, from one scan."""
    title = F.array_distinct(_tokens("title"))
    rest = F.array_except(_tokens("description"), title)
    flagged = F.concat(
        F.transform(title, lambda t: F.struct(t.alias("token"), F.lit(True).alias("in_title"))),
        F.transform(rest, lambda t: F.struct(t.alias("token"), F.lit(False).alias("in_title"))),
    )
    return docs.select("id", F.explode(flagged).alias("_w")).select("_w.token", "id", "_w.in_title")


def postings(docs: DataFrame) -> DataFrame:
    """``(token, id, tf, in_title, in_description)``: one row per distinct word of a record.

    Records are dealt out by id, once, as texts; all words of an id are then counted where they are. So
    no word is shuffled, and a common word fills no single task.
    """
    return (
        _words(docs)
        .groupBy("token", "id")
        .agg(
            F.count(F.lit(1)).alias("tf"),
            F.max("in_title").alias("in_title"),
            F.max(~F.col("in_title")).alias("in_description"),
        )
    )


def _in_scope(rows: DataFrame, docs: DataFrame, filters: SearchFilters | None) -> DataFrame:
    if filters is None:
        return rows
    known = apply_filters(docs, filters).select(F.col("id").alias("_known"))
    return rows.join(known, F.col("id") == F.col("_known"), "left_semi")


class StoredPostings(Protocol):
    """An index that looks words up itself, such as ``word_index.WordIndex``."""

    def vocabulary(self) -> DataFrame: ...

    def holding(self, words: DataFrame) -> DataFrame: ...


# --- a table of queries ------------------------------------------------------------------------


def lexical_search(
    queries: DataFrame,
    docs: DataFrame,
    filters: SearchFilters | None = None,
    limit: int = S.LEXICAL_LIMIT,
    index: DataFrame | StoredPostings | None = None,
) -> DataFrame:
    """``(query_id, id, rank_score, position)`` for a table ``(query_id, query)``.

    A term has no characters that end a word, so a text contains it exactly when one of its
    words does. Up to :data:`MAX_WORDS` distinct terms (checked) are sent to the tasks, which look for
    all of them at once in each text; more terms, or those of an ``index``, are joined by word.

    A record's score is that of its best term, so the best ``limit`` records of a query are
    among the best ``limit`` of each of its terms. Each term is ranked once, however many
    queries use it, and cut to ``limit`` records before anything is combined.
    """
    terms = F.when((F.size(X.key_terms(F.col("query"))) == 0) & (F.size(X.tokens(F.col("query"))) > 0), F.array(F.lit("")))
    asked = queries.select("query_id", F.explode(F.coalesce(terms, X.key_terms(F.col("query")))).alias("term"))
    known = None if index is not None else _bounded(asked.select("term"))
    query_terms = asked.filter("term <> ''")
    if known is not None:
        near = _holders(apply_filters(docs, filters), [t for t in known if t], limit)
    else:
        near = _joined(query_terms, docs, filters, limit, index)
    score = F.when(F.max("in_title"), F.lit(S.TITLE_SCORE)).otherwise(F.lit(S.DESCRIPTION_SCORE))
    per_term = near.groupBy("term", "id").agg(score.alias("rank_score"))
    best = _top_per_query(per_term, "rank_score", limit, "term").drop("position")
    scored = query_terms.join(best, "term").groupBy("query_id", "id").agg(F.max("rank_score").alias("rank_score"))
    if known is None or "" in known:  # a query of short and stop words only has nothing but its full-text rank
        plain = queries.filter((F.size(X.key_terms(F.col("query"))) == 0) & (F.size(X.tokens(F.col("query"))) > 0))
        found = _fulltext(plain, docs, filters, index, limit)
        scored = union_all(scored, found.select("query_id", "id", F.col("rank").alias("rank_score")))
    return _top_per_query(scored, "rank_score", limit)


def _bounded(words: DataFrame) -> list[str] | None:
    """The distinct words, if there are no more than :data:`MAX_WORDS` of them."""
    found = words.distinct().limit(MAX_WORDS + 1).collect()
    return None if len(found) > MAX_WORDS else sorted(r[0] for r in found)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in parts of :data:`HELD_ROWS`."""
    for batch in batches:
        for start in range(0, batch.num_rows, HELD_ROWS):
            yield batch.slice(start, HELD_ROWS)


def _ranked_cut(rows: pa.Table, group: str, order: list[tuple[str, str]], limit: int) -> pa.Table:
    """The first ``limit`` rows of each group, as Spark orders them: null ids first."""
    by = pc.sort_indices(rows, sort_keys=[(group, "ascending"), *order], null_placement="at_start")
    rows = rows.take(by)
    groups = rows.column(group).to_numpy()
    starts = np.flatnonzero(np.diff(groups, prepend=-1))
    place = np.arange(len(groups)) - np.repeat(starts, np.diff([*starts, len(groups)]))
    return rows.filter(pa.array(place < limit))


def _holders(rows: DataFrame, terms: list[str], limit: int) -> DataFrame:
    """``(term, id, in_title)`` of the best ``limit`` records of each term in each task.

    All terms are looked for at once, by one automaton over the lower-cased texts, so a text is read once
    and what leaves a task is bounded by the terms, however many records it holds.
    """
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ahocorasick.Automaton()
        for i, term in enumerate(terms):
            found.add_word(term, i)
        found.make_automaton()
        best = None
        for batch in _slices(batches):
            hit, row, titled = [], [], []
            pairs = zip(batch.column("title").to_pylist(), batch.column("description").to_pylist(), strict=True)
            for r, (title, text) in enumerate(pairs):
                in_title = {i for _, i in found.iter(title)}
                rest = {i for _, i in found.iter(text)} - in_title
                hit += [*in_title, *rest]
                row += [r] * (len(in_title) + len(rest))
                titled += [1] * len(in_title) + [0] * len(rest)
            ids = batch.column("id").take(pa.array(row, pa.int64()))
            held = pa.table({"term": pa.array(hit, pa.int32()), "titled": pa.array(titled, pa.int8()), "id": ids})
            held = pa.concat_tables([best, held]) if best is not None else held
            best = _ranked_cut(held, "term", [("titled", "descending"), ("id", "ascending")], limit)
        if best is not None and best.num_rows:
            names = pa.array(terms).take(best.column("term").combine_chunks())
            yield from pa.table({"term": names, "id": best.column("id"), "in_title": pc.equal(best.column("titled"), 1)}).to_batches()

    if not terms:
        return rows.sparkSession.createDataFrame([], f"term string, id {id_type}, in_title boolean")
    lowered = rows.select("id", *[F.coalesce(F.lower(c), F.lit("")).alias(c) for c in ("title", "description")])
    return lowered.mapInArrow(run, f"term string, id {id_type}, in_title boolean")


def _joined(query_terms: DataFrame, docs: DataFrame, filters: SearchFilters | None, limit: int, index: DataFrame | StoredPostings | None) -> DataFrame:
    """The same from a stored index, or for more terms than are sent to tasks: terms are matched against
    the distinct words, found through a shared three-letter window, and records are reached from words."""
    terms = query_terms.select("term").distinct()
    if index is None or isinstance(index, DataFrame):
        rows = _distinct_words(apply_filters(docs, filters)) if index is None else _in_scope(index, docs, filters)
        matches = _term_tokens(terms, rows.select("token").distinct())
        hits = rows.select("token", "id", "in_title").join(matches, "token")
    else:
        hits = index.holding(_term_tokens(terms, index.vocabulary())).select("token", "id", "in_title", "term")
        hits = _in_scope(hits, docs, filters)
    # A record may hold several words with the same term, in the title or not: two different
    # ranks at most, so 2 * limit ranks hold the best limit records.
    by_rank = Window.partitionBy("term").orderBy(F.col("in_title").desc(), F.col("id").asc())
    return hits.withColumn("_rank", F.dense_rank().over(by_rank)).filter(F.col("_rank") <= 2 * limit)


def _term_tokens(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``(token, term)`` of every word that contains a term."""
    windows = F.transform(
        F.sequence(F.lit(1), F.char_length("token") - 2), lambda i: F.substring(F.col("token"), i, F.lit(3))
    )
    long_words = vocabulary.filter(F.char_length("token") >= 3)
    left = long_words.select("token", F.explode(F.array_distinct(windows)).alias("_window"))
    right = terms.select("term", F.substring("term", 1, 3).alias("_window"))
    return left.join(right, "_window").filter(F.contains(F.col("token"), F.col("term"))).select("token", "term")


def fulltext_search(
    queries: DataFrame,
    docs: DataFrame,
    limit: int = S.TOP_K,
    filters: SearchFilters | None = None,
    index: DataFrame | StoredPostings | None = None,
) -> DataFrame:
    """``(query_id, id, rank, position)``: records holding every word of the query."""
    return _top_per_query(_fulltext(queries, docs, filters, index, limit), "rank", limit)


def _fulltext(
    queries: DataFrame, docs: DataFrame, filters: SearchFilters | None, index: DataFrame | StoredPostings | None, limit: int
) -> DataFrame:
    """``(query_id, id, rank)``, at least the best ``limit`` of each query. Queries of few words in all
    are sent to the tasks, others and those of an ``index`` are joined."""
    if index is None:
        asked = queries.select("query_id", F.array_distinct(X.tokens(F.col("query"))).alias("words")).filter("size(words) > 0")
        found = asked.limit(MAX_WORDS + 1).collect()
        if sum(len(r.words) for r in found) <= MAX_WORDS:
            return _holding_all(apply_filters(docs, filters), queries.schema["query_id"].dataType.simpleString(), found, limit)
    return _fulltext_joined(queries, docs, filters, index)


def _holding_all(rows: DataFrame, query_type: str, asked: list, limit: int) -> DataFrame:
    """Best records of each query in each task. A record is compared with the queries whose rarest word
    (in its batch) it holds; the other words only confirm."""
    id_type = rows.schema["id"].dataType.simpleString()
    schema = f"query int, id {id_type}, hits long"
    wanted = [frozenset(r.words) for r in asked]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, vocabulary, best = regex.compile(X.WORD), frozenset().union(*wanted), None
        for batch in _slices(batches):
            counts = [Counter(word.findall(t)) for t in batch.column("text").to_pylist()]
            held = [vocabulary.intersection(c) for c in counts]
            df = Counter(w for h in held for w in h)
            by_rarest: dict[str, list[int]] = {}
            for q, words in enumerate(wanted):
                by_rarest.setdefault(min(words, key=lambda w: (df[w], w)), []).append(q)
            query, row, hits = [], [], []
            for r, (own, count) in enumerate(zip(held, counts, strict=True)):
                for w in own.intersection(by_rarest):
                    for q in by_rarest[w]:
                        if wanted[q] <= own:
                            query.append(q)
                            row.append(r)
                            hits.append(sum(count[x] for x in wanted[q]))
            ids = batch.column("id").take(pa.array(row, pa.int64()))
            more = pa.table({"query": pa.array(query, pa.int32()), "id": ids, "hits": pa.array(hits, pa.int64())})
            more = pa.concat_tables([best, more]) if best is not None else more
            best = _ranked_cut(more, "query", [("hits", "descending"), ("id", "ascending")], limit)
        if best is not None:
            yield from best.to_batches()

    spark = rows.sparkSession
    names = spark.createDataFrame([(i, r.query_id) for i, r in enumerate(asked)], f"query int, query_id {query_type}")
    if not asked:
        return spark.createDataFrame([], f"query_id {query_type}, id {id_type}, rank double")
    text = F.lower(X.document(F.col("title"), F.col("description"))).alias("text")
    found = rows.select("id", text).mapInArrow(run, schema).join(names, "query")
    return found.select("query_id", "id", X.fulltext_rank(F.col("hits")).alias("rank"))


def _fulltext_joined(
    queries: DataFrame, docs: DataFrame, filters: SearchFilters | None, index: DataFrame | StoredPostings | None
) -> DataFrame:
    """Candidates come from the query's rarest word alone; the other words only confirm them."""
    words = queries.select("query_id", F.array_distinct(X.tokens(F.col("query"))).alias("_words"))
    needed = words.select("query_id", F.size("_words").alias("_n"), F.explode("_words").alias("token"))
    wanted = needed.select("token").distinct()
    if index is None:
        words = F.explode(F.concat(_tokens("title"), _tokens("description"))).alias("token")
        every = apply_filters(docs, filters).select(words, "id")
        counted = every.join(wanted, "token", "left_semi").groupBy("token", "id")
        used = counted.agg(F.count(F.lit(1)).alias("tf"))
    else:
        found = index.join(wanted, "token", "left_semi") if isinstance(index, DataFrame) else index.holding(wanted)
        used = _in_scope(found.select("token", "id", "tf"), docs, filters)
    frequency = used.groupBy("token").agg(F.count(F.lit(1)).alias("_df"))
    # A word no record has leaves its query out of this join, and with it all candidates.
    known = needed.join(frequency, "token")
    rarest = (
        known.groupBy("query_id", "_n")
        .agg(F.min(F.struct("_df", "token")).alias("_first"), F.count(F.lit(1)).alias("_known"))
        .filter(F.col("_known") == F.col("_n"))
        .select("query_id", F.col("_first.token").alias("token"))
    )
    candidates = used.select("token", "id").join(rarest, "token").select("query_id", "id")
    confirmed = (
        candidates.join(needed, "query_id")
        .join(used, ["token", "id"])
        .groupBy("query_id", "id", "_n")
        .agg(F.count(F.lit(1)).alias("_found"), F.sum("tf").alias("_hits"))
        .filter(F.col("_found") == F.col("_n"))
    )
    return confirmed.select("query_id", "id", X.fulltext_rank(F.col("_hits")).alias("rank"))


def fuzzy_search(
    queries: DataFrame,
    docs: DataFrame,
    columns: tuple[str, ...] = ("title", "proposer"),
    limit: int = S.TOP_K,
    cut: float = S.TRIGRAM_CUT,
    salts: int = 16,
) -> DataFrame:
    """``(query_id, id, similarity, position)`` for a table ``(query_id, query)``.

    Queries of equal trigrams are answered once. The rows of a ``query_id`` that repeats are one query, of all their trigrams.
    """
    grams = queries.select("query_id", F.explode(X.trigrams(F.col("query"))).alias("_gram"))
    # trigrams hold letters, digits and blanks only
    asked = grams.groupBy("query_id").agg(F.array_join(F.sort_array(F.collect_list("_gram")), "\n").alias("_text"))
    texts = written(asked.select("_text").distinct().select("_text", F.split("_text", "\n").alias("_grams")), "fuzzy-texts")
    found = union_all(*[_fuzzy_column(texts, docs.select("id", F.col(c).alias("value")), limit, cut, salts) for c in columns])
    scored = found.groupBy("_text", "id").agg(F.max("similarity").alias("similarity"))
    best = _top_per_query(scored, "similarity", limit, "_text")
    # a side's size is no measure of what Spark would send to every task, see _fuzzy_column
    return asked.join(best.hint("merge"), "_text").select("query_id", "id", "similarity", "position")


def _size_class(size: Column) -> Column:
    """The smallest size of the class that a number of trigrams belongs to."""
    return F.greatest(*[F.when(size >= x, F.lit(x)) for x in SIZE_CLASSES])


def _least_shared(one: Column, other: Column, cut: float) -> Column:
    """How many trigrams sets of two sizes must share to reach ``cut``."""
    return F.greatest(F.lit(1), F.ceil((one + other) * F.lit(cut / (1 + cut)) - F.lit(1e-9))).cast("int")


def _indexed(rows: DataFrame, size: str, others: list[int], cut: float, keep: Column) -> DataFrame:
    """Rows with ``_own``, their trigrams that both sides have from the rarest on, once for each size class of the other side and
    each of the trigrams that they may share with it first: so many that fewer than needed are left behind them."""
    first = F.size("_own") - _least_shared(F.col(size), F.col("_other"), cut) + 1
    dealt = rows.withColumn("_other", F.explode(F.array(*[F.lit(x) for x in others]))).filter(first > 0)
    dealt = dealt.select("*", F.posexplode(F.slice("_own", F.lit(1), first)).alias("_place", "_first"))
    return dealt.select(
        *rows.drop("_own").columns, "_other", F.transform("_own", lambda x: x["gram"]).alias("_own"),
        F.col("_first.gram").alias("_gram"), F.col("_first.times").alias("_times"), keep.alias("_salt"), (F.size("_own") - F.col("_place")).alias("_left"),
    )


def _fuzzy_column(texts: DataFrame, docs: DataFrame, limit: int, cut: float, salts: int) -> DataFrame:
    """Best records of each text of sorted trigrams by one column.

    Equal values are compared once. Sets of ``n`` and ``m`` trigrams that reach ``cut`` share ``k = ceil(cut * (n + m) /
    (1 + cut))`` at least. So, in one order of the trigrams that both sides have, the first one that they share has ``k - 1``
    or more behind it in either set: each set is found by its rarest few only, fewer the nearer the two sizes are
    to each other, and the pair is kept at the first trigram that both have. Of a repeated value only the ``limit`` smallest
    ids can be among the best, so a value that fills a third of the table stays small.
    """
    spark = texts.sparkSession
    docs = docs.filter(F.col("value").isNotNull())
    by_id = Window.partitionBy("value").orderBy("id")
    holders = docs.withColumn("_n", F.row_number().over(by_id)).filter(F.col("_n") <= limit).select("value", "id")
    # Comparing and cutting up are the work here, not moving bytes: keep the session's own number of tasks,
    # which adaptive execution would otherwise lower for what looks like little data.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Trigrams are written once: what reads them would cut up every value again, in each place that names them.
    values = docs.select("value").distinct().repartition(tasks, "value").select("value", X.trigrams(F.col("value")).alias("_grams"))
    values = written(values, "fuzzy-values").select("*", F.size("_grams").alias("_m")).repartition(tasks, "value")
    texts = texts.select("*", F.size("_grams").alias("_n"))

    # how many values have a trigram; those that begin with # are the size classes of the values, none for no trigrams
    marked = F.concat("_grams", F.array(F.concat(F.lit("#"), _size_class(F.col("_m")).cast("string"))))
    counts = values.select(F.explode(marked).alias("_gram")).groupBy("_gram").agg(F.count(F.lit(1)).alias("_df"))
    counts = written(counts, "fuzzy-counts")
    value_sizes = sorted(int(r[0][1:]) for r in counts.filter(F.col("_gram").startswith("#")).select("_gram").collect())
    text_sizes = sorted(r[0] for r in texts.select(_size_class(F.col("_n"))).distinct().collect())
    asked = texts.select(F.explode("_grams").alias("_gram"))
    frequency = broadcast_if(counts.join(asked.distinct(), "_gram", "left_semi"), at_most(counts, MAX_WORDS))

    def ordered(rows: DataFrame, *key: str) -> DataFrame:
        """Their trigrams that both sides have, the rarest first, each with the number of times it is there."""
        each = rows.select(*key, F.explode("_grams").alias("_gram")).join(frequency, "_gram")
        if "_text" in key:  # a repeated query_id may bring a trigram more than once
            each = each.groupBy(*key, "_gram", "_df").agg(F.count(F.lit(1)).cast("int").alias("_times"))
        else:
            each = each.withColumn("_times", F.lit(1))
        gram = F.struct(F.col("_df").alias("df"), F.col("_gram").alias("gram"), F.col("_times").alias("times"))
        own = each.groupBy(*key).agg(F.sort_array(F.collect_list(gram)).alias("_own"))
        return own.withColumn("_size", _size_class(F.col(key[1])))

    # a trigram of very many values is dealt out, to more parts the more it has
    df, part = F.col("_first.df"), salts * SALTED_ROWS
    parts = F.when(df <= SALTED_ROWS, F.lit(1)).otherwise(F.lit(salts) * F.ceil(df / F.lit(part))).cast("int")
    held = _indexed(ordered(values, "value", "_m"), "_m", text_sizes, cut, F.pmod(F.xxhash64("value"), parts).cast("int"))
    held = held.withColumnsRenamed({"_own": "_held", "_left": "_held_left", "_size": "_class", "_other": "_asked_class"}).drop("_times")
    probes = _indexed(ordered(texts, "_text", "_n"), "_n", value_sizes, cut, F.explode(F.sequence(F.lit(0), parts - 1)))
    probes = probes.withColumnsRenamed({"_size": "_asked_class", "_other": "_class"})
    key = ["_gram", "_salt", "_class", "_asked_class"]
    probes = probes.repartition(tasks, *key)
    # What both have from this trigram on; a cheap test before any array is looked at.
    enough = F.least("_left", "_held_left") >= _least_shared(F.col("_n"), F.col("_m"), cut)
    # Exploded probes and holders are far more than the columns they come from, by whose size Spark would
    # send them through the driver to every task.
    pairs = held.join(probes.hint("merge"), key).filter(enough)
    pairs = pairs.select("_text", "value", "_gram", "_times", "_n", "_m", F.array_intersect("_own", "_held").alias("_both"))
    shared = F.size("_both")
    score = shared.cast("double") / (F.col("_n") + F.col("_m") - shared)
    near = pairs.filter(F.get("_both", F.lit(0)) == F.col("_gram")).select("_text", "value", "_times", score.alias("similarity"))
    near = near.filter(F.col("similarity") >= cut).join(holders.hint("merge"), "value")
    near = near.withColumn("_again", F.explode(F.array_repeat(F.lit(0), F.col("_times"))))
    return _top_per_query(near, "similarity", limit, "_text").select("_text", "id", "similarity")
