"""Text columns: search tokens, trigrams, cleaned text, embedding text, snippets."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheaf import schema as S
from sheaf.functions.normalize import strip

# A word is a run of letters, digits and underscores; trigrams skip underscores.
WORD = r"[\p{L}\p{N}_]+"
TRIGRAM_GAP = r"[^\p{L}\p{N}]+"

# Words of a query that never count as key terms.
STOP_WORDS = [
    "tell", "me", "about", "the", "a", "an", "and", "or", "but",
    "in", "on", "at", "to", "for", "of", "with", "by",
]


def tokens(c: Column) -> Column:
    """Lower-cased words in order, repeats kept."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), 0)


def document(title: Column, description: Column) -> Column:
    """The searched text of a record."""
    return F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(description, F.lit("")))


def key_terms(c: Column) -> Column:
    """Distinct query words of three letters or more that are not stop words."""
    long_words = F.filter(tokens(c), lambda w: F.char_length(w) > 2)
    return F.array_except(long_words, F.array(*[F.lit(w) for w in STOP_WORDS]))


def words_of(text: str) -> list[str]:
    """Driver-side twin of :func:`tokens`, for one literal query."""
    return re.findall(r"\w+", text.lower())


def key_terms_of(text: str) -> list[str]:
    """Driver-side twin of :func:`key_terms`."""
    return list(dict.fromkeys(w for w in words_of(text) if len(w) > 2 and w not in STOP_WORDS))


def contains_any(c: Column, terms: list[str]) -> Column:
    """True if any term occurs in the text, as plain text rather than as a pattern."""
    found = F.lit(False)
    for term in terms:
        found = found | F.contains(c, F.lit(term))
    return found


def matches_all(doc_tokens: Column, query_tokens: Column) -> Column:
    """Full-text match: the query has words and the document holds every one."""
    return (F.size(query_tokens) > 0) & (F.size(F.array_except(query_tokens, doc_tokens)) == 0)


def fulltext_rank(hits: Column) -> Column:
    """Rank from the number of query-word occurrences: grows with hits, stays below 0.5."""
    return F.lit(0.5) * (F.lit(1.0) - F.exp(F.lit(-0.1) * hits))


def occurrences(doc_tokens: Column, query_tokens: Column) -> Column:
    """How many document words are query words."""
    return F.size(F.filter(doc_tokens, lambda w: F.array_contains(query_tokens, w)))


def trigrams(c: Column) -> Column:
    """Distinct three-letter windows of each word, padded with two blanks before, one after."""
    # words three blanks apart; a window whose last two characters are blanks belongs to no word
    padded = F.concat(F.lit("  "), F.trim(F.regexp_replace(F.lower(c), TRIGRAM_GAP, "   ")), F.lit(" "))
    return F.array_distinct(F.regexp_extract_all(padded, F.lit("(?s)(?=(.(?!  )..))"), 1))


def trigrams_of(text: str) -> list[str]:
    """Driver-side twin of :func:`trigrams`."""
    grams: dict[str, None] = {}
    for word in re.findall(r"[^\W_]+", text.lower()):
        padded = f"  {word} "
        for i in range(len(word) + 1):
            grams[padded[i : i + 3]] = None
    return list(grams)


def similarity(a: Column, b: Column) -> Column:
    """Shared over united trigrams of two trigram arrays, 0 when both are empty."""
    shared = F.size(F.array_intersect(a, b))
    united = F.size(a) + F.size(b) - shared
    return F.coalesce(F.try_divide(shared.cast("double"), united), F.lit(0.0))


def clean_doc_text(title: Column, description: Column) -> Column:
    """Plain words of title and description, cut to the stored length."""
    text = strip(document(title, description))
    text = F.regexp_replace(text, r"[\x00-\x1f\x7f-\x9f]", " ")
    text = F.regexp_replace(text, r"(?U)\s+", " ")
    text = F.regexp_replace(text, r"(?U)[^\p{L}\p{N}_\s]", " ")
    return F.substring(strip(text), 1, S.CLEAN_TEXT_CHARS)


def shorten(c: Column, n: int) -> Column:
    """At most ``n`` characters, with dots where something was cut. The text is named once, so
    a costly text is not computed again for its length."""
    return F.regexp_replace(c, rf"(?s)^(.{{{n}}}).+$", "$1...")


def embedding_text(
    style: str,
    title: Column,
    description: Column,
    proposer: Column | None = None,
    network: Column | None = None,
    type: Column | None = None,
    max_description: int = S.EMBED_DESCRIPTION_CHARS,
    max_total: int = S.EMBED_TEXT_CHARS,
) -> Column:
    """Text handed to the embedding model.

    ``structured``: labelled lines, the description cut. ``plain``: title and description.
    ``capped``: plain, with the description and then the whole cut.
    """
    title = F.coalesce(title, F.lit(""))
    description = F.coalesce(description, F.lit(""))
    if style == "plain":
        return strip(F.concat_ws("\n", title, description))
    if style == "capped":
        short = shorten(description, max_description)
        return shorten(strip(F.concat_ws("\n", title, short)), max_total)
    if style != "structured":
        raise ValueError(f"unknown embedding text style: {style}")

    def line(label: str, c: Column, skip: str | None = None) -> Column:
        keep = c != ""
        if skip is not None:
            keep = keep & (c != skip)
        return F.when(keep, F.concat(F.lit(label), c))

    lines = [line("Title: ", title)]
    if proposer is not None:
        lines.append(line("Proposer: ", proposer, "Unknown"))
    if network is not None:
        lines.append(line("Network: ", network, "Unknown"))
    if type is not None:
        lines.append(line("Type: ", type))
    kept = F.when(description != "No description available", description)
    lines.append(line("Description: ", shorten(kept, max_description)))
    return strip(F.concat_ws("\n", *lines))


def snippet(title: Column, description: Column, n: int = S.SNIPPET_CHARS) -> Column:
    return (
        F.when(title != "", title)
        .when(description != "", shorten(description, n))
        .otherwise(F.lit("No description available"))
    )
