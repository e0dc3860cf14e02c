"""Intent, time window and network of a question, as Column expressions on its text."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names in the order they are tried.
MONTHS = [
    ("january", 1), ("jan", 1),
    ("february", 2), ("feb", 2),
    ("march", 3), ("mar", 3),
    ("april", 4), ("apr", 4),
    ("may", 5),
    ("june", 6), ("jun", 6),
    ("july", 7), ("jul", 7),
    ("august", 8), ("aug", 8),
    ("september", 9), ("sep", 9), ("sept", 9),
    ("october", 10), ("oct", 10),
    ("november", 11), ("nov", 11),
    ("december", 12), ("dec", 12),
]

# Network words in the order they are tried.
NETWORK_WORDS = [
    ("polkadot", "polkadot"),
    ("dot", "polkadot"),
    ("kusama", "kusama"),
    ("ksm", "kusama"),
    ("substrate", "substrate"),
    ("westend", "westend"),
    ("rococo", "rococo"),
]

# Words and phrases of each intent.
ID_PHRASES = [
    "proposal with id", "proposal id", "id is", "id =", "id:",
    "proposal #", "proposal number", "specific proposal", "details of proposal",
]
DETAIL_PHRASES = ["give me the details", "show me the details", "get the details"]
COUNT_WORDS = ["how many", "count", "total"]
EXAMPLE_PHRASES = [
    "show some", "name a few", "give examples", "show examples",
    "and show", "and name", "and give", "and show some", "and name a few",
]
ANALYTIC_WORDS = [
    "how many", "count", "total", "number of", "amount", "amounts",
    "highest", "lowest", "average", "sum", "statistics",
    "most", "least", "maximum", "minimum", "show me proposal amounts",
]
DATE_WORDS = [
    "recent", "after", "before", "between", "since", "until",
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
    "jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec",
    "2024", "2025", "2026", "2027", "2028", "2029", "2030",
]
DATE_SHAPES = [r"\d{4}-\d{2}-\d{2}", r"\d{2}/\d{2}/\d{4}", r"\d{4}/\d{2}/\d{2}", r"\d{1,2}/\d{1,2}/\d{4}"]
FILTER_NETWORKS = ["kusama", "polkadot", "westend", "rococo"]
FILTER_TYPES = ["treasury", "council", "referendum", "bounty", "tip", "motion"]
FILTER_VERBS = ["find", "what", "show me", "get", "list", "all"]
SEARCH_PHRASES = ["find", "search", "show me", "tell me about", "what", "which", "get", "look for", "discover"]
ENTITIES = [
    "clarys", "subsquare", "polkadot", "kusama", "treasury",
    "council", "referendum", "bounty", "tip",
]
GENERAL_STOPPERS = ["how many", "count", "total", "amount"]
COUNT_QUESTION = "count|how many|total|number of"


def mentions(c: Column, phrases: Sequence[str], word_boundary: bool = False) -> Column:
    """Any phrase occurs in the text. By default inside words too, as in ``market`` for
    ``mar``; with ``word_boundary`` only as whole words."""
    if len(phrases) == 1 and not word_boundary:
        return F.contains(c, F.lit(phrases[0]))
    pattern = "|".join(re.escape(p) for p in dict.fromkeys(phrases))
    if word_boundary:
        pattern = rf"(?U)(?<!\w)(?:{pattern})(?!\w)"
    return c.rlike(pattern)


def network_in(text: Column, word_boundary: bool = False) -> Column:
    """Network of the first known word, in table order, that a lower-case text holds."""
    out = None
    for word, network in NETWORK_WORDS:
        hit = mentions(text, [word], word_boundary)
        out = F.when(hit, F.lit(network)) if out is None else out.when(hit, F.lit(network))
    return out


def network_of(question: Column, word_boundary: bool = False) -> Column:
    """Network named in a question, null if none."""
    return network_in(F.lower(question), word_boundary)


def month_of(text: Column, word_boundary: bool = False) -> Column:
    """Number of the first month, in calendar order, that a lower-case text names."""
    names: dict[int, list[str]] = {}
    for name, number in MONTHS:
        names.setdefault(number, []).append(name)
    found = []
    for number, spellings in names.items():
        # Without word boundaries the shortest spelling occurs wherever a longer one does.
        tried = spellings if word_boundary else [min(spellings, key=len)]
        found.append(F.when(mentions(text, tried, word_boundary), F.lit(number)))
    return F.least(*found)


def first_of_month(text: Column, word_boundary: bool = False) -> Column:
    """``YYYY-MM-01`` of the month a lower-case text names, as text, null if it names none.

    A month name counts with the first four digits anywhere in the text; without a month name,
    ``YYYY-MM`` is taken. The month need not exist.
    """
    year = F.regexp_substr(text, F.lit(r"\d{4}"))
    month = F.lpad(month_of(text, word_boundary).cast("string"), 2, "0")
    numbers = F.regexp_substr(text, F.lit(r"\d{4}-\d{2}"))
    return F.coalesce(
        F.concat(year, F.lit("-"), month, F.lit("-01")), F.concat(numbers, F.lit("-01"))
    )


def month_start(first: Column) -> Column:
    """Date of :func:`first_of_month`, null for a month that does not exist."""
    return F.when(~first.startswith("0000"), first.try_cast("date"))


def month_window(question: Column, word_boundary: bool = False) -> Column:
    """``struct(from_ts, to_ts)`` of the month a question names, null if it names none."""
    first = first_of_month(F.lower(question), word_boundary)
    start = month_start(first)
    window = F.struct(start.cast("timestamp").alias("from_ts"), F.add_months(start, 1).cast("timestamp").alias("to_ts"))
    return F.when(first.isNotNull(), window)


def is_exact_lookup(question: Column) -> Column:
    text = F.lower(question)
    numbered = F.contains(text, F.lit("proposal")) & question.rlike(r"(?U)\d")
    return mentions(text, ID_PHRASES) | numbered | mentions(text, DETAIL_PHRASES)


def is_mixed(question: Column) -> Column:
    text = F.lower(question)
    return mentions(text, COUNT_WORDS) & mentions(text, EXAMPLE_PHRASES)


def is_analytical(question: Column) -> Column:
    return mentions(F.lower(question), ANALYTIC_WORDS)


def is_date_filtered(question: Column) -> Column:
    text = F.lower(question)
    return mentions(text, DATE_WORDS) | text.rlike("|".join(DATE_SHAPES))


def is_filtered(question: Column) -> Column:
    text = F.lower(question)
    return mentions(text, FILTER_NETWORKS + FILTER_TYPES) & mentions(text, FILTER_VERBS)


def is_semantic(question: Column) -> Column:
    text = F.lower(question)
    general = (
        F.contains(text, F.lit("proposal")) & ~text.rlike(r"(?U)\d") & ~mentions(text, GENERAL_STOPPERS)
    )
    return mentions(text, SEARCH_PHRASES) | mentions(text, ENTITIES) | general


def intent(question: Column) -> Column:
    """The first intent that fits; the order decides."""
    return (
        F.when(is_exact_lookup(question), F.lit("exact_lookup"))
        .when(is_mixed(question), F.lit("mixed"))
        .when(is_analytical(question), F.lit("analytical"))
        .when(is_date_filtered(question), F.lit("date_filtered"))
        .when(is_filtered(question), F.lit("filtered"))
        .when(is_semantic(question), F.lit("semantic"))
        .otherwise(F.lit("general"))
    )


def route_of(intent_name: Column) -> Column:
    return (
        F.when(intent_name == "semantic", F.lit("retrieval_agent"))
        .when(intent_name == "general", F.lit("composer"))
        .otherwise(F.lit("sql_agent"))
    )


def is_count_question(question: Column) -> Column:
    return question.rlike(f"(?i){COUNT_QUESTION}")
