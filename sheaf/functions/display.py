"""Columns as a result table shows them."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheaf.functions.normalize import strip
from sheaf.functions.text import shorten

# Hosts and path segments of the outside pages of a record.
SITES = ["polkassembly", "subsquare", "subscan"]
SITE_HOSTS = {"polkassembly": "polkassembly.io", "subsquare": "subsquare.io", "subscan": "subscan.io"}
TYPE_PATHS = [
    ("treasury", "/treasury"),
    ("council", "/council"),
    ("tip", "/tips"),
    ("bounty", "/bounties"),
]
DEFAULT_PATH = "/referenda"

# What a browser's regular expressions take for white space.
_SPACE = r"[\s\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
_NOT_SPACE = _SPACE.replace("[", "[^", 1)

# Repairs of a description, applied in this order: plain texts, then patterns,
# then (once the whole is wrapped in a paragraph) the last patterns.
TEXT_REPAIRS = [
    ("x20", " "),
    ("&#x20;", " "),
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("httpsdocs.google.com", "https://docs.google.com"),
    ("httpsforms.gle", "https://forms.gle"),
    ("httpst.co", "https://t.co"),
    ("httpsdrive.google.com", "https://drive.google.com"),
]
MARKUP_REPAIRS = [
    (r"\*\*(.*?)\*\*", "<strong>$1</strong>"),
    (r"\*(.*?)\*", "<em>$1</em>"),
    (r"\* (.*?)(?=\n|\z)", "<li>$1</li>"),
    (r"\d+\. (.*?)(?=\n|\z)", "<li>$1</li>"),
    (r"\n\n+", "</p><p>"),
    (r"\n", "<br>"),
]
SPACING_REPAIRS = [
    (rf"{_SPACE}+", " "),
    (r"\s*<br>\s*", "<br>"),
    (r"\s*</p>\s*<p>\s*", "</p><p>"),
    (
        rf"(https?://{_NOT_SPACE}+)",
        '<a href="$1" target="_blank" rel="noopener noreferrer" '
        'class="text-blue-600 hover:text-blue-800 underline">$1</a>',
    ),
]

# Clean-up of a text for a table cell, applied in this order.
TEXT_CLEANUPS = [
    (r"\*\*(.*?)\*\*", "$1"),
    (r"\*(.*?)\*", "$1"),
    (r"`(.*?)`", "$1"),
    (rf"#{{1,6}}{_SPACE}*", ""),
    (rf"{_SPACE}+", " "),
    (rf"[^{string.ascii_letters}{string.digits}_ .,!?()-]", ""),  # no ranges: ten times faster
]


def _missing(c: Column) -> Column:
    return c.isNull() | (c == "")


def _replace_all(c: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, replacement in steps:
        c = F.regexp_replace(c, pattern, replacement)
    return c


def display_text(c: Column) -> Column:
    return F.when(_missing(c), F.lit("-")).otherwise(strip(_replace_all(c, TEXT_CLEANUPS)))


def display_first_sentence(c: Column, n: int = 100) -> Column:
    return shorten(F.substring_index(display_text(c), ".", 1), n)


def display_amount(amount: Column, currency: Column) -> Column:
    # Half-even rounding of the built-in formatter would turn 0.125 into 0.12.
    text = F.format_number(F.round(amount.cast("decimal(38,10)"), 2), 2)
    shown = F.when(_missing(currency), text).otherwise(F.concat(text, F.lit(" "), currency))
    return F.coalesce(shown, F.lit("-"))


def display_date(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "MMM d, yyyy"), F.lit("-"))


def display_type(c: Column, missing: str = "-") -> Column:
    spaced = F.regexp_replace(c, "([A-Z])", " $1")
    capital = F.concat(F.upper(F.substring(spaced, 1, 1)), F.substr(spaced, F.lit(2)))
    return F.when(_missing(c), F.lit(missing)).otherwise(strip(capital))


def strip_tags(c: Column) -> Column:
    return F.coalesce(strip(F.regexp_replace(c, "<[^>]*>", "")), F.lit(""))


def first_line_without_tags(c: Column) -> Column:
    line = F.substring_index(strip_tags(c), "\n", 1)
    return F.when(_missing(c), F.lit("No description available")).otherwise(line)


def repair_description(c: Column) -> Column:
    text = c
    for broken, whole in TEXT_REPAIRS:
        text = F.replace(text, F.lit(broken), F.lit(whole))
    text = F.concat(F.lit("<p>"), _replace_all(text, MARKUP_REPAIRS), F.lit("</p>"))
    return F.when(_missing(c), F.lit("")).otherwise(_replace_all(text, SPACING_REPAIRS))


def external_links(network: Column, type: Column, id: Column, simple: bool = False) -> Column:
    """Struct of one URL per site, null without an id. ``simple`` ignores the type."""
    name = F.lower(blank_default(network, "polkadot"))
    host = F.when(name == "kusama", F.lit("kusama")).otherwise(F.lit("polkadot"))
    if simple:
        path: Column = F.lit("/proposal")
    else:
        kind = F.lower(blank_default(type, "referendum"))
        path = F.lit(DEFAULT_PATH)
        for word, segment in reversed(TYPE_PATHS):
            path = F.when(F.contains(kind, F.lit(word)), F.lit(segment)).otherwise(path)
    urls = [
        F.concat(F.lit("https://"), host, F.lit(f".{SITE_HOSTS[s]}"), path, F.lit("/"), id).alias(s) for s in SITES
    ]
    return F.when(~_missing(id), F.struct(*urls))


def blank_default(c: Column, default: str) -> Column:
    return F.when(_missing(c), F.lit(default)).otherwise(c)


def display_table(
    df,
    title: str = "title",
    description: str = "description",
    amount: str = "amount_numeric",
    currency: str = "currency",
    created_at: str = "created_at",
    type: str = "type",
    network: str = "network",
    id: str = "id",
):
    """A result table with every column in its shown form, in one projection."""
    c = F.col
    return df.select(
        c(id).cast("string").alias("id"),
        display_text(c(title)).alias("title"),
        display_first_sentence(c(description)).alias("summary"),
        display_amount(c(amount), c(currency)).alias("amount"),
        display_date(c(created_at)).alias("created"),
        display_type(c(type)).alias("type"),
        repair_description(c(description)).alias("description_html"),
        external_links(c(network), c(type), c(id).cast("string")).alias("links"),
    )
