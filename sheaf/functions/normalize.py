"""Cleaning of raw field values, as Column expressions."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheaf.schema import RECORD_TYPES

# The characters that count as white space when a field is stripped.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Short network names, and the words users may send for a type.
NETWORK_ALIASES = {"dot": "polkadot", "ksm": "kusama"}
TYPE_WORDS = {
    "treasury": "TreasuryProposal",
    "democracy": "DemocracyProposal",
    "referendum": "Referendum",
    "bounty": "Bounty",
    "tip": "Tip",
    "council": "CouncilMotion",
    "tech": "TechCommitteeProposal",
}

_AMOUNT_SHAPE = (
    r"^[+-]?(\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"
    r"|^[+-]?(?i:inf|infinity|nan)$"
)
_TIME_SHAPE = r"^\d{4}-\d{1,2}-\d{1,2}([T ]\d{1,2}:\d{1,2}:\d{1,2}(\.\d{1,6})?Z?)?$"
# Other time formats, each with the shape a text must have to be tried with it.
_ZONE = r"(Z|[+-]\d{2}:\d{2})"
_CLOCK = r"( \d{1,2}:\d{1,2}:\d{1,2})?"
_LENIENT_FORMATS = [
    ("yyyy-M-d'T'H:m:s[.SSSSSS]XXX", rf"^\d{{4}}-\d{{1,2}}-\d{{1,2}}T\d{{1,2}}:\d{{1,2}}:\d{{1,2}}(\.\d{{1,6}})?{_ZONE}$"),
    ("yyyy-M-d H:m:s[.SSSSSS]XXX", rf"^\d{{4}}-\d{{1,2}}-\d{{1,2}} \d{{1,2}}:\d{{1,2}}:\d{{1,2}}(\.\d{{1,6}})?{_ZONE}$"),
    ("yyyy-M-d'T'H:mXXX", rf"^\d{{4}}-\d{{1,2}}-\d{{1,2}}T\d{{1,2}}:\d{{1,2}}{_ZONE}$"),
    ("yyyy-M-d[' ']['T']H:m", r"^\d{4}-\d{1,2}-\d{1,2}[ T]\d{1,2}:\d{1,2}$"),
    ("yyyy/M/d[ H:m:s]", rf"^\d{{4}}/\d{{1,2}}/\d{{1,2}}{_CLOCK}$"),
    ("M/d/yyyy[ H:m:s]", rf"^\d{{1,2}}/\d{{1,2}}/\d{{4}}{_CLOCK}$"),
    ("MMM d, yyyy[ H:m:s]", rf"^[A-Z][a-z]{{2}} \d{{1,2}}, \d{{4}}{_CLOCK}$"),
    ("MMMM d, yyyy[ H:m:s]", rf"^[A-Z][a-z]{{3,}} \d{{1,2}}, \d{{4}}{_CLOCK}$"),
    ("d MMM yyyy[ H:m:s]", rf"^\d{{1,2}} [A-Z][a-z]{{2}} \d{{4}}{_CLOCK}$"),
    ("d MMMM yyyy[ H:m:s]", rf"^\d{{1,2}} [A-Z][a-z]{{3,}} \d{{4}}{_CLOCK}$"),
]


def strip(c: Column) -> Column:
    """Both ends without white space of any kind."""
    return F.btrim(c, F.lit(WHITESPACE))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def lookup(c: Column, table: dict[str, str]) -> Column:
    """Value of a small fixed table, null when the key is absent."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), c)


def type_spellings() -> dict[str, str]:
    """Lower-case and snake-case spelling of each known type, to its canonical name."""
    table = {}
    for name in RECORD_TYPES:
        table[name.lower()] = name
        table[re.sub(r"(?<!^)(?=[A-Z])", "_", name).lower()] = name
    return table


def normalize_network(c: Column) -> Column:
    key = strip(F.lower(c))
    known = F.coalesce(lookup(key, NETWORK_ALIASES), key)
    return F.when(c.isNull() | (c == ""), F.lit("polkadot")).otherwise(known)


def normalize_type(c: Column) -> Column:
    """Canonical name of a known spelling; anything else stays exactly as it came."""
    known = lookup(strip(F.lower(c)), type_spellings())
    return F.when(c.isNull() | (c == ""), F.lit("Unknown")).otherwise(F.coalesce(known, c))


def type_from_word(c: Column) -> Column:
    """Type named by a user's short word, else the word itself."""
    return F.coalesce(lookup(F.lower(c), TYPE_WORDS), c)


def normalize_amount(c: Column) -> Column:
    """Text amount to double; null if what is left after signs and commas is no number."""
    bare = strip(F.regexp_replace(strip(c), r"[,$€£]", ""))
    number = F.regexp_replace(bare, "_", "").try_cast("double")
    return F.when(bare.rlike(_AMOUNT_SHAPE), number)


def normalize_currency(c: Column) -> Column:
    return F.when(c != "", strip(F.upper(c)))


def normalize_created_at(c: Column, as_of: datetime) -> Column:
    """Text to timestamp (UTC). What no format fits becomes ``as_of``."""
    text = strip(c)
    usual = F.when(text.rlike(_TIME_SHAPE), text.try_cast("timestamp"))
    # A parse that fails is far dearer than a look at the shape.
    lenient = [F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(f))) for f, shape in _LENIENT_FORMATS]
    return F.coalesce(usual, *lenient, F.lit(as_of).cast("timestamp"))


def token_estimate(c: Column) -> Column:
    """Rough model-token count of a text: words times 1.3."""
    text = strip(c)
    words = F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, r"(?U)\s+")))
    return words * F.lit(1.3)
