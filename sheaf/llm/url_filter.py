"""URL rules found by their rarest literal token, in DataFrame functions only.

A rule is a regular expression over host + path together with the literal tokens that every
matching URL holds, or with several of which every matching URL holds one. Rules are indexed by the
one of their tokens, or by all of such a set, that fewest URLs hold. A URL's own tokens fetch the
rules that can match it; only those run their expression. Among the rules that match, the one of highest rank wins, then the longest, then the first by name.

Verdicts are made once per distinct URL and joined back, so a URL held by a third of all rows costs
one evaluation. The rule index is broadcast behind a check of its size (:data:`MAX_BROADCAST_RULES`);
beyond it Spark joins by token. A null or unparsable URL has empty host and path, no tokens and
hence no rule: it is allowed. Repeated rows are kept, extra columns are not read.

Rules are given as a list, or as a table of any size (:func:`site_rule_table`, :func:`checked_rules`).
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm.common import ascii_lower
from sheaf.session import at_most

MAX_BROADCAST_RULES = 100_000
SITE_RANK, PATTERN_RANK = 2, 1


@dataclass(frozen=True)
class UrlRule:
    """``pattern`` is matched against host + path; ``tokens`` are lower-case literals it implies, of
    ``one_of`` it implies at least one. Both are whole tokens: what the pattern lets run on into
    other letters or digits is none."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int = PATTERN_RANK
    one_of: tuple[str, ...] = ()

    def __post_init__(self):
        if not (self.tokens or self.one_of) or self.verdict not in ("allow", "block"):
            raise ValueError(f"rule {self.name}: a literal token and a verdict are needed")
        re.compile(self.pattern)


def tokens_of(literal: str) -> list[str]:
    return [t for t in re.split("[^a-z0-9]+", literal.lower()) if t]


def site_rule(verdict: str, host: str, path: str) -> UrlRule:
    """A rule for a host and its subdomains below a path. The last path token may be a mere
    beginning of the URL's token, so it only counts as literal if the path goes on after it."""
    whole = path[: max(path.rfind(c) for c in "/-._~")] if re.search("[A-Za-z0-9]$", path) else path
    pattern = rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}"
    return UrlRule(host + path, verdict, pattern, tuple(tokens_of(f"{host} {whole}")), SITE_RANK)


def host_word(word: str) -> UrlRule:
    """Blocks hosts with a label that is exactly these words joined by hyphens."""
    return UrlRule(word, "block", rf"^(?:[^/]*\.)?{re.escape(word)}\.[^/]+(?:/|$)", tuple(tokens_of(word)))


#: The rules of the registered query, fixed values.
SITE_RULES = (
    site_rule("allow", "org", "/"),
    site_rule("block", "example.org", "/es/"),
    site_rule("block", "example.org", "/en/1"),
    site_rule("allow", "com", "/fr/"),
    site_rule("block", "com", "/de/"),
)
#: Words of hosts and paths that mark spam, malware and adult sites; a starting set to add to.
PATTERN_RULES = (
    host_word("spam-farm"),
    host_word("cheap-pills"),
    host_word("free-casino"),
    host_word("adult-cams"),
    UrlRule("pharmacy offers", "block", r"(?i)(?:^|[./-])(?:buy|cheap|discount)-[a-z]*-?pills(?:[./-]|$)", (), one_of=("buy", "cheap", "discount")),
    UrlRule("casino hosts", "block", r"^(?:[^/]*[.-])?casino[.-][^/]*(?:/|$)", ("casino",)),
    UrlRule("porn hosts", "block", r"^(?:[^/]*[.-])?porn[.-][^/]*(?:/|$)", ("porn",)),
    UrlRule("warez paths", "block", r"(?i)/(?:[^/]*-)?warez(?:[/.-]|$)", ("warez",)),
    UrlRule("log-in pages", "block", r"(?i)/wp-login\.php$", ("wp", "login", "php")),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without a ``://``."""
    text = F.coalesce(url, F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise(F.lit(""))
    before_query = F.substring_index(F.substring_index(rest, "#", 1), "?", 1)
    host = F.substring_index(before_query, "/", 1)
    return ascii_lower(host), F.substring(before_query, F.length(host) + 1, F.length(before_query))


def rule_frame(spark: SparkSession, rules: Sequence[UrlRule]) -> DataFrame:
    """Rules with their ``choices``: sets of tokens, of each of which a matching URL holds one."""
    choices = [[[t] for t in dict.fromkeys(r.tokens)] + ([list(dict.fromkeys(r.one_of))] if r.one_of else []) for r in rules]
    rows = [(r.name, r.verdict, r.pattern, c, r.rank) for r, c in zip(rules, choices, strict=True)]
    return spark.createDataFrame(rows, "rule string, rule_verdict string, pattern string, choices array<array<string>>, rank int")


def checked_rules(rules: DataFrame) -> DataFrame:
    """A table of rules with the columns of :func:`rule_frame`. A rule without a name, pattern, rank or verdict,
    or without a set of tokens to fetch it by, is an error: no URL would ever meet it."""
    rules = rules.select("rule", "rule_verdict", "pattern", F.col("choices").cast("array<array<string>>"), F.col("rank").cast("int"))
    named = F.col("rule").isNotNull() & F.col("pattern").isNotNull() & F.col("rank").isNotNull()
    fetched = (F.size("choices") > 0) & F.forall("choices", lambda c: (F.size(c) > 0) & F.forall(c, lambda t: t.rlike("^[a-z0-9]+$")))
    fit = named & F.col("rule_verdict").isin("allow", "block") & fetched
    bad = rules.filter(~F.coalesce(fit, F.lit(False))).select("rule").limit(3).collect()
    if bad:
        raise ValueError(f"rules without name, verdict, pattern, rank or tokens: {[r.rule for r in bad]}")
    return rules


def site_rule_table(sites: DataFrame) -> DataFrame:
    """Rules from a table ``(host, path, verdict)``, such as a published block list: each fits its host and all
    subdomains, for paths that start with ``path`` (null or empty: all). Of rules that repeat with
    both verdicts ``allow`` wins. Extra columns are not read; a host without a letter or digit is refused by :func:`checked_rules`."""
    host, path = ascii_lower(F.col("host")), F.coalesce("path", F.lit(""))
    literal = lambda c: F.regexp_replace(c, r"([\\.\[\]{}()*+?^$|-])", r"\\$1")
    # the end of a path may be a mere beginning of the URL's token
    whole = F.concat_ws(" ", F.lower(host), F.regexp_replace(F.lower(path), "[a-z0-9]+$", ""))
    tokens = F.array_distinct(F.filter(F.split(whole, "[^a-z0-9]+"), lambda t: t != ""))
    return sites.select(
        F.concat(host, path).alias("rule"),
        F.col("verdict").alias("rule_verdict"),
        F.concat(F.lit(r"^(?:[^/]*\.)?"), literal(host), F.lit("(?=/|$)"), literal(path)).alias("pattern"),
        F.transform(tokens, lambda t: F.array(t)).alias("choices"),
        F.lit(SITE_RANK).alias("rank"),
    ).distinct()


def rule_index(rules: DataFrame, url_tokens: DataFrame, small: bool) -> DataFrame:
    """Each rule under the tokens of its rarest choice. ``url_tokens``: one row per distinct URL and token.

    A token that no URL holds is rarest of all; its rules are never fetched.
    """
    rule = ["rule", "rule_verdict", "pattern", "rank"]
    each = rules.select(*rule, F.explode("choices").alias("choice")).select("*", F.explode("choice").alias("token"))
    wanted = each.select("token").distinct()
    held = url_tokens.join(F.broadcast(wanted) if small else wanted, "token").groupBy("token").agg(F.count("*").alias("urls"))
    counted = each.join(held, "token", "left").groupBy(*rule, "choice").agg(F.sum(F.coalesce("urls", F.lit(0))).alias("urls"))
    rarest = counted.groupBy(*rule).agg(F.min(F.struct("urls", "choice")).alias("by"))
    return rarest.select(*rule, F.explode("by.choice").alias("token"))


def url_verdicts(pages: DataFrame, rules: Sequence[UrlRule] | DataFrame = SITE_RULES + PATTERN_RULES) -> DataFrame:
    """page_id, url, host, path, rule (the winning rule's name), rank, verdict of every page.

    ``rules`` is a list of rules or a table with the columns of :func:`rule_frame`.

    ``rule`` and ``rank`` are null where no rule matches; such pages are allowed.
    """
    spark = pages.sparkSession
    pages = pages.select("page_id", "url")
    urls = pages.filter(F.col("url").isNotNull()).select("url").distinct()
    host, path = host_and_path(F.col("url"))
    sites = urls.select("url", F.concat(host, path).alias("site"))
    pieces = F.array_distinct(F.split(F.lower("site"), "[^a-z0-9]+"))
    url_tokens = sites.select("url", "site", F.explode(pieces).alias("token"))
    if isinstance(rules, DataFrame):
        table = checked_rules(rules)
        small = at_most(table, MAX_BROADCAST_RULES)
    else:
        table, small = rule_frame(spark, rules), len(rules) <= MAX_BROADCAST_RULES
    index = rule_index(table, url_tokens.select("token"), small)
    fetched = url_tokens.join(F.broadcast(index) if small else index, "token")
    fits = fetched.filter(F.expr("regexp_like(site, pattern)"))
    best = fits.groupBy("url").agg(
        F.min(F.struct((-F.col("rank")).alias("r"), (-F.length("rule")).alias("l"), "rule", "rule_verdict")).alias("best")
    )
    judged = pages.join(best, "url", "left")
    return judged.select(
        "page_id",
        "url",
        host.alias("host"),
        path.alias("path"),
        F.col("best.rule").alias("rule"),
        (-F.col("best.r")).alias("rank"),
        F.coalesce("best.rule_verdict", F.lit("allow")).alias("verdict"),
    )
