"""URL filters: each rule is indexed by its rarest literal token, and a URL runs only the rules its tokens fetch.

A rule has a pattern and the literal tokens that every URL it matches must hold. Token frequencies are counted over
all URLs for the rules' tokens; the rarest becomes the rule's key in the index. A URL is cut into tokens, the tokens
are joined with the index, and the regular expressions of the fetched rules decide.

Host rules (host, path) fit a host and its subdomains where the path starts with the rule's; of several the longest
wins, and it outranks pattern rules. Of the pattern rules that match, an ``allow`` outranks a ``block``.

Edge cases: a null URL has an empty host and path, and is allowed; without ``://`` host and path are empty and the
pattern rules look at the whole text; an empty path does not start with ``/``; a port is part of the host; rows are told
apart by a row number, so equal rows each get one; other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemesh.sources.staging import stage


@dataclass(frozen=True)
class Rule:
    """``pattern`` looks at ``host + path`` (host rules) or the lower-cased URL; ``literals`` are tokens of any match."""

    name: str
    verdict: str
    pattern: str
    literals: tuple[str, ...]
    length: int = 0  # of host and path; 0: a pattern rule


def _tokens(text: str) -> tuple[str, ...]:
    return tuple(t for t in re.split("[^a-z0-9]+", text.lower()) if t)


def host_rule(verdict: str, host: str, path: str) -> Rule:
    return Rule(host + path, verdict, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", _host_literals(host, path), len(host) + len(path))


def _host_literals(host: str, path: str) -> tuple[str, ...]:
    """Tokens of the rule that are whole tokens of the URL: the last of the path may go on in the URL."""
    whole = path if path.endswith("/") else path.rpartition("/")[0]
    return _tokens(host) + _tokens(whole)


def token_rule(*words: str, verdict: str = "block") -> Rule:
    """Words that stand side by side as tokens of the URL."""
    return Rule("-".join(words), verdict, "(?<![a-z0-9])" + "[^a-z0-9]+".join(words) + "(?![a-z0-9])", words)


HOST_RULES = (
    host_rule("block", "net", "/"), host_rule("allow", "example.net", "/en/"),
    host_rule("block", "example.com", "/de/"), host_rule("allow", "org", "/fr/"),
)
# Filtered subjects, as tokens of a URL.
PATTERN_RULES = (
    *(token_rule(w) for w in (
        "casino", "casinos", "poker", "bets", "betting", "jackpot", "slots", "porn", "porno", "xxx", "adult", "escort", "nude", "viagra",
        "cialis", "pills", "warez", "torrent", "keygen", "crack", "adserver", "doubleclick", "spam", "phishing", "malware")),
    token_rule("ads", "track"), token_rule("ad", "server"), token_rule("free", "bets"), token_rule("online", "pharmacy"),
    token_rule("click", "here"), token_rule("wp", "login"), token_rule("add", "to", "cart"),
    Rule("archive-file", "block", r"\.(?:zip)(?:[?#]|$)", ("zip",)), Rule("program-file", "block", r"\.(?:exe)(?:[?#]|$)", ("exe",)),
    Rule("image-file", "block", r"\.(?:iso)(?:[?#]|$)", ("iso",)), Rule("bounced", "block", r"[?&]redirect=https?(?::|%3a)", ("redirect",)),
)


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parse(pages: DataFrame) -> DataFrame:
    """``row``, ``page_id``, ``url``, ``host``, ``path`` and the distinct ``tokens``."""
    url, parts = F.coalesce("url", F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return pages.select(
        F.monotonically_increasing_id().alias("row"), "page_id", "url", _lower(F.regexp_extract(url, parts, 1)).alias("host"),
        F.regexp_extract(url, parts, 2).alias("path"),
        F.array_distinct(F.filter(F.split(_lower(url), "[^a-z0-9]+"), lambda t: t != "")).alias("tokens"))


def rule_table(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    rows = [(n, r.name, r.verdict, r.pattern, list(r.literals), r.length) for n, r in enumerate(rules)]
    return spark.createDataFrame(rows, "rule_no int, rule string, verdict string, pattern string, literals array<string>, length int")


def rule_index(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Each rule with its ``token``: the literal that the fewest URLs hold."""
    literals = rules.select("rule_no", F.explode("literals").alias("token"))
    known = literals.select("token").distinct()
    counts = urls.select(F.explode("tokens").alias("token")).join(known, "token", "left_semi").groupBy("token").agg(F.count("*").alias("urls"))
    rarest = literals.join(counts, "token", "left").groupBy("rule_no").agg(
        F.min(F.struct(F.coalesce("urls", F.lit(0)).alias("urls"), "token")).alias("least"))
    return rules.join(rarest.select("rule_no", "least.token"), "rule_no").drop("literals")


def matches(urls: DataFrame, index: DataFrame) -> DataFrame:
    """``row`` and the rules that fit, after running the patterns of fetched rules only."""
    fetched = urls.select(
        "row", F.concat("host", "path").alias("place"), _lower(F.coalesce("url", F.lit(""))).alias("whole"),
        F.explode("tokens").alias("token")).join(index, "token")
    return fetched.where(F.expr("rlike(if(length > 0, place, whole), pattern)")).select("row", "rule", "verdict", "length")


def judge(pages: DataFrame, host_rules: tuple[Rule, ...] = HOST_RULES, pattern_rules: tuple[Rule, ...] = PATTERN_RULES) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule`` (the host rule), ``pattern_rule`` and ``verdict``."""
    urls = stage(parse(pages), "urls")
    rules = rule_table(pages.sparkSession, host_rules + pattern_rules)
    found = matches(urls, stage(rule_index(urls, rules), "url-rules"))  # as many rows as rules
    best = found.groupBy("row").agg(
        F.max(F.when(F.col("length") > 0, F.struct("length", "rule", "verdict"))).alias("h"),
        F.min(F.when(F.col("length") == 0, F.struct("verdict", "rule"))).alias("p"))
    return urls.join(best, "row", "left").select(
        "page_id", "url", "host", "path", F.col("h.rule").alias("rule"), F.col("p.rule").alias("pattern_rule"),
        F.coalesce("h.verdict", "p.verdict", F.lit("allow")).alias("verdict"))
