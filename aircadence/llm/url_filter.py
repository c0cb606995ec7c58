"""URL verdicts from host rules and indexed pattern rules.

Host rules name a host and a path prefix, fit the host and all its subdomains,
and the longest that fits decides.  Where none fits, pattern rules decide.  A
pattern is literal text with three signs: ``||`` at its start stands for the
start of the host or of a later label of it, ``*`` for any text, ``^`` for a
character that is no letter, digit, ``_``, ``-``, ``.`` or ``%``, or the end.

Patterns are not run against every URL.  Each is indexed under its rarest
literal token, by the tokens' counts in these URLs; a URL's own tokens fetch
its candidate patterns by a join, and only those run as regular expressions.
Patterns without a whole token run against all URLs.

Everything is decided once for each distinct URL.  Defined cases: a null URL
or one without ``://`` has empty host and path, no rule, and is allowed; rows
that repeat a URL each get its verdict; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

HostRule = tuple[str, str, str]

#: (verdict, host, path prefix)
HOST_RULES: tuple[HostRule, ...] = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

#: Words that open a host's label, or are one, on advertising and spam sites.
AD_WORDS = ("ads", "adserver", "adservice", "advert", "banner", "clicks", "popunder", "tracker")
SPAM_WORDS = ("bets", "betting", "casino", "escort", "jackpot", "lottery", "payday", "pills", "poker", "porn", "replica", "spam", "viagra", "warez", "xxx")

#: Patterns of unwanted URLs.
PATTERNS: tuple[str, ...] = (
    *(f"||{w}{end}" for w in AD_WORDS + SPAM_WORDS for end in ".-"),
    *(f"-{w}." for w in SPAM_WORDS),
    "/adserver/", "/affiliate/*/click", "/banner/*/click", "/popunder^", "||tracker.*/pixel^",
)

#: Rules up to this number are broadcast (some tens of MB at most), more are joined.
MOST_BROADCAST = 200_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def pattern_regex(pattern: str) -> str:
    """The pattern as a regular expression for lower-cased URLs."""
    out, rest = ("", pattern)
    if pattern.startswith("||"):
        out, rest = r"://([^/?#]*\.)?", pattern[2:]
    for ch in rest.lower():
        out += ".*" if ch == "*" else r"([^a-z0-9_.%-]|$)" if ch == "^" else re.escape(ch) if not ch.isalnum() and ch not in "-/_ " else ch
    return out


def pattern_tokens(pattern: str) -> list[str]:
    """Tokens that every matching URL has: runs of letters and digits that the
    pattern itself delimits on both sides."""
    text = "." + pattern[2:] if pattern.startswith("||") else pattern
    return [m[1] for m in re.finditer(r"(?<=[^a-z0-9*])([a-z0-9]+)(?=[^a-z0-9*])", text.lower())]


def _tokens(url: str):
    return F.array_distinct(F.filter(F.split(F.translate(url, _UPPER, _LOWER), "[^a-z0-9]+"), lambda x: x != ""))


def pattern_hits(urls: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """The distinct URLs (column ``url``) that some pattern matches."""
    spark = urls.sparkSession
    exploded = urls.select("url", F.explode(_tokens("url")).alias("token"))
    wanted = sorted({t for p in patterns for t in pattern_tokens(p)})
    rules_list = [(i, pattern_regex(p), t) for i, p in enumerate(patterns) for t in pattern_tokens(p)]
    rules = spark.createDataFrame(rules_list, "rule int, regex string, token string")
    few = F.broadcast if len(rules_list) <= MOST_BROADCAST else lambda table: table
    counts = exploded.join(few(spark.createDataFrame([(t,) for t in wanted], "token string")), "token", "left_semi").groupBy("token").count()
    index = rules.join(counts, "token", "left").groupBy("rule", "regex").agg(F.min_by("token", F.struct(F.coalesce("count", F.lit(0)), "token")).alias("token"))
    fetched = exploded.join(few(index), "token").where(F.expr("rlike(translate(url, '%s', '%s'), regex)" % (_UPPER, _LOWER))).select("url")
    for p in patterns:
        if not pattern_tokens(p):
            fetched = fetched.union(urls.where(F.translate("url", _UPPER, _LOWER).rlike(pattern_regex(p))).select("url"))
    return fetched.distinct()


def host_rule_hits(urls: DataFrame, rules: Sequence[HostRule]) -> DataFrame:
    """The longest fitting host rule of each URL: ``(url, rule, verdict)``."""
    table = urls.sparkSession.createDataFrame([(v, h, p) for v, h, p in rules], "rule_verdict string, rule_host string, rule_path string")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    table = F.broadcast(table) if len(rules) <= MOST_BROADCAST else table
    fits = urls.select("url", "path", F.explode(suffixes).alias("rule_host")).join(table, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    rule = F.concat("rule_host", "rule_path")
    best = fits.groupBy("url").agg(F.max(F.struct(F.length(rule).alias("n"), rule.alias("rule"), F.col("rule_verdict").alias("verdict"))).alias("best"))
    return best.select("url", "best.rule", "best.verdict")


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[HostRule] = HOST_RULES, patterns: Sequence[str] = PATTERNS) -> DataFrame:
    """Per row of ``pages``: ``(id_col, host, path, rule, verdict)``."""
    whole = F.coalesce(F.col("url"), F.lit(""))
    rows = pages.select(F.col(id_col).alias(id_col), F.col(url_col).alias("url"))
    host = F.translate(F.regexp_extract(whole, r"(?s)://([^/?#]*)", 1), _UPPER, _LOWER)
    rows = rows.withColumn("host", host).withColumn("path", F.regexp_extract(whole, r"(?s)://[^/?#]*([^?#]*)", 1))
    urls = rows.where("url is not null").select("url", "host", "path").distinct()
    ruled = host_rule_hits(urls, rules)
    blocked = pattern_hits(urls.select("url"), patterns).withColumn("hit", F.lit(True))
    known = ruled.withColumnRenamed("verdict", "ruled").join(blocked, "url", "full")
    verdict = F.coalesce("ruled", F.when(F.col("hit"), F.lit("block")), F.lit("allow"))
    return rows.join(known, "url", "left").select(id_col, "host", "path", "rule", verdict.alias("verdict"))
