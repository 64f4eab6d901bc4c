"""URL filters: host rules, then pattern rules found through their rarest literal token.

Pattern rules have a small filter syntax: ``||`` a host and its subdomains, ``|`` an end of the url,
``^`` a separator or the end, ``*`` anything, ``@@`` in front an exception. A literal token is a run of
letters and digits that the pattern delimits on both sides, so that it must be a whole token of any url
that fits. Each rule is indexed by the token that the fewest urls have; a url's tokens fetch its candidate
rules from the index by a hash join, and only those run their regular expression. Rules without a token
are candidates for every url. Urls are judged once however many pages have them.

Host rules name a host and the start of a path; the longest that fits decides before any pattern.

Defined results: null urls and urls without ``://`` have an empty host and path, fit no host rule and
are judged by the patterns (null counts as empty); repeated rows are judged row by row; other columns
are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (host, path, verdict)
HOST_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
PATTERN_RULES = (
    "/ads/", "/adserver^", "/banner^", "/banners/", "||doubleclick.net^", "||adservice.*^", "^utm_medium=cpc^", "/popup^", "/tracking^",
    "/pixel.gif", "/login^", "/signin^", "/cart^", "/checkout^", "^sessionid=", "^sort=*^order=", "/print/", "/calendar/", "/wp-login.php",
    "/xxx/", "/casino^", "/viagra^", "|ftp://", ".exe|", ".zip|", "@@/ads/policy^", "@@||archive.org^",
)
#: A rule table up to this size is sent to every executor; a larger one is joined by shuffling.
BROADCAST_RULES = 50_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def to_regex(rule: str) -> str:
    body, out = rule.removeprefix("@@"), ""
    if body.startswith("||"):
        out, body = r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*\.)?", body[2:]
    elif body.startswith("|"):
        out, body = "^", body[1:]
    end = body.endswith("|")
    for c in body[: len(body) - end]:
        out += {"*": ".*", "^": r"(?:[^a-z0-9_.%-]|$)"}.get(c, re.escape(c))
    return "(?s)" + out + ("$" if end else "")


def tokens_of(rule: str) -> list[str]:
    """Tokens that every fitting url has as a whole: delimited by other literals, anchors or separators."""
    body = rule.removeprefix("@@")
    host = body.startswith("||")
    marked = ("^" if host else "") + body[2 if host else 0 :].replace("|", "^")
    return sorted(set(re.findall(r"(?<=[^a-z0-9*])[a-z0-9]{2,}(?=[^a-z0-9*])", marked)))


def lowered(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    part = lambda i: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", i), F.lit(""))
    return lowered(part(1)), part(2)


def host_rule(host: Column, path: Column, rules: tuple = HOST_RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, as expressions."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def pattern_verdicts(urls: DataFrame, patterns: tuple = PATTERN_RULES) -> DataFrame:
    """url, pattern_verdict, patterns for the distinct urls (column url, not null) with a fitting pattern."""
    spark = urls.sparkSession
    rules = spark.createDataFrame([(i, p, to_regex(p), tokens_of(p)) for i, p in enumerate(patterns)], "rule_id int, pattern string, regex string, literals array<string>")
    hint = F.broadcast if len(patterns) <= BROADCAST_RULES else lambda df: df
    low = urls.select("url", lowered(F.col("url")).alias("low"))
    tokens = low.select("url", "low", F.explode(F.array_distinct(F.regexp_extract_all("low", F.lit("[a-z0-9]{2,}"), 0))).alias("token"))
    literals = rules.select("rule_id", F.explode("literals").alias("token"))
    seen = tokens.select("token").join(hint(literals.select("token").distinct()), "token").groupBy("token").agg(F.count("*").alias("n"))
    index = literals.join(seen, "token", "left").groupBy("rule_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("rarest"))
    index = rules.join(index, "rule_id").select("rule_id", "pattern", "regex", F.col("rarest.token").alias("token"))
    found = tokens.join(hint(index), "token").where(F.expr("low rlike regex")).select("url", "pattern")
    for pattern in [p for p in patterns if not tokens_of(p)]:
        found = found.union(low.where(F.col("low").rlike(to_regex(pattern))).select("url", F.lit(pattern)))
    allowed = F.max(F.col("pattern").startswith("@@"))
    return found.groupBy("url").agg(F.when(allowed, "allow").otherwise("block").alias("pattern_verdict"), F.array_sort(F.collect_set("pattern")).alias("patterns"))


def judge(pages: DataFrame, host_rules: tuple = HOST_RULES, patterns: tuple = PATTERN_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and the patterns that fitted, per row of pages."""
    rows = pages.select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"))
    verdicts = pattern_verdicts(rows.select("url").distinct(), patterns)
    host, path = host_and_path(F.col("url"))
    rule, verdict = host_rule(F.col("host"), F.col("path"), host_rules)
    out = rows.withColumn("host", host).withColumn("path", path).withColumn("rule", rule).withColumn("__verdict", verdict)
    return out.join(verdicts, "url", "left").select("page_id", "host", "path", "rule", F.coalesce("__verdict", "pattern_verdict", F.lit("allow")).alias("verdict"), "patterns")
