"""URL rules, found by their rarest literal token.

A rule is a regular expression over host and path, with literal tokens that any URL it
matches must hold. The tokens of the distinct URLs are counted, each rule is indexed by
its token with the lowest count, and the tokens of a URL fetch candidate rules by an
equi-join; only candidates run their expression. Rules without a token are candidates of
every URL, over SALTS keys. Site rules (host and path prefix) come before pattern rules, and within either
kind the longest wins.

Defined results: a null URL, or one without "://", has an empty host and path, fits no
site rule and is allowed; repeated URLs are judged once and each row gets the verdict;
an empty table gives no rows; other columns are passed by.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.llm import common

DEFAULT = "allow"
TOKEN = r"[a-z0-9]+"
#: A token of a path with its ends on both sides: a path that only begins alike holds it too.
INNER = r"(?<=[^a-z0-9])[a-z0-9]+(?=[^a-z0-9])"
#: Keys over which rules without a token are spread.
SALTS = 64


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    site: bool = False


def site_rule(host: str, path: str, verdict: str) -> Rule:
    """Fits the host and its subdomains where the path starts with path."""
    host = host.lower()
    pattern = rf"^([^/]*\.)?{re.escape(host)}{re.escape(path)}".replace(r"\-", "-").replace(r"\/", "/")
    parts = re.findall(TOKEN, host) + re.findall(INNER, path.lower())
    return Rule(host + path, verdict, pattern, tuple(dict.fromkeys(parts)), True)


def pattern_rule(name: str, verdict: str, pattern: str, *tokens: str) -> Rule:
    """tokens: whole tokens that every match of the pattern holds."""
    return Rule(name, verdict, pattern, tokens)


# The site rules of the contract.
SITE_RULES = (
    site_rule("net", "/", "block"),
    site_rule("example.net", "/en/", "allow"),
    site_rule("example.com", "/de/", "block"),
    site_rule("org", "/fr/", "allow"),
)
PATTERN_RULES = (
    pattern_rule("gambling", "block", r"^(.*[.])?casino-[a-z0-9]+[.]", "casino"),
    pattern_rule("pharmacy", "block", r"^(.*[.])?[a-z0-9]+-pills[.]", "pills"),
    pattern_rule("spam farm", "block", r"[.]spam-farm[.]|^spam-farm[.]", "spam", "farm"),
    pattern_rule("tracker", "block", r"^(.*[.])?ads-track\.example\.", "ads", "track"),
    pattern_rule("adult", "block", r"/adult/|-adult[.]", "adult"),
)


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a URL."""
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    after = F.coalesce(after, F.lit(""))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(after, F.length(host) + 1, F.length(after)), r"^[^?#]*", 0)
    return common.lower_ascii(host), path


RULES = "rule string, verdict string, pattern string, site boolean, size int, tokens array<string>"


def rule_table(spark, rules: tuple[Rule, ...]) -> DataFrame:
    return spark.createDataFrame([(r.name, r.verdict, r.pattern, r.site, len(r.name) if r.site else len(r.pattern), list(r.tokens)) for r in rules], RULES)


def site_rules(rows: DataFrame) -> DataFrame:
    """Rules of a table (host, path, verdict) of any size, as site_rule() makes them."""
    host, path = common.lower_ascii(F.col("host")), F.col("path")
    found = lambda text, pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    name = F.concat(host, path)
    return rows.select(
        name.alias("rule"),
        "verdict",
        F.concat(F.lit(r"^([^/]*\.)?\Q"), F.replace(name, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")).alias("pattern"),
        F.lit(True).alias("site"),
        F.length(name).alias("size"),
        F.array_distinct(F.concat(found(host, TOKEN), found(common.lower_ascii(path), INNER))).alias("tokens"),
    )


def pattern_rules(rows: DataFrame) -> DataFrame:
    """Rules of a table (name, verdict, pattern, tokens) of any size; tokens as in
    pattern_rule()."""
    return rows.select(F.col("name").alias("rule"), "verdict", "pattern", F.lit(False).alias("site"), F.length("pattern").alias("size"), F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"))


def every(salt: Column) -> Column:
    """The key of the URLs with that salt, for rules without a token."""
    return F.concat(F.lit("*"), salt.cast("string"))


def index(rules: DataFrame, url_tokens: DataFrame) -> DataFrame:
    """The rules, each with the one of its tokens that fewest URLs hold; those without a
    token once for each salt."""
    held = rules.select(*(c for c in rules.columns if c != "tokens"), F.explode_outer("tokens").alias("token"))
    counts = url_tokens.join(held.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("urls"))
    rarity = F.struct(F.coalesce("urls", F.lit(0)).alias("urls"), "token")
    rarest = held.join(counts, "token", "left").groupBy("rule", "verdict", "pattern", "site", "size").agg(F.min_by("token", rarity).alias("token"))
    all_salts = F.transform(F.sequence(F.lit(0), F.lit(SALTS - 1)), every)
    return rarest.withColumn("token", F.explode(F.when(F.col("token").isNull(), all_salts).otherwise(F.array("token"))))


def judge(pages: DataFrame, rules: tuple[Rule, ...] | DataFrame = SITE_RULES + PATTERN_RULES) -> DataFrame:
    """page_id, host, path, rule (of a site), verdict, pattern_rule. rules: a tuple, or a
    table as site_rules() and pattern_rules() make it."""
    table = rules if isinstance(rules, DataFrame) else rule_table(pages.sparkSession, rules)
    rows = pages.select("page_id", "url")
    host, path = parts(F.col("url"))
    urls = common.stored(rows.where("url IS NOT NULL").select("url").distinct().select("url", F.concat(host, path).alias("subject")), "urls")
    tokens = F.array_distinct(F.regexp_extract_all(common.lower_ascii(F.col("subject")), F.lit(f"({TOKEN})"), F.lit(1)))
    if not table.where(F.size("tokens") == 0).isEmpty():
        tokens = F.concat(tokens, F.array(every(F.pmod(F.xxhash64("url"), F.lit(SALTS)))))
    held = urls.select("url", "subject", F.explode(tokens).alias("token"))
    candidates = held.join(index(table, held.select("token")), "token")
    hits = candidates.where(F.rlike(F.col("subject"), F.col("pattern")))
    first = F.struct("site", "size", "rule")
    best = hits.groupBy("url").agg(F.max_by(F.struct("rule", "verdict", "site"), first).alias("hit"))
    return rows.join(best, "url", "left").select(
        "page_id",
        host.alias("host"),
        path.alias("path"),
        F.when(F.col("hit.site"), F.col("hit.rule")).alias("rule"),
        F.coalesce("hit.verdict", F.lit(DEFAULT)).alias("verdict"),
        F.when(~F.col("hit.site"), F.col("hit.rule")).alias("pattern_rule"),
    )
