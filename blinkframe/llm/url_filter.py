"""URL rules behind a token index, in DataFrame functions alone.

A rule is a regular expression over host and path with the literal tokens that every match must hold. The index has each
rule once, under the token that fewest URLs have; a URL's own tokens fetch the rules under them, and only those run. Rules
without a token are fetched by every URL. URLs are judged once for each distinct host and path.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Up to so many rules are broadcast; more are joined by token like any table.
BROADCAST_RULES = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    name: str
    action: str
    pattern: str
    tokens: list[str]
    domain: bool


def domain_rule(name: str, action: str) -> Rule:
    """Rule such as ``example.net/en/``: its host and all subdomains, paths that start with its path."""
    host, slash, path = name.partition("/")
    whole = re.findall(r"[a-z0-9]+", host) + re.findall(r"(?<=/)[a-z0-9]+(?=[^a-zA-Z0-9])", slash + path)
    literal = re.sub(r"[^A-Za-z0-9/-]", lambda m: "[" + m[0] + "]", name)
    return Rule(name, action, f"^(?:[^/]*[.])?{literal}", whole, True)


_PARTS = re.compile(r"\\(.)|\[\^?\]?[^]]*\]|([?*+]|\{[0-9,]*\})[?+]?|(.)", re.S)


def literal_tokens(pattern: str) -> list[str]:
    """Runs of letters and digits that every match of a pattern holds in full, lower-cased; none where that is uncertain.

    A run counts if it stands outside of groups, classes and repeats, with a word boundary, an anchor or punctuation on
    both sides. Alternatives outside of groups leave no run certain.
    """
    seen: list[str] = []  # a letter or digit, " " for what is neither, "?" for what isn't known
    depth = 0
    for part in _PARTS.finditer(pattern):
        escaped, repeat, plain = part[1], part[2], part[3]
        if plain in ("(", ")"):
            depth += 1 if plain == "(" else -1
            seen.append("?")
        elif depth:
            continue
        elif repeat:
            seen[-1:] = ["?"]
        elif plain == "|":
            return []
        elif escaped:
            seen.append(" " if escaped == "b" or not escaped.isalnum() else "?")
        elif plain:
            seen.append("?" if plain == "." else plain if plain.isalnum() else " ")
        else:  # a class: known if it holds punctuation alone
            inner = part[0][1:-1]
            seen.append("?" if inner.startswith("^") or "\\" in inner or any(c.isalnum() or c == "-" for c in inner) else " ")
    return [t.lower() for t in re.findall(r"(?<= )[A-Za-z0-9]+(?= )", "".join(seen))]


def pattern_rule(name: str, pattern: str) -> Rule:
    """Rule that blocks where its pattern is found, A-Z lower-cased; its tokens are taken from the pattern."""
    return Rule(name, "block", pattern, literal_tokens(pattern), False)


#: Hosts that sell, spam or show what a training corpus has no use for.
PATTERNS = [
    pattern_rule("spam farms", r"^[^/]*\bspam-farm\b"),
    pattern_rule("pills", r"^[^/]*\bcheap-pills\b"),
    pattern_rule("casinos", r"^[^/]*\bcasino\b"),
    pattern_rule("adult", r"^[^/]*\badult-x\b"),
    pattern_rule("xxx", r"^[^/]*\bxxx\b"),
    pattern_rule("porn", r"^[^/]*\bporn\b"),
    pattern_rule("viagra", r"\bviagra\b"),
    pattern_rule("payday loans", r"\bpayday-loans?\b"),
    pattern_rule("warez", r"^[^/]*\bwarez\b"),
    pattern_rule("ad servers", r"^(?:[^/]*[.])?\badserver[.]"),
]


def parse(pages: DataFrame, url: str = "url") -> DataFrame:
    """Add host (A-Z lower-cased) and path; both are empty for null and for URLs without ``://``."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return pages.withColumns({"host": F.translate(F.coalesce(host, F.lit("")), UPPER, LOWER), "path": F.coalesce(path, F.lit(""))})


def _tokens(target) -> F.Column:
    """Distinct tokens of a URL, and the empty one under which rules without tokens are."""
    return F.array_distinct(F.concat(F.split(F.translate(target, UPPER, LOWER), "[^a-z0-9]+", -1), F.array(F.lit(""))))


def rule_index(spark: SparkSession, targets: DataFrame, rules: list[Rule] | DataFrame) -> DataFrame:
    """Rules with the token that fewest rows of ``targets`` (target) have: token, name, action, pattern, domain."""
    own = rules if isinstance(rules, DataFrame) else spark.createDataFrame([tuple(r) for r in rules], "name string, action string, pattern string, tokens array<string>, domain boolean")
    small = F.broadcast if _few(rules) else (lambda x: x)
    # A rule is told by all its fields: names may be null, or those of several rules.
    own = own.withColumn("number", F.sha2(F.to_json(F.struct("name", "action", "pattern", "tokens", "domain")), 256))
    listed = own.select("number", F.explode_outer("tokens").alias("token")).withColumn("token", F.coalesce("token", F.lit("")))
    seen = targets.select(F.explode(_tokens(F.col("target"))).alias("token")).join(small(listed.select("token").distinct()), "token", "left_semi").groupBy("token").count()
    rarest = listed.join(seen, "token", "left").groupBy("number").agg(F.min(F.struct(F.coalesce("count", F.lit(0)), "token")).alias("best"))
    return own.join(rarest, "number").select(F.col("best.token").alias("token"), "name", "action", "pattern", "domain")


def _few(rules: list[Rule] | DataFrame) -> bool:
    return (rules.limit(BROADCAST_RULES + 1).count() if isinstance(rules, DataFrame) else len(rules)) <= BROADCAST_RULES


def judge(pages: DataFrame, rules: list[Rule] | DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """One row per input row: key, host, path, rule (the longest domain rule that fits, or null), verdict.

    The verdict is the domain rule's; without one it is block if a pattern rule matches, else allow. Null and malformed
    URLs are allowed. ``rules`` is a list or a table with the fields of Rule, which need not fit the driver. Rows that repeat give equal rows; other columns are ignored.
    """
    spark = pages.sparkSession
    parsed = parse(pages.select(F.col(f"`{key}`").alias(key), F.col(f"`{url}`").alias("url"))).select(key, "host", "path")
    targets = parsed.select("host", "path").filter("host <> '' or path <> ''").distinct().withColumn("target", F.concat("host", "path"))
    index = rule_index(spark, targets, rules)
    if _few(rules):
        index = F.broadcast(index)
    fetched = targets.withColumn("token", F.explode(_tokens(F.col("target")))).join(index, "token")
    hits = fetched.withColumn("tried", F.when(F.col("domain"), F.col("target")).otherwise(F.translate("target", UPPER, LOWER))).filter(F.expr("tried rlike pattern"))
    longest = F.max(F.when(F.col("domain"), F.struct(F.length("name"), "name", "action"))).alias("best")
    found = hits.groupBy("host", "path").agg(longest, F.bool_or(~F.col("domain") & (F.col("action") == "block")).alias("blocked"))
    # URLs without host and path are all alike: they have no target to meet, and go wherever their key's hash says.
    known = F.expr("host <> '' or path <> ''")
    found = found.select(F.col("host").alias("own"), "path", F.lit(True).alias("known"), "best", "blocked")
    dealt = parsed.withColumns({"known": known, "own": F.when(known, F.col("host")).otherwise(F.xxhash64(key).cast("string"))})
    out = dealt.join(found, ["own", "path", "known"], "left")
    verdict = F.coalesce("best.action", F.when(F.col("blocked"), "block").otherwise("allow"))
    return out.select(key, "host", "path", F.col("best.name").alias("rule"), verdict.alias("verdict"))


def duckdb_sql(rules: list[Rule]) -> str:
    """The same over a view ``pages`` in DuckDB, every rule against every URL."""
    quoted = ", ".join("('{}', '{}', '{}', {})".format(r.name, r.action, r.pattern.replace("'", "''"), r.domain) for r in rules)
    return rf"""
    WITH rules(name, action, pattern, domain) AS (VALUES {quoted}),
    parsed AS (
      SELECT row_number() OVER () AS n, page_id,
             translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
             coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
      FROM pages
    ), best AS (
      SELECT n, max_by(name, length(name)) FILTER (domain) AS rule, max_by(action, length(name)) FILTER (domain) AS action,
             bool_or(NOT domain AND action = 'block') AS blocked
      FROM parsed, rules WHERE regexp_matches(CASE WHEN domain THEN host || path ELSE translate(host || path, '{UPPER}', '{LOWER}') END, pattern) GROUP BY n
    )
    SELECT page_id, host, path, rule, coalesce(action, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict
    FROM parsed LEFT JOIN best USING (n)
    """
