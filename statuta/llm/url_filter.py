"""URL rules with a literal-token index, in DataFrame functions only.

Host rules (host and path prefix, longest wins) judge first: a URL's host and its parent domains
are joined with the rules' hosts. The rest meets pattern rules: every rule lists the literal tokens
that any URL it matches must hold, and is filed under the one of them that is rarest over all URLs.
A URL's tokens fetch the rules filed under them by a join, and only those run their regular
expression. Rules are tables of any size, which Spark broadcasts while they are below its
threshold; only addresses are moved, never markup.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .shared import Scratch

#: (action, host, path)
HOST_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: (action, literal tokens, pattern over the lower-cased URL); an allow outweighs every block.
PATTERN_RULES = [
    ("block", ["casino"], r"://([^/?#]*[.-])?casino[.-]"),
    ("block", ["free", "bets"], r"://([^/?#]*[.-])?free-bets\."),
    ("block", ["cheap", "pills"], r"://([^/?#]*[.-])?cheap-pills\."),
    ("block", ["adult"], r"://([^/?#]*[.-])?adult[.-]"),
    ("block", ["spam", "farm"], r"://([^/?#]*[.-])?spam-farm\."),
    ("block", ["ads", "track"], r"://([^/?#]*[.-])?ads-track\."),
    ("block", ["doubleclick"], r"://([^/?#]*\.)?doubleclick\."),
    ("block", ["wp", "admin"], r"/wp-admin(/|$)"),
    ("block", ["utm", "campaign", "popunder"], r"[?&]utm_campaign=popunder(&|#|$)"),
    ("allow", ["ads", "track", "optout"], r"://([^/?#]*\.)?ads-track\.[^?#]*/optout(/|$)"),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def ascii_lower(column: Column) -> Column:
    return F.translate(column, _UPPER, _LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ``://``; both empty for null or where there is none."""
    held = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(held, _PARTS, 1)), F.regexp_extract(held, _PARTS, 2)


def url_tokens(url: Column) -> Column:
    return F.array_distinct(F.split(ascii_lower(F.coalesce(url, F.lit(""))), "[^a-z0-9]+"))


def _text_array(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def url_verdicts(pages: DataFrame, keep: list[str] = ("page_id",), url_col: str = "url", host_rules: list = HOST_RULES, pattern_rules: list = PATTERN_RULES) -> DataFrame:
    """``keep`` columns, host, path, rule, verdict of every row.

    ``rule`` is the host rule that decided, else null; of two as long as each other the one listed
    first. ``verdict`` is its action, else that of the pattern rules, else allow. Null and empty
    URLs have an empty host and path and are allowed. Repeated rows are judged alike; an empty
    table gives none. ``keep`` may name any column but those added here; others don't matter.
    """
    spark, scratch = pages.sparkSession, Scratch(pages.sparkSession, "urls")
    host, path = host_and_path(F.col(url_col))
    base = pages.select(*(F.col(c).alias(f"k_{c}") for c in keep), F.coalesce(url_col, F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
    base = scratch.save(base.withColumn("row", F.monotonically_increasing_id()), "base")

    words = spark.createDataFrame(sorted({(w,) for _, tokens, _ in pattern_rules for w in tokens}), "token string")
    tokens = base.select("row", "url", F.explode(url_tokens(F.col("url"))).alias("token"))
    # Rows: one for each literal of the rules at most.
    seen = {r["token"]: r["n"] for r in tokens.join(words, "token").groupBy("token").agg(F.count("*").alias("n")).collect()}
    filed = [(min(literals, key=lambda w: (seen.get(w, 0), w)), action, pattern) for action, literals, pattern in pattern_rules]
    index = spark.createDataFrame(filed, "token string, action string, pattern string")
    matched = tokens.join(index, "token").filter(F.rlike(ascii_lower(F.col("url")), F.col("pattern")))
    by_pattern = matched.groupBy("row").agg(F.when(F.bool_or(F.col("action") == "allow"), "allow").otherwise("block").alias("by_pattern"))

    rules = spark.createDataFrame([(name, prefix, name + prefix, action, -len(name + prefix), k) for k, (action, name, prefix) in enumerate(host_rules)], "name string, prefix string, rule string, action string, longest int, listed int")
    parts = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    fits = base.select("row", "path", F.explode(domains).alias("name")).join(rules, "name").filter(F.col("path").startswith(F.col("prefix")))
    by_host = fits.groupBy("row").agg(F.min_by(F.struct("rule", "action"), F.struct("longest", "listed")).alias("by_host"))

    out = base.join(by_host, "row", "left").join(by_pattern, "row", "left")
    verdict = F.coalesce("by_host.action", "by_pattern", F.lit("allow"))
    return out.select(*(F.col(f"k_{c}").alias(c) for c in keep), "host", "path", F.col("by_host.rule").alias("rule"), verdict.alias("verdict"))


def verdicts_sql() -> str:
    """The same rows for DuckDB, with every pattern run on every URL."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    fits = lambda n, p: f"((host = {quote(n)} or ends_with(host, {quote('.' + n)})) and starts_with(path, {quote(p)}))"
    rules = sorted(HOST_RULES, key=lambda r: -len(r[1] + r[2]))
    chosen = " ".join(f"when {fits(n, p)} then {quote(n + p)}" for _, n, p in rules)
    decided = " ".join(f"when {fits(n, p)} then {quote(a)}" for a, n, p in rules)
    some = lambda action: " or ".join(f"regexp_matches(low, {quote(p)})" for a, _, p in PATTERN_RULES if a == action) or "false"
    return f"""
with parts as (
  select page_id, translate(coalesce(url, ''), '{_UPPER}', '{_LOWER}') as low,
         translate(regexp_extract(coalesce(url, ''), '{_PARTS}', 1), '{_UPPER}', '{_LOWER}') as host,
         regexp_extract(coalesce(url, ''), '{_PARTS}', 2) as path
  from pages)
select page_id, host, path, case {chosen} end as rule,
       case {decided} when {some('allow')} then 'allow' when {some('block')} then 'block' else 'allow' end as verdict
from parts"""
