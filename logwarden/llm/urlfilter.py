"""URL filters: rules indexed by their rarest literal token, fetched by the tokens of a URL.

A rule is a host with its subdomains plus the beginning of a path, and a verdict. Its literal tokens are the host labels and
the whole path segments before its last slash. The tokens of all URLs are counted, each rule is filed under its rarest token,
and a URL's tokens fetch the rules filed under them by an equi-join; only those rules' regular expressions run. The longest
matching rule wins. URLs without a matching rule get the default verdict.

The work is done once per distinct URL, so a host or URL that many pages share costs one row. The rule table is broadcast
while it has at most ``BROADCAST_RULES`` rules; beyond that the join is by shuffle on (token, salt): the rules are repeated
per salt and the URL rows spread over the salts, so a token that a third of all URLs hold meets many tasks.

Edge cases: null URLs and those without ``://`` have empty host and path and no rule; an empty path fits no rule; a port or
user name is part of the host; repeated rows are judged alike; an empty table gives an empty result; extra columns are not
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logwarden.llm.textops import fits

#: Fixed rules: verdict, host, path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
DEFAULT = "allow"
BROADCAST_RULES, SALTS = 100_000, 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(host: Column, path: Column) -> Column:
    """Host labels as ``h:label`` and path segments that are followed by a slash as ``p:segment``, each once."""
    labels = F.transform(F.split(host, "[.]"), lambda x: F.concat(F.lit("h:"), x))
    pieces = F.split(path, "/")
    segments = F.transform(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda x: F.concat(F.lit("p:"), x))
    return F.filter(F.array_distinct(F.concat(labels, segments)), lambda x: F.length(x) > 2)


def quote(text: Column) -> Column:
    """The text as a literal inside a regular expression."""
    return F.regexp_replace(text, r"([^A-Za-z0-9\x80-\x{10FFFF}])", r"\\$1")


def rule_table(spark, rules: list[tuple[str, str, str]]) -> DataFrame:
    """verdict, rule, length, pattern (over host and path), tokens; made by Spark from the given rules.

    A rule needs a host label: one without would fit every page, and is refused.
    """
    for verdict, host, path in rules:
        if not host or not all(host.split(".")):
            raise ValueError(f"a rule needs a host of non-empty labels: {(verdict, host, path)}")
    df = spark.createDataFrame(rules, "verdict string, rule_host string, rule_path string")
    pattern = F.concat(F.lit(r"^(?:[^/]*\.)?"), quote(F.col("rule_host")), quote(F.col("rule_path")))
    return df.select("verdict", F.concat("rule_host", "rule_path").alias("rule"),
                     F.char_length(F.concat("rule_host", "rule_path")).alias("length"), pattern.alias("pattern"),
                     tokens(F.col("rule_host"), F.col("rule_path")).alias("tokens"))


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    urls = pages.select("page_id", "url")
    distinct = urls.filter("url is not null").select("url").distinct().select(
        "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    held = distinct.select("url", F.concat("host", "path").alias("target"), F.explode(tokens(F.col("host"), F.col("path"))).alias("token"))
    filed = rules.select("verdict", "rule", "length", "pattern", F.explode("tokens").alias("token"))
    seen = held.join(F.broadcast(filed.select("token").distinct()) if fits(rules, BROADCAST_RULES) else filed.select("token").distinct(),
                     "token", "left_semi").groupBy("token").agg(F.count("*").alias("urls"))
    rarest = filed.join(seen, "token", "left").groupBy("verdict", "rule", "length", "pattern").agg(
        F.min(F.struct(F.coalesce("urls", F.lit(0)).alias("urls"), "token")).alias("rarest"))
    index = rarest.select("verdict", "rule", "length", "pattern", F.col("rarest.token").alias("token"))
    if fits(rules, BROADCAST_RULES):
        fetched = held.join(F.broadcast(index), "token")
    else:
        salted = held.withColumn("salt", F.pmod(F.xxhash64("url"), F.lit(SALTS)).cast("int"))
        fetched = salted.join(index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["token", "salt"])
    best = fetched.filter(F.expr("target rlike pattern")).groupBy("url").agg(
        F.max(F.struct("length", F.col("rule").alias("rule"), "verdict")).alias("best"))
    return urls.join(best, "url", "left").select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


SQL = """
with parts as (
  select page_id,
    coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path
  from pages),
rules(verdict, h, p) as (values ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/'))
select page_id, host, path,
  (select h || p from rules where (host = h or ends_with(host, '.' || h)) and starts_with(path, p) order by length(h || p) desc limit 1) as rule,
  coalesce((select verdict from rules where (host = h or ends_with(host, '.' || h)) and starts_with(path, p) order by length(h || p) desc limit 1), 'allow') as verdict
from parts
"""
