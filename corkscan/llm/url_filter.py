"""Allow and block rules for URLs by host suffixes and path prefixes.

A URL is taken apart into its host, that host's parent domains, and the starts of
its path that are as long as some rule's path. Each such expression is joined with
the rules by the first eight digits of its SHA-256 sum, which is short enough to
keep everything about the rules small; whoever matches there is confirmed by the
full sum. Of the rules that fit, the longest wins; of two equally long ones, the
one with the longer host; a rule that is both allowed and blocked is blocked.

The host is what follows the first ``://`` up to a slash, question mark, number
sign or the end, with A-Z lower-cased; the path goes on up to a question mark,
number sign or the end. Null URLs, and those without ``://``, have neither, fit no
rule, and get the default verdict. Rows that repeat are judged each. Without any
rule every verdict is the default.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corkscan.llm.common import free_name

ALLOW, BLOCK = "allow", "block"
PREFIX_DIGITS = 8
# So many rules may be broadcast; more are joined by shuffle.
FEW_RULES = 200_000
# Different lengths of the paths of rules; URLs are cut at each of them.
MOST_LENGTHS = 4_096


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, ascii_uppercase, ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*(/[^?#]*)", 1)


def expressions(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every suffix of the host with every start of the path of one of these lengths."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, n, F.size(labels)), "."))
    cuts = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length(path))
    each = lambda suffix: F.transform(cuts, lambda n: F.concat(suffix, F.left(path, n)))
    every = F.flatten(F.transform(suffixes, each))
    return F.when(host != "", every).otherwise(F.array().cast("array<string>"))


def judge(urls: DataFrame, rules: DataFrame, url_col: str = "url", default: str = ALLOW) -> DataFrame:
    """``urls`` with host, path, rule and verdict.

    ``rules`` has a host, a path that is empty or begins with a slash, and a
    verdict. Columns of ``urls`` with the new names are replaced.
    """
    told = rules.select(F.lower("host").alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    told = told.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # "block" comes after "allow"
    lengths = [row[0] for row in told.select(F.length("path")).distinct().limit(MOST_LENGTHS + 1).collect()]
    if len(lengths) > MOST_LENGTHS:
        raise ValueError("the paths of the rules have too many different lengths")
    rule = F.concat("host", "path")
    known = told.select(
        F.left(F.sha2(rule, 256), F.lit(PREFIX_DIGITS)).alias("prefix"), F.sha2(rule, 256).alias("rule_sum"),
        F.struct(F.length(rule).alias("length"), F.length("host").alias("host_length"), rule.alias("rule"),
                 F.col("verdict").alias("verdict")).alias("found"))
    if known.count() <= FEW_RULES:
        known = F.broadcast(known)

    new = ["host", "path", "rule", "verdict"]
    kept = [name for name in urls.columns if name not in new]
    # The caller's columns travel in one struct, so that no name of theirs meets one of ours.
    taken = urls.select(F.struct(*(F.col(f"`{name}`") for name in kept), F.lit(0).alias(free_name(urls, "_"))).alias("caller"), host_of(F.col(url_col)).alias("host"),
                        path_of(F.col(url_col)).alias("path"), F.monotonically_increasing_id().alias("row"))
    asked = taken.withColumn("expression", F.explode_outer(expressions(F.col("host"), F.col("path"), sorted(lengths) or [0])))
    asked = asked.withColumn("sum", F.sha2("expression", 256)).withColumn("key", F.left("sum", F.lit(PREFIX_DIGITS)))
    met = asked.join(known, F.col("key") == F.col("prefix"), "left")
    # The short prefix only finds rules; the full digest confirms them.
    met = met.withColumn("found", F.when(F.col("sum") == F.col("rule_sum"), F.col("found")))
    # Rows of one URL are together still, so that they become one before the shuffle.
    best = met.groupBy("row").agg(*(F.first(name).alias(name) for name in ["caller", "host", "path"]), F.max("found").alias("found"))
    return best.select(*(F.col(f"caller.`{name}`").alias(name) for name in kept), "host", "path", F.col("found.rule").alias("rule"),
                       F.coalesce("found.verdict", F.lit(default)).alias("verdict"))
