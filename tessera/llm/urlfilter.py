"""URL rules by host suffixes and path prefixes, with DataFrame functions only.

Every distinct (host, path) is expanded into host suffix + path prefix
expressions, as browsers do for block lists; prefixes of all lengths that rules
have are made, so a rule's path may end anywhere.  Expressions meet the rules by
an equi-join on the first 32 bits of their SHA-256, full digests are compared,
and among the rules that fit the longest wins (block before allow on a tie).

Verdicts are made once for each distinct (host, path) and joined back, so a hot
URL is expanded once; the optimizer broadcasts rules only below its size limit
and splits hot hosts otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX_CHARS = 8  # hexadecimal digits of the short hash


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host (A-Z lower-cased) and the path of a URL; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def rule_table(spark, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(action, host, path) rules as a table."""
    return spark.createDataFrame(rules, "action string, host string, path string")


def expressions(hosts: DataFrame, lengths: Column) -> DataFrame:
    """``hosts`` (host, path) with a row for each host suffix and path prefix."""
    parts = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")
    )
    fitting = F.filter(lengths, lambda n: n <= F.length("path"))
    prefixes = F.transform(fitting, lambda n: F.substr("path", F.lit(1), n))
    return (
        hosts.withColumn("suffix", F.explode(suffixes))
        .withColumn("expression", F.explode(F.transform(prefixes, lambda p: F.concat(F.col("suffix"), p))))
        .select("host", "path", F.sha2("expression", 256).alias("digest"))
    )


def verdicts(pages: DataFrame, rules: DataFrame, url_column: str = "url") -> DataFrame:
    """``pages`` with columns host, path, rule and verdict.

    ``rule`` is the winning rule as host + path, null if none fits; such pages
    get the verdict allow.  A null URL or one without ``://`` has empty host and
    path and fits no rule; rules with nulls are left out; repeated rows stay;
    columns of ``pages`` with the new names are replaced; empty tables are fine.
    """
    host, path = host_and_path(F.col(url_column))
    pages = pages.withColumns({"host": host, "path": path}).drop("rule", "verdict")
    rules = rules.where("host is not null and path is not null and action is not null").select(
        F.concat("host", "path").alias("rule"), "action", F.length("path").alias("n")
    )
    lengths = rules.agg(F.sort_array(F.collect_set("n")).alias("n")).first().n  # one for each length of a rule's path
    keyed = rules.select("rule", "action", F.sha2("rule", 256).alias("full")).withColumn(
        "short", F.substring("full", 1, PREFIX_CHARS)
    )
    hosts = pages.where("host != ''").select("host", "path").distinct()
    found = (
        expressions(hosts, F.array(*[F.lit(n) for n in lengths]) if lengths else F.array().cast("array<int>"))
        .withColumn("short", F.substring("digest", 1, PREFIX_CHARS))
        .join(keyed, "short")
        .where("digest = full")
    )
    rank = F.struct(F.length("rule"), F.col("action") == "block", "rule", "action")
    won = found.groupBy("host", "path").agg(F.max(rank).alias("won"))
    won = won.select("host", "path", F.col("won.rule").alias("rule"), F.col("won.action").alias("verdict"))
    return pages.join(won, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit("allow")))
