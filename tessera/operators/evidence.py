"""Checks of evidence tables: rules told as data, judged in one aggregation.

A rule gives a column of violations; all rules of a table are aggregates of one
scan.  ``check`` gives a row for each rule, and nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASH = "[0-9a-f]{64}"


@dataclass(frozen=True)
class Rule:
    """A name and an aggregate that counts violations."""

    name: str
    violations: Column


def _bad(condition: Column) -> Column:
    """Rows for which a condition doesn't hold, missing ones included."""
    return F.count_if(~F.coalesce(condition, F.lit(False)))


def matches(column: str, pattern: str = HASH, optional: bool = False) -> Rule:
    """The whole of each value follows a pattern; ``optional`` lets missing and empty ones be."""
    v = F.col(column).cast("string")
    ok = v.rlike(f"^(?:{pattern})$")
    return Rule(f"{column} matches", _bad(ok | (F.coalesce(v, F.lit("")) == "") if optional else ok))


def one_of(column: str, values: Iterable) -> Rule:
    """Each value is one of a set."""
    return Rule(f"{column} one of", _bad(F.col(column).isin(*values)))


def boolean(column: str) -> Rule:
    """Each value reads as true or false, in any case."""
    return Rule(f"{column} boolean", _bad(F.lower(F.col(column).cast("string")).isin("true", "false")))


def present_if(column: str, condition: Column, name: str) -> Rule:
    """A value is there exactly where a condition holds."""
    there = F.coalesce(F.col(column).cast("string"), F.lit("")) != ""
    return Rule(f"{column} present if {name}", _bad(there == F.coalesce(condition, F.lit(False))))


def unique(column: str) -> Rule:
    """No two rows share a value; rows without one count as sharing it."""
    return Rule(f"{column} unique", F.count("*") - F.count_distinct(F.coalesce(F.col(column).cast("string"), F.lit("\0"))))


def contiguous(column: str) -> Rule:
    """The values are 0, 1, 2 ... without gaps or repeats: counts, sums and bounds of them are."""
    v, n = F.col(column).cast("decimal(38, 0)"), F.count("*").cast("decimal(38, 0)")
    good = (F.min(v) == 0) & (F.max(v) == n - 1) & (F.count(v) == n) & (F.count_distinct(v) == n)
    return Rule(f"{column} contiguous", F.when((F.count("*") == 0) | F.coalesce(good, F.lit(False)), 0).otherwise(1))


def follows(column: str, expected: Column, name: str) -> Rule:
    """Each value equals an expression over its row."""
    return Rule(f"{column} is {name}", _bad(F.col(column).eqNullSafe(expected)))


def rows(n: int) -> Rule:
    """The table has so many rows."""
    return Rule("row count", F.abs(F.count("*") - F.lit(n)))


def free_of(columns: Iterable[str], pattern: str, name: str) -> Rule:
    """No value of the columns contains a pattern."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).cast("string").rlike(pattern), F.lit(False))
    return Rule(f"free of {name}", F.count_if(hit))


def free_of_paths(columns: Iterable[str]) -> Rule:
    return free_of(columns, r"^(?:/|[A-Za-z]:[\\/])", "paths")


def free_of_queries(columns: Iterable[str]) -> Rule:
    return free_of(columns, r"(?i)select ", "queries")


def sealed(column: str, columns: Iterable[str]) -> Rule:
    """Each row's digest is that of its other columns, by the library's row digest."""
    from tessera.sources.tables import digest_of

    return Rule(f"{column} seals the row", _bad(F.col(column) == digest_of([F.col(c).alias(c) for c in columns])))


def check(df: DataFrame, rules: Iterable[Rule], columns: list[str] | None = None, forbidden: Iterable[str] = ()) -> DataFrame:
    """(rule, violations, passed): one row for each rule, all of one scan of ``df``.

    ``columns`` is the exact order of columns, ``forbidden`` names that mustn't be
    among them; both are told by the schema.  An empty table passes what holds for
    all of its rows.
    """
    told = list(rules)
    shape = []
    if columns is not None:
        shape.append(("columns", 0 if df.columns == columns else 1))
    if banned := list(forbidden):
        shape.append(("no forbidden columns", len(set(banned) & set(df.columns))))
    counted = df.agg(*[r.violations.cast("long").alias(f"v{i}") for i, r in enumerate(told)]) if told else df.sparkSession.range(1)
    cells = [F.struct(F.lit(name).alias("rule"), F.lit(n).cast("long").alias("violations")) for name, n in shape]
    cells += [F.struct(F.lit(r.name).alias("rule"), F.col(f"v{i}").alias("violations")) for i, r in enumerate(told)]
    out = counted.select(F.explode(F.array(*cells)).alias("r")).select("r.*")
    return out.withColumn("passed", F.col("violations") == 0)


def require(checked: DataFrame) -> None:
    """An error that names the rules that fail; there are as many rows as rules."""
    if failed := [f"{r.rule} ({r.violations})" for r in checked.where(~F.col("passed")).collect()]:
        raise ValueError("evidence fails: " + ", ".join(failed))
