"""Panels derived from the given tables, as DataFrames and as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import panel

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function as a query, with its SQL."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            SQL[key] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month x supplier bars from lineitem; the first and last line give open and close.

    One aggregation: the order of lines is carried in the aggregates, not by a sort.
    Lines that are equal up to the quantity have one price, so the order ends there,
    and the price is made of it afterwards.
    """
    line = read(spark, sf_dir, "lineitem")
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    px = F.col("l_extendedprice") / F.col("l_quantity")
    out = line.groupBy(F.trunc("l_shipdate", "month").alias("date"), F.col("l_suppkey").alias("permno")).agg(
        F.min(order).alias("open"), F.max(px).alias("high"), F.min(px).alias("low"), F.max(order).alias("close"),
        F.sum("l_quantity").cast("double").alias("volume"), F.sum("l_extendedprice").cast("double").alias("dollar_volume"),
    )
    out = out.withColumns({c: F.col(f"{c}.l_extendedprice") / F.col(f"{c}.l_quantity") for c in ("open", "close")})
    split = F.when((F.col("permno") % 5 == 0) & (F.col("date") < F.lit("1998-07-01").cast("date")), 2.0).otherwise(1.0)
    return out.withColumn("adj_close", F.col("close") / split)


BARS = """
bar_lines AS (
  SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, l_suppkey AS permno,
         l_extendedprice / l_quantity AS px, l_quantity AS q, l_extendedprice AS ext,
         row_number() OVER (PARTITION BY date_trunc('month', l_shipdate), l_suppkey
           ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_discount, l_tax) AS rn,
         count(*) OVER (PARTITION BY date_trunc('month', l_shipdate), l_suppkey) AS n
  FROM lineitem),
bars AS (
  SELECT date, permno, max(CASE WHEN rn = 1 THEN px END) AS open, max(px) AS high, min(px) AS low,
         max(CASE WHEN rn = n THEN px END) AS close,
         max(CASE WHEN rn = n THEN px END) / CASE WHEN permno % 5 = 0 AND date < DATE '1998-07-01' THEN 2.0 ELSE 1.0 END AS adj_close,
         CAST(sum(q) AS DOUBLE) AS volume, CAST(sum(ext) AS DOUBLE) AS dollar_volume
  FROM bar_lines GROUP BY date, permno)"""

GRID = f"""{BARS},
grid AS (
  SELECT *, close / lag(close) OVER (PARTITION BY key ORDER BY date) - 1 AS return
  FROM (SELECT k.permno AS key, c.date, open * (adj_close / close) AS open, high * (adj_close / close) AS high,
               low * (adj_close / close) AS low, adj_close AS close, adj_close, volume, dollar_volume
        FROM (SELECT DISTINCT permno FROM bars) k CROSS JOIN (SELECT DISTINCT date FROM bars) c
        LEFT JOIN bars b ON b.permno = k.permno AND b.date = c.date))"""

USER_DAYS = """
user_days AS (
  SELECT CAST(ts AS DATE) AS date, user_id AS key, min(value) AS low, max(value) AS high,
         sum(value) AS volume, avg(value) AS close, count(*) AS n_events
  FROM events GROUP BY CAST(ts AS DATE), user_id),
gaps AS (
  SELECT k.key, c.date, low, high, volume, close, CAST(n_events AS DOUBLE) AS open
  FROM (SELECT DISTINCT key FROM user_days) k CROSS JOIN (SELECT DISTINCT date FROM user_days) c
  LEFT JOIN user_days b ON b.key = k.key AND b.date = c.date)"""


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem")  # every line has a price, so its months and suppliers are those of the bars
    days = line.select(F.trunc("l_shipdate", "month").alias("date")).distinct()
    keys = line.select(F.col("l_suppkey").alias("permno")).distinct()
    return panel.field_panel(bars(spark, sf_dir), "permno", days, keys)


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day x user panel with gaps: the fields are statistics of the day's events."""
    days = read(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("date"), F.col("user_id").alias("key")).agg(
        F.min("value").alias("low"), F.max("value").alias("high"), F.sum("value").alias("volume"), F.avg("value").alias("close"),
        F.count("*").cast("double").alias("open"),
    )
    return panel.dense_grid(days, "key")


def r(x: str, digits: int = 6) -> str:
    """SQL for :func:`tessera.functions.rounded`."""
    return f"floor(({x}) * {float(10**digits)!r} + 0.4997) / {float(10**digits)!r}"
