"""Reference data: fundamental ratios, sectors, ticker snapshots, fixed samples, and run-log reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.scratch import scratch

from tessera.functions import finite

EPS = 1e-9
# The first range that holds a code gives its sector.
SIC_SECTORS = (
    (3570, 3699, "Information Technology"),
    (3810, 3839, "Information Technology"),
    (100, 999, "Energy"),
    (1000, 1499, "Materials"),
    (1500, 1799, "Industrials"),
    (2000, 2399, "Consumer Staples"),
    (2400, 3999, "Industrials"),
    (4000, 4799, "Industrials"),
    (4800, 4899, "Communication Services"),
    (4900, 4949, "Utilities"),
    (5000, 5199, "Industrials"),
    (5200, 5999, "Consumer Discretionary"),
    (6000, 6499, "Financials"),
    (6500, 6999, "Real Estate"),
    (7000, 7299, "Consumer Discretionary"),
    (7300, 7399, "Industrials"),
    (7500, 7999, "Consumer Discretionary"),
    (8000, 8099, "Health Care"),
    (8100, 8999, "Industrials"),
    (9100, 9729, "Utilities"),
)
# Column names of snapshots and what they are called here.
SNAPSHOT_NAMES = {
    "Symbol": "Code", "Ticker": "Code", "Security": "Name", "Company": "Name", "GICS Sector": "Sector",
    "GICS Sub-Industry": "Industry", "Sub-Industry": "Industry", "Sub Industry": "Industry",
}


def sector_of(code: Column) -> Column:
    """Sector of an industry code; unknown without one or outside all ranges."""
    n = code.try_cast("double").cast("int")
    out = F.when(n.isNull(), F.lit("Unknown"))
    for low, high, name in SIC_SECTORS:
        out = out.when(n.between(low, high), F.lit(name))
    return out.otherwise(F.lit("Unknown"))


def ratios(items: DataFrame) -> DataFrame:
    """The eight ratios of a report; infinities and absent inputs are missing, absent debt is none."""
    book = F.coalesce("ceqq", "seqq")
    debt = F.coalesce("dlttq", F.lit(0.0)) + F.coalesce("dlcq", F.lit(0.0))
    parts = {
        "roa": (F.col("niq"), F.col("atq")), "roe": (F.col("niq"), book), "operating_margin": (F.col("oiadpq"), F.col("revtq")),
        "leverage": (debt, F.col("atq")), "asset_turnover": (F.col("revtq"), F.col("atq")), "book_per_share": (book, F.col("cshoq")),
        "earnings_per_share": (F.col("ibq"), F.col("cshoq")), "accrual_gap": (F.col("niq") - F.col("oiadpq"), F.col("atq")),
    }
    return items.withColumns({name: finite(F.try_divide(a, b + F.lit(EPS))) for name, (a, b) in parts.items()})


def snapshot(df: DataFrame) -> DataFrame:
    """A constituents snapshot as Code, Exchange, Name, Sector, Industry, one row for each code."""
    for old, new in SNAPSHOT_NAMES.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    if "Code" not in df.columns:
        raise ValueError("a snapshot needs a column Symbol or Ticker")
    df = df.withColumn("Code", F.replace(F.trim(F.upper("Code")), F.lit("."), F.lit("-")))
    absent = {"Name": F.col("Code"), "Sector": F.lit(None).cast("string"), "Industry": F.lit(None).cast("string")}
    df = df.withColumns({c: v for c, v in absent.items() if c not in df.columns} | {"Exchange": F.lit("US")})
    return df.select("Code", "Exchange", "Name", "Sector", "Industry").dropDuplicates(["Code"])


def even_sample(df: DataFrame, order: list[str], most: int = 32) -> DataFrame:
    """At most ``most`` rows at even distances of the ordered table, both ends included."""
    n = df.count()
    count = min(most, n)
    if not count:
        return df
    wanted = sorted({int(i * (n - 1) / (count - 1)) if count > 1 else 0 for i in range(count)})
    # Rows are numbered without one global window: range partitions in order, then places inside them.
    # Ranges are drawn by sampling, so the numbered rows are written once and both steps read that table.
    path = scratch(df.sparkSession, "even-sample")
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"__part": F.spark_partition_id(), "__row": F.monotonically_increasing_id()})
    parts.withColumn("__row", F.col("__row") - F.shiftleft(F.col("__part").cast("long"), 33)).write.parquet(path)
    parts = df.sparkSession.read.parquet(path)
    sizes = {r["__part"]: r["n"] for r in parts.groupBy("__part").agg(F.count("*").alias("n")).collect()}  # one row for each partition
    hits, before = [], 0
    for part in sorted(sizes):
        hits += [(part, i - before) for i in wanted if before <= i < before + sizes[part]]
        before += sizes[part]
    at = df.sparkSession.createDataFrame(hits, "__part int, __row long")
    return parts.join(F.broadcast(at), ["__part", "__row"], "left_semi").drop("__part", "__row")


def gate_tallies(log: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Rejections for each gate; ``archive:*`` reasons count together."""
    gate = F.when(F.col("rejected_by").startswith("archive"), F.lit("archive")).otherwise(F.col("rejected_by"))
    return log.where("rejected_by is not null").groupBy(*by, gate.alias("gate")).agg(F.count("*").alias("n"))


def totals(log: DataFrame, columns: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """Sums of counters over a run log."""
    return log.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns])


def survivors(log: DataFrame, group: str, passed: str, retention: str) -> DataFrame:
    """For each group its size, survivors, their share and the survivors' median retention."""
    ok = F.col(passed)
    return log.groupBy(group).agg(
        F.count("*").alias("n"), F.count_if(ok).alias("survivors"), F.avg(ok.cast("double")).alias("rate"),
        F.percentile(F.when(ok, F.col(retention)), F.lit(0.5)).alias("median_retention"),
    )


def best_of_group(df: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """For each group the largest |value| and whose it is (smallest name on a tie)."""
    order = Window.partitionBy(group).orderBy(F.abs(value).desc(), name)
    return df.withColumn("__k", F.row_number().over(order)).where("__k = 1").select(group, name, value)


def set_summary(tests: DataFrame, group: str, t: str = "t", fit: str = "fit_ic", later: str = "hold_ic") -> DataFrame:
    """For each set of factors its size, the largest |t|, the median retention and the share whose later mean keeps the sign.

    Retention is the later mean over the fitted one; factors without either count for neither.
    """
    both = F.col(fit).isNotNull() & F.col(later).isNotNull() & (F.col(fit) != 0)
    kept = F.when(both, F.col(later) / F.when(F.col(fit) != 0, F.col(fit)))
    return tests.groupBy(group).agg(
        F.count("*").alias("n"), F.max(F.abs(t)).alias("best_t"), F.percentile(kept, F.lit(0.5)).alias("median_retention"), F.avg((kept > 0).cast("double")).alias("sign_held")
    )


def trace_summary(trace: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, verdict, n) of a trace of hypotheses, and a row ``distinct_expressions`` for what was ever tried.

    Every expression ever proposed counts once there, whatever became of it: that
    is the denominator of a multiple test.
    """
    verdicts = trace.groupBy(*by, "verdict").agg(F.count("*").alias("n"))
    tried = trace.groupBy(*by).agg(F.countDistinct("expression_id").alias("n")).withColumn("verdict", F.lit("distinct_expressions"))
    return verdicts.unionByName(tried)


def unseen(proposals: DataFrame, trace: DataFrame, column: str = "expression_id") -> DataFrame:
    """The proposals that no run has tried, each once."""
    return proposals.dropDuplicates([column]).join(trace.select(column).distinct(), column, "left_anti")
