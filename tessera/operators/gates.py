"""Promotion gates of strategies, and the factors that a fold of a backtest leans on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import inference


@dataclass(frozen=True)
class GateLimits:
    """What a strategy has to reach."""

    deflated_sharpe: float = 0.95
    positive_subperiods: int = 6
    subperiods: int = 8
    sector_share: float = 0.40
    drawdown: float = 0.25
    turnover: float = 0.30
    overlap: float = 0.50
    net_sharpe: float = 0.4


def _annual(ret: str, periods: int):
    """Annualised mean over spread of the returns that are there; 0 for one return or constant ones."""
    spread = F.stddev_samp(ret)
    return F.coalesce(F.when(spread > 0, F.avg(ret) / spread * F.sqrt(F.lit(float(periods)))), F.lit(0.0))


def promotion_gates(
    returns: DataFrame, by: str, baselines: tuple[str, ...] = (), sectors: DataFrame | None = None, overlap: DataFrame | None = None,
    trials: int | None = None, periods: int = 252, limits: GateLimits = GateLimits(), date: str = "date",
) -> DataFrame:
    """(by, gate, name, value, passed): eight gates for every strategy at once.

    ``returns`` has ``by``, date, net, turnover and the baselines' returns;
    ``sectors`` (by, sector, share) and ``overlap`` (by, overlap) may be missing,
    which fails their gates, as does a missing value of one strategy.  Rows
    without a net return take no part; a strategy without any has no gates.
    """
    net = returns.where(F.col("net").isNotNull() & ~F.isnan("net"))
    one = Window.partitionBy(by)
    order = one.orderBy(date)
    place, n = F.row_number().over(order) - 1, F.count("*").over(one)
    parts = F.least(F.lit(limits.subperiods), n)
    part = F.greatest(F.lit(0), F.ceil(F.round(place * parts / F.greatest(n - 1, F.lit(1)), 9)) - 1)
    equity = F.product(1 + F.col("net")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    net = net.withColumns({"__part": part, "__equity": equity})
    net = net.withColumn("__fall", 1 - F.col("__equity") / F.max("__equity").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    up = net.groupBy(by, "__part").agg(_annual("net", periods).alias("s")).groupBy(by).agg(F.count_if(F.col("s") > 0).cast("double").alias("up"))
    whole = net.groupBy(by).agg(_annual("net", periods).alias("sharpe"), F.max("__fall").alias("fall"))
    # turnover and baselines are judged on all rows, those without a net return included
    rest = returns.groupBy(by).agg(F.avg("turnover").alias("turnover"), *[_annual(b, periods).alias(f"__{b}") for b in baselines])
    skill = inference.deflated_sharpe(net, "net", (by,), trials).select(by, "dsr")
    all_ = whole.join(skill, by).join(up, by).join(rest, by)
    none = F.lit(None).cast("double")
    shares = sectors.groupBy(by).agg(F.max("share").alias("share")) if sectors is not None else None
    all_ = all_.join(shares, by, "left") if shares is not None else all_.withColumn("share", none)
    all_ = all_.join(overlap.select(by, "overlap"), by, "left") if overlap is not None else all_.withColumn("overlap", none)
    best = F.greatest(*[F.col(f"__{b}") for b in baselines]) if len(baselines) > 1 else F.col(f"__{baselines[0]}") if baselines else none
    ahead = F.col("sharpe") - best
    gates = [
        ("GATE-1", "Deflated Sharpe Ratio", F.col("dsr"), F.col("dsr") > limits.deflated_sharpe),
        ("GATE-2", "Subperiod Stability", F.col("up"), F.col("up") >= limits.positive_subperiods),
        ("GATE-3", "Sector Concentration", F.col("share"), F.col("share") <= limits.sector_share),
        ("GATE-4", "Max Drawdown", F.col("fall"), F.col("fall") < limits.drawdown),
        ("GATE-5", "Turnover Check", F.col("turnover"), F.col("turnover") < limits.turnover),
        ("GATE-6", "Factor Importance Stability", F.col("overlap"), F.col("overlap") >= limits.overlap),
        ("GATE-7", "Baseline Comparison", ahead, ahead > 0),
        ("GATE-8", "Net Sharpe", F.col("sharpe"), F.col("sharpe") > limits.net_sharpe),
    ]  # fixed values: numbers and names
    rows = [F.struct(F.lit(g).alias("gate"), F.lit(name).alias("name"), v.cast("double").alias("value"), F.coalesce(ok, F.lit(False)).alias("passed")) for g, name, v, ok in gates]
    return all_.select(by, F.explode(F.array(*rows)).alias("r")).select(by, "r.*")


def promoted(gates: DataFrame, by: str) -> DataFrame:
    """(by, passed, failed): whether a strategy passes all gates, and those that it fails."""
    failed = F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("gate"))))  # eight at most
    return gates.groupBy(by).agg(F.bool_and("passed").alias("passed"), F.array_join(failed, ",").alias("failed"))


def fold_factors(ic: DataFrame, folds: DataFrame, most: int = 3, date: str = "date", name: str = "signal") -> DataFrame:
    """(fold, signal, mean_ic, place): the factors of largest |mean daily IC| in each fold.

    ``folds`` has fold and the bounds b and e of its dates; equal ones come by name.
    """
    inside = F.col(date).between(F.col("b"), F.col("e"))
    means = ic.join(F.broadcast(folds), inside).groupBy("fold", name).agg(F.avg("ic").alias("mean_ic"))  # a fold a year, say
    order = Window.partitionBy("fold").orderBy(F.abs("mean_ic").desc(), name)
    return means.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
