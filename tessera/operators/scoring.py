"""Scoring of signals: rank correlation with labels, turnover, coverage, decay, selection.

Signals are long: (date, key, signal name, value), so a pool of any number of
signals is ranked by one window and reduced by one aggregation.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import correlation, percent_rank_average


def melt(wide: DataFrame, signals: Iterable[str], keep: Iterable[str] = ("date", "key")) -> DataFrame:
    """One row for each signal: columns ``keep``, signal and value."""
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), F.col(s).alias("value")) for s in signals]))
    return wide.select(*keep, pairs.alias("p")).select(*keep, "p.signal", "p.value")


def group_correlation(x: str, y: str) -> Column:
    """Sample correlation in an aggregation; NULL where a side is constant."""
    varied = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(varied, correlation(F.covar_samp(x, y), F.stddev_samp(x), F.stddev_samp(y)))


def daily_ic(long: DataFrame, label: str, minimum: int, by: tuple[str, ...] = ("signal",)) -> DataFrame:
    """Spearman correlation of value and label for each date (and signal).

    Both are ranked over the rows where both are present; dates with fewer than
    ``minimum`` such rows, or without spread, have none.
    """
    both = long.where(F.col("value").isNotNull() & F.col(label).isNotNull())
    ranked = both.select(
        "date", *by, percent_rank_average(F.col("value"), "date", *by).alias("__x"), percent_rank_average(F.col(label), "date", *by).alias("__y")
    )
    out = ranked.groupBy("date", *by).agg(group_correlation("__x", "__y").alias("ic"), F.count("*").alias("n"))
    return out.where((F.col("n") >= minimum) & F.col("ic").isNotNull()).select("date", *by, "ic", "n")


def ic_summary(ic: DataFrame, by: tuple[str, ...] = ("signal",)) -> DataFrame:
    """Mean, spread, t and number of dates of the correlations."""
    n, mean, spread = F.count("ic"), F.avg("ic"), F.stddev_samp("ic")
    t = F.when(spread > 0, mean / spread * F.sqrt(n))
    return ic.groupBy(*by).agg(mean.alias("mean_ic"), spread.alias("std_ic"), t.alias("t_ic"), n.alias("n_days"))


def yearly_ic(ic: DataFrame, by: tuple[str, ...] = ("signal",)) -> DataFrame:
    """Mean correlation of each year."""
    return ic.groupBy(*by, F.year("date").alias("year")).agg(F.avg("ic").alias("mean_ic"), F.count("*").alias("n_days"))


def year_stability(ic: DataFrame, by: tuple[str, ...] = ("signal",), floor: float = 0.5) -> DataFrame:
    """Share of all years with the sign of the overall mean, and whether it reaches ``floor``."""
    years = ic.select(F.year("date").alias("year")).distinct().agg(F.count("*").alias("years"))
    overall = ic.groupBy(*by).agg(F.signum(F.avg("ic")).alias("sign"))
    held = yearly_ic(ic, by).join(overall, list(by)).groupBy(*by).agg(F.count_if(F.col("mean_ic") * F.col("sign") > 0).alias("held"))
    share = F.col("held") / F.col("years")
    return held.crossJoin(F.broadcast(years)).select(*by, share.alias("share"), (share >= floor).alias("stable"))


def coverage(long: DataFrame, by: tuple[str, ...] = ("signal",)) -> DataFrame:
    """Share of the dense grid on which a signal is present."""
    return long.groupBy(*by).agg(F.avg(F.col("value").isNotNull().cast("double")).alias("coverage"))


def universe_coverage(long: DataFrame, available: str, by: tuple[str, ...] = ("signal",)) -> DataFrame:
    """Mean over dates of the share of available keys on which a signal is present."""
    there = F.col(available)
    daily = long.groupBy("date", *by).agg(
        F.count_if(there & F.col("value").isNotNull()).alias("hit"), F.count_if(there).alias("all")
    )
    return daily.where("all > 0").groupBy(*by).agg(F.avg(F.col("hit") / F.col("all")).alias("universe_coverage"))


def rank_weights(long: DataFrame, by: tuple[str, ...] = ("signal",)) -> DataFrame:
    """Demeaned ranks over their gross sum; missing and ungraded dates weigh 0."""
    day = Window.partitionBy("date", *by)
    ranked = long.withColumn("__r", percent_rank_average(F.col("value"), "date", *by))
    centred = ranked.withColumn("__c", F.col("__r") - F.avg("__r").over(day))
    gross = F.sum(F.abs("__c")).over(day)
    weight = F.coalesce(F.when(gross > 0, F.col("__c") / gross), F.lit(0.0))
    return centred.withColumn("weight", weight).drop("__r", "__c")


def turnover(long: DataFrame, by: tuple[str, ...] = ("signal",)) -> DataFrame:
    """Half the mean daily change of the weights of a dense grid; the first date has none."""
    past = F.lag("weight").over(Window.partitionBy(*by, "key").orderBy("date"))
    moved = rank_weights(long, by).withColumn("__d", F.abs(F.col("weight") - past))
    daily = moved.groupBy("date", *by).agg(F.sum("__d").alias("d")).where("d is not null")
    return daily.groupBy(*by).agg((F.avg("d") / 2).alias("turnover"))


def autocorrelation(long: DataFrame, by: tuple[str, ...] = ("signal",)) -> DataFrame:
    """Lag-1 correlation of each key's values, averaged over keys."""
    past = F.lag("value").over(Window.partitionBy(*by, "key").orderBy("date"))
    pairs = long.withColumn("__p", past).where("value is not null and __p is not null")
    return pairs.groupBy(*by, "key").agg(group_correlation("value", "__p").alias("c")).groupBy(*by).agg(F.avg("c").alias("autocorr"))


def half_life(curve: DataFrame, by: tuple[str, ...] = ("signal",)) -> DataFrame:
    """Horizon at which the mean correlation halves, by straight lines between horizons.

    ``curve`` has horizon and mean_ic.  NULL without a base; ``never`` marks
    curves that stay above half, whose half-life is NULL as well.
    """
    order = Window.partitionBy(*by).orderBy("horizon")
    base = F.first("mean_ic").over(order.rowsBetween(Window.unboundedPreceding, 0))
    share = F.when(base != 0, F.col("mean_ic") / base)
    steps = curve.withColumn("s", share).withColumns({"next_h": F.lead("horizon").over(order), "next_s": F.lead("s").over(order)})
    cross = F.when((F.col("s") > 0.5) & (F.col("next_s") <= 0.5), F.col("horizon") + (F.col("s") - 0.5) / (F.col("s") - F.col("next_s")) * (F.col("next_h") - F.col("horizon")))
    return steps.withColumn("x", cross).groupBy(*by).agg(
        F.min("x").alias("half_life"), ((F.count("x") == 0) & (F.count("s") > 0)).alias("never")
    )


def signal_correlation(long: DataFrame, minimum: int) -> DataFrame:
    """Mean daily rank correlation of every pair of signals (a < b).

    A self-join on (date, key): each key's row holds all its signals, so pairs
    are made inside a row and one aggregation by (pair, date) follows.
    """
    ranked = long.where("value is not null").select("date", "key", "signal", percent_rank_average(F.col("value"), "date", "signal").alias("r"))
    rows = ranked.groupBy("date", "key").agg(F.sort_array(F.collect_list(F.struct("signal", "r"))).alias("s"))
    pairs = rows.select("date", F.posexplode("s").alias("i", "a"), "s").select(
        "date", "a", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("b")
    )
    flat = pairs.select("date", F.col("a.signal").alias("a"), F.col("b.signal").alias("b"), F.col("a.r").alias("x"), F.col("b.r").alias("y"))
    daily = flat.groupBy("a", "b", "date").agg(group_correlation("x", "y").alias("c"), F.count("*").alias("n"))
    daily = daily.where((F.col("n") >= minimum) & F.col("c").isNotNull())
    return daily.groupBy("a", "b").agg(F.avg("c").alias("corr"), F.count("*").alias("n_days"))


def pooled_correlation(long: DataFrame, minimum: int = 100) -> DataFrame:
    """Rank correlation of signal pairs over all dates at once."""
    wide = long.where("value is not null").select("date", "key", "signal", percent_rank_average(F.col("value"), "date", "signal").alias("r"))
    left = wide.select(F.col("date").alias("__d"), F.col("key").alias("__k"), F.col("signal").alias("a"), F.col("r").alias("x"))
    right = wide.select("date", "key", F.col("signal").alias("b"), F.col("r").alias("y"))
    pairs = left.join(right, (F.col("__d") == F.col("date")) & (F.col("__k") == F.col("key")) & (F.col("a") < F.col("b")))
    out = pairs.groupBy("a", "b").agg(group_correlation("x", "y").alias("corr"), F.count("*").alias("n"))
    return out.where(F.col("n") >= minimum)


def usable(long: DataFrame, least: float = 2.0, by: tuple[str, ...] = ("signal",)) -> DataFrame:
    """Signals whose dates have ``least`` distinct values or more on average; constant ones have none to rank."""
    daily = long.groupBy("date", *by).agg(F.countDistinct("value").alias("n"))
    return daily.groupBy(*by).agg(F.avg("n").alias("mean_distinct")).where(F.col("mean_distinct") >= least)


def cheap_screen(tests: DataFrame, least: int = 60, t: str = "t_nw", n: str = "n") -> DataFrame:
    """``tests`` of a short slice with ``screen``: |t|, or 0 with fewer than ``least`` dates."""
    return tests.withColumn("screen", F.when(F.col(n) < least, F.lit(0.0)).otherwise(F.coalesce(F.abs(t), F.lit(0.0))))


def strided_ranks(long: DataFrame, days: DataFrame, k: int) -> DataFrame:
    """Ranks of every k-th date of a calendar with positions: enough to compare signals by."""
    kept = long.where("value is not null").join(F.broadcast(days.where(F.col("pos") % k == 0).select("date")), "date")
    return kept.select("date", "key", "signal", percent_rank_average(F.col("value"), "date", "signal").alias("rank"))


def combined_signal(long: DataFrame, signs: DataFrame) -> DataFrame:
    """Sum of signed, centred ranks; a missing signal adds 0, a key without any has none."""
    day = Window.partitionBy("date", "signal")
    ranked = long.withColumn("__r", percent_rank_average(F.col("value"), "date", "signal"))
    centred = ranked.withColumn("__c", F.col("__r") - F.avg("__r").over(day)).join(signs, "signal")
    total = F.sum(F.coalesce(F.col("__c") * F.col("sign"), F.lit(0.0)))
    return centred.groupBy("date", "key").agg(F.when(F.count("__c") > 0, total).alias("value"))


def greedy_uncorrelated(scores: list[dict], pairs: dict[tuple[str, str], float], most: int = 10, limit: float = 0.7, least_t: float = 2.0, least_autocorr: float = 0.2) -> list[dict]:
    """Strongest signals first, each little correlated with those taken; negative ones are flipped."""
    taken: list[dict] = []
    for s in sorted(scores, key=lambda s: (-abs(s["t_ic"] or 0), s["signal"])):
        if len(taken) == most:
            break
        if abs(s["t_ic"] or 0) < least_t or (s.get("autocorr") or 0) < least_autocorr:
            continue
        close = [abs(pairs.get(tuple(sorted((s["signal"], o["signal"]))), 0.0)) for o in taken]
        if all(c <= limit for c in close):
            taken.append(s | {"sign": 1 if s["t_ic"] >= 0 else -1})
    return taken
