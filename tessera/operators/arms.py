"""Sets of factors against each other: what each selects, how that holds later, and how new it is."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import inference, runlog


def select_uncorrelated(
    scores: DataFrame, pairs: DataFrame, most: int = 10, limit: float = 0.7, least_t: float = 2.0, least_autocorr: float = 0.2, by: tuple[str, ...] = ()
) -> DataFrame:
    """(by, signal, sign, place): the strongest signals of each set that are little correlated with those taken before.

    ``scores`` has ``by``, signal, t_ic and autocorr; ``pairs`` (a, b, corr) each
    pair once.  Signals come by |t|, then name; one whose |correlation| with a
    taken one exceeds ``limit`` is passed over.  That is the fold of a run log in
    which nothing is evicted, so every set is one ordered pass and pairs stay in
    Spark: a signal brings those that it is too like.
    """
    size = F.abs(F.coalesce("t_ic", F.lit(0.0)))
    fit = scores.where((size >= least_t) & (F.coalesce("autocorr", F.lit(0.0)) >= least_autocorr)).withColumn("__set", F.concat_ws("/", F.lit(""), *by))
    order = Window.partitionBy("__set").orderBy(size.desc(), "signal")
    close = pairs.where(F.abs("corr") > limit)
    close = close.select("a", "b").unionByName(close.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = close.groupBy(F.col("a").alias("signal")).agg(F.collect_list(F.struct(F.col("b").alias("id"), F.lit(1.0).alias("corr"), F.lit(0).alias("shared"))).alias("conflicts"))
    rows = fit.withColumn("seq", F.row_number().over(order).cast("long")).join(near, "signal", "left")
    none = F.array().cast("array<struct<id: string, corr: double, shared: int>>")
    rows = rows.select(
        *by, "signal", "t_ic", "__set", F.col("signal").alias("id"), F.lit("all").alias("niche"), size.alias("fitness"), "seq", F.coalesce("conflicts", none).alias("conflicts"),
        F.lit(0.5).alias("max_corr"), F.lit(1).alias("max_shared"),
    ).withColumnRenamed("__set", "set_key")
    taken = runlog.admissions(rows, most, ("set_key",), conflicts=True)
    place = F.row_number().over(Window.partitionBy("set_key").orderBy("seq"))
    return taken.withColumn("place", place).select(*by, "signal", F.when(F.col("t_ic") >= 0, 1).otherwise(-1).alias("sign"), "place")


def compare_sets(tests: DataFrame, taken: DataFrame, holdout: DataFrame, closest: DataFrame, like: float = 0.9) -> DataFrame:
    """A row for each set: candidates, best |t| against the luck of as many, what was selected and how it held.

    ``tests`` has set, signal and t (null for what could not be scored), ``taken``
    set and signal, ``holdout`` signal, fit_ic and hold_ic, ``closest`` (a, corr)
    each signal's strongest |correlation| with a published one.  ``share_known`` is
    the share of a set's signals beyond ``like`` there.
    """
    scored = F.count("t")
    one = tests.groupBy("set").agg(F.count("*").alias("candidates"), scored.alias("n"), F.max(F.abs("t")).alias("best_t"))
    one = inference.expected_max_t(one).withColumnsRenamed({"n": "scorable", "expected": "null_best_t"})
    kept = F.when(F.col("fit_ic") != 0, F.col("hold_ic") / F.when(F.col("fit_ic") != 0, F.col("fit_ic")))
    held = taken.join(holdout, "signal", "left").withColumn("__k", kept).groupBy("set").agg(
        F.count("*").alias("selected"), F.percentile("__k", F.lit(0.5)).alias("median_retention"), F.avg((F.col("__k") > 0).cast("double")).alias("sign_held")
    )
    known = tests.select("set", "signal").join(closest.select(F.col("a").alias("signal"), "corr"), "signal", "left")
    known = known.groupBy("set").agg(F.avg((F.col("corr") > like).cast("double")).alias("share_known"))
    return one.join(held, "set", "left").na.fill(0, ["selected"]).join(known, "set", "left")


def compare_arms(ic: DataFrame, base: str, starts: DataFrame, block: int, n: int) -> DataFrame:
    """Every arm against ``base`` on the same dates: difference of mean ICs, its interval, p and Holm-adjusted p.

    ``ic`` has pos, arm and value for every arm and date.  All arms are resampled in
    the same blocks of dates, as they trade the same days.
    """
    other = ic.where(F.col("arm") == base).select("pos", F.col("value").alias("__b"))
    diff = ic.where(F.col("arm") != base).join(other, "pos").select(F.col("arm").alias("signal"), "pos", (F.col("value") - F.col("__b")).alias("value"))
    seen = diff.groupBy("signal").agg(F.avg("value").alias("observed"), F.count("*").alias("days"))
    draws = inference.bootstrap_means(diff, starts, block, n).join(seen.select("signal", "observed"), "signal")
    far = F.abs(F.col("mean") - F.avg("mean").over(Window.partitionBy("signal"))) >= F.abs("observed")
    told = draws.withColumn("__far", far).groupBy("signal").agg(
        F.percentile("mean", F.lit(0.025)).alias("lo"), F.percentile("mean", F.lit(0.975)).alias("hi"), F.avg(F.col("__far").cast("double")).alias("p")
    )
    return inference.holm(seen.join(told, "signal"), "p").withColumnRenamed("signal", "arm")
