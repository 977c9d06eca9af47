"""What a search needs to know of its candidates: one row of metrics for each, and the gates in their order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import scoring
from tessera.plans.formula import complexity, data_family, parse


@dataclass(frozen=True)
class Weights:
    """What fitness takes off, and the bounds of the buckets."""

    stability_floor: float = 0.5
    free_fields: int = 3
    free_constants: int = 1
    per_unit: float = 0.1
    turnover_cost: float = 0.00005
    fast: float = 5.0
    medium: float = 21.0


def forms(spark, formulas: dict[str, str]) -> DataFrame:
    """(signal, base_fields, free_constants, depth, data_family) of formulas, from their text alone."""
    rows = []
    for name, text in formulas.items():
        node = parse(text)
        c = complexity(node)
        rows.append((name, int(c["fields"]), int(c["constants"]), int(c["depth"]), data_family(node)))
    return spark.createDataFrame(rows, "signal string, base_fields int, free_constants int, depth int, data_family string")


def metrics(
    curve: DataFrame, errors: DataFrame, turnover: DataFrame, coverage: DataFrame, forms: DataFrame, years: DataFrame, turnover_cut: float, weights: Weights = Weights(),
) -> DataFrame:
    """One row for each candidate: the numbers that gates, fitness and niches read.

    ``curve`` has the daily correlations (date, signal, horizon, ic), its smallest
    horizon being the one that is scored; ``errors`` (signal, se) their bootstrap
    errors; ``years`` (year) all years of the window, also those without any
    correlation.  Means, t and years are in the direction of the mean, which is
    ``sign``.  Without an error there is no t, and fitness is minus infinity; a
    half-life that is never reached counts as slow.
    """
    base = curve.withColumn("__h", F.min("horizon").over(Window.partitionBy("signal"))).where("horizon = __h")
    one = base.groupBy("signal").agg(F.avg("ic").alias("__m"), F.stddev_samp("ic").alias("__sd"), F.count("*").alias("n_days"))
    sign = F.when(F.coalesce("__m", F.lit(0.0)) >= 0, 1).otherwise(-1)
    one = one.withColumn("sign", sign)
    yearly = base.groupBy("signal", F.year("date").alias("year")).agg(F.avg("ic").alias("y")).join(years.distinct(), "year")
    held = yearly.join(one.select("signal", "sign"), "signal").groupBy("signal").agg(F.count_if(F.col("y") * F.col("sign") > 0).alias("__held"))
    all_years = years.distinct().agg(F.greatest(F.count("*"), F.lit(1)).alias("__years"))
    lives = scoring.half_life(curve.groupBy("signal", "horizon").agg(F.avg("ic").alias("mean_ic")))
    out = one.join(held, "signal", "left").join(F.broadcast(all_years), F.lit(True))  # one row
    for part in (errors.select("signal", F.col("se").alias("ic_se")), turnover.select("signal", "turnover"), coverage.select("signal", "coverage"), lives.select("signal", "half_life"), forms):
        out = out.join(part, "signal", "left")
    mean, se = F.col("__m") * F.col("sign"), F.col("ic_se")
    out = out.withColumns({"mean_ic": mean, "tstat": F.when(se > 0, mean / se), "icir": F.when(F.col("__sd") > 0, mean / F.col("__sd"))})
    units = F.greatest(F.lit(0), F.col("base_fields") - weights.free_fields) + F.greatest(F.lit(0), F.col("free_constants") - weights.free_constants)
    out = out.withColumns(
        {
            "stability": F.greatest(F.lit(weights.stability_floor), F.coalesce("__held", F.lit(0)) / F.col("__years")),
            "complexity_penalty": units * F.lit(weights.per_unit),
            "turnover_penalty": F.coalesce(F.when(se > 0, F.lit(weights.turnover_cost) * F.col("turnover") / se), F.lit(0.0)),
        }
    )
    fitness = F.abs("tstat") * F.col("stability") - F.col("complexity_penalty") - F.col("turnover_penalty")
    speed = F.when(F.col("half_life") < weights.fast, "fast").when(F.col("half_life") <= weights.medium, "medium").otherwise("slow")
    return out.select(
        "signal", "sign", "mean_ic", "ic_se", "tstat", "icir", "n_days", "coverage", "turnover", "half_life", "stability", "complexity_penalty", "turnover_penalty",
        F.coalesce(fitness, F.lit(float("-inf"))).alias("fitness"), speed.alias("horizon_bucket"), "data_family", F.when(F.col("turnover") <= turnover_cut, "low").otherwise("high").alias("turnover_bucket"),
    )


def gates(coverage: DataFrame, closest: DataFrame, screen: DataFrame, least_coverage: float = 0.9, most_correlation: float = 0.7, least_t: float = 1.0) -> DataFrame:
    """(signal, gate): the first gate that refuses each candidate, cheapest first, or null.

    ``coverage`` names all candidates; ``closest`` (a, corr) is what
    ``gram.correlation_gate`` gives, and no row there means no member to be like;
    ``screen`` (signal, screen) the |t| of a short slice.  A missing number fails.
    """
    all_ = coverage.select("signal", "coverage").join(closest.select(F.col("a").alias("signal"), F.col("corr").alias("__c")), "signal", "left").join(screen.select("signal", "screen"), "signal", "left")
    low = lambda c, least: F.coalesce(F.col(c) < least, F.lit(True)) | F.isnan(c)
    gate = F.when(low("coverage", least_coverage), "coverage").when(F.coalesce(F.col("__c") >= most_correlation, F.lit(False)), "correlation").when(low("screen", least_t), "cheap_screen")
    return all_.select("signal", gate.alias("gate"))


def simplified(children: DataFrame, share: float = 0.8) -> DataFrame:
    """(signal, gate) of simplified formulas: refused unless they are simpler and keep ``share`` of the parent's |IC|.

    ``children`` has signal, cost and mean_ic, and parent_cost and parent_ic.
    """
    ic, parent = F.abs("mean_ic"), F.abs("parent_ic")
    gate = F.when(F.col("cost") >= F.col("parent_cost"), "simplify_not_simpler").when((parent > 0) & (ic < share * parent), "simplify_lost_too_much_ic")
    return children.select("signal", gate.alias("gate"))
