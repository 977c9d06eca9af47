"""From signals to portfolios: features, weights, costs, simulation and its statistics."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import safe_div
from tessera.functions.groups import map_groups, numbers


def series_features(bars: DataFrame, key: str = "permno", date: str = "date", price: str = "adj_close", windows: tuple[int, int, int] = (5, 21, 252)) -> DataFrame:
    """Momentum, volatility, volume and range features on observed rows, each key on its own.

    Windows count a key's own rows (not calendar dates); momentum fills gaps
    forward; rolling values need fewer rows than their window.
    """
    rows = Window.partitionBy(key).orderBy(date)
    past = rows.rowsBetween(Window.unboundedPreceding, 0)
    filled = F.last(price, ignorenulls=True).over(past)
    b = bars.withColumn("__p", filled)
    for w in windows:
        b = b.withColumn(f"mom_{w}", safe_div(F.col("__p"), F.lag("__p", w).over(rows)) - 1)
    b = b.withColumn("__r", safe_div(F.col("__p"), F.lag("__p", 1).over(rows)) - 1)

    def rolling(f, column: str, size: int, least: int) -> Column:
        frame = rows.rowsBetween(-(size - 1), 0)
        return F.when(F.count(column).over(frame) >= least, f(column).over(frame))

    b = b.withColumns(
        {
            "vol_21": rolling(F.stddev_samp, "__r", 21, 10),
            "vol_63": rolling(F.stddev_samp, "__r", 63, 20),
            "vol_5d": rolling(F.avg, "volume", 5, 3),
            "adv20": rolling(F.avg, "dollar_volume", 20, 10),
            "volume_20": rolling(F.avg, "volume", 20, 10),
            "range": safe_div(F.col("high") - F.col("low"), F.col("close")),
        }
    )
    b = b.withColumns({"volume_accel": safe_div(F.col("vol_5d"), F.col("volume_20")) - 1, "vol_ratio": safe_div(F.col("vol_21"), F.col("vol_63"))})
    return b.drop("__p", "__r")


def features(
    bars: DataFrame, key: str = "permno", date: str = "date", price: str = "adj_close", windows: tuple[int, int, int] = (5, 21, 252), keep: Iterable[str] | None = None
) -> DataFrame:
    """``series_features`` with their ranks by date, and the mean of these as ``score``.

    As windows the seven ranks would sort a task's dates fourteen times over and
    hold every sort; they are one Arrow pass over whole dates instead.  With
    ``keep`` only these columns and the score are returned, and no others go
    through it.
    """
    b = series_features(bars, key, date, price, windows)
    up, down = [f"mom_{w}" for w in windows] + ["volume_accel"], ["vol_21", "range", "vol_ratio"]
    names = [f"rank_{c}" for c in up + down]
    held = b.columns if keep is None else list(dict.fromkeys([key, date, *keep]))
    signed = [F.col(c).alias(f"rank_{c}") for c in up] + [(-F.col(c)).alias(f"rank_{c}") for c in down]
    dealt = b.select(*held, *signed).repartition(date)

    def rank(rows: pa.RecordBatch, edges: np.ndarray) -> pa.RecordBatch:
        for name in names:
            parts = np.split(numbers(rows, [name])[0], edges[1:-1])
            ranks = np.concatenate([pd.Series(part).rank(pct=True).to_numpy() for part in parts])
            rows = rows.set_column(rows.schema.get_field_index(name), name, pa.array(ranks, pa.float64(), from_pandas=True))
        return rows

    ranked = map_groups(dealt, date, date, rank, dealt.schema)
    there = F.array_compact(F.array(*[F.col(c) for c in names]))
    score = F.when(F.size(there) > 0, F.aggregate(there, F.lit(0.0), lambda a, v: a + v) / F.size(there))
    ranked = ranked.withColumn("score", score)
    return ranked if keep is None else ranked.drop(*names)


def top_weights(scored: DataFrame, k: int, cap: float, date: str = "date", key: str = "permno", score: str = "score", cash: float = 0.0) -> DataFrame:
    """Equal weights of each date's k best scores, each at most ``cap``, ``cash`` kept back."""
    order = Window.partitionBy(date).orderBy(F.col(score).desc(), key)
    best = scored.where(F.col(score).isNotNull()).withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= k)
    n = F.count("*").over(Window.partitionBy(date))
    return best.withColumn("weight", F.least(F.lit(1 - cash) / n, F.lit(cap))).drop("__k")


def capped_weights(scored: DataFrame, k: int, cap: float, sector_cap: float, date: str = "date", key: str = "permno", score: str = "score", sector: str = "sector") -> DataFrame:
    """Greedy weights in score order under a name cap and a sector cap, with a second pass for the rest.

    The first pass gives each name 1 / k at most; a name whose sector is full
    makes way for the next, until k names hold something.  The second fills
    names up to ``cap`` in the same order.  One date at a time (a date holds one
    row for each security, a bounded group).
    """
    wide = scored.select(F.col(date).alias("date"), F.col(key).alias("key"), F.col(score).alias("score"), F.col(sector).alias("sector"))

    def allot(pdf):
        pdf = pdf.sort_values(["score", "key"], ascending=[False, True], ignore_index=True)
        names = pdf["sector"].fillna("Unknown")
        held, room, left = {}, dict.fromkeys(names, min(max(sector_cap, 0.0), 1.0)), 1.0
        for most in (min(1 / k, cap), cap):
            for i, s in names.items():
                if i not in held and len(held) == k:
                    continue
                more = min(most - held.get(i, 0.0), room[s], left)
                if more > 1e-10:
                    held[i] = held.get(i, 0.0) + more
                    room[s] -= more
                    left -= more
        out = pdf.loc[sorted(held)].assign(weight=[held[i] for i in sorted(held)])
        return out[["date", "key", "sector", "score", "weight"]]

    return wide.where("score is not null").groupBy("date").applyInPandas(allot, "date date, key long, sector string, score double, weight double")


def trade_cost(notional: Column, adv: Column, volatility: Column, spread: float = 0.0005, slippage: float = 0.0005, impact: float = 0.1) -> Column:
    """Cost in currency: spread and slippage, and impact x volatility x square root of participation."""
    share = F.when(adv > 0, F.sqrt(F.abs(notional) / adv)).otherwise(F.lit(0.0))
    return F.abs(notional) * (F.lit(spread + slippage) + F.lit(impact) * F.coalesce(volatility, F.lit(0.0)) * share)


def cap_turnover(previous: DataFrame, target: DataFrame, most: float, cap: float = 1.0, total: float = 1.0, key: str = "key", by: tuple[str, ...] = ()) -> DataFrame:
    """Blend previous weights towards the target so that half the change is at most ``most``.

    A target within the bound stays as it is, as does one without any previous
    weight.  Blended weights lie in [0, ``cap``] and are scaled down where they
    sum to more than ``total``.  ``by`` keeps portfolios (dates) apart.
    """
    keys = [*by, key]
    both = previous.select(*keys, F.col("weight").alias("w0")).join(target.select(*keys, F.col("weight").alias("w1")), keys, "full_outer")
    both = both.withColumn("__had", F.col("w0").isNotNull()).na.fill(0.0, ["w0", "w1"])
    one = Window.partitionBy(*by)  # a portfolio's names, a bounded group
    turn = F.sum(F.abs(F.col("w1") - F.col("w0"))).over(one) / 2
    both = both.withColumns({"__turn": turn, "__any": F.max("__had").over(one)})
    over = F.col("__any") & (F.col("__turn") > most) & (F.lit(most) > 0)
    step = F.col("w0") + F.try_divide(F.lit(most), "__turn") * (F.col("w1") - F.col("w0"))
    both = both.withColumn("weight", F.when(over, F.greatest(F.least(step, F.lit(cap)), F.lit(0.0))).otherwise(F.col("w1"))).withColumn("__over", over)
    sum_ = F.sum("weight").over(one)
    scaled = F.when(F.col("__over") & (sum_ > total), F.col("weight") * F.lit(total) / sum_).otherwise(F.col("weight"))
    return both.withColumn("weight", scaled).where("weight > 1e-8").select(*keys, "weight")


def rebalance(
    positions: DataFrame, equity: Column, cash: float = 0.05, participation: float = 0.05, least: float = 100.0, fractional: bool = True
) -> DataFrame:
    """Shares to hold after the trades of one open, within what the market takes.

    ``positions`` has shares (held before), entry (price), adv, target (weight;
    null or 0 for a name that wasn't chosen), present (whether the name stands in
    the day's table; null counts as present) and any keys.  A name that left the
    table is sold whole.  Of the others, a change below ``least`` isn't traded, and a
    larger one is cut to ``participation`` of the average volume, chosen or not;
    whole shares are rounded down.
    New columns: held_value, value, new_shares, notional, weight, old_weight.
    """
    entry, shares = F.col("entry"), F.coalesce("shares", F.lit(0.0))
    out = positions.withColumn("held_value", shares * entry)
    left = ~F.coalesce("present", F.lit(True))
    wish = F.greatest(F.greatest(equity * (1 - cash), F.lit(0.0)) * F.coalesce("target", F.lit(0.0)), F.lit(0.0))
    change = wish - F.col("held_value")
    bound = F.when((F.col("adv") > 0) & (F.lit(participation) > 0), F.col("adv") * participation)
    cut = F.greatest(F.lit(0.0), F.col("held_value") + F.signum(change) * bound)
    value = F.when(left, F.lit(0.0)).when(F.abs(change) < least, F.col("held_value")).when(F.abs(change) > bound, cut).otherwise(wish)
    out = out.withColumn("value", value)
    if fractional:
        out = out.withColumn("new_shares", F.when(entry > 0, F.col("value") / entry).otherwise(0.0))
    else:
        out = out.withColumn("new_shares", F.when(entry > 0, F.floor(F.greatest("value", F.lit(0.0)) / entry + 1e-12).cast("double")).otherwise(0.0))
        out = out.withColumn("value", F.col("new_shares") * entry)
    return out.withColumns({
        "notional": F.abs(F.col("value") - F.col("held_value")),
        "weight": F.when(equity > 0, F.col("value") / equity).otherwise(0.0), "old_weight": F.when(equity > 0, F.col("held_value") / equity).otherwise(0.0),
    })


def open_returns(prices: DataFrame, date: str = "date", key: str = "permno") -> DataFrame:
    """(date, key, ret): from the next open to the one after, where both are positive."""
    series = Window.partitionBy(key).orderBy(date)
    px = prices.select(date, key, F.lead("open", 1).over(series).alias("__in"), F.lead("open", 2).over(series).alias("__out"))
    return px.where("__in > 0 and __out > 0").select(date, key, (F.col("__out") / F.col("__in") - 1).alias("ret"))


def baselines(gains: DataFrame, benchmark: Column, momentum: DataFrame, k: int, cash: float, date: str = "date", key: str = "permno", value: str = "mom") -> DataFrame:
    """Daily returns of three plain portfolios: one benchmark name, all names alike, the k of strongest momentum.

    ``gains`` has ret of the active names; each portfolio keeps ``cash`` back.
    """
    order = Window.partitionBy(date).orderBy(F.col(value).desc(), key)
    top = momentum.where(F.col(value).isNotNull()).withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= k).select(date, key, F.lit(True).alias("__top"))
    all_ = gains.join(top, [date, key], "left")
    mean = lambda flag: F.avg(F.when(flag, F.col("ret"))) * (1 - cash)
    return all_.groupBy(date).agg(mean(benchmark).alias("benchmark"), mean(F.lit(True)).alias("equal"), mean(F.col("__top")).alias("momentum"))


def portfolio_returns(weights: DataFrame, prices: DataFrame, date: str = "date", key: str = "permno") -> DataFrame:
    """Return of each date's weights from the next open to the one after; exits without a price use the entry close."""
    series = Window.partitionBy(key).orderBy(date)
    px = prices.select(key, date, F.lead("open", 1).over(series).alias("entry"), F.lead("open", 2).over(series).alias("exit"), F.lead("close", 1).over(series).alias("mark"))
    joined = weights.join(px, [key, date]).where("entry > 0")
    gain = F.when(F.col("exit") > 0, F.col("exit")).otherwise(F.col("mark")) / F.col("entry") - 1
    return joined.groupBy(date).agg(F.sum(F.col("weight") * gain).alias("ret"), F.count("*").alias("names"))


def weight_turnover(weights: DataFrame, days: DataFrame, date: str = "date", key: str = "permno") -> DataFrame:
    """Half the change of weights between consecutive dates, by a join on positions."""
    order = days.select(date, "pos")
    now = weights.join(order, date).select("pos", key, F.col("weight").alias("w"))
    before = now.select((F.col("pos") + 1).alias("pos"), key, F.col("w").alias("v"))
    both = now.join(before, ["pos", key], "full_outer").join(order, "pos")
    change = F.abs(F.coalesce("w", F.lit(0.0)) - F.coalesce("v", F.lit(0.0)))
    return both.groupBy(date).agg((F.sum(change) / 2).alias("turnover"))


def sharpe(ret: str, periods: int) -> Column:
    """Annualised mean over spread; 0 for empty or constant series."""
    spread = F.stddev_samp(ret)
    return F.coalesce(F.when(spread > 0, F.avg(ret) / spread * F.sqrt(F.lit(float(periods)))), F.lit(0.0))


def equity_curve(returns: DataFrame, ret: str = "ret", date: str = "date", by: tuple[str, ...] = ()) -> DataFrame:
    """Compounded equity, its running peak and the drawdown."""
    past = Window.partitionBy(*by).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    curve = returns.withColumn("equity", F.product(1 + F.coalesce(F.col(ret), F.lit(0.0))).over(past))
    return curve.withColumn("peak", F.max("equity").over(past)).withColumn("drawdown", F.col("equity") / F.col("peak") - 1)


def subperiod_sharpe(returns: DataFrame, parts: int, ret: str = "ret", date: str = "date", periods: int = 12) -> DataFrame:
    """Sharpe ratio of ``parts`` equal stretches of the row numbers (quantile bins, not ntile)."""
    whole = Window.partitionBy()
    i, n = F.row_number().over(Window.orderBy(date)) - 1, F.count("*").over(whole)
    part = F.greatest(F.lit(0), F.ceil(F.round(i * F.lit(parts) / (n - 1), 9)) - 1)
    return returns.withColumn("part", part.cast("long")).groupBy("part").agg(sharpe(ret, periods).alias("sharpe"), F.count("*").alias("n"))


def sample_moments(ret: str) -> tuple[Column, Column]:
    """Bias-corrected skewness and excess kurtosis from the population moments."""
    n = F.count(ret)
    skew = F.skewness(ret) * F.sqrt(n * (n - 1)) / (n - 2)
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(ret) + 6)
    return F.when(n > 2, skew), F.when(n > 3, kurt)


def sector_contribution(weights: DataFrame, gains: DataFrame, sector: str = "sector") -> DataFrame:
    """Sum of |weight x return| by sector, and its share of all."""
    by = weights.join(gains, ["date", "permno"]).groupBy(sector).agg(F.sum(F.abs(F.col("weight") * F.col("gain"))).alias("contribution"))
    return by.withColumn("share", F.col("contribution") / F.sum("contribution").over(Window.partitionBy()))


def fold_stability(sets: DataFrame, fold: str = "fold", member: str = "member") -> DataFrame:
    """Jaccard similarity of each fold's set with the one before."""
    per = sets.groupBy(fold).agg(F.array_sort(F.collect_set(member)).alias("s"))
    pairs = per.withColumn("p", F.lag("s").over(Window.orderBy(fold))).where("p is not null")
    return pairs.select(fold, (F.size(F.array_intersect("s", "p")) / F.size(F.array_union("s", "p"))).alias("jaccard"))


def order_intents(target: DataFrame, held: DataFrame, deployable: float, least: float = 1.0, key: str = "key", by: tuple[str, ...] = ()) -> DataFrame:
    """The trades from held positions to target weights, as orders.

    ``held`` has market_value, qty and price.  Buys are told in currency; sells
    in shares, never more than are held, where there is a price.  Changes under
    ``least`` are no trades.
    """
    keys = [*by, key]
    both = target.select(*keys, "weight").join(held.select(*keys, "market_value", "qty", "price"), keys, "full_outer")
    both = both.na.fill(0.0, ["weight", "market_value", "qty", "price"])
    goal = F.lit(deployable) * F.col("weight")
    out = both.withColumn("__d", goal - F.col("market_value")).where(F.abs("__d") >= least)
    buy = F.col("__d") > 0
    in_shares = ~buy & (F.col("price") > 0)
    return out.select(
        *keys, F.when(buy, F.lit("buy")).otherwise(F.lit("sell")).alias("side"), F.round(goal, 2).alias("target_value"),
        F.round("market_value", 2).alias("current_value"), F.round("__d", 2).alias("delta_value"), F.round("price", 6).alias("price"),
        F.when(in_shares, F.lit("qty")).otherwise(F.lit("notional")).alias("submit_mode"),
        F.when(~in_shares, F.round(F.abs("__d"), 2)).alias("notional"),
        F.when(in_shares, F.round(F.least(F.try_divide(F.abs("__d"), F.col("price")), F.abs("qty")), 6)).alias("qty"),
    )


def order_notional(delta_value: Column, notional: Column, qty: Column, price: Column) -> Column:
    """Size of an order in currency: the first of its change, its notional, and quantity times price that it tells."""
    return F.coalesce(F.abs(delta_value), F.abs(notional), F.abs(qty * price), F.lit(0.0))


def walk_forward(
    daily: DataFrame, folds: list[tuple[int, str, str]], k: int = 10, equity: float = 1e6, cash: float = 0.05, participation: float = 0.05,
    least: float = 100.0, fractional: bool = True, date: str = "date",
) -> DataFrame:
    """Simulate each fold on its own: equity and holdings restart at the fold's first date.

    ``daily`` has date, permno, score, entry, exit and mark (the open at which a
    position is taken, the next one and the close before it), adv and vol.  The k
    best names of a date weigh alike; trades follow ``rebalance``: a name without
    a score has left the day's table and is sold whole.  Folds share no state, so
    each is one group and they run in parallel; only names that are ever among a
    fold's best are sent, so a group holds dates x such names.
    """
    spark = daily.sparkSession
    windows = spark.createDataFrame(folds, "fold int, begin string, end string").select("fold", F.to_date("begin").alias("b"), F.to_date("end").alias("e"))
    dated = daily.join(F.broadcast(windows), F.col(date).between(F.col("b"), F.col("e")))  # a row for each fold
    usable = F.col("score").isNotNull() & (F.col("entry") > 0)
    order = Window.partitionBy("fold", date).orderBy(usable.desc(), F.col("score").desc(), "permno")
    ranked = dated.withColumn("__k", F.row_number().over(order)).withColumn("target", F.when(usable & (F.col("__k") <= k), F.lit(1.0 / k)))
    names = ranked.where("target is not null").select("fold", "permno").distinct()
    sent = ranked.join(names, ["fold", "permno"], "left_semi").where("entry > 0").select(
        "fold", date, "permno", "target", F.col("score").isNull().alias("left"), "entry", F.when(F.col("exit") > 0, F.col("exit")).otherwise(F.col("mark")).alias("exit"), "adv", "vol"
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, shares, wealth = [], {}, equity
        for day, part in pdf.sort_values([date, "permno"]).groupby(date):
            held = part["permno"].map(shares).fillna(0.0).to_numpy()
            entry, exit_, adv, vol = (part[c].to_numpy(float) for c in ("entry", "exit", "adv", "vol"))
            wanted = part["target"].to_numpy(float)
            before, wish = held * entry, np.nan_to_num(wanted) * wealth * (1 - cash)
            change = wish - before
            bound = np.where(adv > 0, adv * participation, np.inf) if participation > 0 else np.full(len(part), np.inf)
            bound = np.where(np.isnan(bound), np.inf, bound)
            after = np.where(np.abs(change) > bound, np.maximum(before + np.sign(change) * bound, 0), wish)
            after = np.where(part["left"], 0.0, np.where(np.abs(change) < least, before, after))
            new = after / entry if fractional else np.floor(np.maximum(after, 0) / entry + 1e-12)
            after = new * entry
            traded = np.abs(after - before)
            share = np.sqrt(np.where(adv > 0, traded / np.where(adv > 0, adv, 1), 0))
            cost = float((traded * (0.001 + 0.1 * np.nan_to_num(vol) * share)).sum()) / wealth
            gross = float((after / wealth * np.nan_to_num(exit_ / entry - 1)).sum())
            turn = float(np.abs(after - before).sum()) / wealth / 2
            net = gross - cost
            wealth *= 1 + net
            shares = {n: s for n, s in zip(part["permno"], new, strict=True) if s > 1e-10}
            rows.append((int(pdf["fold"].iloc[0]), day, gross, cost, net, turn, wealth / equity))
        return pd.DataFrame(rows, columns=["fold", date, "gross", "cost", "net", "turnover", "equity"])

    return sent.groupBy("fold").applyInPandas(run, f"fold int, {date} date, gross double, cost double, net double, turnover double, equity double")


def gates(stats: dict[str, float], limits: dict[str, tuple[str, float]]) -> dict[str, bool]:
    """Whether each statistic passes its limit; a missing one fails."""
    passed = {}
    for name, (side, limit) in limits.items():
        v = stats.get(name)
        passed[name] = v is not None and (v >= limit if side == ">=" else v <= limit)
    return passed


def signals_asof(weights: DataFrame, day: str, date: str = "date") -> tuple[DataFrame, DataFrame]:
    """The snapshot of weights that holds on a day (the last one up to it), and the one before that."""
    past = weights.where(F.col(date) <= F.lit(day).cast("date"))
    order = F.dense_rank().over(Window.orderBy(F.desc(date)))
    last = past.select(date).distinct().withColumn("__k", order).where("__k <= 2")  # the calendar of snapshots
    told = past.join(F.broadcast(last), date)
    return told.where("__k = 1").drop("__k"), told.where("__k = 2").drop("__k")
