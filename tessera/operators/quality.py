"""Data-quality checks, coverage reports and summaries of bars and memberships."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.portfolio import order_notional


def invalid_bars(bars: DataFrame) -> DataFrame:
    """Rows whose prices contradict each other, whose close isn't positive or whose volume is negative."""
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    bad = (h < lo) | (h < F.greatest(o, c)) | (lo > F.least(o, c)) | (c <= 0) | (F.col("volume") < 0)
    return bars.where(bad)


def return_outliers(bars: DataFrame, limit: float, key: str = "permno", date: str = "date", explained: DataFrame | None = None) -> DataFrame:
    """Rows whose adjusted one-step return exceeds ``limit``, less those explained by (key, date)."""
    past = F.lag("adj_close").over(Window.partitionBy(key).orderBy(date))
    out = bars.withColumn("ret", F.when(past > 0, F.col("adj_close") / past - 1)).where(F.abs("ret") > limit)
    return out.join(explained, [key, date], "left_anti") if explained is not None else out


def ratio_jumps(bars: DataFrame, limit: float, key: str = "permno", date: str = "date") -> DataFrame:
    """Rows whose adjustment ratio differs from the row before by more than ``limit``."""
    ratio = F.when(F.col("close") != 0, F.col("adj_close") / F.col("close"))
    with_ratio = bars.withColumn("ratio", ratio)
    past = F.lag("ratio").over(Window.partitionBy(key).orderBy(date))
    return with_ratio.withColumn("before", past).where(F.abs(F.col("ratio") / F.col("before") - 1) > limit)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def daily_counts(bars: DataFrame, key: str = "permno", date: str = "date") -> DataFrame:
    return bars.groupBy(date).agg(F.countDistinct(key).alias("n"))


def coverage_report(members: DataFrame, bars: DataFrame, on: list[str], date: str = "date") -> DataFrame:
    """For each date members, members with a bar and their ratio."""
    have = bars.select(*on).distinct().withColumn("has_bar", F.lit(True))
    joined = members.join(have, on, "left")
    out = joined.groupBy(date).agg(F.count("*").alias("members"), F.count_if(F.coalesce("has_bar", F.lit(False))).alias("with_bar"))
    return out.withColumn("ratio", F.col("with_bar") / F.col("members"))


def missing_days(days: DataFrame, begin: str, end: str, date: str = "date") -> DataFrame:
    """Weekdays in [begin, end] without a row (holidays are not known)."""
    spark = days.sparkSession
    span = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(begin)), F.to_date(F.lit(end)))).alias(date))
    return span.where(~F.dayofweek(date).isin(1, 7)).join(days.select(date).distinct(), date, "left_anti")


def summary(bars: DataFrame, key: str = "permno", date: str = "date") -> DataFrame:
    """Rows, keys, dates, bounds and mean keys per date of a panel, as (metric, value) text."""
    per_day = bars.groupBy(date).agg(F.count("*").alias("n"))
    a = bars.agg(F.count("*").alias("rows"), F.countDistinct(key).alias("keys"), F.min(date).alias("first"), F.max(date).alias("last"))
    b = per_day.agg(F.count("*").alias("dates"), F.avg("n").alias("mean_keys"), F.min("n").alias("least_keys"), F.max("n").alias("most_keys"))
    return a.crossJoin(b)


def report(checks: dict[str, DataFrame], lenient: tuple[str, ...] = ()) -> DataFrame:
    """One row for each check (name, violations, ok); lenient checks are ok with violations."""
    out = None
    for name, bad in checks.items():
        row = bad.agg(F.lit(name).alias("check"), F.count("*").alias("violations"))
        out = row if out is None else out.union(row)
    return out.withColumn("ok", (F.col("violations") == 0) | F.col("check").isin(*lenient))


def panel_summary(bars: DataFrame, members: DataFrame, key: str = "permno", symbol: str = "symbol", date: str = "date") -> DataFrame:
    """(metric, value) of a panel and its memberships as text: eleven metrics, the rows of a report.

    Two passes over the bars: one for totals, one for names by date; members are
    those that are ``active``, where that column is there.
    """
    active = (members.where("active") if "active" in members.columns else members).select(date, key).distinct()
    daily = lambda df: df.groupBy(date).agg(F.countDistinct(key).alias("n")).agg(F.round(F.avg("n"), 1).alias("mean"))
    whole = bars.agg(
        F.count("*").alias("panel_rows"), F.countDistinct(key).alias("panel_permnos"), F.countDistinct(symbol).alias("panel_ticker_symbols"), F.countDistinct(date).alias("panel_trading_days"),
        F.min(date).alias("panel_first_date"), F.max(date).alias("panel_last_date"), F.count_if(F.col("adj_close") != F.col("close")).alias("rows_with_split_adjustment"),
    )
    inside = bars.join(active, [date, key], "left_semi").agg(F.count("*").alias("member_filtered_rows"), F.countDistinct(key).alias("member_filtered_permnos"))
    row = whole.join(inside, F.lit(True)).join(daily(bars).withColumnRenamed("mean", "panel_mean_names_per_date"), F.lit(True))
    row = row.join(daily(active).withColumnRenamed("mean", "member_mean_names_per_date"), F.lit(True))  # each is one row
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for c in row.columns])).alias("m")).select("m.*")


def coverage_summary(members: DataFrame, bars: DataFrame, key: str = "permno", date: str = "date", sample: int = 50) -> DataFrame:
    """One row: how many member days have a bar, by day at least, in the middle and at most, and what is known of former members."""
    days = coverage_report(members.select(date, key).distinct(), bars, [date, key], date)
    a = days.agg(
        F.sum("members").alias("member_days_total"), F.sum("with_bar").alias("member_days_covered"), F.try_divide(F.sum("with_bar"), F.sum("members")).alias("coverage_pct"),
        F.min("ratio").alias("daily_min"), F.percentile("ratio", F.lit(0.5)).alias("daily_median"), F.max("ratio").alias("daily_max"), F.min(date).alias("date_min"), F.max(date).alias("date_max"),
    )
    last = members.agg(F.max(date).alias("__last"))
    former = members.join(F.broadcast(last), F.lit(True)).groupBy(key).agg(F.max(F.col(date) == F.col("__last")).alias("now")).where("not now").select(key)  # last is one row
    known = former.join(bars.select(key).distinct().withColumn("__bar", F.lit(True)), key, "left")
    first = known.where("__bar").select(key).orderBy(key).limit(sample).agg(F.array_sort(F.collect_list(key)).alias("former_sample"))  # a sample is part of the report
    told = known.agg(F.count("*").alias("former_members"), F.count("__bar").alias("former_with_bars"))
    return a.join(told, F.lit(True)).join(first, F.lit(True))


def count_violations(members: DataFrame, least: int, most: int, key: str = "permno", date: str = "date") -> DataFrame:
    """(date, n): the dates whose number of distinct members isn't within bounds."""
    return members.groupBy(date).agg(F.countDistinct(key).alias("n")).where((F.col("n") < least) | (F.col("n") > most))


#: Checks whose failure halts a lenient run, whatever their severity.
HALTING = ("freshness", "completeness")


def roll_up(checks: DataFrame, mode: str = "strict", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, passed, halt_reason) from rows (by, check, passed, severity) in the order of ``place``.

    A strict run halts on any failed check; a lenient one on ``HALTING`` ones and on
    a gap too long to fill (``gap_backfill`` with severity critical).
    """
    if mode not in ("strict", "lenient"):
        raise ValueError("a run is strict or lenient")
    failed = ~F.coalesce("passed", F.lit(False))
    halts = failed if mode == "strict" else failed & (F.col("check").isin(*HALTING) | ((F.col("check") == "gap_backfill") & (F.col("severity") == "critical")))
    named = F.array_sort(F.collect_list(F.when(halts, F.struct("place", "check"))))  # as many as there are checks
    out = checks.groupBy(*by).agg(F.transform(named, lambda c: c["check"]).alias("__f"))
    reason = F.when(F.size("__f") > 0, F.concat(F.lit("Failed checks: "), F.array_join("__f", ", ")))
    return out.select(*by, (F.size("__f") == 0).alias("passed"), reason.alias("halt_reason"))


def run_checks(bars: DataFrame, target: str, halt: int, warn: int, limit: float, most_gap: int, key: str = "permno", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, place, check, passed, severity) of the checks that a load runs, for every group ``by`` at once.

    Validity, outliers, duplicates and ratio jumps are counted in one pass over
    windows by key; freshness, completeness and the gap come from group totals.
    """
    day = F.lit(target).cast("date")
    series = Window.partitionBy(key).orderBy("date")
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    invalid = (h < lo) | (h < F.greatest(o, c)) | (lo > F.least(o, c)) | (c <= 0) | (F.col("volume") < 0)
    past, ratio = F.lag("adj_close").over(series), F.when(c != 0, F.col("adj_close") / c)
    seen = bars.withColumns({"__r": F.when(past > 0, F.col("adj_close") / past - 1), "__q": ratio, "__n": F.count("*").over(Window.partitionBy(key, "date"))})
    jump = F.abs(F.col("__q") / F.lag("__q").over(series) - 1) > 0.01
    on_day = F.col("date") == day
    flagged = seen.withColumn("__j", jump)
    a = flagged.groupBy(*by).agg(
        F.max("date").alias("latest"), F.countDistinct(F.when(on_day, F.col(key))).alias("actual"), F.count_if(on_day & F.coalesce(invalid, F.lit(False))).alias("invalid"),
        F.count_if(on_day & (F.abs("__r") > limit)).alias("outliers"), F.count_if(on_day & (F.col("__n") > 1)).alias("duplicates"), F.count_if(on_day & F.coalesce("__j", F.lit(False))).alias("jumps"),
    ).withColumn("gap", business_days(F.col("latest"), day))
    level = lambda ok, bad: F.when(ok, "info").otherwise(bad)
    fresh, full = F.coalesce(F.col("latest") >= day, F.lit(False)), F.col("actual") >= halt
    gap = F.when(F.col("latest").isNull(), "critical").when(F.col("gap") <= 1, "info").when(F.col("gap") <= most_gap, "warning").otherwise("critical")
    told = [
        ("freshness", fresh, level(fresh, "critical")),
        ("completeness", full, F.when(~full, "critical").when(F.col("actual") < warn, "warning").otherwise("info")),
        *[(name, F.col(column) == 0, level(F.col(column) == 0, "warning")) for name, column in (("ohlc_validity", "invalid"), ("return_outliers", "outliers"), ("duplicates", "duplicates"))],
        ("adjusted_consistency", F.col("jumps") == 0, level(F.col("jumps") == 0, "warning")),
        ("gap_backfill", gap == "info", gap),
    ]
    cells = [F.struct(F.lit(i).alias("place"), F.lit(n).alias("check"), ok.alias("passed"), s.alias("severity")) for i, (n, ok, s) in enumerate(told)]
    return a.select(*by, F.explode(F.array(*cells)).alias("r")).select(*by, "r.*")


def backfill_plan(bars: DataFrame, target: str, most: int = 5, by: tuple[str, ...] = (), date: str = "date") -> DataFrame:
    """(by, date, place, status): the business days to load up to a target date, the oldest first.

    Days after the newest bar and before the target are ``backfill``, the target is
    ``load``.  A group that lacks more than ``most`` days, or has no bars at all, gets
    its target date as ``halt`` and nothing to load.
    """
    day = F.lit(target).cast("date")
    last = bars.groupBy(*by).agg(F.max(date).alias("__last")).withColumn("__gap", business_days(F.col("__last"), day))
    span = F.when(F.col("__last") < day, F.sequence(F.date_add("__last", 1), day)).otherwise(F.array().cast("array<date>"))
    weekdays = F.filter(span, lambda d: ~F.dayofweek(d).isin(1, 7) & (d < day))
    halt = F.col("__last").isNull() | (F.col("__gap") > most)
    days = F.when(halt, F.array(day)).when(F.col("__last") >= day, F.array().cast("array<date>")).otherwise(F.concat(weekdays, F.array(day)))
    out = last.select(*by, halt.alias("__h"), F.posexplode(days).alias("place", date))
    return out.select(*by, date, "place", F.when(F.col("__h"), "halt").when(F.col(date) < day, "backfill").otherwise("load").alias("status"))


def freshness(bars: DataFrame, target: str, date: str = "date", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, latest, fresh): whether the newest bar reaches the target date."""
    return bars.groupBy(*by).agg(F.max(date).alias("latest")).withColumn("fresh", F.coalesce(F.col("latest") >= F.lit(target).cast("date"), F.lit(False)))


def completeness(bars: DataFrame, members: DataFrame | None, halt: int, warn: int, date: str = "date", key: str = "permno") -> DataFrame:
    """(date, actual, expected, severity): keys with a bar against the members of each date.

    Below ``halt`` keys a date is critical, below ``warn`` a warning.
    """
    out = bars.groupBy(date).agg(F.countDistinct(key).alias("actual"))
    if members is None:
        out = out.withColumn("expected", F.lit(None).cast("long"))
    else:
        active = members.where("active") if "active" in members.columns else members
        out = out.join(active.groupBy(date).agg(F.countDistinct(key).alias("expected")), date, "full_outer")
        out = out.na.fill(0, ["actual"])
    severity = F.when(F.col("actual") < halt, F.lit("critical")).when(F.col("actual") < warn, F.lit("warning")).otherwise(F.lit("info"))
    return out.withColumns({"severity": severity, "passed": F.col("actual") >= halt})


def business_days(begin: Column, end: Column) -> Column:
    """Weekdays after ``begin`` up to ``end``; 0 if there are none."""
    span = F.when(begin < end, F.sequence(F.date_add(begin, 1), end)).otherwise(F.array().cast("array<date>"))
    return F.size(F.filter(span, lambda d: ~F.dayofweek(d).isin(1, 7))).cast("long")


def gap_backfill(bars: DataFrame, target: Column, most: int = 5, date: str = "date", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, latest, gap, severity, passed): business days missing before the target date.

    One missing day is the day to be loaded; up to ``most`` must be filled first
    (a warning), more are critical, as is a group without dates.
    """
    out = bars.groupBy(*by).agg(F.max(date).alias("latest")).withColumn("gap", business_days(F.col("latest"), target))
    severity = F.when(F.col("latest").isNull(), F.lit("critical")).when(F.col("gap") <= 1, F.lit("info"))
    severity = severity.when(F.col("gap") <= most, F.lit("warning")).otherwise(F.lit("critical"))
    return out.withColumn("severity", severity).withColumn("passed", F.col("severity") == "info")


@dataclass(frozen=True)
class RiskLimits:
    """Bounds of the pre-trade and post-trade checks."""

    gross: float = 0.40
    order_value: float = 12_500.0
    position: float = 0.10
    most_positions: int = 50
    least_positions: int = 1
    cash: float = 0.02
    slippage_bps: float = 100.0
    weight_gap: float = 0.01


def _checks(base: DataFrame, checks: list[tuple[str, Column, Column]], by: tuple[str, ...]) -> DataFrame:
    rows = [F.struct(F.lit(name).alias("check"), value.cast("double").alias("value"), passed.alias("passed")) for name, value, passed in checks]
    return base.select(*by, F.explode(F.array(*rows)).alias("r")).select(*by, "r.*")


def pre_trade(
    signals: DataFrame, orders: DataFrame, equity: float, buying_power: float, limits: RiskLimits = RiskLimits(), universe: DataFrame | None = None,
    latest: str | None = None, as_of: str | None = None, halted: bool = False, session: bool = True, by: tuple[str, ...] = (), key: str = "key",
) -> DataFrame:
    """The eight checks before orders are sent: (by, check, value, passed).

    ``signals`` has key and weight, ``orders`` side and the columns that tell an
    order's size (delta_value, notional, qty, price).  Checks without their input
    (universe, dates) pass.  Aggregates only, for any number of portfolios.
    """
    absent = {c: F.lit(None).cast("double") for c in ("delta_value", "notional", "qty", "price") if c not in orders.columns}
    sized = orders.withColumns(absent) if absent else orders
    sized = sized.withColumn("__n", order_notional(F.col("delta_value"), F.col("notional"), F.col("qty"), F.col("price")))
    buys = F.sum(F.when(F.lower("side") == "buy", F.col("__n")))
    o = sized.groupBy(*by).agg(F.sum("__n").alias("total"), F.max("__n").alias("single"), buys.alias("buys"))
    known = signals
    if universe is None:
        known = signals.withColumn("__in", F.lit(True))
    else:
        known = signals.join(universe.select(key).distinct().withColumn("__in", F.lit(True)), key, "left")
    p = known.groupBy(*by).agg(
        F.count_if(F.col("__in").isNull()).alias("strangers"), F.count("*").alias("n"), F.max(F.coalesce("weight", F.lit(0.0))).alias("most"),
        F.sum(F.coalesce("weight", F.lit(0.0))).alias("sum"),
    )
    base = (p.join(o, list(by), "full_outer") if by else p.join(o)).na.fill(0)
    tiny, e = 1e-9, max(equity, 0.0)
    stale = latest is not None and as_of is not None and latest < as_of
    fits = F.col("n").between(limits.least_positions, limits.most_positions) & (F.col("most") <= limits.position + tiny) & (F.col("sum") <= 1 + tiny)
    return _checks(base, [
        ("PT-01", F.col("total"), F.col("total") <= limits.gross * e + tiny),
        ("PT-02", F.col("single"), F.col("single") <= min(limits.order_value, limits.position * e) + tiny),
        ("PT-03", F.col("strangers"), F.col("strangers") == 0),
        ("PT-04", F.lit(float(stale)), F.lit(not stale)),
        ("PT-05", F.col("n"), fits),
        ("PT-06", F.col("buys"), F.col("buys") <= buying_power + tiny),
        ("PT-07", F.lit(float(halted)), F.lit(not halted)),
        ("PT-08", F.lit(float(session)), F.lit(session)),
    ], by)


#: Statuses after which an order is lost.
FATAL = ("rejected", "canceled", "expired", "suspended")


def post_trade(
    target: DataFrame, positions: DataFrame, fills: DataFrame, equity: float, cash: float | None, limits: RiskLimits = RiskLimits(),
    by: tuple[str, ...] = (), key: str = "key",
) -> DataFrame:
    """The four checks after trading: lost orders, slippage, weights reached, cash: (by, check, value, passed).

    ``target`` has key and weight, ``positions`` key and market_value, ``fills``
    status, fill and expected (prices).
    """
    slip = F.when((F.col("expected") > 0) & F.col("fill").isNotNull(), F.abs(F.try_divide(F.col("fill"), F.col("expected")) - 1) * 10_000)
    f = fills.groupBy(*by).agg(F.count_if(F.lower("status").isin(*FATAL)).alias("lost"), F.max(slip).alias("slip"))
    keys = [*by, key]
    both = target.select(*keys, "weight").join(positions.select(*keys, "market_value"), keys, "full_outer").na.fill(0.0, ["weight", "market_value"])
    actual = F.col("market_value") / equity if equity > 0 else F.lit(0.0)
    w = both.groupBy(*by).agg(F.max(F.abs(actual - F.col("weight"))).alias("gap"))
    base = (f.join(w, list(by), "full_outer") if by else f.join(w)).na.fill(0)
    enough = cash is None or cash + 1e-9 >= limits.cash * max(equity, 0.0)
    return _checks(base, [
        ("PT-09", F.col("lost"), F.col("lost") == 0),
        ("PT-10", F.col("slip"), F.col("slip") <= limits.slippage_bps + 1e-9),
        ("PT-11", F.col("gap"), F.col("gap") <= limits.weight_gap + 1e-9),
        ("PT-12", F.lit(cash or 0.0), F.lit(enough)),
    ], by)
