"""The panel model: long bars, a dense date x key grid, and point-in-time joins."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import null_nan, safe_div

PRICE_FIELDS = ("open", "high", "low", "close", "adj_close", "volume", "dollar_volume")


def key_column(bars: DataFrame) -> str:
    """permno if it is there without a gap, else symbol."""
    if "permno" in bars.columns and bars.where("permno IS NULL").isEmpty():
        return "permno"
    return "symbol"


def normalise(bars: DataFrame) -> DataFrame:
    """Dates without time, upper-case symbols, numeric fields; what can't be cast is missing."""
    made = {"date": F.to_date("date")}
    if "symbol" in bars.columns:
        made["symbol"] = F.nullif(F.upper(F.trim(F.col("symbol").cast("string"))), F.lit(""))
    for f in PRICE_FIELDS:
        if f in bars.columns:
            made[f] = null_nan(F.col(f).try_cast("double"))
    return bars.withColumns(made)


def last_by_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keep the last row of each key in the given order (all columns break ties)."""
    names = [c for c in df.columns if c not in keys]
    rank = F.struct(*order, *[c for c in names if c not in order])
    return df.groupBy(*keys).agg(F.max_by(F.struct(*names), rank).alias("row")).select(*keys, "row.*")


def one_value(bars: DataFrame, keys: Iterable[str], fields: Iterable[str], sequence: Column) -> DataFrame:
    """One row for each key; of each field the last non-missing value by ``sequence``.

    Rows in which all fields are missing vanish.
    """
    fields = list(fields)
    last = [F.max_by(F.col(f), F.when(F.col(f).isNotNull(), sequence)).alias(f) for f in fields]
    return bars.where(F.coalesce(*fields).isNotNull()).groupBy(*keys).agg(*last)


def calendar(bars: DataFrame, date: str = "date", price: str = "close") -> DataFrame:
    """The dates with a price, numbered from 0."""
    days = bars.where(F.col(price).isNotNull()).select(date).distinct()
    # a calendar has some thousand rows at most, whatever the number of securities
    return days.withColumn("pos", F.row_number().over(Window.orderBy(date)) - 1)


def adjust(bars: DataFrame) -> DataFrame:
    """Split-adjusted open, high, low and close; volume stays raw.

    dollar_volume, where absent, comes from the raw close and volume.
    """
    factor = safe_div(F.col("adj_close"), F.col("close"))
    factor = F.when((factor > 0) & (factor < F.lit(float("inf"))), factor)
    money = F.coalesce("dollar_volume", F.col("close") * F.col("volume")) if "dollar_volume" in bars.columns else F.col("close") * F.col("volume")
    return bars.withColumns(
        {"dollar_volume": money, **{f: F.col(f) * factor for f in ("open", "high", "low")}, "close": F.col("adj_close")}
    )


def dense_grid(bars: DataFrame, key: str, date: str = "date", days: DataFrame | None = None, keys: DataFrame | None = None) -> DataFrame:
    """Every calendar date for every key, left-joined to the bars.

    ``days`` and ``keys`` (distinct) save two more passes over bars that are
    costly to make; else they are taken from the bars.

    The calendar (thousands of rows) is crossed with the distinct keys, so each
    date is a constant number of rows; the grid is what rolling windows count.
    """
    days = calendar(bars, date).select(date) if days is None else days.select(date)
    keys = bars.select(key).distinct() if keys is None else keys.select(key)
    return keys.join(F.broadcast(days)).join(bars, [key, date], "left") if _small(days) else keys.crossJoin(days).join(bars, [key, date], "left")


def _small(days: DataFrame, limit: int = 100_000) -> bool:
    """Whether a calendar is short enough to send to every executor."""
    return days.limit(limit + 1).count() <= limit


def returns(grid: DataFrame, key: str = "key", date: str = "date") -> DataFrame:
    """The grid with ``return``: close over the previous date's close, less one; gaps are not filled."""
    past = F.lag("close").over(Window.partitionBy(key).orderBy(date))
    return grid.withColumn("return", safe_div(F.col("close"), past) - 1)


def field_panel(bars: DataFrame, key: str, days: DataFrame | None = None, keys: DataFrame | None = None) -> DataFrame:
    """Adjusted dense grid with columns key, date, all fields and ``return``."""
    keys = None if keys is None else keys.withColumnRenamed(key, "key")
    grid = dense_grid(adjust(bars).withColumnRenamed(key, "key"), "key", days=days, keys=keys)
    return returns(grid)


def forward_returns(grid: DataFrame, horizons: Iterable[int], lagged: bool = False, key: str = "key", date: str = "date") -> DataFrame:
    """Labels of a signal at t, traded at the next open: open[t+h+1] over open[t+1], less one.

    ``lagged`` holds the last step only: open[t+h+1] over open[t+h].
    """
    return grid.withColumns(forward_columns(horizons, lagged, key, date))


def forward_columns(horizons: Iterable[int], lagged: bool = False, key: str = "key", date: str = "date") -> dict[str, Column]:
    """The labels of :func:`forward_returns` as columns over ``open``."""
    series = Window.partitionBy(key).orderBy(date)
    made = {}
    for h in horizons:
        end, begin = F.lead("open", h + 1).over(series), F.lead("open", h if lagged else 1).over(series)
        made[f"fwd_{h}"] = F.when(begin > 0, end / begin - 1)
    return made


def label_ends(days: DataFrame, horizons: Iterable[int], date: str = "date") -> DataFrame:
    """For each calendar date the date on which its label of each horizon ends."""
    order = Window.orderBy(date)
    return days.withColumns({f"end_{h}": F.lead(date, h + 1).over(order) for h in horizons})


def purge(grid: DataFrame, days: DataFrame, cutoff: str, horizons: Iterable[int], date: str = "date") -> DataFrame:
    """Mask labels that end after the cutoff, or never."""
    ends = label_ends(days.select(date), horizons, date)
    limit = F.lit(cutoff).cast("date")
    joined = grid.join(ends, date, "left")
    made = {f"fwd_{h}": F.when(F.col(f"end_{h}") <= limit, F.col(f"fwd_{h}")) for h in horizons}
    return joined.withColumns(made).drop(*[f"end_{h}" for h in horizons])


def members_only(bars: DataFrame, members: DataFrame, on: list[str]) -> DataFrame:
    """Point-in-time filter: rows whose (date, key) is an active membership."""
    active = members.where("active").select(*on).distinct()
    return bars.join(active, on, "left_semi")


def interval_join(left: DataFrame, right: DataFrame, key: str, at: str, begin: str, end: str, how: str = "inner") -> DataFrame:
    """Equi-join on ``key`` where ``at`` lies in [begin, end]; a null end is open."""
    r = right.withColumnRenamed(key, "__key")
    hit = (F.col(key) == F.col("__key")) & (F.col(at) >= F.col(begin)) & (F.col(end).isNull() | (F.col(at) <= F.col(end)))
    return left.join(r, hit, how).drop("__key")


def overlap_join(left: DataFrame, right: DataFrame, key: str, a: tuple[str, str], b: tuple[str, str]) -> DataFrame:
    """Pairs of intervals of one key that meet, with their intersection as (begin, end)."""
    r = right.withColumnRenamed(key, "__key")
    far = F.lit("9999-12-31").cast("date")
    a_end, b_end = F.coalesce(F.col(a[1]), far), F.coalesce(F.col(b[1]), far)
    met = (F.col(key) == F.col("__key")) & (F.col(a[0]) <= b_end) & (F.col(b[0]) <= a_end)
    return left.join(r, met).drop("__key").withColumns({"begin": F.greatest(a[0], b[0]), "end": F.least(a_end, b_end)})


def tolerance_match(left: DataFrame, right: DataFrame, on: list[str], a: str, b: str, absolute: float = 1e-9, relative: float = 1e-6, how: str = "inner") -> DataFrame:
    """Rows of two tables with equal keys and ``same``: whether their values agree within the tolerances.

    Values agree if both are missing, or |a - b| <= absolute + relative * |b|.
    """
    near = F.abs(F.col(a) - F.col(b)) <= F.lit(absolute) + F.lit(relative) * F.abs(b)
    same = (F.col(a).isNull() & F.col(b).isNull()) | F.coalesce(near, F.lit(False))
    return left.join(right, on, how).withColumn("same", same)


def band_pairs(rows: DataFrame, key: str, by: str, value: str, width: float) -> DataFrame:
    """(a, b): keys a < b of one ``by`` whose values differ by ``width`` at most.

    Values are put in bins of that width, so partners lie in one bin or in two
    neighbouring ones; a pair of neighbours is made once, from its lower bin.  What
    a join looks at is then little more than what it returns, and groups are small.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # told, as few rows make many pairs and small shuffles would be merged
    binned = rows.select(F.col(key).alias("__a"), F.col(by).alias("__by"), F.col(value).alias("__v"), F.floor(F.col(value) / F.lit(width)).alias("__bin"))
    low = binned.where("__by is not null and __bin is not null")
    both = low.select(F.col("__a").alias("__b"), "__by", F.col("__v").alias("__w"), F.posexplode(F.array("__bin", F.col("__bin") - 1)).alias("__step", "__bin"))
    near = F.abs(F.col("__v") - F.col("__w")) <= F.lit(width)
    once = F.when(F.col("__step") == 0, F.col("__a") < F.col("__b")).otherwise(F.col("__a") != F.col("__b"))
    met = low.repartition(parts, "__by", "__bin").join(both.repartition(parts, "__by", "__bin").hint("merge"), ["__by", "__bin"])
    return met.where(near & once).select(F.least("__a", "__b").alias("a"), F.greatest("__a", "__b").alias("b"))


def nearest_date(days: DataFrame, asked: DataFrame, at: str, after: bool = False, date: str = "date") -> DataFrame:
    """``asked`` with ``date``: the last calendar date on or before ``at``, or the first on or after it; null if none."""
    ends = days.agg(F.array_sort(F.collect_set(date)).alias("__days"))  # a calendar: some thousand dates
    pick = (lambda d: d >= F.col(at)) if after else (lambda d: d <= F.col(at))
    fitting = F.filter("__days", pick)
    return asked.join(F.broadcast(ends)).withColumn(date, F.get(fitting, F.lit(0) if after else F.size(fitting) - 1)).drop("__days")


def expand_intervals(intervals: DataFrame, days: DataFrame, begin: str, end: str, date: str = "date") -> DataFrame:
    """One row for each calendar date in [begin, end] of each interval."""
    bounds = days.agg(F.min(date).alias("lo"), F.max(date).alias("hi")).first()
    clipped = intervals.withColumns(
        {"__b": F.greatest(F.col(begin), F.lit(bounds.lo)), "__e": F.least(F.coalesce(F.col(end), F.lit(bounds.hi)), F.lit(bounds.hi))}
    )
    months = F.explode(F.sequence(F.trunc("__b", "month"), F.trunc("__e", "month"), F.expr("interval 1 month")))
    by_month = clipped.where("__b <= __e").withColumn("__m", months)
    dated = days.select(F.col(date), F.trunc(date, "month").alias("__m"))
    return by_month.join(dated, "__m").where(F.col(date).between(F.col("__b"), F.col("__e"))).drop("__m", "__b", "__e")


def asof_join(grid: DataFrame, events: DataFrame, key: str, at: str, known: str, values: list[str], order: list[str]) -> DataFrame:
    """The latest event of the key known on or before each grid date (backward as-of).

    Both sides are unioned and the newest values carried forward in one window,
    so there is one exchange on the key and no range join.  Events of one key
    and day are told apart by ``order``; the last one counts.
    """
    packed = last_by_key(
        events.where(F.col(known).isNotNull()).select(F.col(key), F.col(known).alias(at), F.struct(*order).alias("__o"), F.struct(*values).alias("__v")),
        [key, at], ["__o"],
    ).select(key, at, "__v")
    rows = grid.withColumn("__grid", F.lit(1)).unionByName(packed.withColumn("__grid", F.lit(0)), allowMissingColumns=True)
    series = Window.partitionBy(key).orderBy(at, "__grid").rowsBetween(Window.unboundedPreceding, 0)
    carried = rows.withColumn("__v", F.last("__v", ignorenulls=True).over(series)).where("__grid = 1")
    return carried.select(*grid.columns, *[F.col(f"__v.{v}").alias(v) for v in values])


def changes(history: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, old, new, order) wherever a key's value changes."""
    old = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    return history.withColumn("old", old).where(F.col("old") != F.col(value)).select(key, "old", F.col(value).alias("new"), order)


def forward_fill(df: DataFrame, key: str, order: str, columns: Iterable[str]) -> DataFrame:
    """Missing values take the key's last present value."""
    past = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(past) for c in columns})


def stride(days: DataFrame, k: int) -> DataFrame:
    """Every k-th date of a calendar with positions."""
    return days.where(F.col("pos") % k == 0)


def nth_next_date(days: DataFrame, n: int, date: str = "date") -> DataFrame:
    """(date, next): the date n positions later, by an equi-join on positions."""
    later = days.select(F.col(date).alias("next"), (F.col("pos") - n).alias("pos"))
    return days.join(later, "pos").select(date, "next")


def quarter_samples(df: DataFrame, key: str, date: str = "date") -> DataFrame:
    """First, middle (number n // 2) and last row of each key's quarter, marked in ``sample``."""
    part = Window.partitionBy(key, F.trunc(date, "quarter"))
    rows = df.withColumns({"__i": F.row_number().over(part.orderBy(date)) - 1, "__n": F.count(F.lit(1)).over(part)})
    mark = F.array_compact(
        F.array(
            F.when(F.col("__i") == 0, F.lit("first")),
            F.when(F.col("__i") == F.floor(F.col("__n") / 2), F.lit("mid")),
            F.when(F.col("__i") == F.col("__n") - 1, F.lit("last")),
        )
    )
    return rows.withColumn("sample", F.explode(mark)).drop("__i", "__n")


def members_of(members: DataFrame, begin: str, end: str | None = None, remap: DataFrame | None = None, date: str = "date", key: str = "symbol") -> DataFrame:
    """The distinct active members of a date or a range of dates.

    A file of members without dates counts for any date; only there are old names
    turned into new ones, by ``remap`` (old, new).
    """
    active = members.where("active") if "active" in members.columns else members
    if date in members.columns:
        return active.where(F.col(date).between(F.lit(begin).cast("date"), F.lit(end or begin).cast("date"))).select(key).distinct()
    if remap is None:
        return active.select(key).distinct()
    names = remap.select(F.col("old").alias("__old"), F.col("new").alias("__new"))
    return active.join(names, F.col(key) == F.col("__old"), "left").select(F.coalesce("__new", key).alias(key)).distinct()
