"""Column functions with the panel's missing-value rules: NULL is the only missing value.

They hold under ANSI mode: nothing divides without a guard, and a window of
constant values has no correlation instead of an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def null_nan(x: Column) -> Column:
    """NaN becomes NULL."""
    return F.when(~F.isnan(x), x)


def finite(x: Column) -> Column:
    """NaN and infinities become NULL, as rolling windows want them."""
    return F.when((F.abs(x) < F.lit(INF)) & ~F.isnan(x), x)


def safe_div(a: Column, b: Column) -> Column:
    """Division with signed infinity over zero, and NULL for 0/0."""
    zero = F.when(a > 0, F.lit(INF)).when(a < 0, F.lit(-INF))
    return null_nan(F.when(b == 0, zero).otherwise(F.try_divide(a, b)))


def guarded(f, *args: Column) -> Column:
    """``f`` of the arguments, NULL as soon as one of them is missing."""
    present = args[0].isNotNull()
    for a in args[1:]:
        present = present & a.isNotNull()
    return F.when(present, f(*args))


def rounded(x: Column | str, digits: int = 6) -> Column:
    """Round by scaling, the same arithmetic in every engine; exact halves go down."""
    x = F.col(x) if isinstance(x, str) else x
    scale = float(10**digits)
    return F.floor(x * F.lit(scale) + F.lit(0.4997)) / F.lit(scale)


def correlation(cov: Column, sx: Column, sy: Column) -> Column:
    """Correlation from its parts; NULL where either side is constant."""
    return F.when((sx > 0) & (sy > 0), F.try_divide(cov, sx * sy))


def percent_rank_average(x: Column, *partition: str | Column):
    """Rank in (0, 1] with ties averaged, over the non-missing values of a partition."""
    from pyspark.sql import Window

    ordered = Window.partitionBy(*partition, x.isNull()).orderBy(x)
    ties = Window.partitionBy(*partition, x)
    whole = Window.partitionBy(*partition)
    place = F.rank().over(ordered) + (F.count(F.lit(1)).over(ties) - 1) / F.lit(2.0)
    return F.when(x.isNotNull(), place / F.count(x).over(whole))
