"""Sums of products of a pool's ranks, date by date in matrix form.

A date's cross-section is a matrix of names x signals.  Its ranks, and what pairs
of signals share, are a few matrix products, so a task adds up its dates in one
signals x signals array and sends that once; no row for a pair, a name and a date
is ever made.  The wide table is dealt out by date once, with the signals' columns
only.  Memory: a few times one date's rows, and a few
arrays of signals x signals numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.groups import map_groups, numbers, whole_groups

ROWS = 1 << 14  # names of a date whose products are made at once
PENALTIES = (0.01, 0.1, 1.0, 10.0, 100.0)


def _by_date(df: DataFrame, columns: list[str], date: str, dealt: bool = False) -> DataFrame:
    """The columns as numbers, all rows of a date next to each other in one task, as ``dealt`` says they are already."""
    out = df.select(F.col(date).alias("__date"), *[F.col(f"`{c}`").cast("double").alias(c) for c in columns])
    return out if dealt else out.repartition("__date").sortWithinPartitions("__date")


def _dates(batches: Iterator[pa.RecordBatch], date: str = "__date") -> Iterator[tuple[object, np.ndarray]]:
    """(date, rows x columns) of each date of a sorted partition, missing values as NaN."""
    for rows, edges in whole_groups(batches, date):
        values = numbers(rows, rows.schema.names[1:])
        days = [rows.column(date)[begin].as_py() for begin in edges[:-1].tolist()]
        del rows  # the numbers are all that is needed of them
        for day, begin, end in zip(days, edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            yield day, values[:, begin:end].T


def _ranks(values: np.ndarray) -> np.ndarray:
    """Percent ranks of each column's present values, ties averaged, around the column's own mean; one column at a time."""
    ranks = np.empty(values.shape, order="F")
    for i in range(values.shape[1]):
        one = pd.Series(values[:, i]).rank(pct=True).to_numpy()
        ranks[:, i] = one - np.nansum(one) / max(1, np.isfinite(one).sum())
    return ranks


def _correlations(ranks: np.ndarray, mine: list[int], other: list[int], minimum: int) -> tuple[np.ndarray, np.ndarray]:
    """Correlation of each of some columns with each of others over the rows where both are present, and where it holds.

    Products are summed over stretches of rows, so that no second table of them is held.
    """
    n, sx, sy, sxx, syy, sxy = (np.zeros((len(mine), len(other))) for _ in range(6))
    for begin in range(0, len(ranks), ROWS):
        part = ranks[begin : begin + ROWS]
        there, part = np.isfinite(part), np.nan_to_num(part)
        x, y, mx, my = part[:, mine], part[:, other], there[:, mine].astype(float), there[:, other].astype(float)
        n += mx.T @ my
        sx += x.T @ my
        sy += mx.T @ y
        sxx += (x * x).T @ my
        syy += mx.T @ (y * y)
        sxy += x.T @ y
    with np.errstate(divide="ignore", invalid="ignore"):
        vx, vy = sxx - sx * sx / n, syy - sy * sy / n
        c = (sxy - sx * sy / n) / np.sqrt(vx * vy)
    holds = (n >= minimum) & (vx > 1e-9) & (vy > 1e-9)
    return np.where(holds, c, 0.0), holds


class _Sorted:
    """Columns (as rows of an array) in order, so that ranks within any subset are sums along that order."""

    def __init__(self, values: np.ndarray) -> None:
        self.there = ~np.isnan(values)
        self.order = np.argsort(values, axis=1, kind="stable")
        ordered = np.take_along_axis(values, self.order, axis=1)
        place = np.arange(values.shape[1])
        new = np.ones(values.shape, bool)
        new[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
        self.first = np.maximum.accumulate(np.where(new, place, 0), axis=1)  # of equal values
        last = np.where(np.roll(new, -1, axis=1), place, len(place))
        last[:, -1] = len(place) - 1
        self.last = np.minimum.accumulate(last[:, ::-1], axis=1)[:, ::-1]

    def ranks(self, some: np.ndarray) -> np.ndarray:
        """Average ranks, from 1, among the entries that ``some`` marks; other entries are meaningless."""
        order = np.broadcast_to(self.order, some.shape)
        upto = np.zeros((some.shape[0], some.shape[1] + 1), np.int32)
        np.cumsum(np.take_along_axis(some, order, axis=1), axis=1, out=upto[:, 1:])
        low = np.take_along_axis(upto, np.broadcast_to(self.first, some.shape), axis=1)
        high = np.take_along_axis(upto, np.broadcast_to(self.last, some.shape) + 1, axis=1)
        out = np.empty(some.shape)
        np.put_along_axis(out, order, (low + high + 1) / 2.0, axis=1)
        return out


def rank_ic(wide: DataFrame, signals: list[str], labels: list[str], minimum: int, date: str = "date", dealt: bool = False) -> DataFrame:
    """(date, signal, label, ic, n): Spearman correlation of every signal with every label on every date.

    Both are ranked over the names where both are there; dates with fewer than
    ``minimum`` of them, or without spread, have none.  A date's signals are sorted
    once for all labels.  ``dealt`` rows (``evaluate`` by date) aren't moved again.
    """

    columns = list(dict.fromkeys([*signals, *labels]))
    at = {c: i for i, c in enumerate(columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for day, values in _dates(batches):
            series = np.ascontiguousarray(values.T)
            rows = []
            targets = {label: _Sorted(series[[at[label]]]) for label in labels}
            for signal in signals:  # one at a time: the arrays of a sorted column are many times its size
                x = _Sorted(series[[at[signal]]])
                for label, y in targets.items():
                    both = x.there & y.there
                    n = int(both.sum())
                    a, b = (np.where(both, s.ranks(both) - (n + 1) / 2.0, 0.0)[0] for s in (x, y))
                    va, vb = (a * a).sum(), (b * b).sum()
                    if n >= minimum and va > 0 and vb > 0:
                        rows.append((signal, label, float(a @ b / np.sqrt(va * vb)), n))
            if rows:
                names, of, ic, n = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([day] * len(rows)), pa.array(names), pa.array(of), pa.array(ic), pa.array(n)], ["date", "signal", "label", "ic", "n"])

    kind = dict(wide.dtypes)[date]
    return _by_date(wide, columns, date, dealt).mapInArrow(run, f"date {kind}, signal string, label string, ic double, n long")


def rank_correlations(wide: DataFrame, left: list[str], right: list[str] | None = None, minimum: int = 30, date: str = "date", dealt: bool = False) -> DataFrame:
    """(a, b, corr, n_days): mean daily rank correlation of pairs of signals.

    Ranks are each signal's own; correlations are over the names that both have,
    on dates with ``minimum`` of them or more.  With ``right`` each of ``left`` is
    held against each of ``right``; else all pairs a < b of ``left``.  ``dealt``
    rows aren't moved again.
    """
    columns = list(dict.fromkeys([*left, *(right or [])]))
    at = {c: i for i, c in enumerate(columns)}
    mine, other = [at[c] for c in left], [at[c] for c in right or left]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((len(mine), len(other))), np.zeros((len(mine), len(other)), np.int64)
        for _, values in _dates(batches):
            ranks = _ranks(values)
            c, holds = _correlations(ranks, mine, other, minimum)
            total += c
            count += holds
        i, j = np.nonzero(count)
        if right is None:
            keep = np.array([left[x] < left[y] for x, y in zip(i, j, strict=True)], bool)
            i, j = i[keep], j[keep]
        names = np.array(columns, object)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names[np.array(mine)[i]], pa.string()), pa.array(names[np.array(other)[j]], pa.string()), pa.array(total[i, j]), pa.array(count[i, j])], ["a", "b", "total", "days"]
        )

    parts = _by_date(wide, columns, date, dealt).mapInArrow(run, "a string, b string, total double, days long")
    return parts.groupBy("a", "b").agg((F.sum("total") / F.sum("days")).alias("corr"), F.sum("days").alias("n_days"))


def turnover(wide: DataFrame, signals: list[str], date: str = "date", key: str = "key", dealt: bool = False) -> DataFrame:
    """(signal, turnover): half the mean daily change of each signal's weights on a dense grid, as ``scoring.turnover`` of long rows.

    Weights stay columns, so a name and date is one row of each of two exchanges,
    by date and by key, however many signals there are; ``dealt`` rows are moved by
    key only.
    """

    def run(rows: pa.RecordBatch, edges: np.ndarray) -> pa.RecordBatch:
        for s in signals:
            made = []
            for part in np.split(numbers(rows, [s])[0], edges[1:-1]):
                centred = _ranks(part[:, None])[:, 0]
                gross = np.nansum(np.abs(centred))
                made.append(np.nan_to_num(centred / gross) if gross > 0 else np.zeros(len(part)))
            rows = rows.set_column(rows.schema.get_field_index(s), s, pa.array(np.concatenate(made), pa.float64()))
        return rows

    rows = wide.select(date, key, *[F.col(f"`{s}`").cast("double").alias(s) for s in signals])
    weights = map_groups(rows if dealt else rows.repartition(date), date, None if dealt else date, run, rows.schema)
    series = Window.partitionBy(key).orderBy(date)
    moved = weights.select(date, *[F.abs(F.col(f"`{s}`") - F.lag(f"`{s}`").over(series)).alias(s) for s in signals])
    daily = moved.groupBy(date).agg(*[F.sum(f"`{s}`").alias(s) for s in signals])
    each = daily.select(F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), F.col(f"`{s}`").alias("d")) for s in signals])).alias("r")).select("r.*")
    return each.where("d is not null").groupBy("signal").agg((F.avg("d") / 2).alias("turnover"))


def autocorrelation(wide: DataFrame, signals: list[str], date: str = "date", key: str = "key") -> DataFrame:
    """(signal, autocorr): lag-1 correlation of each key's values, averaged over keys, as ``scoring.autocorrelation`` of long rows.

    A name and date is one row of one exchange by key; a task sends one row for
    each signal.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count, met = np.zeros(len(signals)), np.zeros(len(signals), np.int64), np.zeros(len(signals), bool)
        for rows, edges in whole_groups(batches, key):
            begin = edges[:-1]
            sizes = np.diff(edges)
            for i, s in enumerate(signals):
                x = numbers(rows, [s])[0]
                past = np.concatenate([[np.nan], x[:-1]])
                past[begin] = np.nan
                both = ~(np.isnan(x) | np.isnan(past))
                met[i] |= both.any()
                c, holds = _each(x, past, both, begin, sizes)
                total[i] += c[holds].sum()
                count[i] += holds.sum()
        at = np.flatnonzero(met)
        yield pa.RecordBatch.from_arrays([pa.array([signals[i] for i in at], pa.string()), pa.array(total[at]), pa.array(count[at])], ["signal", "total", "keys"])

    rows = wide.select(key, date, *[F.col(f"`{s}`").cast("double").alias(s) for s in signals]).repartition(key).sortWithinPartitions(key, date)
    parts = rows.mapInArrow(run, "signal string, total double, keys long")
    return parts.groupBy("signal").agg(F.when(F.sum("keys") > 0, F.sum("total") / F.sum("keys")).alias("autocorr"))


def _each(x: np.ndarray, y: np.ndarray, both: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Correlation of two columns in each stretch of rows, over those that ``both`` marks, and where both vary there."""
    n = np.add.reduceat(both.astype(float), begin)
    varied = np.ones(len(begin), bool)
    centred = []
    with np.errstate(all="ignore"):
        for v in (x, y):
            varied &= np.minimum.reduceat(np.where(both, v, np.inf), begin) < np.maximum.reduceat(np.where(both, v, -np.inf), begin)
            v = np.where(both, v, 0.0)
            centred.append(np.where(both, v - np.repeat(np.add.reduceat(v, begin) / n, sizes), 0.0))
        a, b = centred
        c = np.add.reduceat(a * b, begin) / np.sqrt(np.add.reduceat(a * a, begin) * np.add.reduceat(b * b, begin))
    return c, varied


def correlation_gate(pairs: DataFrame, limit: float = 0.7) -> DataFrame:
    """(a, closest, corr, passed) for each candidate: its strongest |correlation| with a member, and whether it may enter."""
    best = pairs.where("a != b").groupBy("a").agg(F.max(F.struct(F.abs("corr").alias("corr"), F.col("b").alias("b"))).alias("m"))
    return best.select("a", F.col("m.b").alias("closest"), F.col("m.corr").alias("corr"), (F.col("m.corr") < limit).alias("passed"))


def design_sums(
    wide: DataFrame, features: list[str], label: str, window: str, signs: list[int] | None = None, date: str = "date", windows: list[str] | None = None
) -> DataFrame:
    """(window, sums): sums of products of 1, the features' centred ranks and the label less its daily mean.

    One pass for all windows (``window`` is a column that is the same for all
    rows of a date; null dates take no part); rows count where all are present.
    ``windows`` names them; else they are looked up first, which reads the table.
    ``sums`` is the array of a (p + 2) x (p + 2) matrix, row by row.
    """
    p, turned = len(features), np.array(signs or [1] * len(features))
    if windows is None:
        windows = [r[0] for r in wide.select(window).distinct().where(F.col(window).isNotNull()).orderBy(window).collect()]  # those of a study
    names = {w: float(i) for i, w in enumerate(windows)}
    if not names:
        return wide.sparkSession.createDataFrame([], "window string, sums array<double>")
    label_of = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    rows = wide.withColumn("__w", label_of[F.col(window)]).where("__w is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[float, np.ndarray] = {}
        for _, values in _dates(batches):
            y = values[:, p]
            if not np.isfinite(y).any():
                continue
            z = np.column_stack([np.ones(len(y)), _ranks(values[:, :p]) * turned, y - np.nanmean(np.where(np.isfinite(y), y, np.nan))])
            z = z[np.isfinite(z).all(axis=1)]
            w = float(values[0, p + 1])
            sums[w] = sums.get(w, 0) + z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([m.ravel() for m in sums.values()], pa.list_(pa.float64()))], ["w", "sums"])

    parts = _by_date(rows, [*features, label, "__w"], date).mapInArrow(run, "w double, sums array<double>")
    cells = parts.select("w", F.posexplode("sums").alias("i", "v")).groupBy("w", "i").agg(F.sum("v").alias("v"))
    whole = cells.groupBy("w").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda c: c["v"]).alias("sums"))
    back = F.create_map(*[F.lit(x) for k, v in names.items() for x in (v, str(k))])
    return whole.select(back[F.col("w")].alias("window"), "sums")


def _parts(sums: list[float]) -> tuple[float, np.ndarray, np.ndarray]:
    m = np.asarray(sums, float)
    side = round(len(m) ** 0.5)
    m = m.reshape(side, side)
    return m[0, 0], m[0], m


def ridge_path(sums: DataFrame, fit: str, validation: str, penalties: tuple[float, ...] = PENALTIES) -> DataFrame:
    """(penalty, weights, score): ridge weights of every penalty and their correlation with the label in another window.

    A penalty counts in units of the mean diagonal.  Penalties are rows and solved
    side by side; the validation score comes from that window's sums, so the data
    are read once for all of them.
    """
    spark = sums.sparkSession
    both = sums.where(F.col("window").isin(fit, validation)).groupBy().agg(
        F.max(F.when(F.col("window") == fit, F.col("sums"))).alias("fit"), F.max(F.when(F.col("window") == validation, F.col("sums"))).alias("validation")
    )
    grid = spark.createDataFrame([(i, float(v)) for i, v in enumerate(penalties)], "place int, penalty double").repartition(len(penalties))

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                weights, score = None, None
                if row.fit is not None:
                    _, _, m = _parts(row.fit)
                    x = m[1:-1, 1:-1]
                    weights = np.linalg.solve(x + row.penalty * np.trace(x) / len(x) * np.eye(len(x)), m[1:-1, -1])
                    score = _score(row.validation, weights)
                out.append((row.place, row.penalty, weights, score))
            yield pd.DataFrame(out, columns=["place", "penalty", "weights", "score"])

    return grid.join(F.broadcast(both), F.lit(True)).mapInPandas(solve, "place int, penalty double, weights array<double>, score double")  # both is one row


def _score(sums: list[float] | None, weights: np.ndarray) -> float | None:
    """Correlation of the weighted features with the label, from sums."""
    if sums is None:
        return None
    n, first, m = _parts(sums)
    covariance = m / n - np.outer(first, first) / n**2 if n else m * 0
    x, xy, y = covariance[1:-1, 1:-1], covariance[1:-1, -1], covariance[-1, -1]
    spread = float(weights @ x @ weights) * float(y)
    return float(weights @ xy) / spread**0.5 if spread > 0 else None


def best_ridge(path: DataFrame) -> DataFrame:
    """The first penalty of the best score; without any score none."""
    return path.where("score is not null").orderBy(F.desc("score"), "place").limit(1)


def weighted_signal(wide: DataFrame, features: list[str], weights: Callable[[str], float] | dict[str, float], date: str = "date", key: str = "key") -> DataFrame:
    """(date, key, value): weighted sum of centred ranks; a missing signal adds 0, a key without any has none."""
    from tessera.operators import scoring

    of = weights if callable(weights) else weights.__getitem__
    signs = wide.sparkSession.createDataFrame([(f, float(of(f))) for f in features], "signal string, sign double")
    return scoring.combined_signal(scoring.melt(wide, features, (date, key)), signs)
