"""Queries that score a pool of signals on the monthly bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import rounded
from tessera.operators import arms, candidates, gates, gram, inference, panel, runlog, scoring
from tessera.plans.compile import evaluate, to_sql
from tessera.plans.formula import complexity, data_family, parse
from tessera.queries.base import GRID, grid, query, r

SIGNALS = {
    "momentum": "RANK(TS_DELTA($close, 3) / (TS_STD($close, 6) + 1e-8))",
    "reversal": "-TS_DELTA($close, 1)",
    "volume_surge": "$volume / TS_MEAN($volume, 6)",
    "range": "TS_MEAN(($high - $low) / $close, 4)",
    "drawup": "$close / TS_MIN($low, 6) - 1",
}
MINIMUM = 5
HORIZONS = (1, 2, 3, 6, 12)
LAG = 6
CUTOFF = "1999-12-31"


def panel_values(spark: SparkSession, sf_dir: str, lagged: bool = False) -> DataFrame:
    """Signals and labels of every horizon on the grid."""
    labelled = panel.forward_returns(grid(spark, sf_dir), HORIZONS, lagged)
    return evaluate(labelled, SIGNALS, keep=[f"fwd_{h}" for h in HORIZONS])


def long_values(spark: SparkSession, sf_dir: str, lagged: bool = False) -> DataFrame:
    return scoring.melt(panel_values(spark, sf_dir, lagged), SIGNALS, ("date", "key", *[f"fwd_{h}" for h in HORIZONS]))


def ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gram.rank_ic(panel_values(spark, sf_dir), list(SIGNALS), ["fwd_1"], MINIMUM).select("date", "signal", "ic", "n")


_FWD = ", ".join(f"CASE WHEN lead(open, 1) OVER s > 0 THEN lead(open, {h + 1}) OVER s / lead(open, 1) OVER s - 1 END AS fwd_{h}" for h in HORIZONS)
_LAGGED = ", ".join(f"CASE WHEN lead(open, {h}) OVER s > 0 THEN lead(open, {h + 1}) OVER s / lead(open, {h}) OVER s - 1 END AS fwd_{h}" for h in HORIZONS)
_KEEP = [f"fwd_{h}" for h in HORIZONS]


def _long(forward: str = _FWD) -> str:
    values = to_sql("labelled", SIGNALS, keep=_KEEP)
    parts = " UNION ALL ".join(f"SELECT date, key, {', '.join(_KEEP)}, '{s}' AS signal, {s} AS value FROM wide" for s in SIGNALS)
    return f"{GRID}, labelled AS (SELECT *, {forward} FROM grid WINDOW s AS (PARTITION BY key ORDER BY date)), wide AS ({values}), long AS ({parts})"


def _rank(x: str, by: str, where: str = "") -> str:
    return f"(rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0) / count(*) OVER (PARTITION BY {by})"


def _corr(x: str, y: str) -> str:
    return f"CASE WHEN min({x}) < max({x}) AND min({y}) < max({y}) THEN covar_samp({x}, {y}) / (stddev_samp({x}) * stddev_samp({y})) END"


def _ic(label: str = "fwd_1", name: str = "ic") -> str:
    return f"""{name}_r AS (SELECT date, signal, {_rank('value', 'date, signal')} AS x, {_rank(label, 'date, signal')} AS y
      FROM long WHERE value IS NOT NULL AND {label} IS NOT NULL),
    {name} AS (SELECT date, signal, {_corr('x', 'y')} AS ic, count(*) AS n FROM {name}_r GROUP BY date, signal
      HAVING count(*) >= {MINIMUM} AND {_corr('x', 'y')} IS NOT NULL)"""


_IC = f"{_long()}, {_ic()}"


@query(f"WITH {_IC} SELECT date, signal, {r('ic')} AS ic, n FROM ic")
def score_daily_ic(spark, sf_dir):
    return ic(spark, sf_dir).select("date", "signal", rounded("ic").alias("ic"), "n")


@query(f"""WITH {_IC} SELECT signal, {r('avg(ic)')} AS mean_ic, {r('stddev_samp(ic)')} AS std_ic,
       {r('avg(ic) / stddev_samp(ic) * sqrt(count(*))')} AS t_ic, count(*) AS n_days FROM ic GROUP BY signal""")
def score_ic_summary(spark, sf_dir):
    out = scoring.ic_summary(ic(spark, sf_dir))
    return out.select("signal", *[rounded(c).alias(c) for c in ("mean_ic", "std_ic", "t_ic")], "n_days")


@query(f"WITH {_IC} SELECT signal, year(date) AS year, {r('avg(ic)')} AS mean_ic, count(*) AS n_days FROM ic GROUP BY signal, year(date)")
def score_ic_by_year(spark, sf_dir):
    out = scoring.yearly_ic(ic(spark, sf_dir))
    return out.select("signal", F.col("year").cast("long").alias("year"), rounded("mean_ic").alias("mean_ic"), "n_days")


@query(f"""WITH {_IC}, y AS (SELECT signal, year(date) AS year, avg(ic) AS m FROM ic GROUP BY signal, year(date)),
     o AS (SELECT signal, sign(avg(ic)) AS s FROM ic GROUP BY signal), k AS (SELECT count(DISTINCT year(date)) AS years FROM ic)
     SELECT y.signal, {r('count(*) FILTER (WHERE m * s > 0) / CAST(max(years) AS DOUBLE)')} AS share,
            count(*) FILTER (WHERE m * s > 0) / CAST(max(years) AS DOUBLE) >= 0.5 AS stable
     FROM y JOIN o ON o.signal = y.signal CROSS JOIN k GROUP BY y.signal""")
def score_year_stability(spark, sf_dir):
    return scoring.year_stability(ic(spark, sf_dir)).select("signal", rounded("share").alias("share"), "stable")


@query(f"WITH {_long()} SELECT signal, {r('avg(CASE WHEN value IS NOT NULL THEN 1.0 ELSE 0.0 END)')} AS coverage FROM long GROUP BY signal")
def score_coverage(spark, sf_dir):
    return scoring.coverage(long_values(spark, sf_dir)).select("signal", rounded("coverage").alias("coverage"))


@query(f"""WITH {_long()}, d AS (SELECT date, signal, count(*) FILTER (WHERE fwd_1 IS NOT NULL AND value IS NOT NULL) AS hit,
     count(*) FILTER (WHERE fwd_1 IS NOT NULL) AS every FROM long GROUP BY date, signal)
     SELECT signal, {r('avg(CAST(hit AS DOUBLE) / every)')} AS universe_coverage FROM d WHERE every > 0 GROUP BY signal""")
def score_universe_coverage(spark, sf_dir):
    long = long_values(spark, sf_dir).withColumn("available", F.col("fwd_1").isNotNull())
    out = scoring.universe_coverage(long, "available")
    return out.select("signal", rounded("universe_coverage").alias("universe_coverage"))


_WEIGHTS = f"""{_long()}, wr AS (SELECT date, key, signal, CASE WHEN value IS NOT NULL THEN
       (rank() OVER (PARTITION BY date, signal, value IS NULL ORDER BY value) + (count(*) OVER (PARTITION BY date, signal, value) - 1) / 2.0)
       / count(value) OVER (PARTITION BY date, signal) END AS rk FROM long),
     wc AS (SELECT *, rk - avg(rk) OVER (PARTITION BY date, signal) AS c FROM wr),
     ww AS (SELECT *, coalesce(CASE WHEN sum(abs(c)) OVER (PARTITION BY date, signal) > 0 THEN c / sum(abs(c)) OVER (PARTITION BY date, signal) END, 0.0) AS w FROM wc)"""


@query(f"""WITH {_WEIGHTS}, m AS (SELECT date, signal, abs(w - lag(w) OVER (PARTITION BY signal, key ORDER BY date)) AS d FROM ww),
     t AS (SELECT date, signal, sum(d) AS d FROM m GROUP BY date, signal)
     SELECT signal, {r('avg(d) / 2')} AS turnover FROM t WHERE d IS NOT NULL GROUP BY signal""")
def score_turnover(spark, sf_dir):
    return scoring.turnover(long_values(spark, sf_dir)).select("signal", rounded("turnover").alias("turnover"))


@query(f"""WITH {_long()}, p AS (SELECT signal, key, value, lag(value) OVER (PARTITION BY signal, key ORDER BY date) AS past FROM long),
     c AS (SELECT signal, key, {_corr('value', 'past')} AS c FROM p WHERE value IS NOT NULL AND past IS NOT NULL GROUP BY signal, key)
     SELECT signal, {r('avg(c)')} AS autocorr FROM c GROUP BY signal""")
def score_autocorrelation(spark, sf_dir):
    return scoring.autocorrelation(long_values(spark, sf_dir)).select("signal", rounded("autocorr").alias("autocorr"))


def _curve(spark: SparkSession, sf_dir: str, lagged: bool = False) -> DataFrame:
    """Mean correlation for each horizon; a date's signals are ranked once for all of them."""
    horizons = {f"fwd_{h}": h for h in HORIZONS}
    per_day = gram.rank_ic(panel_values(spark, sf_dir, lagged), list(SIGNALS), list(horizons), MINIMUM)
    horizon = F.regexp_extract("label", r"(\d+)$", 1).cast("int")
    return per_day.groupBy("signal", horizon.alias("horizon")).agg(F.avg("ic").alias("mean_ic"), F.count("*").alias("n_days"))


def _curve_sql(forward: str = _FWD) -> str:
    each = ", ".join(_ic(f"fwd_{h}", f"ic{h}") for h in HORIZONS)
    union = " UNION ALL ".join(f"SELECT signal, {h} AS horizon, avg(ic) AS mean_ic, count(*) AS n_days FROM ic{h} GROUP BY signal" for h in HORIZONS)
    return f"{_long(forward)}, {each}, curve AS ({union})"


@query(f"WITH {_curve_sql()} SELECT signal, horizon, {r('mean_ic')} AS mean_ic, n_days FROM curve")
def score_horizon_curve(spark, sf_dir):
    return _curve(spark, sf_dir).select("signal", "horizon", rounded("mean_ic").alias("mean_ic"), "n_days")


@query(f"WITH {_curve_sql(_LAGGED)} SELECT signal, horizon, {r('mean_ic')} AS mean_ic, n_days FROM curve")
def score_horizon_curve_lagged(spark, sf_dir):
    return _curve(spark, sf_dir, True).select("signal", "horizon", rounded("mean_ic").alias("mean_ic"), "n_days")


@query(f"""WITH {_curve_sql()}, s AS (SELECT signal, horizon, mean_ic / first_value(mean_ic) OVER (PARTITION BY signal ORDER BY horizon) AS s FROM curve),
     n AS (SELECT *, lead(horizon) OVER (PARTITION BY signal ORDER BY horizon) AS nh, lead(s) OVER (PARTITION BY signal ORDER BY horizon) AS ns FROM s),
     x AS (SELECT signal, s, CASE WHEN s > 0.5 AND ns <= 0.5 THEN horizon + (s - 0.5) / (s - ns) * (nh - horizon) END AS x FROM n)
     SELECT signal, {r('min(x)', 4)} AS half_life, count(x) = 0 AND count(s) > 0 AS never FROM x GROUP BY signal""")
def score_half_life(spark, sf_dir):
    return scoring.half_life(_curve(spark, sf_dir)).select("signal", rounded("half_life", 4).alias("half_life"), "never")


_PAIRS = f"""{_long()}, pr AS (SELECT date, key, signal, {_rank('value', 'date, signal')} AS x FROM long WHERE value IS NOT NULL),
     pd AS (SELECT a.signal AS a, b.signal AS b, a.date, {_corr('a.x', 'b.x')} AS c, count(*) AS n
            FROM pr a JOIN pr b ON a.date = b.date AND a.key = b.key AND a.signal < b.signal GROUP BY a.signal, b.signal, a.date)"""


@query(f"WITH {_PAIRS} SELECT a, b, {r('avg(c)')} AS corr, count(*) AS n_days FROM pd WHERE n >= {MINIMUM} AND c IS NOT NULL GROUP BY a, b")
def select_signal_correlation(spark, sf_dir):
    out = gram.rank_correlations(panel_values(spark, sf_dir), list(SIGNALS), minimum=MINIMUM)
    return out.select("a", "b", rounded("corr").alias("corr"), "n_days")


_MEMBERS = list(SIGNALS)[: len(SIGNALS) // 2]
_ASKING = [s for s in SIGNALS if s not in _MEMBERS]


@query(f"""WITH {_PAIRS}, pm AS (SELECT a, b, avg(c) AS c FROM pd WHERE n >= {MINIMUM} AND c IS NOT NULL GROUP BY a, b), two AS (SELECT a, b, abs(c) AS c FROM pm UNION ALL SELECT b, a, abs(c) FROM pm),
     rk AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY c DESC, b DESC) AS k FROM two WHERE a IN ({', '.join(f"'{s}'" for s in _ASKING)}) AND b IN ({', '.join(f"'{s}'" for s in _MEMBERS)}))
     SELECT a, b AS closest, {r('c')} AS corr, c < 0.3 AS passed FROM rk WHERE k = 1""")
def select_correlation_gate(spark, sf_dir):
    """Whether each new signal is little enough correlated with those already taken."""
    pairs = gram.rank_correlations(panel_values(spark, sf_dir), _ASKING, _MEMBERS, MINIMUM)
    return gram.correlation_gate(pairs, 0.3).withColumn("corr", rounded("corr"))


_RIDGE = ["momentum", "range", "drawup"]


def _ridge_sql() -> str:
    """Centred ranks and labels of complete rows, their sums in both windows, and each penalty's weights by Cramer's rule."""
    x = lambda t, i, j: f"sum({t}.x{i} * {t}.x{j})"
    products = ", ".join([f"{x('z', i, j)} AS s{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3) if i <= j] + [f"sum(x{i} * y) AS s{i}y" for i in (1, 2, 3)])
    det = lambda a, b, c: f"({a[0]} * ({b[1]} * {c[2]} - {b[2]} * {c[1]}) - {a[1]} * ({b[0]} * {c[2]} - {b[2]} * {c[0]}) + {a[2]} * ({b[0]} * {c[1]} - {b[1]} * {c[0]}))"
    a = [["(s11 + t)", "s12", "s13"], ["s12", "(s22 + t)", "s23"], ["s13", "s23", "(s33 + t)"]]
    y = ["s1y", "s2y", "s3y"]
    swapped = [[[y[i] if j == k else a[i][j] for j in range(3)] for i in range(3)] for k in range(3)]
    weights = ", ".join(f"{det(*swapped[k])} / {det(*a)} AS w{k + 1}" for k in range(3))
    ranks = " JOIN ".join(f"(SELECT date, key, x - avg(x) OVER (PARTITION BY date) AS x{i + 1} FROM pr WHERE signal = '{s}') q{i + 1}" + (" USING (date, key)" if i else "") for i, s in enumerate(_RIDGE))
    return f"""{_PAIRS}, lb AS (SELECT date, key, fwd_1 - avg(fwd_1) OVER (PARTITION BY date) AS y FROM wide WHERE fwd_1 IS NOT NULL),
        z AS (SELECT date, x1, x2, x3, y FROM {ranks} JOIN lb USING (date, key)), ft AS (SELECT {products} FROM z WHERE date <= DATE '1996-06-30'),
        pen AS (SELECT unnest(CAST([0.01, 0.1, 1.0, 10.0, 100.0] AS DOUBLE[])) AS penalty), tt AS (SELECT *, penalty * (s11 + s22 + s33) / 3 AS t FROM ft, pen), ws AS (SELECT penalty, {weights} FROM tt),
        sc AS (SELECT penalty, any_value(w1) AS w1, any_value(w2) AS w2, any_value(w3) AS w3, corr(w1 * x1 + w2 * x2 + w3 * x3, y) AS score FROM ws, z WHERE date > DATE '1996-06-30' GROUP BY penalty)"""


@query(f"WITH {_ridge_sql()} SELECT penalty, {r('w1', 7)} AS w1, {r('w2', 7)} AS w2, {r('w3', 7)} AS w3, {r('score')} AS score, score = (SELECT max(score) FROM sc) AS chosen FROM sc")
def select_ridge(spark, sf_dir):
    """Ridge weights of three signals for every penalty, chosen by correlation in later dates."""
    wide = panel_values(spark, sf_dir).withColumn("window", F.when(F.col("date") <= F.lit("1996-06-30").cast("date"), "fit").otherwise("validation"))
    path = gram.ridge_path(gram.design_sums(wide, _RIDGE, "fwd_1", "window", windows=["fit", "validation"]), "fit", "validation")
    best = F.max("score").over(Window.partitionBy())  # five rows
    out = path.withColumn("chosen", F.col("score") == best)
    return out.select("penalty", *[rounded(F.col("weights")[i], 7).alias(f"w{i + 1}") for i in range(3)], rounded("score").alias("score"), "chosen")


@query(f"""WITH {_long()}, pr AS (SELECT date, key, signal, {_rank('value', 'date, signal')} AS x FROM long WHERE value IS NOT NULL)
     SELECT a.signal AS a, b.signal AS b, {r(_corr('a.x', 'b.x'))} AS corr, count(*) AS n
     FROM pr a JOIN pr b ON a.date = b.date AND a.key = b.key AND a.signal < b.signal GROUP BY a.signal, b.signal HAVING count(*) >= 100""")
def select_pooled_correlation(spark, sf_dir):
    return scoring.pooled_correlation(long_values(spark, sf_dir)).select("a", "b", rounded("corr").alias("corr"), "n")


@query(f"""WITH {_WEIGHTS}, {_ic()}, g AS (SELECT signal, CASE WHEN avg(ic) < 0 THEN -1.0 ELSE 1.0 END AS sg FROM ic GROUP BY signal)
     SELECT date, key, {r('CASE WHEN count(c) > 0 THEN sum(coalesce(c * sg, 0.0)) END', 5)} AS value FROM wc JOIN g ON g.signal = wc.signal GROUP BY date, key""")
def select_combined_signal(spark, sf_dir):
    signs = ic(spark, sf_dir).groupBy("signal").agg(F.when(F.avg("ic") < 0, -1.0).otherwise(1.0).alias("sign"))
    out = scoring.combined_signal(long_values(spark, sf_dir).select("date", "key", "signal", "value"), signs)
    return out.select("date", "key", rounded("value", 5).alias("value"))


_PURGED = f"""{_IC}, ends AS (SELECT date, lead(date, 2) OVER (ORDER BY date) AS e FROM (SELECT DISTINCT date FROM grid)),
     fit AS (SELECT ic.* FROM ic JOIN ends ON ends.date = ic.date WHERE e <= DATE '{CUTOFF}'),
     hold AS (SELECT ic.* FROM ic WHERE date > DATE '{CUTOFF}')"""


@query(f"""WITH {_PURGED}, f AS (SELECT signal, avg(ic) AS m, count(*) AS n FROM fit GROUP BY signal), h AS (SELECT signal, avg(ic) AS m, count(*) AS n FROM hold GROUP BY signal)
     SELECT f.signal, {r('f.m * CASE WHEN f.m < 0 THEN -1 ELSE 1 END')} AS fit_ic, f.n AS fit_days, {r('h.m * CASE WHEN f.m < 0 THEN -1 ELSE 1 END')} AS hold_ic,
            h.n AS hold_days, {r('h.m / f.m', 4)} AS retention FROM f JOIN h ON h.signal = f.signal""")
def score_holdout(spark, sf_dir):
    """Fit-window mean with purged labels, and the later mean in the frozen direction."""
    values = ic(spark, sf_dir)
    ends = panel.label_ends(grid(spark, sf_dir).select("date").distinct(), [1])
    fit = values.join(ends, "date").where(F.col("end_1") <= F.lit(CUTOFF).cast("date"))
    later = values.where(F.col("date") > F.lit(CUTOFF).cast("date"))
    f = fit.groupBy("signal").agg(F.avg("ic").alias("f"), F.count("*").alias("fit_days"))
    h = later.groupBy("signal").agg(F.avg("ic").alias("h"), F.count("*").alias("hold_days"))
    sign = F.when(F.col("f") < 0, -1.0).otherwise(1.0)
    return f.join(h, "signal").select(
        "signal", rounded(F.col("f") * sign).alias("fit_ic"), "fit_days", rounded(F.col("h") * sign).alias("hold_ic"), "hold_days",
        rounded(F.try_divide("h", "f"), 4).alias("retention"),
    )


_NW = f"""nwc AS (SELECT signal, date, ic, ic - avg(ic) OVER (PARTITION BY signal) AS c FROM ic),
     nwp AS (SELECT signal, ic, c, {', '.join(f'c * lag(c, {k}) OVER (PARTITION BY signal ORDER BY date) AS p{k}' for k in range(1, LAG + 1))} FROM nwc),
     nwv AS (SELECT signal, avg(ic) AS mean, count(*) AS n, sum(c * c) / count(*) {' '.join(f'+ {2 * (1 - k / (LAG + 1))!r} * coalesce(sum(p{k}), 0) / count(*)' for k in range(1, LAG + 1))} AS v FROM nwp GROUP BY signal),
     nw AS (SELECT signal, mean, n, CASE WHEN n > {LAG + 1} AND v > 0 THEN mean / sqrt(v / n) END AS t FROM nwv)"""


@query(f"WITH {_IC}, {_NW} SELECT signal, {r('mean')} AS mean, n, {r('t')} AS t_nw FROM nw")
def test_newey_west(spark, sf_dir):
    out = inference.newey_west(ic(spark, sf_dir), "ic", LAG)
    return out.select("signal", rounded("mean").alias("mean"), "n", rounded("t_nw").alias("t_nw"))


#: A p-value that SQL can express: the logistic approximation 1.702 t of the normal tail.


_TAIL = "-1.26551223 + x * (1.00002368 + x * (0.37409196 + x * (0.09678418 + x * (-0.18628806 + x * (0.27886807 + x * (-1.13520398 + x * (1.48851587 + x * (-0.82215223 + x * 0.17087277))))))))"
_PV = f"pv AS (SELECT signal, t, x * exp(-z * z + {_TAIL}) AS p FROM (SELECT signal, t, z, 1 / (1 + z / 2) AS x FROM (SELECT signal, t, abs(t) / sqrt(2.0) AS z FROM nw)))"


def _tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = inference.newey_west(ic(spark, sf_dir), "ic", LAG)
    return out.select("signal", inference.normal_tail(F.abs("t_nw")).alias("p"))


@query(f"""WITH {_IC}, {_NW}, {_PV}, k AS (SELECT *, row_number() OVER (ORDER BY p, signal) AS i, count(*) OVER () AS m FROM pv)
     SELECT signal, {r('p')} AS p, i AS rank, i <= coalesce(max(CASE WHEN p <= 0.6 * i / m THEN i END) OVER (), 0) AS discovery FROM k""")
def test_benjamini_hochberg(spark, sf_dir):
    out = inference.benjamini_hochberg(_tests(spark, sf_dir), "p", 0.6)
    return out.select("signal", rounded("p").alias("p"), F.col("rank").cast("long").alias("rank"), "discovery")


@query(f"""WITH {_IC}, {_NW}, {_PV}, k AS (SELECT *, row_number() OVER (ORDER BY p, signal) - 1 AS i, count(*) OVER () AS m FROM pv)
     SELECT signal, {r('least(1.0, max(p * (m - i)) OVER (ORDER BY p, signal ROWS UNBOUNDED PRECEDING))')} AS p_holm FROM k""")
def test_holm(spark, sf_dir):
    return inference.holm(_tests(spark, sf_dir), "p").select("signal", rounded("p_holm").alias("p_holm"))


@query(f"""WITH {_IC}, d AS (SELECT d FROM (SELECT {r('a.ic - b.ic', 9)} AS d FROM ic a JOIN ic b ON a.date = b.date AND a.signal = 'momentum' AND b.signal = 'reversal') WHERE d <> 0),
     k AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY abs(d)) AS c FROM d)
     SELECT count(*) AS n, {r('sum(CASE WHEN d > 0 THEN rk ELSE 0 END)', 3)} AS w_plus,
            {r('(sum(CASE WHEN d > 0 THEN rk ELSE 0 END) - count(*) * (count(*) + 1) / 4.0) / sqrt(count(*) * (count(*) + 1) * (2 * count(*) + 1) / 24.0 - sum(c * c - 1) / 48.0)')} AS z FROM k""")
def test_wilcoxon(spark, sf_dir):
    values = ic(spark, sf_dir)
    a = values.where("signal = 'momentum'").select("date", F.col("ic").alias("x"))
    b = values.where("signal = 'reversal'").select("date", F.col("ic").alias("y"))
    return inference.wilcoxon(a.join(b, "date"), "x", "y").select("n", rounded("w_plus", 3).alias("w_plus"), rounded("z").alias("z"))


@query(f"""WITH {_IC} SELECT count(*) AS n, {r('avg(a.ic - b.ic)')} AS mean, {r('avg(a.ic - b.ic) / stddev_samp(a.ic - b.ic) * sqrt(count(*))')} AS t
     FROM ic a JOIN ic b ON a.date = b.date AND a.signal = 'momentum' AND b.signal = 'range'""")
def test_paired_t(spark, sf_dir):
    values = ic(spark, sf_dir)
    a = values.where("signal = 'momentum'").select("date", F.col("ic").alias("x"))
    b = values.where("signal = 'range'").select("date", F.col("ic").alias("y"))
    return inference.paired_t(a.join(b, "date"), "x", "y").select("n", rounded("mean").alias("mean"), rounded("t").alias("t"))


DRAWS, BLOCK, ALPHA = 2000, 6, 0.1
#: The signals that stand for random controls.
CONTROLS = ("range", "drawup")


def _starts(days: DataFrame, salt: int = 0) -> tuple[DataFrame, int]:
    """Block starts for each of the days' number, by a rule that SQL can repeat, and that number."""
    n = days.count()  # one number
    blocks = max(1, -(-n // BLOCK))
    rows = days.sparkSession.range(DRAWS * blocks)
    return rows.select((F.col("id") / blocks).cast("int").alias("draw"), (F.col("id") % blocks).cast("int").alias("block_no"),
                       ((F.col("id") * 7919 + (F.col("id") * F.col("id")) % 997 + salt) % max(n, 1)).cast("int").alias("start")), n


def _positions(values: DataFrame, where: str = "true") -> tuple[DataFrame, DataFrame]:
    """All values on the dates on which every signal has one, by position, and those dates."""
    values = values.persist()  # a row for each date and signal, read by several steps
    days = inference.complete_dates(values.where(where), len(SIGNALS))
    return values.join(days, "date").select("signal", "date", "pos", F.col("ic").alias("value")), days


def _boot(tag: str = "", where: str = "TRUE", salt: int = 0) -> str:
    """SQL of the complete dates, their values, and every draw's positions."""
    return f"""full_days{tag} AS (SELECT date FROM ic WHERE {where} GROUP BY date HAVING count(*) = {len(SIGNALS)}),
     pos{tag} AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM full_days{tag}),
     size{tag} AS (SELECT count(*) AS n, CAST(ceil(count(*) / {float(BLOCK)}) AS BIGINT) AS blocks FROM full_days{tag}),
     vals{tag} AS (SELECT signal, ic.date, pos, ic AS value FROM ic JOIN pos{tag} p ON p.date = ic.date),
     ids{tag} AS (SELECT unnest(range({DRAWS} * blocks)) AS id, n, blocks FROM size{tag}),
     starts{tag} AS (SELECT id // blocks AS draw, id % blocks AS block_no, (id * 7919 + (id * id) % 997 + {salt}) % n AS start, n FROM ids{tag}),
     slots{tag} AS (SELECT draw, block_no * {BLOCK} + k AS i, (start + k) % n AS pos FROM starts{tag} CROSS JOIN range({BLOCK}) b(k) WHERE block_no * {BLOCK} + k < n)"""


_MEANS = f"""{_IC}, {_boot()}, means AS (SELECT signal, draw, avg(value) AS mean FROM vals JOIN slots ON slots.pos = vals.pos GROUP BY signal, draw)"""
_TBOOT = f"""{_IC}, {_NW}, {_boot()}, cen AS (SELECT signal, pos, value - avg(value) OVER (PARTITION BY signal) AS v FROM vals),
     drawn AS (SELECT signal, draw, i, v FROM cen JOIN slots ON slots.pos = cen.pos),
     dc AS (SELECT signal, draw, i, v, v - avg(v) OVER (PARTITION BY signal, draw) AS c FROM drawn),
     dp AS (SELECT signal, draw, v, c, {', '.join(f'c * lag(c, {k}) OVER (PARTITION BY signal, draw ORDER BY i) AS p{k}' for k in range(1, LAG + 1))} FROM dc),
     dv AS (SELECT signal, draw, avg(v) AS mean, count(*) AS n, sum(c * c) / count(*) {' '.join(f'+ {2 * (1 - k / (LAG + 1))!r} * coalesce(sum(p{k}), 0) / count(*)' for k in range(1, LAG + 1))} AS v FROM dp GROUP BY signal, draw),
     bt AS (SELECT signal, draw, CASE WHEN n > {LAG + 1} AND v > 0 THEN mean / sqrt(v / n) END AS t FROM dv)"""


def _crit(of: str) -> str:
    return f"(SELECT quantile_cont(m, {1 - ALPHA}) FROM (SELECT draw, max(abs(t)) AS m FROM bt WHERE signal IN (SELECT signal FROM {of}) GROUP BY draw))"


_STEPS = ", ".join(f"rw{k} AS (SELECT signal, t, c FROM (SELECT signal, t, {_crit(f'rw{k - 1}')} AS c FROM rw{k - 1}) WHERE t <= c)" for k in range(1, len(SIGNALS) + 1))
_RW = f"{_TBOOT}, rw0 AS (SELECT signal, abs(t) AS t FROM nw), {_STEPS}, rw AS (SELECT signal, signal NOT IN (SELECT signal FROM rw{len(SIGNALS)}) AS rejected FROM nw)"


def _null(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The signals' HAC t, and that of every draw under the null."""
    values = ic(spark, sf_dir).persist()
    series, days = _positions(values)
    starts, n = _starts(days)
    return inference.newey_west(values, "ic", LAG), inference.bootstrap_t(series, starts, BLOCK, n, LAG)


@query(f"WITH {_MEANS} SELECT signal, {r('stddev_samp(mean)')} AS se, count(*) AS draws FROM means GROUP BY signal")
def test_block_bootstrap(spark, sf_dir):
    series, days = _positions(ic(spark, sf_dir))
    starts, n = _starts(days)
    means = inference.bootstrap_means(series, starts, BLOCK, n)
    return inference.bootstrap_errors(means).select("signal", rounded("se").alias("se"), "draws")


@query(f"WITH {_TBOOT} SELECT {r('quantile_cont(t, 0.95)')} AS critical, count(*) AS draws FROM (SELECT draw, max(abs(t)) AS t FROM bt GROUP BY draw)")
def test_max_t(spark, sf_dir):
    out = inference.max_t_quantile(_null(spark, sf_dir)[1], 0.05)
    return out.select(rounded("critical").alias("critical"), "draws")


@query(f"WITH {_IC}, {_NW}, {_PV} SELECT signal, {r('p', 5)} AS p FROM pv")
def test_normal_p(spark, sf_dir):
    out = inference.newey_west(ic(spark, sf_dir), "ic", LAG)
    return out.select("signal", rounded(inference.two_sided_p("t_nw"), 5).alias("p"))


@query(f"WITH {_RW} SELECT signal, rejected FROM rw")
def test_romano_wolf(spark, sf_dir):
    """Step-down rejections over all complete dates."""
    return inference.romano_wolf(*_null(spark, sf_dir), ALPHA).select("signal", "rejected")


@query(f"""WITH {_RW}, {_PV}, bh AS (SELECT signal, p, row_number() OVER (ORDER BY p, signal) AS i, count(*) OVER () AS m FROM pv),
     controls AS (SELECT unnest({list(CONTROLS)!r}) AS signal)
     SELECT nw.signal, {r('nw.t')} AS t_nw, abs(nw.t) > 3 AS passes_flat,
            i <= coalesce((SELECT max(i) FROM bh WHERE p <= {ALPHA} * i / m), 0) AS passes_bh, rejected AS passes_romano_wolf,
            abs(nw.t) > {_crit('controls')} AS passes_random, {r(_crit('controls'))} AS random_critical
     FROM nw JOIN bh ON bh.signal = nw.signal JOIN rw ON rw.signal = nw.signal""")
def test_pool_verdict(spark, sf_dir):
    """Every hurdle on one set of draws."""
    tests, null = _null(spark, sf_dir)
    controls = spark.createDataFrame([(c,) for c in CONTROLS], "signal string")
    out = inference.pool_verdict(tests, null, controls, ALPHA)
    return out.select(
        "signal", rounded("t_nw").alias("t_nw"), "passes_flat", "passes_bh", "passes_romano_wolf", "passes_random", rounded("random_critical").alias("random_critical")
    )


def _interval_sql(draws: str, seen: str) -> str:
    return f"""SELECT {r(f'(SELECT o FROM {seen})')} AS observed, {r('quantile_cont(mean, 0.025)')} AS lo, {r('quantile_cont(mean, 0.975)')} AS hi,
     {r(f'avg(CASE WHEN c >= abs((SELECT o FROM {seen})) THEN 1.0 ELSE 0.0 END)', 3)} AS p FROM (SELECT mean, abs(mean - avg(mean) OVER ()) AS c FROM {draws})"""


def _told(out: DataFrame) -> DataFrame:
    return out.select(*[rounded(c).alias(c) for c in ("observed", "lo", "hi")], rounded("p", 3).alias("p"))


@query(f"""WITH {_IC}, {_boot()}, df AS (SELECT a.pos, a.value - b.value AS d FROM vals a JOIN vals b ON a.pos = b.pos AND a.signal = 'momentum' AND b.signal = 'range'),
     dm AS (SELECT draw, avg(d) AS mean FROM df JOIN slots ON slots.pos = df.pos GROUP BY draw), so AS (SELECT avg(d) AS o FROM df) {_interval_sql('dm', 'so')}""")
def test_paired_bootstrap(spark, sf_dir):
    """Difference of two signals on the same dates, with its interval."""
    series, days = _positions(ic(spark, sf_dir))
    starts, n = _starts(days)
    a = series.where("signal = 'momentum'").select("pos", F.col("value").alias("x"))
    b = series.where("signal = 'range'").select("pos", F.col("value").alias("y"))
    return _told(inference.paired_bootstrap(a.join(b, "pos"), "x", "y", starts, BLOCK, n))


_EARLY, _LATE = "date <= DATE '1996-06-30'", "date > DATE '1996-06-30'"


@query(f"""WITH {_IC}, {_boot('_a', _EARLY)}, {_boot('_b', _LATE, 31)},
     {', '.join(f"dm_{t} AS (SELECT pos, avg(value) AS v FROM vals_{t} GROUP BY pos), mm_{t} AS (SELECT draw, avg(v) AS mean FROM dm_{t} d JOIN slots_{t} s ON s.pos = d.pos GROUP BY draw)" for t in 'ab')},
     sh AS (SELECT b.mean - a.mean AS mean FROM mm_a a JOIN mm_b b ON a.draw = b.draw), so AS (SELECT (SELECT avg(v) FROM dm_b) - (SELECT avg(v) FROM dm_a) AS o) {_interval_sql('sh', 'so')}""")
def test_window_shift(spark, sf_dir):
    """Change of the pool's mean correlation between two windows of dates."""
    values = ic(spark, sf_dir)
    (a, days_a), (b, days_b) = _positions(values, _EARLY), _positions(values, _LATE)
    (starts_a, n), (starts_b, m) = _starts(days_a), _starts(days_b, 31)
    return _told(inference.window_shift(a, b, (starts_a, starts_b), BLOCK, (n, m)))


@query(f"WITH {_IC}, c AS (SELECT signal, count(*) AS n_days FROM ic GROUP BY signal) SELECT signal, n_days FROM c WHERE n_days >= 0.95 * (SELECT max(n_days) FROM c)")
def select_long_enough(spark, sf_dir):
    """Signals with nearly as many dates as the longest."""
    return inference.long_enough(ic(spark, sf_dir).groupBy("signal").agg(F.count("*").alias("n_days")), 0.95)


@query(f"WITH {_IC}, {_boot()} SELECT date, pos FROM pos")
def select_complete_dates(spark, sf_dir):
    return inference.complete_dates(ic(spark, sf_dir), len(SIGNALS))


@query(f"""WITH {_long()}, c AS (SELECT momentum, range, drawup, fwd_1 FROM wide WHERE momentum IS NOT NULL AND range IS NOT NULL AND drawup IS NOT NULL AND fwd_1 IS NOT NULL)
     SELECT {r('sum(momentum * momentum)', 2)} AS mm, {r('sum(momentum * range)', 2)} AS mr, {r('sum(drawup * fwd_1)', 2)} AS df, {r('sum(range * fwd_1)', 2)} AS rf FROM c""")
def select_normal_equations(spark, sf_dir):
    out = inference.normal_equations(panel_values(spark, sf_dir), ["momentum", "range", "drawup", "fwd_1"])
    return out.select(rounded("`momentum*momentum`", 2).alias("mm"), rounded("`momentum*range`", 2).alias("mr"), rounded("`drawup*fwd_1`", 2).alias("df"), rounded("`fwd_1*range`", 2).alias("rf"))


@query(f"""WITH {_long()}, d AS (SELECT date, signal, count(DISTINCT value) AS n FROM long GROUP BY date, signal)
     SELECT signal, {r('avg(n)', 4)} AS mean_distinct FROM d GROUP BY signal HAVING avg(n) >= 2""")
def select_usable(spark, sf_dir):
    """Signals that can be ranked on most dates."""
    return scoring.usable(long_values(spark, sf_dir)).select("signal", rounded("mean_distinct", 4).alias("mean_distinct"))


@query(f"WITH {_IC}, {_NW} SELECT signal, {r('CASE WHEN n < 60 THEN 0 ELSE coalesce(abs(t), 0) END')} AS screen FROM nw")
def score_cheap_screen(spark, sf_dir):
    out = scoring.cheap_screen(inference.newey_west(ic(spark, sf_dir), "ic", LAG))
    return out.select("signal", rounded("screen").alias("screen"))


@query(f"""WITH {_long()}, dd AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM (SELECT DISTINCT date FROM grid WHERE close IS NOT NULL))
     SELECT date, key, signal, {r(_rank('value', 'date, signal'))} AS rank FROM long WHERE value IS NOT NULL AND date IN (SELECT date FROM dd WHERE pos % 5 = 0)""")
def score_strided_ranks(spark, sf_dir):
    out = scoring.strided_ranks(long_values(spark, sf_dir), panel.calendar(grid(spark, sf_dir)), 5)
    return out.select("date", "key", "signal", rounded("rank").alias("rank"))


_GREEDY = f"""{_PAIRS}, {_ic()}, ts AS (SELECT signal, avg(ic) / stddev_samp(ic) * sqrt(count(ic)) AS t FROM ic GROUP BY signal),
     ap AS (SELECT signal, key, value, lag(value) OVER (PARTITION BY signal, key ORDER BY date) AS past FROM long),
     ac AS (SELECT signal, avg(c) AS autocorr FROM (SELECT signal, key, {_corr('value', 'past')} AS c FROM ap WHERE value IS NOT NULL AND past IS NOT NULL GROUP BY signal, key) GROUP BY signal),
     pm AS (SELECT a, b FROM pd WHERE n >= {MINIMUM} AND c IS NOT NULL GROUP BY a, b HAVING abs(avg(c)) > 0.7),
     nr AS (SELECT s, list(o) AS near FROM (SELECT a AS s, b AS o FROM pm UNION ALL SELECT b, a FROM pm) GROUP BY s),
     od AS (SELECT ts.signal, t, coalesce(near, []) AS near, row_number() OVER (ORDER BY abs(t) DESC, ts.signal) AS k FROM ts JOIN ac ON ac.signal = ts.signal LEFT JOIN nr ON s = ts.signal WHERE abs(t) >= 0.1 AND coalesce(autocorr, 0) >= -1),
     gr(k, taken) AS (SELECT CAST(0 AS BIGINT), CAST([] AS VARCHAR[]) UNION ALL
                      SELECT od.k, CASE WHEN len(taken) < 10 AND len(list_intersect(taken, near)) = 0 THEN list_append(taken, signal) ELSE taken END FROM gr JOIN od ON od.k = gr.k + 1),
     tk AS (SELECT taken FROM gr ORDER BY k DESC LIMIT 1)"""


@query(f"WITH RECURSIVE {_GREEDY} SELECT signal, CASE WHEN t >= 0 THEN 1 ELSE -1 END AS sign, CAST(list_position(taken, signal) AS INTEGER) AS place FROM od, tk WHERE list_contains(taken, signal)")
def select_greedy(spark, sf_dir):
    """At most ten strong signals that are little correlated with each other."""
    wide = panel_values(spark, sf_dir)
    stats = scoring.ic_summary(ic(spark, sf_dir)).join(scoring.autocorrelation(scoring.melt(wide, SIGNALS)), "signal")
    return arms.select_uncorrelated(stats, gram.rank_correlations(wide, list(SIGNALS), minimum=MINIMUM), 10, 0.7, 0.1, -1.0)


_ARMS = {"price": ["momentum", "reversal"], "volume": ["volume_surge"], "range": ["range", "drawup"]}


def _arms_sql() -> str:
    """Daily ICs of each arm's signals, equally weighted as centred ranks, on dates that all arms have."""
    of = " UNION ALL ".join(f"SELECT '{a}' AS arm, '{s}' AS signal" for a, names in _ARMS.items() for s in names)
    rank = lambda x: f"(rank() OVER (PARTITION BY arm, date ORDER BY {x}) + (count(*) OVER (PARTITION BY arm, date, {x}) - 1) / 2.0)"
    return f"""{_WEIGHTS}, arm_of AS ({of}), cb AS (SELECT arm, date, key, round(sum(coalesce(c, 0)), 9) AS v FROM wc JOIN arm_of ON arm_of.signal = wc.signal GROUP BY arm, date, key HAVING count(c) > 0),
        lb AS (SELECT DISTINCT date, key, fwd_1 FROM long WHERE fwd_1 IS NOT NULL), bt AS (SELECT arm, date, v, fwd_1 AS y FROM cb JOIN lb USING (date, key)),
        rk AS (SELECT arm, date, {rank('v')} AS x, {rank('y')} AS y FROM bt), ci AS (SELECT arm, date, {_corr('x', 'y')} AS value, count(*) AS n FROM rk GROUP BY arm, date),
        ic AS (SELECT arm AS signal, date, value AS ic FROM ci WHERE value IS NOT NULL AND n >= {MINIMUM})"""


@query(f"""WITH {_arms_sql()}, {_boot().replace(f"HAVING count(*) = {len(SIGNALS)}", f"HAVING count(*) = {len(_ARMS)}")},
     df AS (SELECT a.signal AS arm, a.pos, a.value - b.value AS d FROM vals a JOIN vals b ON b.pos = a.pos AND b.signal = 'price' AND a.signal <> 'price'), sn AS (SELECT arm, avg(d) AS observed, count(*) AS days FROM df GROUP BY arm),
     dm AS (SELECT arm, draw, avg(d) AS mean FROM df JOIN slots ON slots.pos = df.pos GROUP BY arm, draw), dc AS (SELECT *, abs(mean - avg(mean) OVER (PARTITION BY arm)) AS c FROM dm),
     iv AS (SELECT dc.arm, any_value(observed) AS observed, any_value(days) AS days, quantile_cont(mean, 0.025) AS lo, quantile_cont(mean, 0.975) AS hi, avg(CASE WHEN c >= abs(observed) THEN 1.0 ELSE 0.0 END) AS p FROM dc JOIN sn ON sn.arm = dc.arm GROUP BY dc.arm),
     hk AS (SELECT *, row_number() OVER (ORDER BY p, arm) - 1 AS i, count(*) OVER () AS m FROM iv)
     SELECT arm, {r('observed')} AS observed, days, {r('lo')} AS lo, {r('hi')} AS hi, {r('p')} AS p, {r('least(1.0, max(p * (m - i)) OVER (ORDER BY p, arm ROWS UNBOUNDED PRECEDING))')} AS p_holm FROM hk""")
def test_arms(spark, sf_dir):
    """Equally weighted arms against the price arm, resampled in the same blocks of dates."""
    wide = panel_values(spark, sf_dir)
    mixed = wide.select("date", "key", "fwd_1")
    for arm, names in _ARMS.items():
        one = gram.weighted_signal(wide, names, dict.fromkeys(names, 1.0)).withColumn("value", F.round("value", 9))  # sums in another order differ in the last digits
        mixed = mixed.join(one.withColumnRenamed("value", arm), ["date", "key"], "left")
    daily = gram.rank_ic(mixed, list(_ARMS), ["fwd_1"], MINIMUM).select("date", "signal", "ic").persist()  # a row for each date and arm
    days = inference.complete_dates(daily, len(_ARMS))
    series = daily.join(days, "date").select(F.col("signal").alias("arm"), "pos", F.col("ic").alias("value"))
    starts, n = _starts(days)
    out = arms.compare_arms(series, "price", starts, BLOCK, n)
    return out.select("arm", *[rounded(c).alias(c) for c in ("observed", "lo", "hi", "p", "p_holm")], "days")


@query()
def search_baselines(spark, sf_dir):
    """The published pool and as many random formulas of its shapes: selection in early dates, retention in later ones."""
    from tessera.queries.formulas import POOL, POOL_NAMES
    from tessera.search import sampler

    drawn = [r.expression for r in sampler.sample_set(spark, sampler.profile(POOL), len(POOL), seed=17).orderBy("expression").collect()]  # as many as the pool has
    every = POOL_NAMES | {f"r{i:02d}": t for i, t in enumerate(drawn)}
    wide = evaluate(grid(spark, sf_dir), every, series=panel.forward_columns([1]), needs=["open"], by_date=True).persist()  # dealt out by date once for all that ranks
    daily = gram.rank_ic(wide, list(every), ["fwd_1"], MINIMUM, dealt=True).select("date", "signal", "ic").persist()
    cut = F.lit("1999-06-30").cast("date")
    fit, later = daily.where(F.col("date") <= cut), daily.where(F.col("date") > cut)
    group = lambda c: F.when(F.col(c).startswith("f"), "published").otherwise("random")
    auto = gram.autocorrelation(wide.where(F.col("date") <= cut), list(every)).persist()  # a row for each formula; read twice
    stats = scoring.ic_summary(fit).join(auto, "signal").withColumn("set", group("signal"))
    names = spark.createDataFrame([(n,) for n in every], "signal string").withColumn("set", group("signal"))
    tests = names.join(stats.select("signal", F.col("t_ic").alias("t")), "signal", "left")
    pairs = gram.rank_correlations(wide, list(every), list(every), MINIMUM, dealt=True).persist()  # formulas of two sets against each other; read three times
    taken = arms.select_uncorrelated(stats, pairs.where("a < b"), 10, 0.7, 0.5, 0.0, ("set",))
    means = fit.groupBy("signal").agg(F.avg("ic").alias("fit_ic")).join(later.groupBy("signal").agg(F.avg("ic").alias("hold_ic")), "signal", "left")
    closest = gram.correlation_gate(pairs.where(F.col("b").isin(list(POOL_NAMES))))
    out = arms.compare_sets(tests, taken, means, closest)
    digits = {"best_t": 5, "null_best_t": 4, "median_retention": 4, "sign_held": 4, "share_known": 4}
    return out.select("set", "candidates", "scorable", "selected", *[rounded(c, d).alias(c) for c, d in digits.items()])


@query(f"""WITH {_IC}, mi AS (SELECT year(date) AS fold, signal, avg(ic) AS m FROM ic GROUP BY year(date), signal), rk AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY abs(m) DESC, signal) AS place FROM mi)
     SELECT fold, signal, {r('m')} AS mean_ic, place FROM rk WHERE place <= 3""")
def select_fold_factors(spark, sf_dir):
    """The three signals that each year leans on most."""
    values = ic(spark, sf_dir).persist()  # a row for each date and signal; made once for its years and its means
    first, last = values.agg(F.year(F.min("date")), F.year(F.max("date"))).first()
    years = spark.range(first or 0, (last or -1) + 1).select(F.col("id").alias("fold"), F.make_date("id", F.lit(1), F.lit(1)).alias("b"), F.make_date("id", F.lit(12), F.lit(31)).alias("e"))
    return gates.fold_factors(values, years).select("fold", "signal", rounded("mean_ic").alias("mean_ic"), "place")


def _candidates_sql() -> str:
    """All metrics of the pool from its correlations at every horizon."""
    rest = _curve_sql()[len(_long()) :]
    shapes = ", ".join(f"('{s}', {int(c['fields'])}, {int(c['constants'])}, '{data_family(parse(t))}')" for s, t in SIGNALS.items() for c in [complexity(parse(t))])
    return f"""{_WEIGHTS}{rest}, ic AS (SELECT * FROM ic1), {_boot()}, means AS (SELECT signal, draw, avg(value) AS mean FROM vals JOIN slots ON slots.pos = vals.pos GROUP BY signal, draw),
        ers AS (SELECT signal, stddev_samp(mean) AS se FROM means GROUP BY signal), tm AS (SELECT date, signal, abs(w - lag(w) OVER (PARTITION BY signal, key ORDER BY date)) AS d FROM ww),
        td AS (SELECT date, signal, sum(d) AS d FROM tm GROUP BY date, signal), tv AS (SELECT signal, avg(d) / 2 AS turnover FROM td WHERE d IS NOT NULL GROUP BY signal),
        cd AS (SELECT date, signal, count(*) FILTER (WHERE fwd_1 IS NOT NULL AND value IS NOT NULL) AS hit, count(*) FILTER (WHERE fwd_1 IS NOT NULL) AS every FROM long GROUP BY date, signal),
        cv AS (SELECT signal, avg(CAST(hit AS DOUBLE) / every) AS coverage FROM cd WHERE every > 0 GROUP BY signal),
        hs AS (SELECT signal, horizon, mean_ic / first_value(mean_ic) OVER (PARTITION BY signal ORDER BY horizon) AS s FROM curve),
        hn AS (SELECT *, lead(horizon) OVER (PARTITION BY signal ORDER BY horizon) AS nh, lead(s) OVER (PARTITION BY signal ORDER BY horizon) AS ns FROM hs),
        hl AS (SELECT signal, min(CASE WHEN s > 0.5 AND ns <= 0.5 THEN horizon + (s - 0.5) / (s - ns) * (nh - horizon) END) AS half_life FROM hn GROUP BY signal),
        mn AS (SELECT signal, avg(ic) AS m, stddev_samp(ic) AS sd, CASE WHEN avg(ic) >= 0 THEN 1 ELSE -1 END AS sign FROM ic GROUP BY signal),
        yy AS (SELECT signal, year(date) AS year, avg(ic) AS y FROM ic GROUP BY signal, year(date)), nyr AS (SELECT count(DISTINCT year(date)) AS years FROM grid),
        st AS (SELECT mn.signal, greatest(0.5, count(*) FILTER (WHERE y * sign > 0) / CAST(any_value(years) AS DOUBLE)) AS stability FROM yy JOIN mn ON mn.signal = yy.signal CROSS JOIN nyr GROUP BY mn.signal),
        shp(signal, fields, constants, family) AS (VALUES {shapes}),
        cm AS (SELECT mn.signal, sign, m * sign AS mean_ic, se, m * sign / se AS t, m * sign / sd AS icir, coverage, turnover, half_life, stability, family,
               0.1 * (greatest(0, fields - 3) + greatest(0, constants - 1)) AS cp, 0.00005 * turnover / se AS tp FROM mn JOIN ers USING (signal) JOIN tv USING (signal) JOIN cv USING (signal) JOIN hl USING (signal) JOIN st USING (signal) JOIN shp USING (signal))"""


@query(f"""WITH {_candidates_sql()} SELECT signal, sign, {r('mean_ic')} AS mean_ic, {r('se')} AS ic_se, {r('t', 5)} AS tstat, {r('icir', 5)} AS icir, {r('coverage')} AS coverage, {r('turnover')} AS turnover, {r('half_life', 4)} AS half_life,
     {r('stability')} AS stability, {r('abs(t) * stability - cp - tp', 5)} AS fitness, CASE WHEN half_life < 5 THEN 'fast' WHEN half_life <= 21 THEN 'medium' ELSE 'slow' END AS horizon_bucket, family AS data_family,
     CASE WHEN turnover <= 0.3 THEN 'low' ELSE 'high' END AS turnover_bucket FROM cm""")
def score_candidates(spark, sf_dir):
    """All that fitness and niches need of each signal, in one table."""
    out = _candidates(spark, sf_dir)
    digits = {"mean_ic": 6, "ic_se": 6, "tstat": 5, "icir": 5, "coverage": 6, "turnover": 6, "half_life": 4, "stability": 6, "fitness": 5}
    return out.select("signal", "sign", *[rounded(c, d).alias(c) for c, d in digits.items()], "horizon_bucket", "data_family", "turnover_bucket")


def _candidates(spark, sf_dir):
    wide = panel_values(spark, sf_dir).persist()  # read for correlations, turnover and coverage
    horizons = [f"fwd_{h}" for h in HORIZONS]
    daily = gram.rank_ic(wide, list(SIGNALS), horizons, MINIMUM).withColumn("horizon", F.regexp_extract("label", r"(\d+)$", 1).cast("int")).persist()  # a row for each date, signal and horizon
    series, days = _positions(daily.where("horizon = 1").select("date", "signal", "ic"))
    starts, n = _starts(days)
    errors = inference.bootstrap_errors(inference.bootstrap_means(series, starts, BLOCK, n))
    long = scoring.melt(wide, SIGNALS, ("date", "key", "fwd_1")).withColumn("available", F.col("fwd_1").isNotNull())
    coverage = scoring.universe_coverage(long, "available").withColumnRenamed("universe_coverage", "coverage")
    years = grid(spark, sf_dir).select(F.year("date").alias("year")).distinct()
    return candidates.metrics(daily, errors, scoring.turnover(long), coverage, candidates.forms(spark, SIGNALS), years, 0.3)


@query(f"""WITH {_candidates_sql()}, {_PAIRS[len(_long()) + 2 :]}, pm AS (SELECT a, b, abs(avg(c)) AS c FROM pd WHERE n >= {MINIMUM} AND c IS NOT NULL GROUP BY a, b),
     cl AS (SELECT s AS signal, max(c) AS c FROM (SELECT a AS s, c FROM pm WHERE b IN ({', '.join(f"'{s}'" for s in _MEMBERS)}) UNION ALL SELECT b, c FROM pm WHERE a IN ({', '.join(f"'{s}'" for s in _MEMBERS)})) GROUP BY s), {_NW}
     SELECT cm.signal, CASE WHEN coverage < 0.9 THEN 'coverage' WHEN cl.c >= 0.3 THEN 'correlation' WHEN CASE WHEN n < 24 THEN 0 ELSE coalesce(abs(nw.t), 0) END < 0.5 THEN 'cheap_screen' END AS gate
     FROM cm LEFT JOIN cl ON cl.signal = cm.signal JOIN nw ON nw.signal = cm.signal""")
def select_gates(spark, sf_dir):
    """The first gate that refuses each signal, held against the members of an archive."""
    wide = panel_values(spark, sf_dir)
    long = scoring.melt(wide, SIGNALS, ("date", "key", "fwd_1")).withColumn("available", F.col("fwd_1").isNotNull())
    coverage = scoring.universe_coverage(long, "available").withColumnRenamed("universe_coverage", "coverage")
    closest = gram.correlation_gate(gram.rank_correlations(wide, list(SIGNALS), _MEMBERS, MINIMUM))
    screen = scoring.cheap_screen(inference.newey_west(ic(spark, sf_dir), "ic", LAG), 24)
    return candidates.gates(coverage, closest, screen, 0.9, 0.3, 0.5)


def _sweep_inputs(spark, sf_dir):
    """The pool's formulas as a stream of scored candidates: each is evaluated once, for all cells."""
    from tessera.plans.formula import largest_shared
    from tessera.queries.formulas import POOL_NAMES

    names = list(POOL_NAMES)
    wide = evaluate(panel.forward_returns(grid(spark, sf_dir), [1], False), POOL_NAMES, keep=["fwd_1"]).persist()  # one evaluation serves both passes
    daily = gram.rank_ic(wide, names, ["fwd_1"], MINIMUM).select("date", "signal", "ic").persist()
    cut = F.lit("1999-06-30").cast("date")
    fit = inference.newey_west(daily.where(F.col("date") <= cut), "ic", LAG)
    later = daily.where(F.col("date") > cut).groupBy("signal").agg(F.avg("ic").alias("later"))
    pairs = gram.rank_correlations(wide, names, minimum=MINIMUM).select("a", "b", F.abs("corr").alias("corr"))
    trees = {n: parse(t) for n, t in POOL_NAMES.items()}
    shared = spark.createDataFrame([(a, b, largest_shared(trees[a], trees[b])) for a in names for b in names if a < b], "a string, b string, shared int")  # texts of a published set
    near = pairs.join(shared, ["a", "b"], "full_outer").na.fill({"corr": 0.0, "shared": 0})
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "corr", "shared"))
    conflicts = both.groupBy(F.col("a").alias("signal")).agg(F.collect_list(F.struct(F.col("b").alias("id"), "corr", "shared")).alias("conflicts"))
    forms = candidates.forms(spark, POOL_NAMES)
    rows = fit.join(later, "signal", "left").join(conflicts, "signal").join(forms, "signal")
    return rows.select(
        F.col("signal").alias("id"), F.concat_ws("/", "data_family", F.when(F.col("depth") > 2, "deep").otherwise("flat")).alias("niche"), F.abs("t_nw").alias("fitness"), F.expr("int(substr(signal, 2))").alias("seq"),
        F.lit(1).alias("round"), F.lit("pool").alias("operator"), (F.col("later") * F.signum("mean")).alias("validation"), "conflicts",
    )


@query()
def search_sweep(spark, sf_dir):
    """Nine pairs of thresholds replay one stream of scored formulas; tests hold the replay against a plain one."""
    grid_ = [(f"{c}/{s}", c, s) for c in (0.6, 0.7, 0.8) for s in (4, 5, 6)]
    cells = spark.createDataFrame(grid_, "cell string, max_corr double, max_shared int")
    out = runlog.sweep(_sweep_inputs(spark, sf_dir), cells, "validation", 3, 10)
    return out.select("cell", "max_corr", "max_shared", "archive_size", "niches_filled", rounded("validation").alias("validation"))
