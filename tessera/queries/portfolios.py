"""Portfolio, simulation and data-quality queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import rounded
from tessera.operators import evidence, gates, inference, panel, portfolio, quality
from tessera.queries.base import BARS, GRID, bars, grid, query, r, read
from tessera.sources.tables import digest_of, row_digest

W3 = (1, 3, 12)
_RK = lambda x: f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY date, {x} IS NULL ORDER BY {x}) + (count(*) OVER (PARTITION BY date, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY date) END"
_FEATURES = f"""{BARS},
f1 AS (SELECT *, {', '.join(f'adj_close / lag(adj_close, {w}) OVER o - 1 AS mom_{w}' for w in W3)}, adj_close / lag(adj_close, 1) OVER o - 1 AS ret1,
       (high - low) / close AS rng FROM bars WINDOW o AS (PARTITION BY permno ORDER BY date)),
f2 AS (SELECT *, CASE WHEN count(ret1) OVER a >= 10 THEN stddev_samp(ret1) OVER a END AS vol_21, CASE WHEN count(ret1) OVER b >= 20 THEN stddev_samp(ret1) OVER b END AS vol_63,
       CASE WHEN count(volume) OVER c >= 3 THEN avg(volume) OVER c END AS vol_5d, CASE WHEN count(volume) OVER d >= 10 THEN avg(volume) OVER d END AS volume_20,
       CASE WHEN count(dollar_volume) OVER d >= 10 THEN avg(dollar_volume) OVER d END AS adv20
       FROM f1 WINDOW a AS (PARTITION BY permno ORDER BY date ROWS 20 PRECEDING), b AS (PARTITION BY permno ORDER BY date ROWS 62 PRECEDING),
                      c AS (PARTITION BY permno ORDER BY date ROWS 4 PRECEDING), d AS (PARTITION BY permno ORDER BY date ROWS 19 PRECEDING)),
f3 AS (SELECT *, vol_5d / volume_20 - 1 AS accel, -vol_21 AS nv, -rng AS nr, -(vol_21 / vol_63) AS nq FROM f2),
f4 AS (SELECT *, {', '.join(f'{_RK(x)} AS r{i}' for i, x in enumerate(['mom_1', 'mom_3', 'mom_12', 'accel', 'nv', 'nr', 'nq']))} FROM f3),
feat AS (SELECT *, list_avg([r0, r1, r2, r3, r4, r5, r6]) AS score FROM f4)"""


def scored(spark, sf_dir, *keep):
    """The score of each name and date, with the features asked for."""
    return portfolio.features(bars(spark, sf_dir), windows=W3, keep=keep)


def unscored(spark, sf_dir):
    return portfolio.series_features(bars(spark, sf_dir), windows=W3)


@query(f"WITH {_FEATURES} SELECT permno, date, {r('mom_3')} AS mom_3, {r('vol_21')} AS vol_21, {r('adv20', 2)} AS adv20, {r('accel')} AS accel, {r('score')} AS score FROM feat")
def portfolio_features(spark, sf_dir):
    f = scored(spark, sf_dir, "mom_3", "vol_21", "adv20", "volume_accel")
    return f.select("permno", "date", rounded("mom_3").alias("mom_3"), rounded("vol_21").alias("vol_21"), rounded("adv20", 2).alias("adv20"), rounded("volume_accel").alias("accel"), rounded("score").alias("score"))


_TOP = f"""{_FEATURES}, best AS (SELECT date, permno, row_number() OVER (PARTITION BY date ORDER BY floor(score * 1e9) DESC, permno) AS k FROM feat WHERE score IS NOT NULL AND coalesce(adv20, 0) >= 1000),
     wts AS (SELECT date, permno, least(0.95 / count(*) OVER (PARTITION BY date), 0.15) AS weight FROM best WHERE k <= 10)"""


def weights(spark, sf_dir):
    """Ten names a date among the liquid ones."""
    liquid = scored(spark, sf_dir, "adv20").where(F.coalesce("adv20", F.lit(0.0)) >= 1000).withColumn("score", F.floor(F.col("score") * 1e9))
    return portfolio.top_weights(liquid.select("date", "permno", "score"), 10, 0.15, cash=0.05).select("date", "permno", "weight")


@query(f"WITH {_TOP} SELECT date, permno, {r('weight')} AS weight FROM wts")
def portfolio_top_weights(spark, sf_dir):
    return weights(spark, sf_dir).select("date", "permno", rounded("weight").alias("weight"))


_RET = f"""{_TOP}, px AS (SELECT permno, date, lead(open, 1) OVER o AS entry, lead(open, 2) OVER o AS ex, lead(close, 1) OVER o AS mark FROM bars WINDOW o AS (PARTITION BY permno ORDER BY date)),
     rets AS (SELECT w.date, sum(weight * (CASE WHEN ex > 0 THEN ex ELSE mark END / entry - 1)) AS ret, count(*) AS names FROM wts w JOIN px ON px.permno = w.permno AND px.date = w.date WHERE entry > 0 GROUP BY w.date)"""


def returns(spark, sf_dir):
    return portfolio.portfolio_returns(weights(spark, sf_dir), bars(spark, sf_dir).select("permno", "date", "open", "close"))


@query(f"WITH {_RET} SELECT date, {r('ret')} AS ret, names FROM rets")
def portfolio_returns(spark, sf_dir):
    return returns(spark, sf_dir).select("date", rounded("ret").alias("ret"), "names")


@query(f"""WITH {_TOP}, d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM (SELECT DISTINCT date FROM bars)), n AS (SELECT pos, permno, weight FROM wts JOIN d ON d.date = wts.date),
     j AS (SELECT coalesce(a.pos, b.pos + 1) AS pos, abs(coalesce(a.weight, 0) - coalesce(b.weight, 0)) AS c FROM n a FULL OUTER JOIN n b ON a.pos = b.pos + 1 AND a.permno = b.permno)
     SELECT date, {r('sum(c) / 2')} AS turnover FROM j JOIN d ON d.pos = j.pos GROUP BY date""")
def portfolio_turnover(spark, sf_dir):
    out = portfolio.weight_turnover(weights(spark, sf_dir), panel.calendar(bars(spark, sf_dir)))
    return out.select("date", rounded("turnover").alias("turnover"))


@query(f"WITH {_RET} SELECT {r('avg(ret) / stddev_samp(ret) * sqrt(12.0)')} AS sharpe, {r('exp(sum(ln(1 + ret / 100))) - 1')} AS total, count(*) AS n FROM rets")
def portfolio_sharpe(spark, sf_dir):
    out = returns(spark, sf_dir).agg(portfolio.sharpe("ret", 12).alias("s"), F.product(1 + F.col("ret") / 100).alias("t"), F.count("*").alias("n"))
    return out.select(rounded("s").alias("sharpe"), rounded(F.col("t") - 1).alias("total"), "n")


@query(f"""WITH {_RET}, e AS (SELECT date, exp(sum(ln(1 + ret / 100)) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)) AS equity FROM rets),
     p AS (SELECT *, max(equity) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak FROM e) SELECT date, {r('equity')} AS equity, {r('equity / peak - 1 + 1e-12')} AS drawdown FROM p""")
def portfolio_drawdown(spark, sf_dir):
    out = portfolio.equity_curve(returns(spark, sf_dir).withColumn("ret", F.col("ret") / 100))
    return out.select("date", rounded("equity").alias("equity"), rounded(F.col("drawdown") + 1e-12).alias("drawdown"))


@query(f"""WITH {_RET}, k AS (SELECT ret, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM rets),
     b AS (SELECT ret, CAST(greatest(0, ceil(round(i * 8.0 / (n - 1), 9)) - 1) AS BIGINT) AS part FROM k)
     SELECT part, {r('coalesce(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(12.0), 0)')} AS sharpe, count(*) AS n FROM b GROUP BY part""")
def portfolio_subperiods(spark, sf_dir):
    return portfolio.subperiod_sharpe(returns(spark, sf_dir), 8).select("part", rounded("sharpe").alias("sharpe"), "n")


@query(f"WITH {_RET} SELECT {r('skewness(ret)', 5)} AS skew, {r('kurtosis(ret)', 5)} AS kurt FROM rets")
def portfolio_moments(spark, sf_dir):
    skew, kurt = portfolio.sample_moments("ret")
    return returns(spark, sf_dir).agg(rounded(skew, 5).alias("skew"), rounded(kurt, 5).alias("kurt"))


@query(f"""WITH {_TOP}, g AS (SELECT permno, date, lead(adj_close) OVER (PARTITION BY permno ORDER BY date) / adj_close - 1 AS gain FROM bars), s AS (SELECT s_suppkey, s_nationkey AS sector FROM supplier),
     c AS (SELECT sector, sum(abs(weight * gain)) AS contribution FROM wts w JOIN g ON g.permno = w.permno AND g.date = w.date JOIN s ON s_suppkey = w.permno GROUP BY sector)
     SELECT sector, {r('contribution')} AS contribution, {r('contribution / sum(contribution) OVER ()')} AS share FROM c""")
def portfolio_sector_contribution(spark, sf_dir):
    b = bars(spark, sf_dir)
    gains = b.select("permno", "date", (F.lead("adj_close").over(Window.partitionBy("permno").orderBy("date")) / F.col("adj_close") - 1).alias("gain"))
    sectors = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("permno"), F.col("s_nationkey").alias("sector"))
    out = portfolio.sector_contribution(weights(spark, sf_dir).join(sectors, "permno"), gains)
    return out.select("sector", rounded("contribution").alias("contribution"), rounded("share").alias("share"))


@query(f"""WITH {_TOP}, f AS (SELECT year(date) AS fold, list_sort(list(DISTINCT permno)) AS s FROM wts GROUP BY year(date)), p AS (SELECT fold, s, lag(s) OVER (ORDER BY fold) AS q FROM f)
     SELECT CAST(fold AS BIGINT) AS fold, {r('len(list_intersect(s, q)) / CAST(len(list_distinct(list_concat(s, q))) AS DOUBLE)')} AS jaccard FROM p WHERE q IS NOT NULL""")
def portfolio_fold_stability(spark, sf_dir):
    sets = weights(spark, sf_dir).select(F.year("date").cast("long").alias("fold"), F.col("permno").alias("member"))
    return portfolio.fold_stability(sets).select("fold", rounded("jaccard").alias("jaccard"))


#: The weights of each date and those of the date before, under the later date.
_PREV = f"""{_TOP}, cal AS (SELECT date, lead(date) OVER (ORDER BY date) AS after FROM (SELECT DISTINCT date FROM bars)),
     prv AS (SELECT after AS date, permno, weight FROM wts JOIN cal ON cal.date = wts.date WHERE after IS NOT NULL)"""


def _previous(spark, sf_dir, w):
    """Each date's weights, moved to the date after it."""
    days = panel.calendar(bars(spark, sf_dir))
    return w.join(panel.nth_next_date(days, 1), "date").select(F.col("next").alias("date"), "permno", "weight")


@query(f"""WITH {_PREV}, j AS (SELECT coalesce(p.date, w.date) AS date, coalesce(p.permno, w.permno) AS key, p.weight IS NOT NULL AS had, coalesce(p.weight, 0) AS w0, coalesce(w.weight, 0) AS w1
          FROM prv p FULL OUTER JOIN wts w ON p.date = w.date AND p.permno = w.permno),
     t AS (SELECT *, sum(abs(w1 - w0)) OVER (PARTITION BY date) / 2 AS turn, bool_or(had) OVER (PARTITION BY date) AS any_had FROM j),
     x AS (SELECT date, key, any_had AND turn > 0.2 AS over_, CASE WHEN any_had AND turn > 0.2 THEN greatest(least(w0 + 0.2 / turn * (w1 - w0), 0.09), 0) ELSE w1 END AS w FROM t),
     y AS (SELECT date, key, CASE WHEN over_ AND sum(w) OVER (PARTITION BY date) > 0.9 THEN w * 0.9 / sum(w) OVER (PARTITION BY date) ELSE w END AS weight FROM x)
     SELECT date, key, {r('weight')} AS weight FROM y WHERE weight > 1e-8""")
def portfolio_turnover_cap(spark, sf_dir):
    """Every date's weights, no further from those of the date before than the turnover allows."""
    w = weights(spark, sf_dir)
    before = _previous(spark, sf_dir, w).withColumnRenamed("permno", "key")
    out = portfolio.cap_turnover(before, w.withColumnRenamed("permno", "key"), 0.2, cap=0.09, total=0.9, by=("date",))
    return out.select("date", "key", rounded("weight").alias("weight"))


@query(f"WITH {BARS} SELECT date, permno, {r('abs(dollar_volume) * (0.001 + 0.1 * 0.02 * sqrt(abs(dollar_volume) / 1e6))', 4)} AS cost FROM bars")
def portfolio_trade_cost(spark, sf_dir):
    cost = portfolio.trade_cost(F.col("dollar_volume"), F.lit(1e6), F.lit(0.02))
    return bars(spark, sf_dir).select("date", "permno", rounded(cost, 4).alias("cost"))


_HELD = """px AS (SELECT permno, date, close, lag(close) OVER (PARTITION BY permno ORDER BY date) AS past FROM bars),
     held AS (SELECT p.date, p.permno AS key, coalesce(x.close, 0) AS price, CASE WHEN past > 0 THEN 100000 * weight / past ELSE 0 END AS qty FROM prv p LEFT JOIN px x ON x.date = p.date AND x.permno = p.permno)"""
_ORDERS = f"""{_PREV}, {_HELD},
     oj AS (SELECT coalesce(w.date, h.date) AS date, coalesce(w.permno, h.key) AS key, 95000 * coalesce(weight, 0) AS goal, coalesce(qty * price, 0) AS mv, coalesce(qty, 0) AS q, coalesce(price, 0) AS price
            FROM wts w FULL OUTER JOIN held h ON h.date = w.date AND h.key = w.permno),
     od AS (SELECT *, goal - mv AS d, goal - mv <= 0 AND price > 0 AS in_shares FROM oj WHERE abs(goal - mv) >= 50),
     orders_ AS (SELECT date, key, CASE WHEN d > 0 THEN 'buy' ELSE 'sell' END AS side, round(d, 2) AS d, CASE WHEN in_shares THEN 'qty' ELSE 'notional' END AS submit_mode,
                 CASE WHEN NOT in_shares THEN round(abs(d), 2) END AS notional, CASE WHEN in_shares THEN round(least(abs(d) / price, abs(q)), 6) END AS qty, price FROM od)"""


def holdings(spark, sf_dir):
    """What each date holds of the portfolio before: shares at the former close, valued at the date's."""
    b = bars(spark, sf_dir)
    px = b.select("permno", "date", F.col("close").alias("price"), F.lag("close").over(Window.partitionBy("permno").orderBy("date")).alias("past"))
    held = _previous(spark, sf_dir, weights(spark, sf_dir)).join(px, ["date", "permno"], "left")
    qty = F.when(F.col("past") > 0, F.col("weight") * 100_000 / F.col("past")).otherwise(0.0)
    held = held.select("date", F.col("permno").alias("key"), F.coalesce("price", F.lit(0.0)).alias("price"), qty.alias("qty"))
    return held.withColumn("market_value", F.col("qty") * F.col("price"))


def orders(spark, sf_dir):
    target = weights(spark, sf_dir).withColumnRenamed("permno", "key")
    return portfolio.order_intents(target, holdings(spark, sf_dir), 95_000.0, 50.0, by=("date",))


@query(f"""WITH {_ORDERS} SELECT date, key, side, submit_mode, {r('d', 1)} AS delta_value, {r('notional', 1)} AS notional, {r('qty', 4)} AS qty FROM orders_""")
def portfolio_order_intents(spark, sf_dir):
    """Orders of every date from the portfolio of the date before."""
    out = orders(spark, sf_dir)
    return out.select("date", "key", "side", "submit_mode", rounded("delta_value", 1).alias("delta_value"), rounded("notional", 1).alias("notional"), rounded("qty", 4).alias("qty"))


_SIZED = f"""{_PREV}, {_HELD}, adv AS (SELECT date, permno, adv20 FROM feat),
     en AS (SELECT permno, date, lead(open) OVER (PARTITION BY permno ORDER BY date) AS entry FROM bars),
     sj AS (SELECT coalesce(w.date, h.date) AS date, coalesce(w.permno, h.key) AS key, w.weight AS target, coalesce(h.qty, 0) AS shares
            FROM wts w FULL OUTER JOIN held h ON h.date = w.date AND h.key = w.permno),
     sx AS (SELECT sj.*, entry, adv20 AS adv, shares * entry AS hv, volume > 50 AS member FROM sj JOIN en ON en.date = sj.date AND en.permno = key
            JOIN bars ON bars.date = sj.date AND bars.permno = key LEFT JOIN adv ON adv.date = sj.date AND adv.permno = key WHERE entry > 0),
     sy AS (SELECT *, CASE WHEN member THEN 95000 * coalesce(target, 0) ELSE 0 END AS wish FROM sx),
     sv AS (SELECT *, CASE WHEN NOT member THEN 0 WHEN abs(wish - hv) < 100 THEN hv
                           WHEN adv > 0 AND abs(wish - hv) > adv * 0.05 THEN greatest(0, hv + sign(wish - hv) * adv * 0.05) ELSE wish END AS v0 FROM sy)"""


@query(f"""WITH {_SIZED}, sw AS (SELECT *, floor(greatest(v0, 0) / entry + 1e-12) AS n FROM sv)
     SELECT date, key, n AS new_shares, {r('abs(n * entry - hv)', 2)} AS notional, {r('n * entry / 100000')} AS weight FROM sw""")
def portfolio_rebalance(spark, sf_dir):
    """Whole shares of every date after trades of at most a share of the average volume; a name that trades little has left the index."""
    held = holdings(spark, sf_dir).select("date", "key", F.col("qty").alias("shares"))
    target = weights(spark, sf_dir).select("date", F.col("permno").alias("key"), F.col("weight").alias("target"))
    b = bars(spark, sf_dir)
    entry = b.select("date", F.col("permno").alias("key"), F.lead("open").over(Window.partitionBy("permno").orderBy("date")).alias("entry"), (F.col("volume") > 50).alias("present")).where("entry > 0")
    adv = unscored(spark, sf_dir).select("date", F.col("permno").alias("key"), F.col("adv20").alias("adv"))
    positions = target.join(held, ["date", "key"], "full_outer").join(entry, ["date", "key"]).join(adv, ["date", "key"], "left")
    positions = positions.withColumn("target", F.when(F.col("present"), F.col("target")))
    out = portfolio.rebalance(positions, F.lit(100_000.0), fractional=False)
    return out.select("date", "key", "new_shares", rounded("notional", 2).alias("notional"), rounded("weight").alias("weight"))


@query(f"""WITH {_FEATURES}, ox AS (SELECT date, permno, lead(open, 1) OVER o AS a, lead(open, 2) OVER o AS b FROM bars WINDOW o AS (PARTITION BY permno ORDER BY date)),
     rt AS (SELECT date, permno, b / a - 1 AS ret FROM ox WHERE a > 0 AND b > 0),
     tm AS (SELECT date, permno, row_number() OVER (PARTITION BY date ORDER BY floor(mom_12 * 1e9) DESC, permno) AS k FROM feat WHERE mom_12 IS NOT NULL)
     SELECT rt.date, {r('avg(CASE WHEN rt.permno = 1 THEN ret END) * 0.95')} AS benchmark, {r('avg(ret) * 0.95')} AS equal, {r('avg(CASE WHEN k <= 10 THEN ret END) * 0.95')} AS momentum
     FROM rt LEFT JOIN tm ON tm.date = rt.date AND tm.permno = rt.permno GROUP BY rt.date""")
def portfolio_baselines(spark, sf_dir):
    """Daily returns of a benchmark name, of all names, and of the strongest momentum."""
    momentum = unscored(spark, sf_dir).select("date", "permno", F.floor(F.col("mom_12") * 1e9).alias("mom"))
    out = portfolio.baselines(portfolio.open_returns(bars(spark, sf_dir)), F.col("permno") == 1, momentum, 10, 0.05)
    return out.select("date", *[rounded(c).alias(c) for c in ("benchmark", "equal", "momentum")])


@query()
def portfolio_sector_capped(spark, sf_dir):
    """Greedy weights under name and sector caps; tests hold it against the caps."""
    sectors = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("permno"), F.col("s_nationkey").cast("string").alias("sector"))
    joined = scored(spark, sf_dir).select("date", "permno", "score").join(sectors, "permno")
    return portfolio.capped_weights(joined, 10, 0.2, 0.3).select("date", "key", "sector", rounded("weight").alias("weight"))


@query()
def portfolio_walk_forward(spark, sf_dir):
    """Each year is a fold that starts without holdings; trades are bounded by volume and cost something."""
    b = bars(spark, sf_dir)
    series = Window.partitionBy("permno").orderBy("date")
    px = b.select("date", "permno", F.lead("open", 1).over(series).alias("entry"), F.lead("open", 2).over(series).alias("exit"), F.lead("close", 1).over(series).alias("mark"))
    daily = scored(spark, sf_dir, "adv20", "vol_21").select("date", "permno", "score", F.col("adv20").alias("adv"), F.col("vol_21").alias("vol")).join(px, ["date", "permno"])
    first, last = read(spark, sf_dir, "lineitem").agg(F.year(F.min("l_shipdate")), F.year(F.max("l_shipdate"))).first()  # bars have the lines' months
    folds = [(y - first, f"{y}-01-01", f"{y}-12-31") for y in range(first, last + 1)] if first else [(0, "1900-01-01", "1900-12-31")]
    out = portfolio.walk_forward(daily, folds, equity=100_000.0)
    return out.select("fold", "date", *[rounded(c).alias(c) for c in ("gross", "cost", "net", "turnover", "equity")])


@query(f"WITH {BARS} SELECT date, permno FROM bars WHERE high < low OR high < greatest(open, close) OR low > least(open, close) OR close <= 0 OR volume < 0")
def quality_invalid_bars(spark, sf_dir):
    return quality.invalid_bars(bars(spark, sf_dir)).select("date", "permno")


@query(f"""WITH {BARS}, v AS (SELECT permno, date, adj_close / lag(adj_close) OVER (PARTITION BY permno ORDER BY date) - 1 AS ret FROM bars),
     j AS (SELECT permno, date, adj_close / close AS x, lag(adj_close / close) OVER (PARTITION BY permno ORDER BY date) AS p FROM bars)
     SELECT permno, date, {r('ret')} AS ret FROM v WHERE abs(ret) > 0.25 AND (permno, date) NOT IN (SELECT (permno, date) FROM j WHERE abs(x / p - 1) > 0.01)""")
def quality_return_outliers(spark, sf_dir):
    b = bars(spark, sf_dir)
    known = quality.ratio_jumps(b, 0.01).select("permno", "date")  # a split explains a jump
    return quality.return_outliers(b, 0.25, explained=known).select("permno", "date", rounded("ret").alias("ret"))


@query(f"""WITH {BARS}, v AS (SELECT permno, date, adj_close / close AS ratio FROM bars), w AS (SELECT *, lag(ratio) OVER (PARTITION BY permno ORDER BY date) AS before FROM v)
     SELECT permno, date, {r('ratio')} AS ratio FROM w WHERE abs(ratio / before - 1) > 0.01""")
def quality_ratio_jumps(spark, sf_dir):
    return quality.ratio_jumps(bars(spark, sf_dir), 0.01).select("permno", "date", rounded("ratio").alias("ratio"))


@query("SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_suppkey HAVING count(*) > 1")
def quality_duplicates(spark, sf_dir):
    return quality.duplicate_keys(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_suppkey"])


@query(f"""WITH {BARS}, k AS (SELECT DISTINCT permno FROM bars), d AS (SELECT DISTINCT date FROM bars), c AS (SELECT d.date, count(*) AS members, count(b.permno) AS with_bar
     FROM d CROSS JOIN k LEFT JOIN bars b ON b.date = d.date AND b.permno = k.permno GROUP BY d.date) SELECT date, members, with_bar, {r('CAST(with_bar AS DOUBLE) / members')} AS ratio FROM c""")
def quality_coverage(spark, sf_dir):
    b = bars(spark, sf_dir)
    members = b.select("permno").distinct().crossJoin(b.select("date").distinct())
    return quality.coverage_report(members, b, ["date", "permno"]).select("date", "members", "with_bar", rounded("ratio").alias("ratio"))


@query(f"""WITH {BARS}, d AS (SELECT date, count(*) AS n FROM bars GROUP BY date) SELECT (SELECT count(*) FROM bars) AS rows, (SELECT count(DISTINCT permno) FROM bars) AS keys,
     min(date) AS first, max(date) AS last, count(*) AS dates, {r('avg(n)')} AS mean_keys, min(n) AS least_keys, max(n) AS most_keys FROM d""")
def quality_summary(spark, sf_dir):
    return quality.summary(bars(spark, sf_dir)).withColumn("mean_keys", rounded("mean_keys"))


@query("""WITH s AS (SELECT CAST(o_orderdate AS DATE) AS date FROM orders WHERE o_totalprice > 300000), b AS (SELECT min(date) AS lo, max(date) AS hi FROM s)
     SELECT CAST(d AS DATE) AS date FROM (SELECT unnest(range(CAST(lo AS TIMESTAMP), CAST(hi + 1 AS TIMESTAMP), INTERVAL 1 DAY)) AS d FROM b) WHERE dayofweek(d) NOT IN (0, 6) AND CAST(d AS DATE) NOT IN (SELECT date FROM s)""")
def quality_missing_days(spark, sf_dir):
    """Weekdays between the first and the last large order without one."""
    days = read(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_orderdate").cast("date").alias("date"))
    low, high = days.agg(F.min("date"), F.max("date")).first()
    return quality.missing_days(days, str(low or "1970-01-02"), str(high or "1970-01-01"))


@query(f"""WITH {BARS}, j AS (SELECT permno, date, adj_close / close AS x, lag(adj_close / close) OVER (PARTITION BY permno ORDER BY date) AS p FROM bars)
     SELECT 'jumps' AS "check", count(*) AS violations, TRUE AS ok FROM j WHERE abs(x / p - 1) > 0.01
     UNION ALL SELECT 'duplicates', count(*) - count(DISTINCT (permno, date)), count(*) = count(DISTINCT (permno, date)) FROM bars""")
def quality_report(spark, sf_dir):
    b = bars(spark, sf_dir)
    return quality.report({"jumps": quality.ratio_jumps(b, 0.01), "duplicates": quality.duplicate_keys(b, ["permno", "date"])}, ("jumps",))


LIMITS = quality.RiskLimits(gross=0.3, order_value=9_000.0, position=0.1)


@query(f"""WITH {_ORDERS}, ag AS (SELECT date, sum(abs(d)) AS total, max(abs(d)) AS single, sum(CASE WHEN side = 'buy' THEN abs(d) ELSE 0 END) AS buys FROM orders_ GROUP BY date),
     uni AS (SELECT s_suppkey AS key FROM supplier WHERE s_acctbal > 0),
     sg AS (SELECT date, count(*) AS n, max(weight) AS most, sum(weight) AS sm, count(*) FILTER (WHERE permno NOT IN (SELECT key FROM uni)) AS strangers FROM wts GROUP BY date),
     ba AS (SELECT coalesce(sg.date, ag.date) AS date, coalesce(n, 0) AS n, coalesce(most, 0) AS most, coalesce(sm, 0) AS sm, coalesce(strangers, 0) AS strangers,
            coalesce(total, 0) AS total, coalesce(single, 0) AS single, coalesce(buys, 0) AS buys FROM sg FULL OUTER JOIN ag ON ag.date = sg.date)
     SELECT date, 'PT-01' AS "check", {r('total', 1)} AS value, total <= 30000 AS passed FROM ba UNION ALL SELECT date, 'PT-02', {r('single', 1)}, single <= 9000 FROM ba
     UNION ALL SELECT date, 'PT-03', {r('strangers', 1)}, strangers = 0 FROM ba UNION ALL SELECT date, 'PT-04', {r('0', 1)}, TRUE FROM ba
     UNION ALL SELECT date, 'PT-05', {r('n', 1)}, n BETWEEN 1 AND 50 AND most <= 0.1 + 1e-9 AND sm <= 1 + 1e-9 FROM ba UNION ALL SELECT date, 'PT-06', {r('buys', 1)}, buys <= 20000 FROM ba
     UNION ALL SELECT date, 'PT-07', {r('0', 1)}, TRUE FROM ba UNION ALL SELECT date, 'PT-08', {r('1', 1)}, TRUE FROM ba""")
def quality_pre_trade(spark, sf_dir):
    """All checks before orders are sent, for every date's orders."""
    signals = weights(spark, sf_dir).withColumnRenamed("permno", "key")
    universe = read(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("key"))
    out = quality.pre_trade(signals, orders(spark, sf_dir), 100_000.0, 20_000.0, LIMITS, universe, by=("date",))
    return out.select("date", "check", rounded("value", 1).alias("value"), "passed")


@query(f"""WITH {_PREV}, {_HELD}, ps AS (SELECT date, key, qty * price AS mv FROM held),
     gp AS (SELECT coalesce(w.date, p.date) AS date, max(abs(coalesce(mv, 0) / 100000 - coalesce(weight, 0))) AS gap FROM wts w FULL OUTER JOIN ps p ON p.date = w.date AND p.key = w.permno GROUP BY coalesce(w.date, p.date)),
     fl AS (SELECT date, 0 AS lost, max(CASE WHEN open > 0 THEN abs(close / open - 1) * 10000 END) AS slip FROM bars GROUP BY date),
     ba AS (SELECT coalesce(fl.date, gp.date) AS date, coalesce(lost, 0) AS lost, coalesce(slip, 0) AS slip, coalesce(gap, 0) AS gap FROM fl FULL OUTER JOIN gp ON gp.date = fl.date)
     SELECT date, 'PT-09' AS "check", {r('lost', 4)} AS value, lost = 0 AS passed FROM ba UNION ALL SELECT date, 'PT-10', {r('slip', 4)}, slip <= 100 FROM ba
     UNION ALL SELECT date, 'PT-11', {r('gap', 4)}, gap <= 0.01 + 1e-9 FROM ba UNION ALL SELECT date, 'PT-12', {r('1500', 4)}, FALSE FROM ba""")
def quality_post_trade(spark, sf_dir):
    """All checks after trading: fills at the close against the open, holdings against the new weights."""
    target = weights(spark, sf_dir).withColumnRenamed("permno", "key")
    fills = bars(spark, sf_dir).select("date", F.lit("filled").alias("status"), F.col("close").alias("fill"), F.col("open").alias("expected"))
    out = quality.post_trade(target, holdings(spark, sf_dir), fills, 100_000.0, 1_500.0, LIMITS, by=("date",))
    return out.select("date", "check", rounded("value", 4).alias("value"), "passed")


@query(f"""WITH {BARS}, b AS (SELECT permno, max(date) AS latest FROM bars GROUP BY permno), t AS (SELECT max(date) AS target FROM bars),
     g AS (SELECT permno, latest, (SELECT count(*) FROM range(CAST(latest + 1 AS TIMESTAMP), CAST(target + 1 AS TIMESTAMP), INTERVAL 1 DAY) x(d) WHERE dayofweek(d) NOT IN (0, 6)) AS gap FROM b CROSS JOIN t)
     SELECT permno, latest, gap, CASE WHEN gap <= 1 THEN 'info' WHEN gap <= 25 THEN 'warning' ELSE 'critical' END AS severity, gap <= 1 AS passed FROM g""")
def quality_gaps(spark, sf_dir):
    """Business days that each key lacks up to the newest date."""
    b = bars(spark, sf_dir)
    target = b.agg(F.max("date")).first()[0]
    return quality.gap_backfill(b, F.lit(target).cast("date"), 25, by=("permno",))


@query(f"""WITH {BARS}, m AS (SELECT date, count(DISTINCT permno) AS expected FROM bars WHERE volume > 50 GROUP BY date), a AS (SELECT date, count(DISTINCT permno) AS actual FROM bars GROUP BY date)
     SELECT coalesce(a.date, m.date) AS date, coalesce(actual, 0) AS actual, expected, CASE WHEN coalesce(actual, 0) < 50 THEN 'critical' WHEN coalesce(actual, 0) < 100 THEN 'warning' ELSE 'info' END AS severity,
            coalesce(actual, 0) >= 50 AS passed FROM a FULL OUTER JOIN m ON m.date = a.date""")
def quality_completeness(spark, sf_dir):
    b = bars(spark, sf_dir)
    members = b.select("date", "permno", (F.col("volume") > 50).alias("active"))
    return quality.completeness(b, members, 50, 100)


@query(f"WITH {BARS} SELECT permno, max(date) AS latest, max(date) >= DATE '1998-11-01' AS fresh FROM bars GROUP BY permno")
def quality_freshness(spark, sf_dir):
    return quality.freshness(bars(spark, sf_dir), "1998-11-01", by=("permno",))


def _quantile_sql(p: str) -> str:
    """The normal quantile of p as ``inference.normal_quantile`` makes it."""

    def horner(x: str, coefficients) -> str:
        out = repr(coefficients[0])
        for c in coefficients[1:]:
            out = f"({out} * {x} + {c!r})"
        return out

    q, low = f"(({p}) - 0.5)", f"least(({p}), 1 - ({p}))"
    far, square = f"sqrt(-2 * ln({low}))", f"({q} * {q})"
    middle = f"{q} * {horner(square, inference._QUANTILE_MIDDLE[0])} / {horner(square, inference._QUANTILE_MIDDLE[1])}"
    tail = f"{horner(far, inference._QUANTILE_TAIL[0])} / {horner(far, inference._QUANTILE_TAIL[1])}"
    return f"CASE WHEN {low} >= 0.02425 THEN {middle} WHEN ({p}) < 0.5 THEN {tail} ELSE -({tail}) END"


def _cdf_sql(x: str) -> str:
    z = f"(abs({x}) / sqrt(2.0))"
    t = f"(1 / (1 + {z} / 2))"
    series = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    power = repr(series[-1])
    for c in series[-2::-1]:
        power = f"({power} * {t} + {c!r})"
    tail = f"({t} * exp(-{z} * {z} + {power}) / 2)"
    return f"CASE WHEN ({x}) >= 0 THEN 1 - {tail} ELSE {tail} END"


def _skill_sql(source: str, by: str, name: str = "skill") -> str:
    """Per-period Sharpe ratios of groups, and their probabilities against 0 and against the best of as many without skill."""
    n = "CAST(groups AS DOUBLE)"
    best = f"(1 - 0.5772156649015329) * ({_quantile_sql(f'1 - 1 / {n}')}) + 0.5772156649015329 * ({_quantile_sql(f'1 - 1 / ({n} * 2.718281828459045)')})"
    psr = lambda against: f"CASE WHEN n < 3 THEN 0.5 WHEN den <= 0 THEN 0.0 ELSE {_cdf_sql(f'((sharpe - {against}) * sqrt(n - 1) / sqrt(den))')} END"
    return f"""{name}_m AS (SELECT {by}, count(net) AS n, coalesce(CASE WHEN stddev_samp(net) > 0 THEN avg(net) / stddev_samp(net) END, 0) AS sharpe, coalesce(CASE WHEN count(net) > 2 THEN skewness(net) END, 0) AS sk,
                 coalesce(CASE WHEN count(net) > 3 THEN kurtosis(net) END, 0) AS ku FROM {source} WHERE net IS NOT NULL GROUP BY {by}),
     {name}_g AS (SELECT count(*) AS groups, var_samp(sharpe) AS v FROM {name}_m),
     {name}_s AS (SELECT m.*, CASE WHEN groups > 1 AND v > 0 THEN sqrt(v) * ({best}) ELSE 0 END AS star, 1 - sk * sharpe + (ku + 2) / 4 * sharpe * sharpe AS den FROM {name}_m m, {name}_g),
     {name} AS (SELECT {by}, n, sharpe, {psr('0')} AS psr, star, {psr('star')} AS dsr FROM {name}_s)"""


@query(f"""WITH {GRID}, rt AS (SELECT key, return AS net FROM grid), {_skill_sql('rt', 'key')} SELECT key, n, {r('sharpe')} AS sharpe, {r('psr', 5)} AS psr, {r('star')} AS star, {r('dsr', 5)} AS dsr FROM skill""")
def portfolio_deflated_sharpe(spark, sf_dir):
    """Each key's monthly returns as a strategy: the chance that its Sharpe ratio is more than the luck of the best."""
    out = inference.deflated_sharpe(grid(spark, sf_dir).select("key", "return"), "return", ("key",))
    return out.select("key", "n", rounded("sharpe").alias("sharpe"), rounded("psr", 5).alias("psr"), rounded("star").alias("star"), rounded("dsr", 5).alias("dsr"))


_SHELF = f"""{GRID}, sr AS (SELECT g.date, s.s_nationkey AS nation, g.key, g.return AS ret, g.volume FROM grid g JOIN supplier s ON s.s_suppkey = g.key),
     al AS (SELECT date, avg(ret) AS base FROM sr GROUP BY date),
     st AS (SELECT sr.date, nation, avg(ret) - 0.001 AS net, avg(CASE WHEN ret IS NULL THEN 1.0 ELSE 0.0 END) AS turnover FROM sr GROUP BY sr.date, nation),
     rs AS (SELECT st.*, base FROM st JOIN al ON al.date = st.date),
     sh AS (SELECT nation, key, sum(abs(ret)) AS c FROM sr GROUP BY nation, key), sx AS (SELECT nation, max(c / t) AS share FROM (SELECT *, sum(c) OVER (PARTITION BY nation) AS t FROM sh) GROUP BY nation)"""


def _annual_sql(x: str) -> str:
    return f"coalesce(CASE WHEN stddev_samp({x}) > 0 THEN avg({x}) / stddev_samp({x}) * sqrt(12.0) END, 0)"


@query(f"""WITH {_SHELF}, {_skill_sql('rs', 'nation')},
     nt AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY nation) AS n, exp(sum(ln(1 + net)) OVER (PARTITION BY nation ORDER BY date)) AS eq FROM rs WHERE net IS NOT NULL),
     dd AS (SELECT *, 1 - eq / max(eq) OVER (PARTITION BY nation ORDER BY date) AS fall, greatest(0, ceil(round(i * least(8, n) / CAST(greatest(n - 1, 1) AS DOUBLE), 9)) - 1) AS part FROM nt),
     up AS (SELECT nation, CAST(count(*) FILTER (WHERE s > 0) AS DOUBLE) AS up FROM (SELECT nation, part, {_annual_sql('net')} AS s FROM dd GROUP BY nation, part) GROUP BY nation),
     wh AS (SELECT nation, {_annual_sql('net')} AS sharpe, max(fall) AS fall FROM dd GROUP BY nation), rr AS (SELECT nation, avg(turnover) AS turnover, {_annual_sql('base')} AS base FROM rs GROUP BY nation),
     al2 AS (SELECT wh.*, dsr, up, turnover, rr.base, share FROM wh JOIN skill USING (nation) JOIN up USING (nation) JOIN rr USING (nation) LEFT JOIN sx USING (nation))
     SELECT nation, 'GATE-1' AS gate, {r('dsr', 5)} AS value, dsr > 0.95 AS passed FROM al2 UNION ALL SELECT nation, 'GATE-2', {r('up', 5)}, up >= 6 FROM al2 UNION ALL SELECT nation, 'GATE-3', {r('share', 5)}, coalesce(share <= 0.4, FALSE) FROM al2
     UNION ALL SELECT nation, 'GATE-4', {r('fall', 5)}, fall < 0.25 FROM al2 UNION ALL SELECT nation, 'GATE-5', {r('turnover', 5)}, turnover < 0.3 FROM al2 UNION ALL SELECT nation, 'GATE-6', NULL, FALSE FROM al2
     UNION ALL SELECT nation, 'GATE-7', {r('sharpe - base', 5)}, sharpe - base > 0 FROM al2 UNION ALL SELECT nation, 'GATE-8', {r('sharpe', 5)}, sharpe > 0.4 FROM al2""")
def portfolio_gates(spark, sf_dir):
    """The suppliers of each nation as a strategy, held against all gates at once."""
    nations = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation"))
    shelf = grid(spark, sf_dir).select("date", "key", F.col("return").alias("ret")).join(nations, "key")
    base = shelf.groupBy("date").agg(F.avg("ret").alias("base"))
    returns = shelf.groupBy("date", "nation").agg((F.avg("ret") - 0.001).alias("net"), F.avg(F.col("ret").isNull().cast("double")).alias("turnover")).join(base, "date")
    shares = shelf.groupBy("nation", F.col("key").alias("sector")).agg(F.sum(F.abs("ret")).alias("c"))
    shares = shares.withColumn("share", F.col("c") / F.sum("c").over(Window.partitionBy("nation")))
    out = gates.promotion_gates(returns, "nation", ("base",), shares, periods=12)
    return out.select("nation", "gate", rounded("value", 5).alias("value"), "passed")


_CHECKED = f"""{BARS}, j AS (SELECT *, lag(adj_close) OVER o AS p, adj_close / close AS q, lag(adj_close / close) OVER o AS pq, count(*) OVER (PARTITION BY permno, date) AS n FROM bars WINDOW o AS (PARTITION BY permno ORDER BY date)),
     g AS (SELECT permno, max(date) AS latest, count(DISTINCT CASE WHEN date = DATE '2001-11-01' THEN permno END) AS actual,
                  count(*) FILTER (WHERE date = DATE '2001-11-01' AND (high < low OR high < greatest(open, close) OR low > least(open, close) OR close <= 0 OR volume < 0)) AS invalid,
                  count(*) FILTER (WHERE date = DATE '2001-11-01' AND abs(adj_close / p - 1) > 0.5) AS outliers, count(*) FILTER (WHERE date = DATE '2001-11-01' AND n > 1) AS duplicates,
                  count(*) FILTER (WHERE date = DATE '2001-11-01' AND abs(q / pq - 1) > 0.01) AS jumps FROM j GROUP BY permno),
     gg AS (SELECT *, (SELECT count(*) FROM range(CAST(latest + 1 AS TIMESTAMP), CAST(DATE '2001-11-01' + 1 AS TIMESTAMP), INTERVAL 1 DAY) x(d) WHERE dayofweek(d) NOT IN (0, 6)) AS gap FROM g),
     ck AS (SELECT permno, 0 AS place, 'freshness' AS "check", latest >= DATE '2001-11-01' AS passed, '' AS severity FROM gg UNION ALL SELECT permno, 1, 'completeness', actual >= 1, '' FROM gg UNION ALL SELECT permno, 2, 'ohlc_validity', invalid = 0, '' FROM gg
            UNION ALL SELECT permno, 3, 'return_outliers', outliers = 0, '' FROM gg UNION ALL SELECT permno, 4, 'duplicates', duplicates = 0, '' FROM gg UNION ALL SELECT permno, 5, 'adjusted_consistency', jumps = 0, '' FROM gg
            UNION ALL SELECT permno, 6, 'gap_backfill', gap <= 1, CASE WHEN gap <= 1 THEN 'info' WHEN gap <= 25 THEN 'warning' ELSE 'critical' END FROM gg)"""


def _rolled(mode: str, condition: str) -> str:
    return f"""SELECT permno, '{mode}' AS mode, count(*) FILTER (WHERE {condition}) = 0 AS passed,
        'Failed checks: ' || string_agg("check", ', ' ORDER BY place) FILTER (WHERE {condition}) AS halt_reason FROM ck GROUP BY permno"""


@query(f"""WITH {_CHECKED} {_rolled('strict', 'NOT passed')} UNION ALL {_rolled('lenient', "NOT passed AND ('check' IN ('freshness') OR \"check\" IN ('freshness', 'completeness') OR (\"check\" = 'gap_backfill' AND severity = 'critical'))")}""")
def quality_roll_up(spark, sf_dir):
    """Whether a strict and a lenient load of one month would halt for each key, and why."""
    checks = quality.run_checks(bars(spark, sf_dir), "2001-11-01", 1, 2, 0.5, 25, by=("permno",))
    told = [quality.roll_up(checks, mode, ("permno",)).withColumn("mode", F.lit(mode)) for mode in ("strict", "lenient")]
    return told[0].unionByName(told[1]).select("permno", "mode", "passed", "halt_reason")


@query(f"""WITH {BARS}, b AS (SELECT permno, max(date) AS latest FROM bars WHERE volume > 50 GROUP BY permno),
     g AS (SELECT permno, latest, (SELECT count(*) FROM range(CAST(latest + 1 AS TIMESTAMP), CAST(DATE '2001-11-06' + 1 AS TIMESTAMP), INTERVAL 1 DAY) x(d) WHERE dayofweek(d) NOT IN (0, 6)) AS gap FROM b),
     d AS (SELECT permno, gap, CAST(unnest(range(CAST(latest + 1 AS TIMESTAMP), CAST(DATE '2001-11-06' AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM g WHERE gap <= 30 AND latest < DATE '2001-11-06'),
     f AS (SELECT permno, date, 'backfill' AS status FROM d WHERE dayofweek(date) NOT IN (0, 6) UNION ALL SELECT permno, DATE '2001-11-06', 'load' FROM g WHERE gap <= 30 AND latest < DATE '2001-11-06')
     SELECT permno, date, CAST(row_number() OVER (PARTITION BY permno ORDER BY date) - 1 AS INTEGER) AS place, status FROM f UNION ALL SELECT permno, DATE '2001-11-06', 0, 'halt' FROM g WHERE gap > 30""")
def quality_backfill_plan(spark, sf_dir):
    """The days that each key's months with real volume lack up to a date, to be loaded oldest first."""
    return quality.backfill_plan(bars(spark, sf_dir).where("volume > 50"), "2001-11-06", 30, by=("permno",))


@query("""WITH o AS (SELECT *, sha256('{"event_id":"' || event_id || '","event_type":"' || trim(event_type) || '"}') AS seal FROM events)
     SELECT 'columns' AS rule, 0 AS violations, TRUE AS passed UNION ALL SELECT 'no forbidden columns', 1, FALSE UNION ALL
     SELECT rule, CAST(n AS BIGINT), n = 0 FROM (SELECT unnest(['seal matches', 'seal unique', 'seal seals the row', 'event_type one of', 'event_id contiguous', 'props present if valued', 'free of paths', 'free of queries', 'row count']) AS rule,
       unnest([count(*) FILTER (WHERE NOT regexp_full_match(seal, '[0-9a-f]{64}')), count(*) - count(DISTINCT seal), 0, count(*) FILTER (WHERE event_type NOT IN ('click', 'view')),
               CASE WHEN min(event_id) = 0 AND max(event_id) = count(*) - 1 AND count(DISTINCT event_id) = count(*) THEN 0 ELSE 1 END, count(*) FILTER (WHERE (value > 50) <> (coalesce(props, '') <> '')),
               count(*) FILTER (WHERE starts_with(props, '/')), count(*) FILTER (WHERE contains(lower(props), 'select ')), abs(count(*) - 1000)]) AS n FROM o)""")
def quality_evidence(spark, sf_dir):
    """Sealed events against rules told as data: one scan, a row for each rule."""
    columns = ["event_id", "event_type"]
    df = row_digest(read(spark, sf_dir, "events"), columns, "seal")
    sealed = evidence.follows("seal", digest_of([F.trim(F.col(c).cast("string")).alias(c) for c in columns]), "seal")
    rules = [
        evidence.matches("seal"), evidence.unique("seal"), evidence.Rule("seal seals the row", sealed.violations), evidence.one_of("event_type", ("click", "view")), evidence.contiguous("event_id"),
        evidence.present_if("props", F.col("value") > 50, "valued"), evidence.free_of_paths(["props"]), evidence.free_of_queries(["props"]), evidence.rows(1000),
    ]
    return evidence.check(df, rules, df.columns, ["user_id", "o_totalprice"])
