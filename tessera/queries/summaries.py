"""Queries of reports: summaries of panels, sets and traces, signals of a day, files of formulas and run trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import rounded
from tessera.operators import panel, portfolio, quality, reference, runlog, scoring
from tessera.queries import portfolios, runlogs, scores
from tessera.queries.base import BARS, bars, query, r, read
from tessera.sources import tables
from tessera.sources.scratch import scratch

_MEMBERS = f"{BARS}, mem AS (SELECT date, permno FROM bars WHERE volume > 50)"


def _members(spark, sf_dir):
    """Months of real volume stand for memberships."""
    return bars(spark, sf_dir).where("volume > 50").select("date", "permno")


@query(f"""WITH {_MEMBERS}, b AS (SELECT *, 'S' || permno AS symbol FROM bars), f AS (SELECT b.* FROM b JOIN mem ON mem.date = b.date AND mem.permno = b.permno),
     dn AS (SELECT round(avg(n), 1) AS v FROM (SELECT count(DISTINCT permno) AS n FROM b GROUP BY date)), mn AS (SELECT round(avg(n), 1) AS v FROM (SELECT count(DISTINCT permno) AS n FROM mem GROUP BY date))
     SELECT 'panel_rows' AS metric, CAST(count(*) AS VARCHAR) AS value FROM b UNION ALL SELECT 'panel_permnos', CAST(count(DISTINCT permno) AS VARCHAR) FROM b UNION ALL SELECT 'panel_ticker_symbols', CAST(count(DISTINCT symbol) AS VARCHAR) FROM b
     UNION ALL SELECT 'panel_trading_days', CAST(count(DISTINCT date) AS VARCHAR) FROM b UNION ALL SELECT 'panel_first_date', CAST(min(date) AS VARCHAR) FROM b UNION ALL SELECT 'panel_last_date', CAST(max(date) AS VARCHAR) FROM b
     UNION ALL SELECT 'panel_mean_names_per_date', CAST(v AS VARCHAR) FROM dn UNION ALL SELECT 'member_mean_names_per_date', CAST(v AS VARCHAR) FROM mn UNION ALL SELECT 'member_filtered_rows', CAST(count(*) AS VARCHAR) FROM f
     UNION ALL SELECT 'member_filtered_permnos', CAST(count(DISTINCT permno) AS VARCHAR) FROM f UNION ALL SELECT 'rows_with_split_adjustment', CAST(count(*) FILTER (WHERE adj_close <> close) AS VARCHAR) FROM b""")
def quality_panel_summary(spark, sf_dir):
    """The eleven rows of the panel's report."""
    b = bars(spark, sf_dir).withColumn("symbol", F.concat(F.lit("S"), F.col("permno").cast("string")))
    return quality.panel_summary(b, _members(spark, sf_dir))


@query(f"""WITH {_MEMBERS}, hv AS (SELECT date, permno FROM bars WHERE open > 10), cv AS (SELECT mem.date, count(*) AS n, count(hv.permno) AS c FROM mem LEFT JOIN hv ON hv.date = mem.date AND hv.permno = mem.permno GROUP BY mem.date),
     fm AS (SELECT permno FROM mem GROUP BY permno HAVING max(date) < (SELECT max(date) FROM mem)), kn AS (SELECT fm.permno, fm.permno IN (SELECT permno FROM hv) AS bar FROM fm)
     SELECT CAST(sum(n) AS BIGINT) AS member_days_total, CAST(sum(c) AS BIGINT) AS member_days_covered, {r('CAST(sum(c) AS DOUBLE) / sum(n)')} AS coverage_pct, {r('min(CAST(c AS DOUBLE) / n)')} AS daily_min,
            {r('quantile_cont(CAST(c AS DOUBLE) / n, 0.5)')} AS daily_median, {r('max(CAST(c AS DOUBLE) / n)')} AS daily_max, min(date) AS date_min, max(date) AS date_max, (SELECT count(*) FROM kn) AS former_members,
            (SELECT count(*) FILTER (WHERE bar) FROM kn) AS former_with_bars, (SELECT string_agg(permno, ',' ORDER BY permno) FROM (SELECT permno FROM kn WHERE bar ORDER BY permno LIMIT 50)) AS former_sample FROM cv""")
def quality_coverage_summary(spark, sf_dir):
    """How well members are covered by bars with a real price, and former members among them."""
    out = quality.coverage_summary(_members(spark, sf_dir), bars(spark, sf_dir).where("open > 10"))
    out = out.withColumns({c: rounded(c) for c in ("coverage_pct", "daily_min", "daily_median", "daily_max")})
    return out.withColumn("former_sample", F.nullif(F.array_join(F.transform("former_sample", lambda x: x.cast("string")), ","), F.lit("")))


@query(f"WITH {_MEMBERS}, n AS (SELECT date, count(DISTINCT permno) AS n FROM mem GROUP BY date) SELECT date, n FROM n WHERE n < 94 OR n > 98")
def quality_count_violations(spark, sf_dir):
    """Dates with too few or too many members."""
    return quality.count_violations(_members(spark, sf_dir), 94, 98)


@query("""SELECT DISTINCT coalesce(n.new, u.symbol) AS symbol FROM (SELECT s_name AS symbol FROM supplier WHERE s_acctbal > 0) u LEFT JOIN (SELECT s_name AS old, 'NATION' || s_nationkey AS new FROM supplier WHERE s_acctbal > 5000) n ON n.old = u.symbol
     UNION ALL SELECT DISTINCT 'S' || l_suppkey FROM lineitem WHERE l_shipdate >= DATE '1998-01-05' AND l_shipdate < DATE '1998-01-10' AND l_discount > 0.05""")
def panel_members_of(spark, sf_dir):
    """Members of an undated file under their new names, and those of a range of dates."""
    supplier = read(spark, sf_dir, "supplier")
    names = supplier.where("s_acctbal > 5000").select(F.col("s_name").alias("old"), F.concat(F.lit("NATION"), F.col("s_nationkey").cast("string")).alias("new"))
    undated = panel.members_of(supplier.where("s_acctbal > 0").select(F.col("s_name").alias("symbol")), "1998-01-05", remap=names)
    lines = read(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("date"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"), (F.col("l_discount") > 0.05).alias("active"))
    return undated.unionByName(panel.members_of(lines, "1998-01-05", "1998-01-09"))


@query(f"""WITH {scores._IC}, p AS (SELECT *, row_number() OVER (PARTITION BY signal, date_trunc('quarter', date) ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY signal, date_trunc('quarter', date)) AS m FROM ic),
     q AS (SELECT signal, ic, 'first' AS sample FROM p WHERE i = 0 UNION ALL SELECT signal, ic, 'mid' FROM p WHERE i = m // 2 UNION ALL SELECT signal, ic, 'last' FROM p WHERE i = m - 1)
     SELECT signal, sample, {r('avg(ic)')} AS mean_ic, {r('stddev_samp(ic)')} AS std_ic, {r('avg(ic) / stddev_samp(ic) * sqrt(count(ic))', 5)} AS t_ic, count(*) AS n_days FROM q GROUP BY signal, sample""")
def score_quarter_samples(spark, sf_dir):
    """Correlations at the first, middle and last observation of each quarter."""
    rows = panel.quarter_samples(scores.ic(spark, sf_dir).select("date", "signal", "ic"), "signal")
    out = scoring.ic_summary(rows, ("signal", "sample"))
    return out.select("signal", "sample", rounded("mean_ic").alias("mean_ic"), rounded("std_ic").alias("std_ic"), rounded("t_ic", 5).alias("t_ic"), "n_days")


@query(f"""WITH s AS (SELECT p_brand, p_size - 25.0 AS t, CAST(p_retailprice AS DOUBLE) - 1200 AS fit, p_size * 10.0 - 240 AS later FROM part)
     SELECT p_brand, count(*) AS n, max(abs(t)) AS best_t, {r('quantile_cont(CASE WHEN fit <> 0 THEN later / fit END, 0.5)', 4)} AS median_retention,
            {r('avg(CASE WHEN fit <> 0 THEN CASE WHEN later / fit > 0 THEN 1.0 ELSE 0.0 END END)')} AS sign_held FROM s GROUP BY p_brand""")
def report_set_summary(spark, sf_dir):
    """Each brand as a set of factors: its best t, its retention, and how often the sign holds."""
    part = read(spark, sf_dir, "part").select("p_brand", (F.col("p_size") - 25.0).alias("t"), (F.col("p_retailprice").cast("double") - 1200).alias("fit_ic"), (F.col("p_size") * 10.0 - 240).alias("hold_ic"))
    out = reference.set_summary(part, "p_brand")
    return out.select("p_brand", "n", "best_t", rounded("median_retention", 4).alias("median_retention"), rounded("sign_held").alias("sign_held"))


@query("""WITH t AS (SELECT user_id % 50 AS expression_id, event_type AS verdict, CAST(ts AS DATE) AS run FROM events)
     SELECT run, verdict, count(*) AS n FROM t GROUP BY run, verdict UNION ALL SELECT run, 'distinct_expressions', count(DISTINCT expression_id) FROM t GROUP BY run""")
def report_trace(spark, sf_dir):
    """Verdicts of every day's hypotheses, and how many different ones there were."""
    trace = read(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("expression_id"), F.col("event_type").alias("verdict"), F.to_date("ts").alias("run"))
    return reference.trace_summary(trace, ("run",))


@query(f"""WITH {runlogs._CAND}, {runlogs._held()}, t AS (SELECT run, id, niche, round, row_number() OVER (PARTITION BY run ORDER BY fitness DESC, seq) AS place FROM held WHERE operator <> 'seed')
     SELECT run, id, place, (CASE WHEN count(*) OVER (PARTITION BY run, niche) < 3 THEN CAST(2.0 AS DOUBLE) ELSE 1.0 END) * (CASE WHEN 7 - round > 3 THEN CAST(0.5 AS DOUBLE) ELSE 1.0 END) AS weight FROM t WHERE place <= 30""")
def runlog_selection(spark, sf_dir):
    """The thirty fittest found members of each run, and how likely each is drawn as a parent."""
    best = runlog.top(runlog.archive(runlogs.log(spark, sf_dir)), 30, seeds=False)
    return runlog.selection_weights(best, 7).select("run", "id", "place", "weight")


@query(f"""WITH {portfolios._TOP}, d AS (SELECT max(date) AS date FROM wts WHERE date <= DATE '1999-06-15'), b AS (SELECT max(date) AS date FROM wts WHERE date < (SELECT date FROM d)),
     n AS (SELECT permno, weight AS w1 FROM wts WHERE date = (SELECT date FROM d)), o AS (SELECT permno, weight AS w0 FROM wts WHERE date = (SELECT date FROM b)),
     u AS (SELECT coalesce(n.permno, o.permno) AS permno, coalesce(w1, 0) AS w1, coalesce(w0, 0) AS w0 FROM n FULL OUTER JOIN o ON o.permno = n.permno),
     t AS (SELECT *, sum(abs(w1 - w0)) OVER () / 2 AS turn FROM u), s AS (SELECT permno, CASE WHEN turn > 0.3 THEN least(greatest(w0 + 0.3 / turn * (w1 - w0), 0), 1) ELSE w1 END AS weight FROM t)
     SELECT permno, {r('CASE WHEN (SELECT turn > 0.3 FROM t LIMIT 1) AND sum(weight) OVER () > 1 THEN weight / sum(weight) OVER () ELSE weight END')} AS weight FROM s WHERE weight > 1e-8""")
def portfolio_signals_asof(spark, sf_dir):
    """The weights of the last snapshot before a day, blended from those of the snapshot before it."""
    w = portfolios.weights(spark, sf_dir).withColumnRenamed("permno", "key")
    new, old = portfolio.signals_asof(w, "1999-06-15", "date")
    out = portfolio.cap_turnover(old, new, 0.3)
    return out.select(F.col("key").alias("permno"), rounded("weight").alias("weight"))


@query("""SELECT CASE WHEN p_brand IN (SELECT DISTINCT p_brand FROM part WHERE p_size > 40) THEN 'large' ELSE 'all' END AS set, CASE WHEN p_brand IN (SELECT DISTINCT p_brand FROM part WHERE p_size > 40) THEN 'a' ELSE 'b' END AS "group", p_brand AS expression
     FROM (SELECT DISTINCT p_brand FROM part)""")
def source_formula_sets(spark, sf_dir):
    """Two files of expressions with comments, as one pool whose first source wins."""
    part = read(spark, sf_dir, "part")
    paths = []
    for name, rows in (("large", part.where("p_size > 40")), ("all", part)):
        paths.append(scratch(spark, f"formulas-{name}"))
        lines = rows.select(F.col("p_brand").alias("value")).distinct()
        lines.union(lines.select(F.concat(F.lit("# "), "value"))).union(lines.limit(1).select(F.lit("  "))).write.text(paths[-1])
    return tables.formula_sets(spark, [("large", "a", paths[0]), ("all", "b", paths[1])]).select("set", "group", "expression")


@query("""SELECT CAST(month(ts) AS INTEGER) AS round, CAST(user_id % 3 AS INTEGER) AS island, event_type AS operator, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY ALL""")
def source_jsonl_tree(spark, sf_dir):
    """Replies written under folders of round, island and operator, read back with keys from their paths."""
    root = scratch(spark, "replies")
    rows = read(spark, sf_dir, "events").select("event_id", F.month("ts").alias("r"), (F.col("user_id") % 3).alias("i"), F.col("event_type").alias("o"))
    rows = rows.withColumns({"a": F.concat(F.lit("round_"), "r"), "b": F.concat(F.lit("island_"), "i")})
    for a, b, o in [tuple(x) for x in rows.select("a", "b", "o").distinct().collect()]:  # folders of a run: rounds x islands x operators
        rows.where((F.col("a") == a) & (F.col("b") == b) & (F.col("o") == o)).select("event_id").write.json(f"{root}/{a}/{b}/{o}")
    back = tables.read_jsonl_tree(spark, root, "event_id long")
    return back.groupBy("round", "island", "operator").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query(f"""WITH {BARS} SELECT date, upper(trim(' s' || permno || ' ')) AS symbol, close FROM bars WHERE close IS NOT NULL""")
def panel_normalise(spark, sf_dir):
    """Bars that come as text, cast and tidied; what isn't a number is missing."""
    b = bars(spark, sf_dir).select(F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date"), F.concat(F.lit(" s"), F.col("permno").cast("string"), F.lit(" ")).alias("symbol"), F.col("close").cast("string").alias("close"))
    dirty = b.unionByName(b.withColumn("close", F.lit("n/a")))
    return panel.normalise(dirty).where("close is not null").select("date", "symbol", "close")


@query("WITH s AS (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY s_nationkey) SELECT s_nationkey, n FROM s")
def source_saved_table(spark, sf_dir):
    """A table that parquet can't hold goes to CSV and comes back."""
    made = read(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n")).withColumn("span", F.expr("make_interval(0, 0, 0, 1)"))
    path = tables.save_table(made, scratch(spark, "saved") + ".parquet")
    return spark.read.csv(path, header=True, schema="s_nationkey long, n long, span string").select("s_nationkey", "n") if path.endswith(".csv") else spark.read.parquet(path).select("s_nationkey", "n")


