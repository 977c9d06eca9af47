"""Sources and sinks, streaming, structure and search as queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import rounded
from tessera.operators import inference, scoring
from tessera.plans.compile import evaluate
from tessera.plans.formula import canonical, normalised_distance, parse, size, subtree_sizes
from tessera.queries.base import BARS, bars, grid, query, r, read
from tessera.queries.formulas import POOL
from tessera.queries.scores import LAG, MINIMUM, _curve, _curve_sql
from tessera.search.evolve import PRICE, TURNOVER_CUT, Replayed, Search, round_rng, sample
from tessera.sources import tables
from tessera.sources.scratch import scratch
from tessera.streaming import bars as streams


def _events(spark, sf_dir):
    schema = read(spark, sf_dir, "events").schema
    return streams.ticks(spark, sf_dir, schema, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query(f"""SELECT CAST(ts AS DATE) AS date, user_id, min_by(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, max_by(value, (ts, event_id)) AS close,
       {r('sum(value)', 4)} AS volume, count(*) AS n FROM events GROUP BY CAST(ts AS DATE), user_id""")
def stream_daily_bars(spark, sf_dir):
    """Daily bars from ticks by a tumbling window."""
    out = streams.drain(streams.tick_bars(_events(spark, sf_dir)), scratch(spark, "daily-bars"))
    return out.select("date", "user_id", "open", "high", "low", "close", rounded("volume", 4).alias("volume"), "n")


@query(f"""WITH o AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events),
     s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
     SELECT user_id, count(*) AS n, {r('sum(value)', 4)} AS volume FROM s GROUP BY user_id, k""")
def stream_sessions(spark, sf_dir):
    """Session windows of each user."""
    out = streams.drain(streams.sessions(_events(spark, sf_dir), gap="12 hours"), scratch(spark, "sessions"), "complete")
    return out.select("user_id", "n", rounded("volume", 4).alias("volume"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_first_only(spark, sf_dir):
    """Keys seen, each once, without keeping more state than the watermark needs."""
    stream = streams.first_only(_events(spark, sf_dir).withColumn("day", F.to_date("ts")), ["user_id", "event_type"], "3650 days")
    return streams.drain(stream, scratch(spark, "first"), "append").select("user_id", "event_type")


@query("""WITH e AS (SELECT CAST(user_id % 10 AS VARCHAR) AS account, ts, 1000.0 + value AS equity, event_id FROM events),
     m AS (SELECT *, max(equity) OVER (PARTITION BY account ORDER BY ts ROWS UNBOUNDED PRECEDING) AS peak, CAST(ts AS DATE) AS day FROM e),
     d AS (SELECT account, day, last(equity ORDER BY ts) AS last FROM m GROUP BY account, day), c AS (SELECT account, day, lag(last) OVER (PARTITION BY account ORDER BY day) AS close FROM d),
     k AS (SELECT m.account, ts, equity / peak - 1 AS drawdown, coalesce(equity / close - 1, 0) AS day_loss FROM m JOIN c ON c.account = m.account AND c.day = m.day)
     SELECT account, ts, CASE WHEN drawdown <= -0.05 THEN 'drawdown' ELSE 'daily loss' END AS reason, drawdown, day_loss FROM k WHERE drawdown <= -0.05 OR day_loss <= -0.04""")
def stream_monitor(spark, sf_dir):
    """Stateful kill switch over equity marks; tests hold it against a plain loop."""
    marks = _events(spark, sf_dir).select((F.col("user_id") % 10).cast("string").alias("account"), "ts", (F.lit(1000.0) + F.col("value")).alias("equity"))
    return streams.drain(streams.monitor(marks, 0.05, 0.04), scratch(spark, "monitor"), "append")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 0")
def source_parquet_pruned(spark, sf_dir):
    """Columns and filter reach the scan."""
    return read(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey", "c_name", "c_acctbal")


@query("SELECT n_nationkey, n_name FROM nation")
def source_csv_round_trip(spark, sf_dir):
    path = scratch(spark, "nation") + ".csv"
    read(spark, sf_dir, "nation").select("n_nationkey", "n_name").write.csv(path, header=True)
    kinds = dict(read(spark, sf_dir, "nation").dtypes)
    return tables.load_table(spark, path, f"n_nationkey {kinds['n_nationkey']}, n_name string")


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT r_regionkey + 100, r_name FROM region")
def source_jsonl_append(spark, sf_dir):
    """Appended JSON lines read back with a schema."""
    path = scratch(spark, "region") + ".jsonl"
    region = read(spark, sf_dir, "region").select("r_regionkey", "r_name")
    tables.append_jsonl(region, path)
    tables.append_jsonl(region.withColumn("r_regionkey", (F.col("r_regionkey") + 100).cast(region.schema["r_regionkey"].dataType)), path)
    return tables.load_table(spark, path, region.schema)


@query(f"WITH {_curve_sql()} SELECT signal, {r('mean_ic')} AS mean_ic, n_days FROM curve WHERE horizon = 3")
def source_ic_directory(spark, sf_dir):
    """Correlations saved by kind and horizon; one folder read back."""
    path = scratch(spark, "ic")
    tables.save_ic(_curve(spark, sf_dir).withColumn("kind", F.lit("cumulative")), path)
    return tables.load_ic(spark, path, "cumulative", 3).select("signal", rounded("mean_ic").alias("mean_ic"), "n_days")


@query("""SELECT s_suppkey, sha256('{"s_suppkey":"' || s_suppkey || '","s_name":"' || trim(s_name) || '"}') AS digest FROM supplier""")
def source_row_digest(spark, sf_dir):
    return tables.row_digest(read(spark, sf_dir, "supplier"), ["s_suppkey", "s_name"]).select("s_suppkey", "digest")


@query("""SELECT o_orderkey FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders WHERE o_orderdate < DATE '1997-01-01')""")
def source_latest_slice(spark, sf_dir):
    return tables.latest_slice(read(spark, sf_dir, "orders"), "o_orderdate", "1997-01-01").select("o_orderkey")


@query("""WITH d AS (SELECT l_suppkey AS permno, l_shipdate AS date, l_orderkey FROM lineitem)
     SELECT permno, CAST(date AS DATE) AS date, l_orderkey, CASE WHEN date < DATE '1996-07-01' THEN 'OLD' || permno ELSE 'NEW' || permno END AS ticker FROM d""")
def source_history(spark, sf_dir):
    """Daily rows of all keys with the name valid that day, through Spark SQL."""
    read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("permno"), F.col("l_shipdate").cast("date").alias("date"), "l_orderkey").createOrReplaceTempView("tessera_daily")
    names = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("permno"))
    old = names.select("permno", F.concat(F.lit("OLD"), "permno").alias("ticker"), F.lit("1900-01-01").cast("date").alias("begin_date"), F.lit("1996-06-30").cast("date").alias("end_date"))
    new = names.select("permno", F.concat(F.lit("NEW"), "permno").alias("ticker"), F.lit("1996-07-01").cast("date").alias("begin_date"), F.lit(None).cast("date").alias("end_date"))
    old.union(new).createOrReplaceTempView("tessera_names")
    daily = tables.resolve_table(spark, ["tessera_missing", "tessera_daily"])
    return tables.history(spark, daily, "tessera_names", None, "1900-01-01", "9999-12-31")


@query()
def structure_nearest(spark, sf_dir):
    """Nearest published formula of each candidate by tree edit distance; pairs are scored in Arrow batches."""
    published = spark.createDataFrame([(i, t) for i, t in enumerate(POOL)], "published int, text string")
    rng = round_rng(7)
    made = [(i, _text(sample(rng))) for i in range(40)]
    candidates = spark.createDataFrame(made, "candidate int, formula string")

    @F.pandas_udf("double")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([normalised_distance(parse(x), parse(y)) for x, y in zip(a, b, strict=True)])

    # forty candidates against twenty formulas, whatever the data
    pairs = candidates.crossJoin(F.broadcast(published)).withColumn("distance", distance("formula", "text"))
    near = pairs.groupBy("candidate").agg(F.min(F.struct("distance", "published")).alias("m"))
    return near.select("candidate", rounded("m.distance").alias("distance"), F.col("m.published").alias("published"))


def _text(node):
    from tessera.plans.formula import render

    text = render(canonical(node))
    try:
        parse(text)
    except ValueError:
        return "$close"
    return text


@query()
def structure_subtrees(spark, sf_dir):
    """Formulas of the pool that share each subtree."""
    rows = [(i, k, n) for i, t in enumerate(POOL) for k, n in subtree_sizes(parse(t)).items()]
    out = spark.createDataFrame(rows, "formula int, subtree string, size int").groupBy("subtree", "size").agg(F.countDistinct("formula").alias("formulas"))
    return out.where("formulas > 1").orderBy(F.desc("formulas"), F.desc("size"), "subtree").limit(12)


def scorer(spark, sf_dir):
    """Scores a list of formulas in one plan: t by bootstrap, stability by year, turnover and half-life make fitness and niche."""
    from tessera.operators import candidates, gram, panel
    from tessera.queries.scores import BLOCK, HORIZONS, _starts

    labels = [f"fwd_{h}" for h in HORIZONS]
    fields = grid(spark, sf_dir).select("key", "date", *[f[1:] for f in PRICE]).persist()  # every round reads it
    years = fields.select(F.year("date").alias("year")).distinct()

    def score(texts: list[str]) -> dict:
        named = {f"c{i}": t for i, t in enumerate(texts)}
        wide = evaluate(fields, named, series=panel.forward_columns(HORIZONS), needs=["open"], by_date=True).persist()  # dealt out by date once for all that ranks
        daily = gram.rank_ic(wide, list(named), labels, MINIMUM, dealt=True).withColumn("horizon", F.regexp_extract("label", r"(\d+)$", 1).cast("int")).persist()
        one = daily.where("horizon = 1")
        days = one.select("date").distinct().withColumn("pos", F.row_number().over(Window.orderBy("date")) - 1)  # the calendar
        starts, n = _starts(days)
        series = one.join(days, "date").select("signal", "pos", F.col("ic").alias("value"))
        errors = inference.bootstrap_errors(inference.bootstrap_means(series, starts.where("draw < 200"), BLOCK, n))
        long = scoring.melt(wide, named, ("date", "key", "fwd_1")).withColumn("available", F.col("fwd_1").isNotNull())
        coverage = scoring.universe_coverage(long, "available").withColumnRenamed("universe_coverage", "coverage")
        rows = candidates.metrics(daily, errors, gram.turnover(wide, list(named), dealt=True), coverage, candidates.forms(spark, named), years, TURNOVER_CUT).collect()  # one row for each formula
        for held in (wide, daily):
            held.unpersist()
        out = {}
        for m in rows:
            if m.n_days >= 24 and (m.coverage or 0.0) >= 0.5:
                told = {"ic": round(m.mean_ic, 6), "n": m.n_days, "turnover": round(m.turnover or 0.0, 6), "stability": round(m.stability, 6)}
                out[named[m.signal]] = (round(m.fitness, 6), told | ({"half_life": round(m.half_life, 4)} if m.half_life is not None else {}))
        return out

    return score


@query()
def search_rounds(spark, sf_dir):
    """Three rounds of the evolutionary search, broken off after the second and resumed from its log of scores."""
    path, score = scratch(spark, "search"), scorer(spark, sf_dir)
    write = lambda lines: spark.createDataFrame([(x,) for x in lines], "value string").write.mode("append").text(path)
    Search(Replayed(score, write=write), seed=11).run(2)
    log = [r.value for r in spark.read.text(path).collect()]  # the search's own scores: some dozen lines a round
    search = Search(Replayed(score, log, write), seed=11)
    search.run(3)
    rows = [(c.expression, c.fitness, size(c.node), "/".join(c.niche)) for c in search.archive.all()]
    return spark.createDataFrame(rows, "expression string, fitness double, size int, niche string")


@query("SELECT l_suppkey AS permno, count(*) AS rows FROM lineitem GROUP BY l_suppkey HAVING count(*) >= 5")
def source_key_counts(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("permno")).agg(F.count("*").alias("rows")).where("rows >= 5")


@query(f"""WITH {BARS} SELECT date, permno, {r("CASE WHEN date >= DATE '1996-06-01' THEN close + 1 ELSE close END")} AS close, CASE WHEN date >= DATE '1996-06-01' THEN 2 ELSE 1 END AS seen FROM bars""")
def ingest_keep_last(spark, sf_dir):
    """Two overlapping batches of bars merged by date folders; later rows win."""
    path = scratch(spark, "ingest")
    b = bars(spark, sf_dir).select("date", "permno", "close")
    first = b.where("date < DATE '1996-07-01'").withColumn("seen", F.lit(1))
    second = b.where("date >= DATE '1996-06-01'").withColumns({"seen": F.lit(2), "close": F.col("close") + 1})
    for batch in (first, second):
        streams.merge_daily(spark, batch, path, ["date", "permno"], "seen")
    return spark.read.parquet(path).select("date", "permno", rounded("close").alias("close"), "seen")
