"""Queries over search logs.  Orders stand for proposals: a priority is a run, a year a round, dates give the niche."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import rounded
from tessera.operators import runlog
from tessera.queries.base import query, r, read
from tessera.sources.scratch import scratch

_CAND = """
prop AS (SELECT o_orderpriority AS run, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) * 100000000000 + o_orderkey AS seq, 'o' || o_orderkey AS id,
                (CASE month(o_orderdate) % 3 WHEN 0 THEN 'fast' WHEN 1 THEN 'medium' ELSE 'slow' END) || '/' || (CASE day(o_orderdate) % 3 WHEN 0 THEN 'price_volume' WHEN 1 THEN 'fundamental' ELSE 'mixed' END)
                  || '/' || (CASE WHEN day(o_orderdate) < 16 THEN 'low' ELSE 'high' END) AS niche,
                CAST(o_totalprice AS DOUBLE) / 1000 AS fitness, year(o_orderdate) - 1991 AS round, CASE WHEN o_orderstatus = 'F' AND year(o_orderdate) = 1995 THEN 'seed' ELSE 'mutate' END AS operator,
                CASE WHEN o_orderstatus = 'P' THEN 'coverage' WHEN o_totalprice < 50000 THEN 'cheap_screen' END AS gate, o_custkey, o_orderstatus FROM orders),
cand AS (SELECT * FROM prop WHERE gate IS NULL)"""

_ADMITTED = f"""{_CAND},
prs AS (SELECT e.run, e.niche, e.seq, x.seq AS before, x.id AS other, x.fitness AS f, row_number() OVER (PARTITION BY e.run, e.seq ORDER BY x.fitness DESC, x.seq) AS k, x.fitness >= e.fitness AS holds
        FROM cand e JOIN cand x ON x.run = e.run AND x.niche = e.niche AND x.seq < e.seq),
cnt AS (SELECT run, seq, count(*) FILTER (WHERE holds) AS n, max(CASE WHEN k = 8 THEN other END) AS weakest FROM prs GROUP BY run, seq),
adm AS (SELECT cand.*, weakest AS evicted FROM cand LEFT JOIN cnt ON cnt.run = cand.run AND cnt.seq = cand.seq WHERE coalesce(n, 0) < 8)"""


def _held(condition: str = "TRUE", name: str = "held") -> str:
    """SQL of an archive as the best eight of each niche, which is what the fold of admissions comes to."""
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run, niche ORDER BY fitness DESC, seq) AS place FROM cand WHERE {condition}) WHERE place <= 8)"


def proposals(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    pick = lambda of, *names: F.element_at(F.array(*map(F.lit, names)), (of % 3 + 1).cast("int"))
    niche = F.array(
        pick(F.month(day), "fast", "medium", "slow"), pick(F.dayofmonth(day), "price_volume", "fundamental", "mixed"), F.when(F.dayofmonth(day) < 16, "low").otherwise("high")
    )
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("run"), (F.datediff(day, F.lit("1992-01-01").cast("date")) * F.lit(100_000_000_000) + F.col("o_orderkey")).alias("seq"),
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), niche.alias("niche"), (F.col("o_totalprice").cast("double") / 1000).alias("fitness"),
        (F.year(day) - 1991).alias("round"), F.when((F.col("o_orderstatus") == "F") & (F.year(day) == 1995), runlog.SEED).otherwise("mutate").alias("operator"),
        F.when(F.col("o_orderstatus") == "P", "coverage").when(F.col("o_totalprice") < 50_000, "cheap_screen").alias("gate"), "o_custkey", "o_orderstatus",
    )


def candidates(spark, sf_dir):
    return proposals(spark, sf_dir).where("gate is null").drop("gate")


def log(spark, sf_dir):
    """Admissions written as JSON lines by Spark and read back."""
    out = runlog.admissions(candidates(spark, sf_dir))
    complexity = F.struct(F.lit(2).alias("base_fields"), F.lit(0).alias("free_constants"), F.col("round").alias("depth"), F.length("id").alias("symbol_length"))
    metrics = F.struct(
        (F.col("fitness") / 1e4).alias("mean_ic"), F.col("fitness").alias("tstat"), F.when(F.col("round") > 2, F.col("fitness")).alias("icir"), F.lit(1.0).alias("coverage"), F.lit(0.25).alias("turnover"),
        (F.col("round") * 3.0).alias("half_life"), (F.col("round") == 7).alias("half_life_is_beyond_grid"), F.lit(1.0).alias("stability"), F.lit(1).alias("sign"), complexity.alias("complexity"),
    )
    path = scratch(spark, "runlog")
    out.select(
        F.lit("admit").alias("event"), "run", F.col("seq").alias("admitted_at"), "evicted", "id", F.concat(F.lit("RANK($"), "id", F.lit(")")).alias("expression"), "fitness", "niche", "round",
        F.col("o_custkey").cast("string").alias("island"), "operator", F.array(F.col("o_custkey").cast("string"), F.col("o_orderstatus")).alias("parent_ids"),
        F.lit("").alias("rationale"), metrics.alias("metrics"),
    ).write.json(path)
    return runlog.read_admissions(spark, path)


@query(f"WITH {_ADMITTED} SELECT run, id, niche, round, evicted FROM adm")
def runlog_admissions(spark, sf_dir):
    """Every admission with the member that made way for it."""
    out = runlog.admissions(candidates(spark, sf_dir))
    return out.select("run", "id", F.array_join("niche", "/").alias("niche"), "round", "evicted")


@query(f"WITH {_CAND}, {_held('round <= 4')} SELECT run, id, niche, {r('fitness')} AS fitness FROM held")
def runlog_archive(spark, sf_dir):
    """The archive after the fourth round, from the log of admissions."""
    return runlog.archive(log(spark, sf_dir), 4).select("run", "id", F.array_join("niche", "/").alias("niche"), rounded("fitness").alias("fitness"))


@query(f"""WITH {_CAND}, rd AS (SELECT DISTINCT run, round FROM cand),
     pl AS (SELECT rd.run, rd.round, niche, fitness, row_number() OVER (PARTITION BY rd.run, rd.round, niche ORDER BY fitness DESC, seq) AS place FROM rd JOIN cand ON cand.run = rd.run AND cand.round <= rd.round)
     SELECT run, round, count(*) AS archive_size, count(DISTINCT niche) AS niches_filled, {r('max(fitness)')} AS best_fitness FROM pl WHERE place <= 8 GROUP BY run, round""")
def runlog_by_round(spark, sf_dir):
    """What each round left behind."""
    out = runlog.by_round(log(spark, sf_dir), candidates(spark, sf_dir).select("run", "round"))
    return out.select("run", "round", "archive_size", "niches_filled", rounded("best_fitness").alias("best_fitness"))


def _resumed(spark, sf_dir):
    """The archive of a run that was lost after its second round and went on from its log."""
    rows = candidates(spark, sf_dir)
    first = runlog.admissions(rows.where("round <= 2")).withColumn("admitted_at", F.col("seq"))
    state = runlog.archive(first)
    rest = runlog.resume(state, rows.where("round > 2")).withColumn("admitted_at", F.col("seq"))
    return runlog.archive(first.unionByName(rest))


@query(f"WITH {_CAND}, {_held()} SELECT run, id, niche, {r('fitness')} AS fitness FROM held")
def runlog_resume(spark, sf_dir):
    """A run resumed after its second round ends with the archive of the unbroken run."""
    return _resumed(spark, sf_dir).select("run", "id", F.array_join("niche", "/").alias("niche"), rounded("fitness").alias("fitness"))


@query(f"""WITH {_CAND}, {_held()}, {_held('round <= 4', 'early')}, ln AS (SELECT run, count(*) AS lines FROM held GROUP BY run),
     a AS (SELECT run, id, row_number() OVER (PARTITION BY run ORDER BY seq) AS place FROM held), b AS (SELECT run, id, row_number() OVER (PARTITION BY run ORDER BY seq) AS place FROM early),
     df AS (SELECT coalesce(a.run, b.run) AS run, count(*) FILTER (WHERE a.id IS DISTINCT FROM b.id) AS n FROM a FULL OUTER JOIN b ON a.run = b.run AND a.place = b.place GROUP BY coalesce(a.run, b.run))
     SELECT ln.run, lines, 0 AS resumed_differs, df.n AS earlier_differs FROM ln JOIN df ON df.run = ln.run""")
def runlog_verify(spark, sf_dir):
    """Snapshots line by line: the resumed run against the unbroken one, and that against its own fourth round."""
    whole = runlog.admissions(candidates(spark, sf_dir)).withColumn("admitted_at", F.col("seq"))
    end, early = runlog.snapshot(runlog.archive(whole)), runlog.snapshot(runlog.archive(whole, 4))
    count = lambda df, name: df.groupBy("run").agg(F.count("*").alias(name))
    out = count(end, "lines").join(count(runlog.snapshot_difference(end, runlog.snapshot(_resumed(spark, sf_dir))), "resumed_differs"), "run", "left")
    return out.join(count(runlog.snapshot_difference(end, early), "earlier_differs"), "run", "left").na.fill(0)


@query(f"""WITH {_CAND}, {_held()} SELECT run, id, 'RANK($' || id || ')' AS expression, niche, string_split(niche, '/')[1] AS horizon_bucket, string_split(niche, '/')[3] AS turnover_bucket,
     o_custkey || ';' || o_orderstatus AS parent_ids, {r('fitness / 10000', 9)} AS mean_ic, CASE WHEN round > 2 THEN {r('fitness')} END AS icir, CASE WHEN round = 7 THEN 'Infinity' ELSE CAST(3 * round AS VARCHAR) || '.0' END AS half_life,
     round AS depth, length(id) AS symbol_length FROM held WHERE operator <> 'seed'""")
def runlog_archive_frame(spark, sf_dir):
    """Members as flat rows, from nested JSON lines, without the seeds."""
    out = runlog.archive_frame(runlog.archive(log(spark, sf_dir)), seeds=False)
    return out.select(
        "run", "id", "expression", "niche", "horizon_bucket", "turnover_bucket", "parent_ids", rounded("mean_ic", 9).alias("mean_ic"), rounded("icir").alias("icir"),
        F.col("half_life").cast("string").alias("half_life"), "depth", "symbol_length",
    )


def _rounds(spark, sf_dir):
    """Summaries of rounds as JSON lines with maps: refusals at gates and by full niches."""
    made = proposals(spark, sf_dir)
    admitted = runlog.admissions(made.where("gate is null").drop("gate")).groupBy("run", "round").agg(F.count("*").alias("admitted"))
    gates = made.where("gate is not null").groupBy("run", "round", "gate").agg(F.count("*").alias("n"))
    scored = made.groupBy("run", "round").agg(F.count("*").alias("proposals"), F.count_if(F.col("gate").isNull()).alias("scored"))
    full = scored.join(admitted, ["run", "round"], "left").na.fill(0, ["admitted"])
    every = gates.unionByName(full.where("scored > admitted").select("run", "round", F.lit("archive:niche_full_and_not_better").alias("gate"), (F.col("scored") - F.col("admitted")).alias("n")))
    maps = every.groupBy("run", "round").agg(F.map_from_entries(F.collect_list(F.struct("gate", "n"))).alias("rejections"))
    path = scratch(spark, "rounds")
    full.join(maps, ["run", "round"], "left").write.json(path)
    from tessera.sources.tables import read_jsonl

    return read_jsonl(spark, path, runlog.ROUND)


_GATES = f"""{_ADMITTED}, gt AS (SELECT run, round, gate, count(*) AS n FROM prop WHERE gate IS NOT NULL GROUP BY run, round, gate), ad AS (SELECT run, round, count(*) AS admitted FROM adm GROUP BY run, round),
     sc AS (SELECT run, round, count(*) AS proposals, count(*) FILTER (WHERE gate IS NULL) AS scored FROM prop GROUP BY run, round),
     fl AS (SELECT sc.*, coalesce(admitted, 0) AS admitted FROM sc LEFT JOIN ad ON ad.run = sc.run AND ad.round = sc.round),
     ev AS (SELECT * FROM gt UNION ALL SELECT run, round, 'archive:niche_full_and_not_better', scored - admitted FROM fl WHERE scored > admitted)"""


@query(f"""WITH {_GATES} SELECT fl.run, fl.round, proposals, scored, admitted, coalesce(string_agg(gate || '=' || n, '; ' ORDER BY gate), '') AS rejections, '' AS migrated
     FROM fl LEFT JOIN ev ON ev.run = fl.run AND ev.round = fl.round GROUP BY fl.run, fl.round, proposals, scored, admitted""")
def runlog_rounds_frame(spark, sf_dir):
    """Rounds as flat rows, their counters as text."""
    return runlog.rounds_frame(_rounds(spark, sf_dir)).select("run", "round", "proposals", "scored", "admitted", "rejections", "migrated")


@query(f"WITH {_GATES} SELECT run, gate, CAST(sum(n) AS BIGINT) AS n, CASE WHEN gate LIKE 'archive:%' THEN 'archive' ELSE 'gate' END AS kind FROM ev GROUP BY run, gate")
def runlog_refusals(spark, sf_dir):
    """Refusals at gates, and by full niches, told apart."""
    rejected = proposals(spark, sf_dir).where("gate is not null")
    return runlog.refusals(rejected, _rounds(spark, sf_dir)).select("run", "gate", "n", "kind")


@query(f"""WITH {_CAND}, al AS (SELECT DISTINCT run, niche FROM prop), {_held()}, hd AS (SELECT run, niche, count(*) AS n, round(max(fitness), 3) AS best FROM held GROUP BY run, niche)
     SELECT al.run, al.niche, coalesce(n, 0) AS count, best AS best_fitness, 8 AS capacity FROM al LEFT JOIN hd ON hd.run = al.run AND hd.niche = al.niche""")
def runlog_niches(spark, sf_dir):
    """Every niche of each run with its members and best fitness."""
    every = proposals(spark, sf_dir).select("run", F.array_join("niche", "/").alias("niche")).distinct()
    return runlog.niche_frame(runlog.archive(log(spark, sf_dir)), every)


@query(f"WITH {_CAND} SELECT run, count(*) FILTER (WHERE gate IS NULL) AS scored, count(gate) AS rejected, count(*) AS generated FROM prop GROUP BY run")
def runlog_generated(spark, sf_dir):
    """Candidates of each run, counted once."""
    made = proposals(spark, sf_dir)
    return runlog.generated(made.where("gate is null"), made.where("gate is not null"))


@query(f"""WITH {_CAND}, {_held()}, tp AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY fitness DESC, seq) AS k FROM held WHERE operator <> 'seed')
     SELECT run, {r('avg(CASE WHEN round > 2 THEN fitness END)')} AS icir, count(CASE WHEN round > 2 THEN 1 END) AS n FROM tp WHERE k <= 20 GROUP BY run""")
def runlog_top_mean(spark, sf_dir):
    """Mean of a metric over the twenty fittest members that have it."""
    members = runlog.archive(log(spark, sf_dir)).select("run", "operator", "fitness", "admitted_at", F.col("metrics.icir").alias("icir"))
    return runlog.top_mean(members, "icir").select("run", rounded("icir").alias("icir"), "n")
