"""Run logs of a search: admissions as events, the archive of any round, frames and totals.

A run proposes candidates in an order.  A niche holds the ``capacity`` best ones;
a candidate that isn't better than the weakest of a full niche is refused, else
the weakest goes.  That fold is made once, over the candidates, and gives a log of
admissions with what each one evicted.  All states come from the log by joins and
aggregations: the archive after any round, what two runs hold differently, the
frames and totals of a report.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.tables import read_jsonl

#: The fields of an admission, of a round and of a rejection in the JSON lines.
COMPLEXITY = "struct<base_fields: int, free_constants: int, depth: int, symbol_length: int>"
METRICS = (
    "struct<mean_ic: double, tstat: double, icir: double, coverage: double, turnover: double, half_life: double, "
    f"half_life_is_beyond_grid: boolean, stability: double, sign: int, complexity: {COMPLEXITY}>"
)
ADMISSION = (
    "event string, run string, admitted_at long, evicted string, id string, expression string, fitness double, niche array<string>, round int, "
    f"island string, operator string, parent_ids array<string>, rationale string, metrics {METRICS}"
)
ROUND = "run string, round int, proposals long, scored long, admitted long, archive_size long, best_fitness double, rejections map<string, long>, migrated map<string, long>"
SEED = "seed"


def _fold(by: list[str], capacity: int, exact: bool, gated: bool):
    """A streaming pass over rows sorted by group and order; keeps at most ``capacity`` rows of each niche at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, niches, members = None, {}, {}
        for frame in frames:
            took, gone = [], []
            keys = list(zip(*(frame[c] for c in by), strict=True))
            for i, row in enumerate(frame.itertuples(index=False)):
                if keys[i] != now:
                    now, niches, members = keys[i], {}, {}
                f = row.fitness
                if f is None or f != f or abs(f) == float("inf"):
                    continue
                if row.id in members:
                    if not exact:  # elsewhere its first admission may have ended by now
                        took.append(i)
                    continue
                if gated and any(c["id"] in members and (c["corr"] >= row.max_corr or c["shared"] >= row.max_shared) for c in row.conflicts):
                    continue
                niche = niches.setdefault(row.niche_key, [])  # weakest first; of equals the one that came later
                evicted = None
                if len(niche) >= capacity:
                    if f <= niche[0][0]:
                        continue
                    evicted = niche.pop(0)[2]
                    members.pop(evicted, None)
                bisect.insort(niche, (f, -row.seq, row.id))
                members[row.id] = True
                took.append(i)
                if exact:
                    gone.append(evicted)
            yield frame.iloc[took].assign(evicted=pd.Series(gone, index=frame.index[took], dtype=object)) if exact else frame.iloc[took]

    return run


def admissions(
    candidates: DataFrame, capacity: int = 8, by: tuple[str, ...] = ("run",), conflicts: bool = False, scored_once: bool = True
) -> DataFrame:
    """The admitted candidates, in the columns given, with ``evicted``: the id that made way, or null.

    ``candidates`` has id, niche, fitness, seq (a number that orders a run) and the
    columns ``by``.  Without a finite fitness, or with the id of a present member,
    a candidate is refused.  Only what a task's own rows don't already refuse is
    dealt out (a handful for each niche and task, however long a run is), then one
    pass over each niche in order decides.  That needs an id to have one niche and
    fitness in a run, as formulas that are scored once have; where it may come again
    with another score, ``scored_once=False`` deals out all rows, and ids are told
    apart within niches.

    With ``conflicts`` rows also have max_corr, max_shared and conflicts (id, corr,
    shared), and a present member with more correlation, or as large a shared
    part, refuses a candidate; that reaches over niches, so each ``by`` group is
    one ordered pass.
    """
    keys = [*by] if conflicts else [*by, "niche_key"]
    niche = F.array_join("niche", "/", "") if dict(candidates.dtypes)["niche"].startswith("array") else F.col("niche")
    rows = candidates.withColumn("niche_key", niche)
    kind = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    if scored_once and not conflicts:
        rows = rows.sortWithinPartitions(*keys, "seq").mapInPandas(_fold(keys, capacity, exact=False, gated=False), kind)
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "seq")
    return rows.mapInPandas(_fold(keys, capacity, exact=True, gated=conflicts), f"{kind}, evicted string").drop("niche_key")


def membership(log: DataFrame, by: tuple[str, ...] = ("run",), when: str = "round") -> DataFrame:
    """Each admission with ``until``: the round in which it was evicted, null if it stays.

    An id can be admitted again after its eviction, so an eviction ends the last
    admission before it: one window over both kinds of events by id.
    """
    out = log.where(F.col("evicted").isNotNull()).select(*by, F.col("evicted").alias("__of"), "admitted_at", F.col(when).alias("__out"))
    events = log.withColumns({"__of": F.col("id"), "__out": F.lit(None).cast("int")}).unionByName(out, allowMissingColumns=True)
    order = Window.partitionBy(*by, "__of").orderBy("admitted_at")
    return events.withColumn("until", F.lead("__out").over(order)).where("id is not null").drop("__of", "__out")


def archive(log: DataFrame, round_: int | None = None, by: tuple[str, ...] = ("run",)) -> DataFrame:
    """Who is in the archive after a round (or at the end): evictions replayed in order."""
    at = log if round_ is None else log.where(F.col("round") <= round_)
    return membership(at, by).where("until is null").drop("until", "evicted")


def by_round(log: DataFrame, rounds: DataFrame, by: tuple[str, ...] = ("run",)) -> DataFrame:
    """Members, niches filled and best fitness after each round; ``rounds`` has ``by`` and round."""
    spans = membership(log, by).select(*by, F.col("round").alias("__in"), "until", "niche", "fitness")
    inside = (F.col("round") >= F.col("__in")) & (F.col("until").isNull() | (F.col("round") < F.col("until")))
    joined = rounds.select(*by, "round").distinct().join(spans, list(by), "left").where(inside | F.col("__in").isNull())
    return joined.groupBy(*by, "round").agg(F.count("__in").alias("archive_size"), F.countDistinct("niche").alias("niches_filled"), F.max("fitness").alias("best_fitness"))


def resume(state: DataFrame, candidates: DataFrame, capacity: int = 8, by: tuple[str, ...] = ("run",), scored_once: bool = True) -> DataFrame:
    """Admissions that follow a state: the members go first, in their order, then what is still to be judged.

    ``state`` is an ``archive`` whose rows have the columns of ``candidates``; its
    own admissions are left out of the result.
    """
    columns = candidates.columns
    both = state.select(*columns).withColumn("__was", F.lit(True)).unionByName(candidates.withColumn("__was", F.lit(False)))
    return admissions(both, capacity, by, scored_once=scored_once).where(~F.col("__was")).drop("__was")


def snapshot(members: DataFrame, by: tuple[str, ...] = ("run",)) -> DataFrame:
    """One canonical line for each member, numbered in the order of admission."""
    fields = sorted(c for c in members.columns if c not in by)
    place = F.row_number().over(Window.partitionBy(*by).orderBy("admitted_at"))
    return members.select(*by, place.alias("place"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("line"))


def snapshot_difference(a: DataFrame, b: DataFrame, by: tuple[str, ...] = ("run",)) -> DataFrame:
    """Places at which two snapshots differ, with both lines; none if they are equal byte for byte."""
    both = a.withColumnRenamed("line", "left").join(b.withColumnRenamed("line", "right"), [*by, "place"], "full_outer")
    return both.where(~F.col("left").eqNullSafe(F.col("right")))


def read_admissions(spark: SparkSession, path: str) -> DataFrame:
    """Admissions from JSON lines; broken lines and other events are passed over."""
    return read_jsonl(spark, path, ADMISSION).where("coalesce(event, 'admit') = 'admit' and id is not null")


def archive_frame(members: DataFrame, seeds: bool = True, by: tuple[str, ...] = ("run",)) -> DataFrame:
    """One flat row for each member: niche and parents as text, metrics as columns."""
    m, c = F.col("metrics"), F.col("metrics.complexity")
    rows = members if seeds else members.where(~F.col("operator").eqNullSafe(SEED))
    return rows.select(
        *by, "id", "expression", "fitness", F.array_join("niche", "/").alias("niche"), F.get("niche", F.lit(0)).alias("horizon_bucket"),
        F.get("niche", F.lit(1)).alias("data_family"), F.get("niche", F.lit(2)).alias("turnover_bucket"), "round", "island", "operator",
        F.array_join("parent_ids", ";").alias("parent_ids"), "rationale", *[m[x].alias(x) for x in ("mean_ic", "tstat", "icir", "coverage", "turnover")],
        F.when(m["half_life_is_beyond_grid"], F.lit(float("inf"))).otherwise(m["half_life"]).alias("half_life"), m["stability"].alias("stability"), m["sign"].alias("sign"),
        *[c[x].alias(x) for x in ("base_fields", "free_constants", "depth", "symbol_length")],
    )


def _told(counts: Column) -> Column:
    pairs = F.array_sort(F.map_entries(F.coalesce(counts, F.create_map().cast("map<string, bigint>"))))
    return F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), "; ")


def rounds_frame(rounds: DataFrame) -> DataFrame:
    """Round summaries with their counters as text, in the order of their names."""
    return rounds.withColumns({c: _told(F.col(c)) for c in ("rejections", "migrated") if c in rounds.columns})


def niche_frame(members: DataFrame, niches: DataFrame, capacity: int = 8, by: tuple[str, ...] = ("run",)) -> DataFrame:
    """Members and best fitness of every niche of ``niches`` (``by`` and niche), empty ones included."""
    held = members.groupBy(*by, F.array_join("niche", "/").alias("niche")).agg(F.count("*").alias("count"), F.round(F.max("fitness"), 3).alias("best_fitness"))
    return niches.join(held, [*by, "niche"], "left").select(*by, "niche", F.coalesce("count", F.lit(0)).alias("count"), "best_fitness", F.lit(capacity).alias("capacity"))


def generated(scored: DataFrame, rejected: DataFrame, by: tuple[str, ...] = ("run",)) -> DataFrame:
    """Candidates of each run: scored, refused at a gate, and both together."""
    n = lambda df, c: df.groupBy(*by).agg(F.count("*").alias(c))
    both = n(scored, "scored").join(n(rejected, "rejected"), list(by), "full_outer").na.fill(0, ["scored", "rejected"])
    return both.withColumn("generated", F.col("scored") + F.col("rejected"))


def refusals(rejected: DataFrame, rounds: DataFrame, by: tuple[str, ...] = ("run",)) -> DataFrame:
    """Refusals at gates (from their log) and by full archives (from the rounds' counters), told apart."""
    gates = rejected.groupBy(*by, "gate").agg(F.count("*").alias("n")).withColumn("kind", F.lit("gate"))
    full = rounds.select(*by, F.explode("rejections").alias("gate", "n")).where(F.col("gate").startswith("archive:"))
    return gates.unionByName(full.groupBy(*by, "gate").agg(F.sum("n").alias("n")).withColumn("kind", F.lit("archive")))


def top(members: DataFrame, most: int, seeds: bool = True, by: tuple[str, ...] = ("run",)) -> DataFrame:
    """The fittest members of each run, of equals the one admitted first."""
    order = Window.partitionBy(*by).orderBy(F.desc("fitness"), "admitted_at")
    rows = members if seeds else members.where(~F.col("operator").eqNullSafe(SEED))
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def selection_weights(members: DataFrame, current: int, sparse: int = 3, stale: int = 3, by: tuple[str, ...] = ("run",)) -> DataFrame:
    """``members`` with ``weight``: twice in a niche of fewer than ``sparse`` members, half if older than ``stale`` rounds."""
    few = F.count("*").over(Window.partitionBy(*by, "niche")) < sparse
    old = F.lit(current) - F.col("round") > stale
    return members.withColumn("weight", F.when(few, 2.0).otherwise(1.0) * F.when(old, 0.5).otherwise(1.0))


def top_mean(members: DataFrame, value: str, most: int = 20, by: tuple[str, ...] = ("run",)) -> DataFrame:
    """Mean of ``value`` over the fittest members (seeds aside) that have a finite one."""
    order = Window.partitionBy(*by).orderBy(F.desc("fitness"), "admitted_at")
    top = members.where(~F.col("operator").eqNullSafe(SEED)).withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= most)
    finite = F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return top.groupBy(*by).agg(F.avg(F.when(finite, F.col(value))).alias(value), F.count_if(finite).alias("n"))


def sweep(candidates: DataFrame, cells: DataFrame, value: str, capacity: int = 8, most: int = 20) -> DataFrame:
    """Replay one stream of scored candidates under every cell of a grid of thresholds.

    ``candidates`` has id, niche, fitness, seq, round, operator, ``value`` and
    conflicts, all made once; ``cells`` has cell, max_corr and max_shared (a
    grid, so it is broadcast).  A row for each cell: archive_size, niches_filled
    and the mean ``value`` of its fittest members.
    """
    cross = candidates.join(F.broadcast(cells), F.lit(True))  # a row for each candidate and cell: the grid is the point
    log = admissions(cross, capacity, ("cell",), conflicts=True)
    log = log.withColumn("admitted_at", F.row_number().over(Window.partitionBy("cell").orderBy("seq")))
    held = archive(log, by=("cell",))
    sizes = held.groupBy("cell").agg(F.count("*").alias("archive_size"), F.countDistinct("niche").alias("niches_filled"))
    return cells.join(sizes, "cell", "left").na.fill(0, ["archive_size", "niches_filled"]).join(top_mean(held, value, most, ("cell",)).drop("n"), "cell", "left")


def strictest_best(grid: DataFrame, value: str, tolerance: float = 1e-6) -> DataFrame:
    """The cell of the best value; of cells within ``tolerance`` of it the strictest one."""
    near = grid.withColumn("__top", F.max(value).over(Window.partitionBy())).where(F.col(value) >= F.col("__top") - tolerance)  # a grid's few cells
    return near.orderBy("max_shared", "max_corr").limit(1).drop("__top")
