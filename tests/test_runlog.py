"""Run logs: the fold of admissions, states from the log, resuming, sweeps and report frames."""

import collections
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import runlog

KIND = "run string, seq long, id string, niche string, fitness double, round int, operator string, validation double"


def candidates(n=900, seed=3, once=False):
    rng = random.Random(seed)
    rows = []
    if once:  # an id has one niche and fitness in a run; it may come again
        first = {}
        for r in candidates(n, seed):
            run, seq, key, niche, fitness, *rest = r
            niche, fitness = first.setdefault((run, key), (niche, fitness))
            rows.append((run, seq, key, niche, fitness, *rest))
        return rows
    for i in range(n):
        fitness = rng.choice([rng.random() * 10, float(round(rng.random() * 10)), None, float("nan"), float("inf")]) if rng.random() < 0.2 else round(rng.random() * 30 + i / 30, 1)
        # ids come again: some are members then, some were evicted or never admitted
        rows.append((rng.choice("ab"), i, f"c{rng.randrange(n * 2 // 3)}", rng.choice(["x/low", "x/high", "y/low"]), fitness, 1 + i * 6 // n, rng.choice(["seed", "mutate", None]), rng.choice([None, rng.random(), float("nan")])))
    return rows


def fold(rows, capacity, gate=None):
    """Admissions as (seq, id, evicted), one candidate at a time."""
    out, held = [], {}
    for run, seq, key, niche, fitness, round_, *rest in sorted(rows, key=lambda r: r[1]):
        if fitness is None or not math.isfinite(fitness) or held.get((run, key), (None,))[0] == niche or (gate and gate(key, [k for r, k in held if r == run])):
            continue
        mine = sorted(((f, -s, k) for (r, k), (n, f, s) in held.items() if r == run and n == niche))
        evicted = None
        if len(mine) >= capacity:
            if fitness <= mine[0][0]:
                continue
            evicted = mine[0][2]
            del held[run, evicted]
        held[run, key] = (niche, fitness, seq)
        out.append((run, seq, key, evicted))
    return out, held


@pytest.fixture(scope="module")
def rows():
    return candidates(once=True)


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, KIND).repartition(5)


def test_fold_matches_one_by_one(spark, df, rows):
    for capacity in (1, 4):
        expected, held = fold(rows, capacity)
        log = runlog.admissions(df, capacity)
        assert sorted((r.run, r.seq, r.id, r.evicted) for r in log.collect()) == sorted(expected)
        log = log.withColumn("admitted_at", F.col("seq"))
        assert {(r.run, r.id) for r in runlog.archive(log).collect()} == set(held)
    assert runlog.admissions(df.limit(0)).count() == 0


def test_ids_that_come_again_with_other_scores(spark):
    """Some are members then, some are admitted again after their eviction."""
    rows = [(r[0], *r[1:3], "one", *r[4:]) for r in candidates()]
    expected, held = fold(rows, 3)
    assert max(collections.Counter((r, c) for r, _, c, _ in expected).values()) > 1
    log = runlog.admissions(spark.createDataFrame(rows, KIND).repartition(5), 3, scored_once=False).withColumn("admitted_at", F.col("seq"))
    assert sorted((r.run, r.seq, r.id, r.evicted) for r in log.collect()) == sorted(expected)
    assert {(r.run, r.id) for r in runlog.archive(log).collect()} == set(held)


def test_states_of_rounds(df, rows):
    log = runlog.admissions(df, 4).withColumn("admitted_at", F.col("seq")).cache()
    got = {(r.run, r.round): (r.archive_size, r.niches_filled, r.best_fitness) for r in runlog.by_round(log, df).collect()}
    for round_ in range(1, 7):
        _, held = fold([r for r in rows if r[5] <= round_], 4)
        assert {(r.run, r.id) for r in runlog.archive(log, round_).collect()} == set(held)
        for run in "ab":
            mine = [v for (r, _), v in held.items() if r == run]
            assert got[run, round_] == (len(mine), len({n for n, _, _ in mine}), max(f for _, f, _ in mine))
    log.unpersist()


@pytest.mark.parametrize("killed", [0, 2, 5])
def test_resumed_run_equals_the_unbroken_one(df, killed):
    columns = df.columns
    whole = runlog.admissions(df, 3).withColumn("admitted_at", F.col("seq"))
    first = runlog.admissions(df.where(F.col("round") <= killed), 3).withColumn("admitted_at", F.col("seq"))
    rest = runlog.resume(runlog.archive(first), df.where(F.col("round") > killed), 3).withColumn("admitted_at", F.col("seq"))
    assert rest.columns == first.columns and first.columns[: len(columns)] == columns
    a, b = (runlog.snapshot(runlog.archive(x)) for x in (whole, first.unionByName(rest)))
    assert a.count() > 0 and runlog.snapshot_difference(a, b).count() == 0
    other = runlog.snapshot(runlog.archive(whole, 4))
    lines = {(r.run, r.place): r.line for r in a.collect()}
    others = {(r.run, r.place): r.line for r in other.collect()}
    differing = {k for k in lines | others if lines.get(k) != others.get(k)}
    assert {(r.run, r.place) for r in runlog.snapshot_difference(a, other).collect()} == differing and differing


def test_sweep_replays_one_stream_under_every_cell(spark, rows):
    one = [r for r in rows if r[0] == "a"]
    rng = random.Random(9)
    ids = sorted({r[2] for r in one})
    near = {(x, y): (round(rng.random(), 2), rng.randrange(8)) for i, x in enumerate(ids) for y in ids[:i] if rng.random() < 0.5}
    of = collections.defaultdict(list)
    for (x, y), (c, s) in near.items():
        of[x].append((y, c, s))
        of[y].append((x, c, s))
    df = spark.createDataFrame([(*r, of[r[2]]) for r in one], KIND + ", conflicts array<struct<id: string, corr: double, shared: int>>").repartition(4)
    cells = [(f"{c}-{s}", c, s) for c in (0.6, 0.7, 0.8) for s in (4, 5, 6)]
    got = {r.cell: r for r in runlog.sweep(df, spark.createDataFrame(cells, "cell string, max_corr double, max_shared int"), "validation", 4, 5).collect()}
    assert len(got) == 9 and len({(r.archive_size, r.validation) for r in got.values()}) > 2
    for cell, corr, shared in cells:
        gate = lambda key, members, corr=corr, shared=shared: any(y in members and (c >= corr or s >= shared) for y, c, s in of[key])
        _, held = fold(one, 4, gate)
        assert (got[cell].archive_size, got[cell].niches_filled) == (len(held), len({n for n, _, _ in held.values()}))
        at = {(r[2], r[1]): (r[6], r[7]) for r in one}
        best = sorted(((-f, s, at[k, s]) for (_, k), (_, f, s) in held.items() if at[k, s][0] != "seed"))[:5]
        values = [v for _, _, (_, v) in best if v is not None and v == v]
        assert got[cell].validation == pytest.approx(sum(values) / len(values)) if values else got[cell].validation is None
    known = [r for r in got.values() if r.validation is not None]
    top = max(r.validation for r in known)
    near_top = sorted((r.max_shared, r.max_corr) for r in known if r.validation >= top - 1e-6)
    best = runlog.strictest_best(spark.createDataFrame([r.asDict() for r in got.values()]), "validation").first()
    assert (best.max_shared, best.max_corr) == near_top[0]


def test_frames_of_nested_lines(spark, tmp_path):
    member = {
        "event": "admit", "run": "a", "admitted_at": 1, "evicted": None, "id": "x", "expression": "RANK($close)", "fitness": 1.5, "niche": ["fast", "mixed", "low"], "round": 1, "island": "i", "operator": "mutate",
        "parent_ids": ["p", "q"], "rationale": "r", "metrics": {"mean_ic": 0.1, "half_life": 3.0, "half_life_is_beyond_grid": True, "complexity": {"depth": 2, "symbol_length": 12}},
    }
    seed = {**member, "id": "s", "operator": "seed", "admitted_at": 2, "metrics": None, "parent_ids": []}
    lines = [json.dumps(member), "broken", json.dumps(seed), json.dumps({"event": "note", "id": "n"})]
    (tmp_path / "log.jsonl").write_text("\n".join(lines))
    log = runlog.read_admissions(spark, str(tmp_path / "log.jsonl"))
    flat = {r.id: r for r in runlog.archive_frame(runlog.archive(log)).collect()}
    assert set(flat) == {"x", "s"} and {r.id for r in runlog.archive_frame(runlog.archive(log), seeds=False).collect()} == {"x"}
    x = flat["x"]
    assert (x.niche, x.turnover_bucket, x.parent_ids, x.mean_ic, x.half_life, x.depth, x.base_fields) == ("fast/mixed/low", "low", "p;q", 0.1, float("inf"), 2, None)
    assert flat["s"].half_life is None and flat["s"].parent_ids == ""
    rounds = spark.createDataFrame([("a", 1, {"b": 2, "a": 1, "archive:full": 3}, None), ("a", 2, None, {"z": 0})], "run string, round int, rejections map<string,long>, migrated map<string,long>")
    assert [(r.rejections, r.migrated) for r in runlog.rounds_frame(rounds).orderBy("round").collect()] == [("a=1; archive:full=3; b=2", ""), ("", "z=0")]
    rejected = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c")], "run string, gate string")
    assert {(r.run, r.gate, r.n, r.kind) for r in runlog.refusals(rejected, rounds).collect()} == {("a", "b", 2, "gate"), ("b", "c", 1, "gate"), ("a", "archive:full", 3, "archive")}
    assert {(r.run, r.scored, r.rejected, r.generated) for r in runlog.generated(spark.createDataFrame([("a",)], "run string"), rejected).collect()} == {("a", 1, 2, 3), ("b", 0, 1, 1)}
    every = spark.createDataFrame([("a", "fast/mixed/low"), ("a", "slow/mixed/low")], "run string, niche string")
    assert {(r.niche, r["count"], r.best_fitness) for r in runlog.niche_frame(runlog.archive(log), every).collect()} == {("fast/mixed/low", 2, 1.5), ("slow/mixed/low", 0, None)}
