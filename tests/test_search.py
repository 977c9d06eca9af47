"""Search: resuming from a log, shapes of random formulas, metrics and gates of candidates."""

import json
import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import candidates
from tessera.plans.formula import parse, render
from tessera.queries.formulas import POOL
from tessera.search import sampler
from tessera.search.evolve import Replayed, Search, fuses


def scored(calls):
    def score(texts):
        calls.append(list(texts))
        return {t: (float(sum(map(ord, t)) % 97), {"turnover": len(t) % 2, "half_life": float(len(t) % 30)}) for t in texts if sum(map(ord, t)) % 11}

    return score


def test_a_run_killed_after_two_rounds_ends_as_the_unbroken_one():
    whole = Search(Replayed(scored([])), seed=4, islands=3)
    whole.run(6)
    kept = []
    first = Search(Replayed(scored([]), write=kept.extend), seed=4, islands=3)
    first.run(2)
    before, calls = len(kept), []
    again = Search(Replayed(scored(calls), kept[:], write=kept.extend), seed=4, islands=3)
    again.run(6)
    assert again.archive.dump() == whole.archive.dump() and again.rounds == whole.rounds and again.rejections == whole.rejections
    assert not {t for c in calls for t in c} & {json.loads(x)["expression"] for x in kept[:before]}  # nothing is scored twice
    replayed = Replayed(scored([]), kept)
    assert Search(replayed, seed=4, islands=3).run(6).dump() == whole.archive.dump() and replayed.evaluated == 0
    assert any(json.loads(x)["fitness"] is None for x in kept)  # failures are known too


def test_a_crossing_shares_with_both_parents():
    a, b = parse("RANK(TS_MEAN($close, 5)) + $open"), parse("ZSCORE(TS_STD($volume, 10))")
    assert fuses(parse("RANK(TS_MEAN($close, 5)) * ZSCORE(TS_STD($volume, 10))"), [a, b])
    assert not fuses(parse("RANK(TS_MEAN($close, 5)) * $volume"), [a, b])


def test_random_formulas_have_the_shapes_of_the_set(spark):
    like = sampler.profile(POOL)
    assert sum(like.values()) == len(POOL)
    n = 3 * len(POOL)
    out = sampler.sample_set(spark, like, n, seed=5)
    rows = out.collect()
    assert Counter((r.calls, r.depth) for r in rows) == {cell: 3 * k for cell, k in like.items()}
    assert len({r.expression for r in rows}) == n
    for r in rows:
        assert sampler.shape(parse(r.expression)) == (r.calls, r.depth) and render(parse(r.expression)) == r.expression
    again = {r.expression for r in sampler.sample_set(spark, like, n, seed=5).collect()}
    assert again == {r.expression for r in rows} != {r.expression for r in sampler.sample_set(spark, like, n, seed=6).collect()}
    shares = sampler.quotas(Counter({(1, 1): 1, (2, 2): 2, (3, 3): 4}), 10)
    assert sum(shares.values()) == 10 and shares == {(1, 1): 1, (2, 2): 3, (3, 3): 6}
    with pytest.raises(ValueError):
        sampler.sample_set(spark, Counter({(0, 0): 1}), 100, seed=1, rounds=1)  # there are few fields


def test_metrics_of_candidates_match_plain_ones(spark):
    rng = np.random.default_rng(1)
    days = pd.bdate_range("2019-01-01", "2021-12-31").date
    rows = []
    for name, drift in (("up", 0.03), ("down", -0.02), ("flat", 0.0)):
        for h, share in ((1, 1.0), (5, 0.8), (10, 0.3)):
            rows += [(d, name, h, float(drift * share + 0.1 * z) if name != "flat" else 0.0) for d, z in zip(days, rng.standard_normal(len(days)), strict=True)]
    curve = spark.createDataFrame(rows, "date date, signal string, horizon int, ic double")
    small = lambda values, kind: spark.createDataFrame(values, kind)
    errors = small([("up", 0.004), ("down", 0.005), ("flat", None)], "signal string, se double")
    turnover = small([("up", 0.2), ("down", 0.5), ("flat", 0.0)], "signal string, turnover double")
    coverage = small([("up", 0.95), ("down", 0.5), ("flat", None)], "signal string, coverage double")
    texts = {"up": "RANK($close)", "down": "($open + $high) * ($low + $volume) / $roa * 2 + 3", "flat": "$roe"}
    years = small([(y,) for y in (2018, 2019, 2020, 2021)], "year int")
    out = {r.signal: r for r in candidates.metrics(curve, errors, turnover, coverage, candidates.forms(spark, texts), years, 0.3).collect()}
    for name, se in (("up", 0.004), ("down", 0.005)):
        s = pd.Series([r[3] for r in rows if r[1] == name and r[2] == 1], index=pd.to_datetime(list(days)))
        sign = 1 if s.mean() >= 0 else -1
        o, got = s * sign, out[name]
        held = (o.groupby(o.index.year).mean() > 0).sum()
        assert (got.sign, got.mean_ic, got.icir) == (sign, pytest.approx(o.mean()), pytest.approx(o.mean() / o.std()))
        assert got.tstat == pytest.approx(o.mean() / se) and got.stability == pytest.approx(max(0.5, held / 4))
        units = {"up": 0, "down": 2 + 1}[name]  # five fields, two free constants
        cost = 0.1 * units + 0.00005 * got.turnover / se
        assert got.fitness == pytest.approx(abs(got.tstat) * got.stability - cost)
    assert (out["up"].turnover_bucket, out["down"].turnover_bucket, out["down"].data_family, out["flat"].data_family) == ("low", "high", "mixed", "fundamental")
    assert out["flat"].fitness == float("-inf") and out["flat"].horizon_bucket == "slow" and out["flat"].tstat is None
    closest = small([("up", "x", 0.7, False), ("down", "x", 0.9, False)], "a string, closest string, corr double, passed boolean")
    screen = small([("up", 2.0), ("down", 3.0), ("flat", 0.0), ("new", 0.9)], "signal string, screen double")
    told = {r.signal: r.gate for r in candidates.gates(coverage.union(small([("new", 1.0), ("fine", 1.0)], "signal string, coverage double")), closest, screen.union(small([("fine", 1.0)], "signal string, screen double"))).collect()}
    assert told == {"up": "correlation", "down": "coverage", "flat": "coverage", "new": "cheap_screen", "fine": None}
    pairs = [("a", 5, 0.02, 6, 0.02), ("b", 6, 0.02, 6, 0.01), ("c", 3, 0.01, 6, -0.02), ("d", 3, -0.016, 6, 0.02), ("e", 3, 0.0, 6, 0.0)]
    told = {r.signal: r.gate for r in candidates.simplified(small(pairs, "signal string, cost int, mean_ic double, parent_cost int, parent_ic double")).collect()}
    assert told == {"a": None, "b": "simplify_not_simpler", "c": "simplify_lost_too_much_ic", "d": None, "e": None}


def test_greedy_selection_matches_the_plain_one(spark):
    from tessera.operators import arms, scoring

    rng = random.Random(4)
    names = [f"s{i:02d}" for i in range(40)]
    scores = [{"signal": s, "set": "xy"[i % 2], "t_ic": rng.choice([None, rng.uniform(-5, 5), 3.0]), "autocorr": rng.choice([None, rng.uniform(0, 0.8)])} for i, s in enumerate(names)]
    pairs = {(a, b): rng.uniform(-1, 1) for a in names for b in names if a < b and rng.random() < 0.7}
    df = spark.createDataFrame([(x["signal"], x["set"], x["t_ic"], x["autocorr"]) for x in scores], "signal string, set string, t_ic double, autocorr double").repartition(3)
    pf = spark.createDataFrame([(*k, v) for k, v in pairs.items()], "a string, b string, corr double")
    for most, limit in ((10, 0.7), (3, 0.2)):
        got = {(r.set, r.place): (r.signal, r.sign) for r in arms.select_uncorrelated(df, pf, most, limit, by=("set",)).collect()}
        expected = {}
        for name in "xy":
            for i, x in enumerate(scoring.greedy_uncorrelated([s for s in scores if s["set"] == name], pairs, most, limit)):
                expected[name, i + 1] = (x["signal"], x["sign"])
        assert got == expected and len(got) > 2
    taken = arms.select_uncorrelated(df, pf, by=("set",))
    hold = spark.createDataFrame([(s, 0.02, 0.01 * (i % 3 - 1)) for i, s in enumerate(names)], "signal string, fit_ic double, hold_ic double")
    closest = spark.createDataFrame([(s, 0.95 if i % 4 == 0 else 0.1) for i, s in enumerate(names)], "a string, corr double")
    out = {r.set: r for r in arms.compare_sets(df.select("set", "signal", F.col("t_ic").alias("t")), taken, hold, closest).collect()}
    for i, name in enumerate("xy"):
        mine = [x for x in scores if x["set"] == name]
        known = [x["t_ic"] for x in mine if x["t_ic"] is not None]
        chosen = [r.signal for r in taken.where(F.col("set") == name).collect()]
        kept = [0.5 * (names.index(s) % 3 - 1) for s in chosen]
        r = out[name]
        assert (r.candidates, r.scorable, r.selected) == (20, len(known), len(chosen)) and r.best_t == max(map(abs, known))
        assert r.median_retention == pytest.approx(float(np.median(kept))) and r.sign_held == pytest.approx(np.mean([k > 0 for k in kept]))
        assert r.share_known == pytest.approx(0.5 if i == 0 else 0.0) and 1 < r.null_best_t < 3
