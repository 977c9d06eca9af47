"""Pools in matrix form, ridge paths, deflated Sharpe ratios, gates and evidence against plain versions."""

import datetime as dt
import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import evidence, gates, gram, inference, quality
from tessera.sources import tables

NAMES = [f"s{i}" for i in range(7)]


@pytest.fixture(scope="module")
def panel():
    rng = np.random.default_rng(4)
    days = pd.date_range("2020-01-01", periods=24).date
    rows = []
    for d, day in enumerate(days):
        n = 12 if d % 5 == 0 else 60
        common = rng.standard_normal(n)
        x = rng.standard_normal((n, 7)) + np.outer(common, [1, 1, -1, 0, 0, 0.5, 0])
        x[:, 3] = np.round(x[:, 3])  # ties
        x[rng.random((n, 7)) < 0.15] = np.nan
        if d == 7:
            x[:, 6] = 1.0  # constant
        if d == 8:
            x[:, 5] = np.nan
        y = common * 0.3 + rng.standard_normal(n)
        y[rng.random(n) < 0.1] = np.nan
        rows += [(day, k, *[None if v != v else float(v) for v in x[k]], None if y[k] != y[k] else float(y[k])) for k in range(n)]
    return pd.DataFrame(rows, columns=["date", "key", *NAMES, "fwd"])


@pytest.fixture(scope="module")
def wide(spark, panel):
    kind = "date date, key long, " + ", ".join(f"{s} double" for s in NAMES) + ", fwd double"
    rows = [tuple(None if isinstance(v, float) and v != v else v for v in r) for r in panel.itertuples(index=False)]
    return spark.createDataFrame(rows, kind).repartition(6).withColumn("corr", F.lit("clash"))


def plain_pairs(panel, minimum):
    out = {}
    for a in NAMES:
        for b in NAMES:
            daily = []
            for _, part in panel.groupby("date"):
                ranks = part[NAMES].astype(float).rank(pct=True)
                both = ranks[[a, b]].dropna() if a != b else ranks[[a]].dropna()
                x, y = both[a], both[b]
                if len(x) >= minimum and x.nunique() > 1 and y.nunique() > 1:
                    daily.append(np.corrcoef(x, y)[0, 1])
            if daily:
                out[a, b] = (np.mean(daily), len(daily))
    return out


def test_pairs_match_plain_correlations(wide, panel):
    expected = plain_pairs(panel, 20)
    got = {(r.a, r.b): (r["corr"], r.n_days) for r in gram.rank_correlations(wide, NAMES, minimum=20).collect()}
    assert got == {k: (pytest.approx(v[0]), v[1]) for k, v in expected.items() if k[0] < k[1]}
    got = {(r.a, r.b): r["corr"] for r in gram.rank_correlations(wide, NAMES[:2], NAMES[1:5], 20).collect()}
    assert got == {(a, b): pytest.approx(expected[a, b][0]) for a in NAMES[:2] for b in NAMES[1:5]}
    gate = {r.a: r for r in gram.correlation_gate(gram.rank_correlations(wide, NAMES[3:], NAMES[:3], 20), 0.2).collect()}
    for a in NAMES[3:]:
        best = max((abs(expected[a, b][0]), b) for b in NAMES[:3])
        assert (gate[a]["corr"], gate[a].closest, gate[a].passed) == (pytest.approx(best[0]), best[1], best[0] < 0.2)
    assert gram.rank_correlations(wide.limit(0), NAMES).count() == 0


def test_rank_ic_matches_plain_ranks(wide, panel):
    expected = {}
    for day, part in panel.groupby("date"):
        for s in NAMES:
            for label in ("fwd", "s0"):
                both = part[[s, label]].astype(float).dropna() if s != label else None
                if both is not None and len(both) >= 20 and both[s].nunique() > 1 and both[label].nunique() > 1:
                    r = both.rank()
                    expected[day, s, label] = (np.corrcoef(r[s], r[label])[0, 1], len(both))
    got = {(r.date, r.signal, r.label): (r.ic, r.n) for r in gram.rank_ic(wide, NAMES, ["fwd", "s0"], 20).collect() if r.signal != r.label}
    assert got == {k: (pytest.approx(v[0], abs=1e-12), v[1]) for k, v in expected.items()}
    assert gram.rank_ic(wide.limit(0), NAMES, ["fwd"], 20).count() == 0


def test_no_row_is_made_for_a_pair_and_a_date(wide):
    """The exchange carries the wide rows once; what follows is sums of pairs."""
    plan = gram.rank_correlations(wide, NAMES, minimum=20)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan and plan.count("MapInArrow") == 1


def test_ridge_path_matches_numpy(spark, wide, panel):
    day = sorted(panel.date.unique())[14]
    used, signs = ["s0", "s2", "s3"], [1, -1, 1]
    parts = wide.withColumn("window", F.when(F.col("date") < F.lit(day), "fit").when(F.col("date") > F.lit(day), "validation"))
    path = {r.place: r for r in gram.ridge_path(gram.design_sums(parts, used, "fwd", "window", signs), "fit", "validation").collect()}
    design = {}
    for name, some in (("fit", panel[panel.date < day]), ("validation", panel[panel.date > day])):
        xs, ys = [], []
        for _, part in some.groupby("date"):
            ranks = part[used].astype(float).rank(pct=True) * signs
            x, y = ranks - ranks.mean(), part.fwd.astype(float) - part.fwd.astype(float).mean()
            keep = x.notna().all(axis=1) & y.notna()
            xs.append(x[keep].to_numpy())
            ys.append(y[keep].to_numpy())
        design[name] = np.concatenate(xs), np.concatenate(ys)
    x, y = design["fit"]
    scores = {}
    for i, penalty in enumerate(gram.PENALTIES):
        w = np.linalg.solve(x.T @ x + penalty * np.trace(x.T @ x) / 3 * np.eye(3), x.T @ y)
        assert path[i].weights == pytest.approx(list(w)) and path[i].penalty == penalty
        scores[i] = np.corrcoef(design["validation"][0] @ w, design["validation"][1])[0, 1]
        assert path[i].score == pytest.approx(scores[i])
    best = gram.best_ridge(spark.createDataFrame([r.asDict() for r in path.values()])).first()
    assert best.place == max(scores, key=lambda i: (scores[i], -i))
    nothing = gram.ridge_path(gram.design_sums(parts.where("window is null"), used, "fwd", "window"), "fit", "validation")
    assert [r.score for r in nothing.collect()] == [None] * 5 and gram.best_ridge(nothing).count() == 0
    mixed = {(r.date, r.key): r.value for r in gram.weighted_signal(wide, used, {"s0": 0.5, "s2": -2.0, "s3": 1.0}).collect()}
    part = panel[panel.date == day]
    ranks = part[used].astype(float).rank(pct=True)
    centred = (ranks - ranks.mean()) * [0.5, -2.0, 1.0]
    for k, (_, row) in zip(part.key, centred.iterrows(), strict=True):
        assert mixed[day, k] == (None if row.isna().all() else pytest.approx(row.fillna(0).sum()))


def test_deflated_sharpe_matches_the_formulas(spark):
    rng = np.random.default_rng(2)
    groups = {f"g{i}": rng.standard_normal(n) * 0.02 + 0.004 * i for i, n in enumerate((60, 250, 3, 2, 1, 40))}
    groups["flat"] = np.full(20, 0.01)
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("g1", None)]
    df = spark.createDataFrame(rows, "g string, r double")
    normal, gamma = NormalDist(), 0.5772156649015329
    sharpe = {g: (v.mean() / v.std(ddof=1) if len(v) > 1 and v.std(ddof=1) > 1e-12 else 0.0) for g, v in groups.items()}
    spread = math.sqrt(np.var(list(sharpe.values()), ddof=1))

    def psr(g, against):
        v, s = pd.Series(groups[g]), sharpe[g]
        if len(v) < 3:
            return 0.5
        skew, kurt = (0.0 if x != x else x for x in (v.skew(), v.kurt()))
        den = 1 - skew * s + (kurt + 2) / 4 * s * s
        return 0.0 if den <= 0 else normal.cdf((s - against) * math.sqrt(len(v) - 1) / math.sqrt(den))

    for trials in (None, 500):
        n = trials or len(groups)
        star = spread * ((1 - gamma) * normal.inv_cdf(1 - 1 / n) + gamma * normal.inv_cdf(1 - 1 / (n * math.e)))
        for r in inference.deflated_sharpe(df, "r", ("g",), trials).collect():
            assert (r.n, r.sharpe, r.star) == (len(groups[r.g]), pytest.approx(sharpe[r.g], abs=1e-12), pytest.approx(star))
            assert r.psr == pytest.approx(psr(r.g, 0.0), abs=1e-6) and r.dsr == pytest.approx(psr(r.g, star), abs=1e-6)
    p = [1e-12, 1e-4, 0.02, 0.024251, 0.3, 0.5, 0.9, 0.99, 1 - 1e-9]
    got = [r.q for r in spark.createDataFrame([(x,) for x in p], "p double").select(inference.normal_quantile(F.col("p")).alias("q")).collect()]
    assert got == pytest.approx([normal.inv_cdf(x) for x in p], abs=1e-7)
    one = inference.deflated_sharpe(df.where("g = 'g1'"), "r", ("g",), 10).first()
    assert one.star == pytest.approx(math.sqrt(1 / 249) * ((1 - gamma) * normal.inv_cdf(0.9) + gamma * normal.inv_cdf(1 - 1 / (10 * math.e))))


def test_gates_of_strategies(spark):
    rng = np.random.default_rng(3)
    days = pd.date_range("2020-01-01", periods=400).date
    rows = []
    for name, drift in (("good", 0.004), ("bad", -0.002)):
        rows += [(name, d, float(drift + 0.01 * z) if i != 5 else None, 0.1 if name == "good" else 0.5, float(0.01 * y)) for i, (d, z, y) in enumerate(zip(days, rng.standard_normal(400), rng.standard_normal(400), strict=True))]
    df = spark.createDataFrame(rows, "strategy string, date date, net double, turnover double, base double")
    shares = spark.createDataFrame([("good", "x", 0.3), ("good", "y", 0.2), ("bad", "x", 0.9)], "strategy string, sector string, share double")
    overlap = spark.createDataFrame([("good", 0.6)], "strategy string, overlap double")
    out = gates.promotion_gates(df, "strategy", ("base",), shares, overlap, trials=1)
    told = {(r.strategy, r.gate): (r.value, r.passed) for r in out.collect()}
    for name in ("good", "bad"):
        net = pd.Series([r[2] for r in rows if r[0] == name], dtype=float).dropna().reset_index(drop=True)
        annual = lambda s: s.mean() / s.std() * math.sqrt(252)
        part = pd.qcut(pd.Series(range(len(net))), q=8, labels=False)
        assert told[name, "GATE-2"][0] == sum(annual(net[part == k]) > 0 for k in range(8))
        equity = (1 + net).cumprod()
        assert told[name, "GATE-4"][0] == pytest.approx((1 - equity / equity.cummax()).max())
        base = annual(pd.Series([r[4] for r in rows if r[0] == name]))
        assert told[name, "GATE-7"][0] == pytest.approx(annual(net) - base) and told[name, "GATE-8"][0] == pytest.approx(annual(net))
    assert all(passed for (name, _), (_, passed) in told.items() if name == "good")
    assert told["bad", "GATE-6"] == (None, False) and told["bad", "GATE-3"] == (0.9, False)
    verdict = {r.strategy: (r.passed, r.failed) for r in gates.promoted(out, "strategy").collect()}
    assert verdict["good"] == (True, "") and not verdict["bad"][0] and "GATE-6" in verdict["bad"][1]


def test_lenient_loads_halt_on_three_checks_only(spark):
    rows = [(0, "freshness", True, "info"), (2, "ohlc_validity", False, "warning"), (6, "gap_backfill", False, "warning")]
    checks = spark.createDataFrame([("a", *r) for r in rows] + [("b", 1, "completeness", False, "critical"), ("b", 6, "gap_backfill", False, "critical"), ("b", 3, "duplicates", None, "warning")], "g string, place int, check string, passed boolean, severity string")
    told = lambda mode: {r.g: (r.passed, r.halt_reason) for r in quality.roll_up(checks, mode, ("g",)).collect()}
    assert told("strict") == {"a": (False, "Failed checks: ohlc_validity, gap_backfill"), "b": (False, "Failed checks: completeness, duplicates, gap_backfill")}
    assert told("lenient") == {"a": (True, None), "b": (False, "Failed checks: completeness, gap_backfill")}
    with pytest.raises(ValueError):
        quality.roll_up(checks, "odd")


def test_backfill_loads_each_day_once_and_in_order(spark, tmp_path):
    from tessera.streaming import bars

    seen = []

    def load(day):
        seen.append(day)
        if day == "2024-01-10" and seen.count(day) == 1:
            raise RuntimeError("lost")
        return spark.createDataFrame([(dt.date.fromisoformat(day), 1, float(len(seen)), 1)], "date date, permno long, close double, seen int")

    old = spark.createDataFrame([(dt.date(2024, 1, 5), 1), (dt.date(2024, 1, 2), 1)], "date date, permno long")  # a Friday
    plan = quality.backfill_plan(old, "2024-01-11", 5)
    assert [(str(r.date), r.place, r.status) for r in plan.orderBy("place").collect()] == [("2024-01-08", 0, "backfill"), ("2024-01-09", 1, "backfill"), ("2024-01-10", 2, "backfill"), ("2024-01-11", 3, "load")]
    run = lambda: bars.run_backfill(spark, plan, load, str(tmp_path), ["date", "permno"], "seen")
    with pytest.raises(RuntimeError):
        run()
    assert run() == ["2024-01-10", "2024-01-11"] and seen == ["2024-01-08", "2024-01-09", "2024-01-10", "2024-01-10", "2024-01-11"]
    before = sorted(spark.read.parquet(f"{tmp_path}/data").collect())
    assert run() == [] and len(seen) == 5 and sorted(spark.read.parquet(f"{tmp_path}/data").collect()) == before and len(before) == 4
    assert quality.backfill_plan(old, "2024-01-05", 5).count() == 0
    late = quality.backfill_plan(old, "2024-03-01", 5)
    assert [(str(r.date), r.status) for r in late.collect()] == [("2024-03-01", "halt")]
    with pytest.raises(ValueError, match="2024-03-01"):
        bars.run_backfill(spark, late, load, str(tmp_path), ["date", "permno"], "seen")
    assert [r.status for r in quality.backfill_plan(old.limit(0), "2024-03-01", 5).collect()] == ["halt"]


def test_evidence_rules_find_what_breaks_them(spark):
    rows = [(i, f"{i % 3}", "a" if i else "b", "true", "x" if i % 2 else "") for i in range(6)]
    good = tables.row_digest(spark.createDataFrame(rows, "n long, kind string, word string, flag string, opt string"), ["n", "kind"], "seal")
    rules = [
        evidence.matches("seal"), evidence.matches("opt", "x+", optional=True), evidence.one_of("kind", ("0", "1", "2")), evidence.boolean("flag"), evidence.present_if("opt", F.col("n") % 2 == 1, "odd"),
        evidence.unique("n"), evidence.contiguous("n"), evidence.rows(6), evidence.free_of_paths(["word", "opt"]), evidence.free_of_queries(["word"]), evidence.follows("seal", F.sha2(F.format_string('{"n":"%d","kind":"%s"}', "n", "kind"), 256), "seal"),
    ]
    out = evidence.check(good, rules, good.columns, ["secret"])
    assert all(r.passed for r in out.collect()) and out.count() == 13
    evidence.require(out)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1  # one scan
    bad = good.withColumns({
        "seal": F.when(F.col("n") == 1, "zz").otherwise(F.col("seal")), "kind": F.when(F.col("n") == 2, "9").otherwise(F.col("kind")), "flag": F.when(F.col("n") == 3, "maybe").otherwise(F.col("flag")),
        "opt": F.when(F.col("n") == 0, "/etc").otherwise(F.col("opt")), "word": F.when(F.col("n") == 4, "SELECT 1").otherwise(F.col("word")),
    }).withColumn("secret", F.lit(1)).unionByName(good.where("n = 5").withColumn("secret", F.lit(1)))
    told = {r.rule: r.violations for r in evidence.check(bad, rules, good.columns, ["secret"]).collect()}
    assert told == {
        "columns": 1, "no forbidden columns": 1, "seal matches": 1, "opt matches": 1, "kind one of": 1, "flag boolean": 1, "opt present if odd": 1, "n unique": 1, "n contiguous": 1, "row count": 1,
        "free of paths": 1, "free of queries": 1, "seal is seal": 2,
    }
    with pytest.raises(ValueError, match="flag boolean"):
        evidence.require(evidence.check(bad, rules))
    assert all(r.passed for r in evidence.check(good.limit(0), [r for r in rules if r.name != "row count"]).collect())


def test_a_table_goes_through_a_database(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = [(i, f"n{i}", float(i) / 3, dt.date(2020, 1, 1) + dt.timedelta(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "ID long, NAME string, PX double, DAY date")
    tables.write_jdbc(df, url, "DAILY", writers=2)
    assert "DAILY" in {r.table for r in tables.jdbc_tables(spark, url).where("schema = 'APP'").collect()}
    assert tables.resolve_jdbc_table(spark, url, [("app", "missing"), ("app", "daily")]) == "APP.DAILY"
    with pytest.raises(ValueError):
        tables.resolve_jdbc_table(spark, url, [("app", "missing")])
    for split in ("ID", "DAY", None):
        back = tables.read_jdbc(spark, url, "DAILY", split, 4)
        assert sorted(map(tuple, back.collect())) == rows and back.rdd.getNumPartitions() == (4 if split else 1)
    some = back.where("ID >= 150 AND PX < 55").select("NAME")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(ID,150)" in plan and some.count() == 15
    assert tables.pick_column(back.columns, ["permno", "id"]) == "ID" and tables.pick_column(back.columns, ["x"]) is None


def test_fold_factors_make_the_correlations_once(spark):
    import __spark_entry__ as contract
    from tests.conftest import DATA

    plan = contract.queries()["select_fold_factors"](spark, DATA)._jdf.queryExecution().withCachedData().toString()
    assert "InMemoryRelation" in plan  # the years were looked up in the same rows
    spark.catalog.clearCache()


def test_a_long_date_takes_little_more_memory_than_its_numbers():
    import tracemalloc

    values = np.random.default_rng(1).normal(size=(100_000, 30))
    every = list(range(30))
    tracemalloc.start()
    try:
        c, _ = gram._correlations(gram._ranks(values), every, every, 5)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 4 * values.nbytes  # was 7.25 times
    assert np.allclose(c, pd.DataFrame(values).rank().corr().to_numpy())


def test_turnover_of_columns_is_that_of_long_rows(spark):
    from tessera.operators import scoring

    rng = np.random.default_rng(2)
    rows = [(dt.date(2024, 1, d), k, *(None if rng.random() < 0.2 or d == 4 else float(rng.integers(0, 5)) for _ in range(2)), 1.0) for d in range(1, 9) for k in range(9)]
    wide = spark.createDataFrame(rows, "date date, key long, a double, b double, c double")
    told = lambda df: {r.signal: round(r.turnover, 12) for r in df.collect()}
    assert told(gram.turnover(wide, ["a", "b", "c"])) == told(scoring.turnover(scoring.melt(wide, ["a", "b", "c"]))) != {}
