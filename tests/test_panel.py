"""The compiler and panel operators against pandas on a planted, gapped panel."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import inference, panel, portfolio, scoring
from tessera.plans.compile import evaluate

DAYS = [dt.date(2020, 1, 1) + dt.timedelta(d) for d in range(40)]
KEYS = list(range(8))


@pytest.fixture(scope="module")
def frames():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(len(DAYS), len(KEYS))).round(1)
    y = rng.normal(size=x.shape)
    x[rng.random(x.shape) < 0.08] = np.nan
    x[10:18, 3] = 1.0
    return pd.DataFrame(x, DAYS, KEYS), pd.DataFrame(y, DAYS, KEYS)


@pytest.fixture(scope="module")
def grid(spark, frames):
    x, y = frames
    rows = [(k, d, None if np.isnan(x.loc[d, k]) else float(x.loc[d, k]), float(y.loc[d, k])) for d in DAYS for k in KEYS]
    return spark.createDataFrame(rows, "key long, date date, close double, volume double")


def wide(df, name="v"):
    p = df.toPandas().pivot(index="date", columns="key", values=name).astype(float)
    p.index = list(p.index)
    return p


def same(got, expected):
    expected = expected.copy()
    expected.index.name = expected.columns.name = None
    got = got.reindex(index=DAYS, columns=KEYS)
    np.testing.assert_allclose(got.to_numpy(), expected.replace([np.inf, -np.inf], np.nan).reindex(index=DAYS, columns=KEYS).to_numpy(float), rtol=1e-9, atol=1e-12)


CASES = {
    "TS_MEAN($close, 4)": lambda x, y: x.rolling(4).mean(),
    "TS_STD($close, 4)": lambda x, y: x.rolling(4).apply(lambda v: v.std(ddof=1), raw=True),
    "TS_RANK($close, 5)": lambda x, y: x.rolling(5).rank(pct=True),
    "TS_ARGMAX($close, 5)": lambda x, y: x.rolling(5).apply(lambda v: 4 - v.argmax(), raw=True),
    "TS_ARGMIN($close, 5)": lambda x, y: x.rolling(5).apply(lambda v: 4 - v.argmin(), raw=True),
    "TS_DECAY_LINEAR($close, 3)": lambda x, y: x.rolling(3).apply(lambda v: (v * [1, 2, 3]).sum() / 6, raw=True),
    "TS_PRODUCT($close, 3)": lambda x, y: x.rolling(3).apply(np.prod, raw=True),
    "EMA($close, 4)": lambda x, y: x.ewm(span=4, adjust=True, ignore_na=False, min_periods=4).mean(),
    "TS_DELTA($close, 2)": lambda x, y: x - x.shift(2),
    "RANK($close)": lambda x, y: x.rank(axis=1, pct=True),
    "ZSCORE($close)": lambda x, y: x.sub(x.mean(axis=1), axis=0).div(x.std(axis=1), axis=0),
    "CS_DEMEAN($volume)": lambda x, y: y.sub(y.mean(axis=1), axis=0),
    "LOG($close)": lambda x, y: np.log(x.where(x > 0)),
    "MAX($close, $volume)": lambda x, y: np.maximum(x, y),
    "IF($close > 0, $volume, -$volume)": lambda x, y: y.where(x > 0, -y).where(x.notna()),
    "COUNT($close > 0, 3)": lambda x, y: (x > 0).astype(float).where(x.notna()).rolling(3).sum(),
    "TS_COV($close, $volume, 5)": lambda x, y: x.rolling(5).cov(y),
}


@pytest.mark.parametrize("text", CASES)
def test_formula_is_pandas(grid, frames, text):
    same(wide(evaluate(grid, {"v": text})), CASES[text](*frames))


def test_pool_equals_formulas_alone(grid):
    pool = {f"f{i}": t for i, t in enumerate(CASES)}
    together = evaluate(grid, pool).toPandas()
    assert list(together.columns) == ["key", "date", *pool] and len(together) == len(DAYS) * len(KEYS)


def test_exchanges_follow_alternation_not_formulas(grid):
    few = evaluate(grid, {"a": "RANK(TS_MEAN($close, 3))"})
    many = evaluate(grid, {f"f{w}": f"RANK(TS_MEAN($close, {w}))" for w in range(2, 12)})
    count = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert count(many) <= count(few)


def test_missing_and_infinite_values(spark):
    rows = [(1, DAYS[0], 1.0, 0.0), (1, DAYS[1], 0.0, 0.0), (1, DAYS[2], -1.0, 0.0), (1, DAYS[3], None, 1.0)]
    g = spark.createDataFrame(rows, "key long, date date, close double, volume double")
    out = evaluate(g, {"q": "$close / $volume", "m": "MIN($close, $volume)", "r": "RANK($close / $volume)", "s": "TS_SUM($close / $volume, 1)", "p": "POWER($close, 0.5)", "c": "TS_CORR($volume, $close, 3)"})
    got = {r.date: r for r in out.collect()}
    assert got[DAYS[0]].q == float("inf") and got[DAYS[2]].q == float("-inf") and got[DAYS[1]].q is None
    assert got[DAYS[3]].m is None and got[DAYS[0]].r == 1.0 and got[DAYS[0]].s is None
    assert got[DAYS[2]].p is None and got[DAYS[2]].c is None


def test_planted_signal_is_found(spark):
    rng = np.random.default_rng(0)
    rows = []
    for k in range(30):
        s = rng.normal(size=80)
        price = 100.0
        for t in range(80):
            day = dt.date(2020, 1, 1) + dt.timedelta(t)
            rows.append((k, day, float(price), float(price), float(s[t])))
            price *= 1 + 0.01 * (s[t - 1] if t else 0) + 0.001 * rng.normal()
    g = spark.createDataFrame(rows, "key long, date date, open double, close double, volume double")
    labelled = panel.forward_returns(g, [1])
    values = evaluate(labelled, {"good": "$volume", "bad": "DELAY($volume, 5)"}, keep=["fwd_1"])
    ic = scoring.daily_ic(scoring.melt(values, ["good", "bad"], ("date", "key", "fwd_1")), "fwd_1", 5)
    mean = {r.signal: r.mean_ic for r in scoring.ic_summary(ic).collect()}
    assert abs(mean["good"]) > 5 * abs(mean["bad"])


def test_future_prices_do_not_change_purged_labels(spark, grid):
    g = grid.withColumn("open", 10 + F.col("volume"))
    days = g.select("date").distinct()
    cutoff = str(DAYS[20])
    changed = g.withColumn("open", F.when(F.col("date") > F.lit(cutoff).cast("date"), F.col("open") * 3).otherwise(F.col("open")))
    label = lambda x: panel.purge(panel.forward_returns(x, [2]), days, cutoff, [2]).select("key", "date", "fwd_2")
    a, b = (sorted(map(tuple, label(x).collect())) for x in (g, changed))
    assert a == b and {d for _, d, v in a if v is not None} == set(DAYS[:18])


def test_newey_west_is_the_sum(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(0.1, 1, 60)
    df = spark.createDataFrame([("a", DAYS[0] + dt.timedelta(i), float(x)) for i, x in enumerate(v)], "signal string, date date, ic double")
    c = v - v.mean()
    var = (c @ c + 2 * sum((1 - k / 5) * (c[k:] @ c[:-k]) for k in range(1, 5))) / 60
    assert inference.newey_west(df, "ic", 4).first().t_nw == pytest.approx(v.mean() / np.sqrt(var / 60), rel=1e-9)


def test_ridge_solves_the_normal_equations():
    x = np.random.default_rng(3).normal(size=(200, 2))
    y = x @ [2.0, -1.0]
    cols = {"p": x[:, 0], "q": x[:, 1], "y": y}
    sums = pd.DataFrame([{f"{a}*{b}": float(cols[a] @ cols[b]) for a in sorted(cols) for b in sorted(cols) if a <= b}])
    np.testing.assert_allclose(inference.ridge(sums, "y", ["p", "q"], 1e-9), [2, -1], atol=1e-6)


def hac(v, lag):
    c = v - v.mean()
    var = (c @ c + 2 * sum((1 - k / (lag + 1)) * (c[k:] @ c[:-k]) for k in range(1, lag + 1))) / len(v)
    return v.mean() / np.sqrt(var / len(v))


def test_bootstraps_equal_a_plain_version(spark):
    rng = np.random.default_rng(4)
    n, block, draws, lag, names = 41, 6, 60, 3, ["a", "b", "c"]
    x = rng.normal(size=(n, 3)) + [0.9, 0.02, -0.7]
    starts = rng.integers(0, n, size=(draws, -(-n // block)))
    at = [((row[:, None] + np.arange(block)) % n).reshape(-1)[:n] for row in starts]
    series = spark.createDataFrame([(m, i, float(x[i, j])) for j, m in enumerate(names) for i in range(n)], "signal string, pos int, value double")
    drawn = spark.createDataFrame([(d, k, int(v)) for d, row in enumerate(starts) for k, v in enumerate(row)], "draw int, block_no int, start int")
    centred = x - x.mean(axis=0)
    null = np.array([[hac(centred[i][:, j], lag) for j in range(3)] for i in at])
    got = {(r.signal, r.draw): r.t for r in inference.bootstrap_t(series, drawn, block, n, lag).collect()}
    for j, m in enumerate(names):
        np.testing.assert_allclose([got[m, d] for d in range(draws)], null[:, j], rtol=1e-8)
    t = [float(hac(x[:, j], lag)) for j in range(3)]
    tests = spark.createDataFrame(list(zip(names, t, strict=True)), "signal string, t_nw double")
    table = spark.createDataFrame([(m, d, float(null[d, j])) for j, m in enumerate(names) for d in range(draws)], "signal string, draw int, t double")
    left, rejected = [0, 1, 2], set()
    while left:
        bar = np.quantile(np.abs(null[:, left]).max(axis=1), 0.9)
        new = [j for j in left if abs(t[j]) > bar]
        rejected |= {names[j] for j in new}
        left = [j for j in left if j not in new] if new else []
    out = inference.romano_wolf(tests, table, 0.1).collect()
    assert rejected and {r.signal for r in out if r.rejected} == rejected and "b" not in rejected
    controls = spark.createDataFrame([("b",)], "signal string")
    verdict = {r.signal: r for r in inference.pool_verdict(tests, table, controls, 0.1).collect()}
    bar = np.quantile(np.abs(null[:, 1]), 0.9)
    for j, m in enumerate(names):
        assert verdict[m].passes_flat == (abs(t[j]) > 3) and verdict[m].passes_random == (abs(t[j]) > bar)
        assert verdict[m].passes_romano_wolf == (m in rejected)
    d = x[:, 0] - x[:, 1]
    means = np.array([d[i].mean() for i in at])
    pairs = spark.createDataFrame([(i, float(x[i, 0]), float(x[i, 1])) for i in range(n)], "pos int, x double, y double")
    r = inference.paired_bootstrap(pairs, "x", "y", drawn, block, n).first()
    np.testing.assert_allclose([r.observed, r.lo, r.hi], [d.mean(), *np.quantile(means, [0.025, 0.975])], rtol=1e-9)
    assert r.p == pytest.approx((np.abs(means - means.mean()) >= abs(d.mean())).mean())


def test_expected_largest_t_and_permutations(spark):
    rng = np.random.default_rng(9)
    out = {r.n: r.expected for r in inference.expected_max_t(spark.createDataFrame([(1,), (10,), (400,), (0,)], "n int")).collect()}
    assert out[1] == pytest.approx(np.sqrt(2 / np.pi), abs=1e-5) and out[0] is None
    for n in (10, 400):
        assert out[n] == pytest.approx(np.abs(rng.normal(size=(20_000, n))).max(axis=1).mean(), abs=0.02)
    far = [(True, float(v)) for v in range(10)] + [(False, float(v + 50)) for v in range(10)]
    near = [(bool(i % 2), float(v)) for i, v in enumerate(range(20))]
    p = [inference.permutation_medians(spark.createDataFrame(x, "group boolean, value double"), 200, 3).first() for x in (far, near)]
    assert p[0].seen == 50 and p[0].p < 0.02 and p[1].p > 0.3


def test_sector_caps_hold_and_full_sectors_make_way(spark):
    rng = np.random.default_rng(5)
    rows = [(DAYS[d], k, float(rng.random()), f"s{k % 3}") for d in range(4) for k in range(20)] + [(DAYS[0], 99, None, "s0")]
    kind = "date date, permno long, score double, sector string"
    for k, cap, most in ((8, 0.2, 0.5), (5, 0.1, 0.15), (10, 0.3, 1.0)):
        out = portfolio.capped_weights(spark.createDataFrame(rows, kind), k, cap, most).toPandas()
        for day in DAYS[:4]:
            order = sorted((r for r in rows if r[0] == day and r[2] is not None), key=lambda r: (-r[2], r[1]))
            want, used = {}, {}
            for _, key, _, s in order:  # each name a share of 1 / k, if its sector has room
                give = min(1 / k, cap, most - used.get(s, 0.0))
                if len(want) < k and give > 1e-10:
                    want[key], used[s] = give, used.get(s, 0.0) + give
            rest = 1 - sum(want.values())
            for _, key, _, s in order:  # then up to the cap
                give = min(rest, cap - want.get(key, 0.0), most - used.get(s, 0.0))
                if (key in want or len(want) < k) and give > 1e-10:
                    want[key], used[s], rest = want.get(key, 0.0) + give, used.get(s, 0.0) + give, rest - give
            got = out[out.date == day].set_index("key").weight.to_dict()
            assert got == pytest.approx(want)


def test_folds_start_afresh_and_trades_are_bounded(spark):
    rows = [(DAYS[d], k, float(k), 10.0, 10.1, 10.0, 1e9, 0.0) for d in range(10) for k in range(5)]
    kind = "date date, permno long, score double, entry double, exit double, mark double, adv double, vol double"
    folds = [(1, str(DAYS[0]), str(DAYS[4])), (2, str(DAYS[5]), str(DAYS[9]))]
    out = portfolio.walk_forward(spark.createDataFrame(rows, kind), folds, k=2, equity=1000.0, cash=0.0).toPandas()
    first = out.sort_values("date").groupby("fold").first()
    assert np.allclose(first.turnover, 0.5) and np.allclose(first.cost, 0.001) and np.allclose(first.equity, 1.009)
    thin = [(*r[:6], 1000.0, r[7]) for r in rows]
    slow = portfolio.walk_forward(spark.createDataFrame(thin, kind), folds, k=2, equity=1000.0, cash=0.0).toPandas()
    assert np.allclose(slow.sort_values("date").groupby("fold").first().turnover, 0.05)  # 50 of each name


def test_asof_takes_the_last_known(spark):
    g = spark.createDataFrame([(1, DAYS[i]) for i in range(5)], "key long, date date")
    e = spark.createDataFrame([(1, DAYS[1], 1, 10.0), (1, DAYS[1], 2, 11.0), (1, DAYS[3], 3, None), (2, DAYS[0], 4, 5.0)], "key long, known date, seq int, v double")
    out = panel.asof_join(g, e, "key", "date", "known", ["v"], ["seq"]).orderBy("date").collect()
    assert [r.v for r in out] == [None, 11.0, 11.0, None, None]


def test_interval_expansion_clips_to_the_calendar(spark):
    days = spark.createDataFrame([(d,) for d in DAYS], "date date")
    iv = spark.createDataFrame([(1, DAYS[0] - dt.timedelta(9), DAYS[2]), (2, DAYS[38], None), (3, DAYS[5], DAYS[4])], "k long, b date, e date")
    got = sorted((r.k, r.date) for r in panel.expand_intervals(iv, days, "b", "e").collect())
    assert got == [(1, DAYS[0]), (1, DAYS[1]), (1, DAYS[2]), (2, DAYS[38]), (2, DAYS[39])]


def test_simulated_folds_tell_unchosen_names_from_those_that_left(spark):
    kind = "date date, permno long, score double, entry double, exit double, mark double, adv double, vol double"
    day = lambda d, k, score, adv: (DAYS[d], k, score, 10.0, 10.0, 10.0, adv, 0.0)
    turn = lambda rows: portfolio.walk_forward(spark.createDataFrame(rows, kind), [(1, str(DAYS[0]), str(DAYS[1]))], k=1, equity=1000.0, cash=0.0).toPandas().sort_values("date").turnover.tolist()
    # 50 of a name that isn't chosen the next day stay, as the change is below the least trade; the other name is bought
    assert turn([day(0, 1, 2.0, 1000.0), day(0, 2, 1.0, 1000.0), day(1, 1, 1.0, 1000.0), day(1, 2, 2.0, 1000.0)]) == pytest.approx([0.025, 25 / 999.95])  # after a cost of a thousandth of what was bought
    # 1,000 of a name without a score go whole, though the market takes 50 a day of the other
    assert turn([day(0, 1, 2.0, 1e9), day(0, 2, 1.0, 1e9), day(1, 1, None, 1000.0), day(1, 2, 2.0, 1000.0)]) == pytest.approx([0.5, 525 / 999.0])


def test_band_pairs_are_all_pairs_and_spread_over_tasks(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "x" if i % 7 else "y", None if i % 11 == 0 else round(float(rng.uniform(-6, 6)), 1)) for i in range(150)] + [(150, None, 1.0), (3, "x", 0.5)]
    out = panel.band_pairs(spark.createDataFrame(rows, "k long, g string, v double"), "k", "g", "v", 1.0)
    met = [(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] is not None and a[1] == b[1] and a[2] is not None and b[2] is not None and abs(a[2] - b[2]) <= 1.0]
    assert sorted((r.a, r.b) for r in out.collect()) == sorted(met)
    one = panel.band_pairs(spark.createDataFrame([(i, "x", i) for i in range(300)], "k long, g string, v int"), "k", "g", "v", 1)
    parts = one.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert sum(r["count"] for r in parts) == 299 and len(parts) > 1  # one group isn't one task


def test_feature_ranks_are_those_of_windows_in_one_pass(spark):
    from tessera.functions import percent_rank_average

    rng = np.random.default_rng(5)
    rows = [(k, d, *(None if rng.random() < 0.1 else float(rng.integers(1, 4)) for _ in range(6))) for k in range(12) for d in DAYS if rng.random() > 0.1]
    bars = spark.createDataFrame(rows, "permno long, date date, high double, low double, close double, adj_close double, volume double, dollar_volume double")
    out = portfolio.features(bars, windows=(1, 3, 12))
    rising = {"mom_1", "mom_3", "mom_12", "volume_accel"}
    names = sorted(c for c in out.columns if c.startswith("rank_"))
    plain = portfolio.series_features(bars, windows=(1, 3, 12)).select(
        "permno", "date", *[percent_rank_average(F.col(n[5:]) if n[5:] in rising else -F.col(n[5:]), "date").alias(n) for n in names]
    )
    told = lambda df: sorted((tuple(r) for r in df.select("permno", "date", *names).collect()), key=lambda r: r[:2])
    assert len(names) == 7 and told(out) == told(plain)
    kept = portfolio.features(bars, windows=(1, 3, 12), keep=["adv20"])
    assert kept.columns == ["permno", "date", "adv20", "score"]
    assert sorted(map(str, kept.select("permno", "date", "score").collect())) == sorted(map(str, out.select("permno", "date", "score").collect()))
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("\n") and sum("Sort [" in line for line in plan.splitlines()) == 1 and "rank(" not in plan  # whole dates are sorted once
