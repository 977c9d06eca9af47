"""Reference data, sources and portfolio helpers on small tables."""

import pytest

from pyspark.sql import functions as F

from tessera.operators import panel, portfolio, quality, reference
from tessera.search.evolve import NICHES, Archive, Candidate, places, replace, text_gates
from tessera.plans.formula import parse
from tessera.sources import tables


def test_sectors_follow_the_ranges(spark):
    rows = [("3571",), ("2834",), ("100",), ("8011",), ("9999",), ("x",), (None,), ("6020.0",)]
    got = [r.s for r in spark.createDataFrame(rows, "c string").select(reference.sector_of(__import__("pyspark").sql.functions.col("c")).alias("s")).collect()]
    assert got == ["Information Technology", "Industrials", "Energy", "Health Care", "Unknown", "Unknown", "Unknown", "Financials"]


def test_ratios_fall_back_and_stay_finite(spark):
    names = "ceqq double, seqq double, dlttq double, dlcq double, niq double, atq double, oiadpq double, revtq double, cshoq double, ibq double"
    row = spark.createDataFrame([(None, 4.0, None, 2.0, 1.0, 10.0, None, 5.0, 2.0, 3.0)], names)
    r = reference.ratios(row).first()
    assert r.roe == pytest.approx(0.25) and r.leverage == pytest.approx(0.2) and r.operating_margin is None and r.accrual_gap is None


def test_snapshot_names_and_tickers(spark):
    out = reference.snapshot(spark.createDataFrame([(" brk.b ", "B", "Fin"), ("BRK.B", "B", "Fin")], ["Symbol", "Security", "GICS Sector"])).collect()
    assert [(r.Code, r.Name, r.Sector, r.Industry) for r in out] == [("BRK-B", "B", "Fin", None)]
    with pytest.raises(ValueError):
        reference.snapshot(spark.createDataFrame([(1,)], ["x"]))


@pytest.mark.parametrize("n", [0, 1, 5, 100])
def test_even_sample_has_both_ends(spark, n):
    got = sorted(r.id for r in reference.even_sample(spark.range(n), ["id"], 10).collect())
    if n:
        assert got[0] == 0 and got[-1] == n - 1 and len(got) == min(n, 10)
    else:
        assert got == []


def test_even_sample_over_many_ranges(spark):
    """Ranges are drawn anew by every job, so what one job counts must be what the other reads."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(0, 300_000, 1, 12).select((F.xxhash64("id") % 1_000_000_007).alias("id"))
        ids = sorted(r.id for r in df.collect())
        for _ in range(2):
            got = sorted(r.id for r in reference.even_sample(df, ["id"], 32).collect())
            assert got == [ids[int(i * (len(ids) - 1) / 31)] for i in range(32)]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_niches_are_those_of_the_search():
    assert len(NICHES) == 18
    niche = lambda text, **m: Candidate(text, 1.0, m).niche
    assert niche("$close * $volume", half_life=5.0, turnover=0.3123) == ("medium", "price_volume", "low")
    assert niche("$roa / $close", half_life=4.9, turnover=0.32) == ("fast", "mixed", "high")
    assert niche("RANK($roe)", half_life=21.5, turnover=0.5, turnover_cut=0.5) == ("slow", "fundamental", "low")
    assert niche("$close") in NICHES


def test_turnover_cap_blends(spark):
    old = spark.createDataFrame([("a", 1.0)], "key string, weight double")
    new = spark.createDataFrame([("b", 1.0)], "key string, weight double")
    told = lambda *a, **k: {r.key: r.weight for r in portfolio.cap_turnover(*a, **k).collect()}
    assert told(old, new, 0.25) == {"a": pytest.approx(0.75), "b": pytest.approx(0.25)}
    assert told(old, new, 0.25, cap=0.5) == {"a": pytest.approx(0.5), "b": pytest.approx(0.25)}
    assert told(old, new, 0.25, total=0.5) == {"a": pytest.approx(0.375), "b": pytest.approx(0.125)}
    assert told(old, new, 1.0, cap=0.5) == {"b": 1.0} and told(old.limit(0), new, 0.25) == {"b": 1.0}


def test_orders_sell_no_more_than_is_held(spark):
    target = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "key string, weight double")
    held = spark.createDataFrame([("b", 900.0, 10.0, 90.0), ("c", 300.0, 2.0, 100.0), ("d", 50.0, 1.0, 0.0), ("e", 0.4, 1.0, 0.4)], "key string, market_value double, qty double, price double")
    out = {r.key: r for r in portfolio.order_intents(target, held, 1000.0).collect()}
    assert (out["a"].side, out["a"].submit_mode, out["a"].notional, out["a"].qty) == ("buy", "notional", 500.0, None)
    assert (out["b"].side, out["b"].submit_mode, out["b"].qty) == ("sell", "qty", pytest.approx(4.444444))
    assert out["c"].qty == 2.0 and (out["d"].submit_mode, out["d"].notional) == ("notional", 50.0) and "e" not in out


def test_rebalance_rounds_cuts_and_liquidates(spark):
    rows = [
        ("a", 0.0, 10.0, 1e9, 0.5, True), ("b", 0.0, 10.0, 1000.0, 0.5, None), ("c", 7.0, 10.0, None, None, False), ("d", 9.5, 100.0, 1e9, 1.0, True),
        ("kept", 5.0, 10.0, 1e9, None, True),  # not chosen, worth 50: under the least trade
        ("cut", 100.0, 10.0, 1000.0, None, True),  # not chosen, worth 1,000: the market takes 50
        ("left", 100.0, 10.0, 1000.0, None, False),  # left the table: sold whole, whatever the market takes
    ]
    p = spark.createDataFrame(rows, "key string, shares double, entry double, adv double, target double, present boolean")
    out = {r.key: r for r in portfolio.rebalance(p, F.lit(1000.0), cash=0.0, participation=0.05, fractional=False).collect()}
    assert out["a"].new_shares == 50 and out["b"].new_shares == 5 and out["c"].new_shares == 0 and out["c"].notional == 70
    assert out["d"].new_shares == 9  # 50 is too small a change, and shares are whole
    assert out["kept"].new_shares == 5 and out["cut"].new_shares == 95 and out["left"].new_shares == 0


def test_pre_and_post_trade_checks(spark):
    signals = spark.createDataFrame([("a", 0.1), ("b", 0.05)], "key string, weight double")
    orders = spark.createDataFrame([("buy", 300.0, None, None, None), ("sell", None, None, 2.0, 50.0)], "side string, delta_value double, notional double, qty double, price double")
    limits = quality.RiskLimits(gross=0.4, order_value=250.0)
    told = lambda **k: {r.check: (r.value, r.passed) for r in quality.pre_trade(signals, orders, 1000.0, 299.0, limits, **k).collect()}
    out = told(universe=signals.where("key = 'a'"), latest="2024-01-02", as_of="2024-01-03", halted=True)
    assert out["PT-01"] == (400.0, True) and out["PT-02"] == (300.0, False) and out["PT-03"] == (1.0, False) and out["PT-04"] == (1.0, False)
    assert out["PT-05"] == (2.0, True) and out["PT-06"] == (300.0, False) and not out["PT-07"][1] and out["PT-08"][1]
    assert told()["PT-03"][1] and told()["PT-04"][1]
    none = {r.check: r.passed for r in quality.pre_trade(signals.limit(0), orders.limit(0), 1000.0, 0.0).collect()}
    assert not none["PT-05"] and none["PT-01"] and none["PT-06"]
    positions = spark.createDataFrame([("a", 100.0), ("c", 20.0)], "key string, market_value double")
    fills = spark.createDataFrame([("filled", 101.5, 100.0), ("Rejected", None, 100.0)], "status string, fill double, expected double")
    post = {r.check: (r.value, r.passed) for r in quality.post_trade(signals, positions, fills, 1000.0, 10.0).collect()}
    assert post["PT-09"] == (1.0, False) and post["PT-10"] == (pytest.approx(150.0), False) and post["PT-11"] == (pytest.approx(0.05), False)
    assert post["PT-12"] == (10.0, False)


def test_gaps_are_counted_in_business_days(spark):
    rows = [("a", "2024-01-05"), ("b", "2024-01-04"), ("c", "2023-12-29"), ("d", "2024-01-08"), ("e", "2023-11-01")]
    bars = spark.createDataFrame(rows, "k string, d string").select("k", F.to_date("d").alias("date"))
    out = {r.k: (r.gap, r.severity) for r in quality.gap_backfill(bars, F.to_date(F.lit("2024-01-08")), 6, by=("k",)).collect()}
    assert out == {"a": (1, "info"), "b": (2, "warning"), "c": (6, "warning"), "d": (0, "info"), "e": (48, "critical")}


def test_nearest_dates_on_either_side(spark):
    days = spark.createDataFrame([("2024-01-02",), ("2024-01-05",)], "d string").select(F.to_date("d").alias("date"))
    asked = spark.createDataFrame([("2024-01-01",), ("2024-01-03",), ("2024-01-05",), ("2024-01-09",)], "a string").select(F.to_date("a").alias("at"))
    told = lambda after: [str(r.date) for r in panel.nearest_date(days, asked, "at", after).orderBy("at").collect()]
    assert told(False) == ["None", "2024-01-02", "2024-01-05", "2024-01-05"] and told(True) == ["2024-01-02", "2024-01-05", "2024-01-05", "None"]


def test_gates_fail_without_a_value():
    assert portfolio.gates({"sharpe": 1.0}, {"sharpe": (">=", 0.5), "drawdown": ("<=", 0.2)}) == {"sharpe": True, "drawdown": False}


def test_quality_report_is_lenient_where_asked(spark):
    bad = spark.range(3)
    rows = {r.check: (r.violations, r.ok) for r in quality.report({"a": bad, "b": bad, "c": bad.limit(0)}, ("b",)).collect()}
    assert rows == {"a": (3, False), "b": (3, True), "c": (0, True)}


def test_archive_evicts_the_weakest_and_refuses_duplicates():
    a = Archive(capacity=2)
    made = [a.add(Candidate(f"TS_MEAN($close, {w})", float(w), {"half_life": 1.0})) for w in (3, 5, 4, 2)]
    assert made == [True, True, True, False] and [c.fitness for c in a.all()] == [5.0, 4.0]
    assert not a.add(Candidate("TS_MEAN($close, 5)", 9.0)) and not a.add(Candidate("$close", float("nan")))
    assert text_gates(parse("TS_MEAN($close, 5)"), a, []) == "duplicate"
    assert text_gates(parse("RANK(TS_CORR($open, TS_MEAN($close, 3), 5) * RANK($volume))"), a, [parse("RANK(TS_CORR($open, TS_MEAN($close, 3), 5) * RANK($volume))")]) == "published"


def test_tree_paths_replace_what_they_name():
    node = parse("RANK($close + TS_MEAN($open, 5))")
    for path, old, _ in places(node):
        assert replace(node, path, old) == node


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="close"):
        tables.require(spark.range(1), ["id", "close"])
    assert tables.first_named(spark.createDataFrame([(-2.0,)], ["prc"]), "close", ["px", "prc"], magnitude=True).first().close == 2.0
