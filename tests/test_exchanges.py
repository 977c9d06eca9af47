"""What is moved between tasks: wide rows once, fields in place of what is made of them, and equal results for it."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import gram, panel, scoring
from tessera.plans.compile import evaluate, late, schedule
from tessera.plans.formula import canonical, parse, render
from tessera.queries import scores

POOL = {
    "a": "RANK(TS_MEAN(RANK($close), 3))", "b": "TS_MEAN($close, 5) / $open", "c": "EMA($close, 3) / EMA($close, 8) - 1", "d": "TS_MIN(EMA($close, 3), 4)", "e": "ZSCORE(TS_DELTA($close, 2))",
    "f": "$close / ($open - $open)", "g": "TS_RANK($volume, 4) * RANK($volume)", "h": "$volume", "i": "RANK(ZSCORE(RANK($open)))", "j": "IF($close > $open, TS_STD($close, 3), -$open)",
}


@pytest.fixture(scope="module")
def grid(spark):
    rng = np.random.default_rng(8)
    start, rows = dt.date(2020, 1, 1), []
    for k in range(20):
        for t in range(30):
            x = [None if rng.random() < 0.05 else float(v) for v in rng.normal(10, 2, 3).round(1)]
            rows.append((k, start + dt.timedelta(t), *x))
    return spark.createDataFrame(rows, "key long, date date, open double, close double, volume double").repartition(5).persist()


def told(df):
    return {tuple(r)[:2]: [None if v is None else float(f"{v:.9g}") if math.isfinite(v) else str(v) for v in tuple(r)[2:]] for r in df.collect()}


def moved(df):
    """Columns of each exchange, from the first to the last."""
    plan = df._jdf.queryExecution().executedPlan()
    if plan.nodeName() == "AdaptiveSparkPlan":
        plan = plan.initialPlan()
    out = []

    def walk(node):
        if node.nodeName() == "Exchange":
            out.insert(0, node.output().size())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(plan)
    return out


def test_fields_are_moved_in_place_of_what_is_made_of_them(grid):
    deep = "RANK(TS_MEAN(RANK($close), 3))"
    alone = moved(evaluate(grid, {"a": deep}, by_date=True))
    pool = {f"f{w}": f"TS_MEAN($close, {w})" for w in range(2, 12)} | {"a": deep}
    many = moved(evaluate(grid, pool, by_date=True))
    assert len(many) == len(alone) == 3
    assert [b - a for a, b in zip(alone, many, strict=True)] == [0, 1, 10]  # before the last one it is one field


def test_late_columns_are_those_of_each_formula_alone(grid):
    labels = panel.forward_returns(grid, [1, 3]).select("key", "date", "fwd_1", "fwd_3")
    out = evaluate(grid, POOL, series=panel.forward_columns([1, 3]), needs=["open"], by_date=True).persist()
    assert out.columns == ["key", "date", "fwd_1", "fwd_3", *POOL]
    assert told(out.select("key", "date", "fwd_1", "fwd_3")) == told(labels)
    for name, text in POOL.items():
        assert told(out.select("key", "date", name)) == told(evaluate(grid, {name: text}).select("key", "date", name)), text
    parts = [r.date for r in out.select("date", F.spark_partition_id().alias("p")).distinct().collect()]
    assert len(parts) == len(set(parts)) == 30
    runs = out.select("date").rdd.mapPartitions(lambda rows: [[r.date for r in rows]]).collect()
    assert all(len(set(days)) == 1 + sum(a != b for a, b in zip(days, days[1:], strict=False)) for days in runs if days)
    out.unpersist()


def test_passes_hold_each_node_once_after_what_it_is_made_of():
    names, plan = schedule([canonical(parse(t)) for t in POOL.values()])
    for phases in (len(plan), len(plan) + 1, len(plan) + 2):
        seen = set()
        for kind, levels, arrow in late(names, phases):
            for nodes in [*levels, arrow]:
                assert all(c in seen for n in nodes for c in n.children if c in names) and not seen & set(nodes)
                assert all(n.kind in ("element", kind) for n in nodes), [render(n) for n in nodes]
                seen |= set(nodes)
        assert seen == set(names)


def test_dealt_rows_are_not_moved_again(grid):
    names = [n for n in POOL if n != "h"]
    wide = evaluate(grid, POOL, series=panel.forward_columns([1]), needs=["open"], by_date=True).persist()
    plain = evaluate(panel.forward_returns(grid, [1]), POOL, keep=["fwd_1"])
    moves = (0, 0, 2)  # of turnover: weights by key, and their sums by date
    for i, f in enumerate((
        lambda x, **kw: gram.rank_ic(x, names, ["fwd_1"], 5, **kw).select("date", "signal", "ic", "n").select(F.concat("date", "signal"), "n", "ic"),
        lambda x, **kw: gram.rank_correlations(x, names, ["h", *names], 5, **kw),
        lambda x, **kw: gram.turnover(x, names, **kw).select("signal", F.lit(0), "turnover"),
    )):
        got = f(wide, dealt=True)
        assert told(got) == told(f(plain)) != {}
        assert sum(n > 5 for n in moved(got)) == moves[i]
    wide.unpersist()


def test_autocorrelation_of_columns_is_that_of_long_rows(spark, grid):
    values = evaluate(grid, POOL).withColumns({"none": F.lit(None).cast("double"), "flat": F.lit(2.0)})
    some = values.withColumn("c", F.when(F.col("key") != 3, F.col("c"))).withColumn("b", F.when((F.col("key") == 4) & (F.day("date") == 9), float("inf")).otherwise(F.col("b")))
    names = [*POOL, "none", "flat"]
    short = lambda df: {r.signal: None if r.autocorr is None else round(r.autocorr, 9) if math.isfinite(r.autocorr) else str(r.autocorr) for r in df.collect()}
    got = short(gram.autocorrelation(some, names))
    assert got == short(scoring.autocorrelation(scoring.melt(some, names)))
    assert got["flat"] is None and "none" not in got and got["b"] == "nan" and 0 < abs(got["c"]) < 1
    assert gram.autocorrelation(some.limit(0), names).count() == 0


def test_baselines_move_no_row_for_a_formula_and_a_name(spark):
    """Rows that the query's jobs shuffle are few for each bar, whatever the number of formulas."""
    from tests.conftest import DATA

    bars = scores.grid(spark, DATA).count()
    seen = len(_stages(spark))
    assert len(scores.search_baselines(spark, DATA).collect()) == 2
    moved_rows = sum(_stages(spark)[seen:])
    assert moved_rows < 20 * bars


def test_a_round_of_the_search_moves_its_rows_by_key_by_date_and_by_key(spark):
    from tests.conftest import DATA

    from tessera.queries.extras import scorer

    cells, score = scores.grid(spark, DATA).count(), scorer(spark, DATA)
    texts = ["RANK(TS_MEAN($close, 3))", "TS_STD($volume, 5)", "-$return"]
    first = score(texts)  # makes the bars too
    seen = len(_stages(spark))
    assert score(texts) == first and set(first) == set(texts)
    assert sum(records == cells for records in _stages(spark)[seen:]) <= 3  # pool, correlations and turnover


def _stages(spark):
    """Rows that each stage wrote for exchanges, in the order of stages."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return [n for _, n in sorted((stages.apply(i).stageId(), stages.apply(i).shuffleWriteRecords()) for i in range(stages.size()))]
