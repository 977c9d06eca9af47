"""One query for every function of the formula language, and pools of formulas."""

from __future__ import annotations

from tessera.functions import rounded
from tessera.plans.compile import evaluate, to_sql
from tessera.queries.base import GRID, USER_DAYS, gaps, grid, query, r

#: Every function alone or in a small formula; the first letter names the panel (b: bars, g: with gaps).
FORMULAS = {
    "b_arithmetic": "($close - $open) * 2 / ($high - $low) + $volume / 100 - -$open",
    "b_compare_if": "IF($close > $open, $high, $low) + IF($close <= $open, 1, 2) * IF($close >= $low, 1, 0) - IF($low < $high, 1, 0)",
    "b_min_max": "MIN($open, $close) + MAX($open, $close, TS_MEAN($close, 3))",
    "b_abs_sign": "ABS($return) + SIGN($return)",
    "b_log_sqrt": "LOG($return) + SQRT($volume)",
    "b_power_bound": "POWER(BOUND($return, -0.5, 0.5), 2) + POWER($close / $open, 0.5)",
    "b_ts_mean": "TS_MEAN($close, 5)",
    "b_ts_std": "TS_STD($return, 6)",
    "b_ts_max": "TS_MAX($high, 4)",
    "b_ts_min": "TS_MIN($low, 4)",
    "b_ts_sum": "TS_SUM($volume, 6)",
    "b_ts_rank": "TS_RANK($close, 6)",
    "b_ts_product": "TS_PRODUCT(1 + $return, 4)",
    "b_ts_argmax": "TS_ARGMAX($close, 6)",
    "b_ts_argmin": "TS_ARGMIN($close, 6)",
    "b_ts_decay_linear": "TS_DECAY_LINEAR($close, 5)",
    "b_ts_delta": "TS_DELTA($close, 3)",
    "b_delay": "DELAY($volume, 2)",
    "b_ema": "EMA($close, 5)",
    "b_ts_corr": "TS_CORR($close, $volume, 8)",
    "b_ts_cov": "TS_COV($return, $volume, 6)",
    "b_count": "COUNT($close > $open, 6)",
    "b_rank": "RANK($return)",
    "b_zscore": "ZSCORE($volume)",
    "b_cs_demean": "CS_DEMEAN($close)",
    "g_ts_mean": "TS_MEAN($close, 3)",
    "g_ts_rank": "TS_RANK($volume, 4)",
    "g_ema": "EMA($close, 3)",
    "g_ts_corr": "TS_CORR($close, $volume, 4)",
    "g_count": "COUNT($close > 50, 3)",
    "g_rank": "RANK($open)",
    "g_if_missing": "IF($close > 50, MIN($low, $high), MAX($low, DELAY($close, 1)))",
    "g_divide": "($open - 1) / ($open - 1)",
}
#: A pool that shares subtrees; all its formulas are one plan.
POOL = [
    "RANK(TS_DELTA($close, 3) / (TS_STD($close, 6) + 1e-8))",
    "-TS_DELTA($close, 1) / TS_STD($close, 6)",
    "RANK($volume / TS_MEAN($volume, 6))",
    "TS_CORR(RANK($close), RANK($volume), 6)",
    "ZSCORE(TS_MEAN($return, 3))",
    "TS_RANK($close, 6) - TS_RANK($volume, 6)",
    "TS_DECAY_LINEAR(RANK($return), 4)",
    "IF($close > TS_MEAN($close, 6), RANK($return), -RANK($return))",
    "EMA($close, 3) / EMA($close, 8) - 1",
    "TS_ARGMAX($close, 6) - TS_ARGMIN($close, 6)",
    "CS_DEMEAN(TS_SUM($return, 6))",
    "RANK(TS_MEAN($high - $low, 4)) * RANK($volume)",
    "TS_COV(RANK($high), RANK($volume), 5)",
    "TS_MAX($high, 6) / $close - 1",
    "$close / TS_MIN($low, 6) - 1",
    "LOG($volume / DELAY($volume, 1))",
    "TS_PRODUCT(1 + $return, 3) - 1",
    "COUNT($return > 0, 6) / 6",
    "RANK(TS_CORR($close, $volume, 8)) - RANK(TS_STD($return, 6))",
    "BOUND(ZSCORE($return), -2, 2)",
]
POOL_NAMES = {f"f{i:02d}": text for i, text in enumerate(POOL)}


def _register(name: str, text: str) -> None:
    source, table, made = (GRID, "grid", grid) if name[0] == "b" else (USER_DAYS, "gaps", gaps)
    inner = to_sql(table, {"value": text})

    def run(spark, sf_dir, made=made, text=text):
        return evaluate(made(spark, sf_dir), {"value": text}).select("key", "date", rounded("value").alias("value"))

    query(f"WITH {source} SELECT key, date, {r('value')} AS value FROM ({inner})", f"formula_{name}")(run)


for _name, _text in FORMULAS.items():
    _register(_name, _text)

_POOL_COLUMNS = ", ".join(f"{r(n)} AS {n}" for n in POOL_NAMES)


@query(f"WITH {GRID} SELECT key, date, {_POOL_COLUMNS} FROM ({to_sql('grid', POOL_NAMES)})")
def formula_pool(spark, sf_dir):
    """Twenty formulas in one plan."""
    values = evaluate(grid(spark, sf_dir), POOL_NAMES)
    return values.select("key", "date", *[rounded(n).alias(n) for n in POOL_NAMES])
