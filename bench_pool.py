"""Time a whole pool at the size of a real panel: about a million rows, hundreds of formulas, ten labels.

The panel is the one that the queries make from lineitem, each key as several
with prices of their own.  Prints one JSON line; ``BENCH_POOL`` sets the number
of formulas and ``BENCH_COPIES`` that of copies.
"""

from __future__ import annotations

import itertools
import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.operators import gram, panel
from tessera.plans.compile import evaluate
from tessera.queries import base

TEMPLATES = (
    "RANK(TS_DELTA($close, {w}))", "TS_MEAN($return, {w}) / TS_STD($return, {w})", "TS_RANK($volume, {w})", "RANK($close / TS_MAX($high, {w}))", "TS_CORR($close, $volume, {w})",
    "ZSCORE(TS_SUM($return, {w}))", "TS_ARGMAX($high, {w}) - TS_ARGMIN($low, {w})", "EMA($close, {w}) / $close - 1", "TS_DECAY_LINEAR($return, {w})", "RANK(TS_STD($return, {w})) * RANK($volume)",
    "$close / TS_MEAN($close, {w}) - 1", "TS_COV(RANK($high), RANK($volume), {w})", "CS_DEMEAN(TS_MEAN($volume, {w}))", "TS_MIN($low, {w}) / $close", "RANK(TS_RANK($close, {w}) - TS_RANK($volume, {w}))",
)


def main() -> None:
    many, copies = int(os.environ.get("BENCH_POOL", "400")), int(os.environ.get("BENCH_COPIES", "12"))
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", str(4 * cpus)).config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    factor = 1 + (F.xxhash64("key", "date", "copy") % 1000) / 20_000
    grid = base.grid(spark, sf_dir).select("*", F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("copy"))
    grid = grid.withColumns({c: F.col(c) * factor for c in ("open", "high", "low", "close", "volume", "return")}).withColumn("key", F.col("key") * 1000 + F.col("copy")).drop("copy")
    labelled = panel.forward_returns(grid, [1, 2, 3, 4, 5], False)
    path = os.environ.get("BENCH_SCRATCH", "/tmp") + f"/bench-pool-{os.getpid()}"
    labelled.repartition(4 * cpus, "key").write.parquet(path)
    labelled = spark.read.parquet(path)
    rows = labelled.count()
    formulas = {f"f{i:03d}": t.format(w=w) for i, (w, t) in enumerate(itertools.islice(itertools.product(range(2, 60), TEMPLATES), many))}
    labels = [f"fwd_{h}" for h in (1, 2, 3, 4, 5)]
    began = time.perf_counter()
    ic = gram.rank_ic(evaluate(labelled, formulas, keep=labels), list(formulas), labels, 30)
    planned = time.perf_counter()
    n = ic.groupBy("signal", "label").agg(F.avg("ic").alias("mean")).count()
    seconds = time.perf_counter() - began
    rate = rows * many * len(labels) / seconds
    print(json.dumps({"metric": "pool_ic", "value": round(seconds, 1), "unit": "sec", "plan_sec": round(planned - began, 1), "rows": rows, "formulas": many, "labels": len(labels), "means": n, "formula_rows_labels_per_sec": round(rate)}))
    spark.stop()


if __name__ == "__main__":
    main()
