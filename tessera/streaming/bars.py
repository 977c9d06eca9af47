"""Structured Streaming forms: bars from ticks, keep-last ingest and a stateful monitor."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def ticks(spark: SparkSession, path: str, schema, name: str = "*.parquet") -> DataFrame:
    """A stream over the parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).option("pathGlobFilter", name).parquet(path)


def drain(stream: DataFrame, path: str, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there now; each batch's result goes to ``path``."""
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{path}/data")

    sink = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    sink.foreachBatch(write).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/data")


def tick_bars(stream: DataFrame, key: str = "user_id", width: str = "1 day", lateness: str = "7 days", slide: str | None = None) -> DataFrame:
    """Open, high, low, close, volume and count for each window and key; later rows than ``lateness`` are dropped."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return (
        stream.withWatermark("ts", lateness)
        .groupBy(window.alias("w"), key)
        .agg(
            F.min_by("value", F.struct("ts", "event_id")).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
            F.max_by("value", F.struct("ts", "event_id")).alias("close"), F.sum("value").alias("volume"), F.count("*").alias("n"),
        )
        .select(F.to_date("w.start").alias("date"), F.col("w.start").alias("start"), key, "open", "high", "low", "close", "volume", "n")
    )


def sessions(stream: DataFrame, key: str = "user_id", gap: str = "1 hour", lateness: str = "7 days") -> DataFrame:
    """Runs of a key's ticks without a longer pause than ``gap``."""
    return (
        stream.withWatermark("ts", lateness)
        .groupBy(F.session_window("ts", gap).alias("w"), key)
        .agg(F.count("*").alias("n"), F.sum("value").alias("volume"))
        .select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "volume")
    )


def first_only(stream: DataFrame, keys: list[str], lateness: str = "7 days") -> DataFrame:
    """One row for each key within the watermark."""
    return stream.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(keys)


def merge_daily(spark: SparkSession, batch: DataFrame, path: str, keys: list[str], order: str) -> None:
    """Upsert a batch into a parquet table by date folders: for each key the last row by ``order`` stays.

    Only the folders of dates in the batch are read and rewritten.
    """
    from tessera.operators.panel import last_by_key
    from tessera.sources.tables import exists

    new = batch
    if exists(spark, path):
        old = spark.read.parquet(path)
        new = old.join(batch.select("date").distinct(), "date", "left_semi").unionByName(batch, allowMissingColumns=True)
    merged = last_by_key(new, keys, [order]).select(*new.columns)
    # the result replaces folders that it is read from, so it is made whole first, under a name of its own
    staged = f"{path.rstrip('/')}-staged-{uuid.uuid4().hex}"
    merged.write.parquet(staged)
    ready = spark.read.schema(merged.schema).parquet(staged)
    ready.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staged)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def ingest(stream: DataFrame, path: str, keys: list[str], order: str, late: int = 5, date: str = "date") -> DataFrame:
    """Upsert a stream of daily rows by batch and give the table; rows too late go to a side table, ``{path}/late``.

    A row is late if its date lies more than ``late`` days before the newest date
    of the batches before.  Each batch first writes down that date under its
    number, so a batch that is run again after a failure judges its rows as
    before, upserts the same rows and changes nothing.
    """
    spark = stream.sparkSession
    from tessera.sources.tables import exists

    data, side, marks = f"{path}/data", f"{path}/late", f"{path}/newest"

    def write(batch: DataFrame, number: int) -> None:
        mark = f"{marks}/batch={number}"
        if not exists(spark, f"{mark}/_SUCCESS"):
            seen = spark.read.parquet(data).select(date) if exists(spark, data) else batch.select(date).limit(0)
            seen.agg(F.max(date).alias("newest")).write.mode("overwrite").parquet(mark)
        newest = spark.read.parquet(mark).first()[0]  # one date
        in_time = F.lit(True) if newest is None else F.col(date) >= F.date_sub(F.lit(newest), late)
        batch.where(~F.coalesce(in_time, F.lit(False))).write.mode("overwrite").parquet(f"{side}/batch={number}")
        merge_daily(spark, batch.where(in_time), data, keys, order)

    sink = stream.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    sink.foreachBatch(write).start().awaitTermination()
    return spark.read.parquet(data)


def run_backfill(spark: SparkSession, plan: DataFrame, load: Callable[[str], DataFrame], path: str, keys: list[str], order: str) -> list[str]:
    """Load the days of a plan that its ledger doesn't hold yet, the oldest first; the days loaded.

    ``plan`` is a ``backfill_plan``; ``load`` gives a day's rows.  The table is
    ``{path}/data`` and the ledger ``{path}/ledger``: a day is upserted before it is
    written down, so a run that is broken off and started again loads the day once
    more, which changes nothing, and a finished day is never loaded again.  A plan
    that halts is an error, and nothing is loaded.
    """
    from tessera.sources.tables import exists

    if halted := [str(r.date) for r in plan.where("status = 'halt'").select("date").distinct().take(3)]:
        raise ValueError(f"the gap before {', '.join(halted)} is too long to be filled")
    ledger, todo = f"{path}/ledger", plan.select("date").distinct()
    if exists(spark, ledger):
        todo = todo.join(spark.read.schema("date date").parquet(ledger), "date", "left_anti")
    done = []
    for day in [r.date for r in todo.orderBy("date").collect()]:  # a plan holds a few days, else it halts
        merge_daily(spark, load(str(day)), f"{path}/data", keys, order)
        spark.createDataFrame([(day,)], "date date").write.mode("append").parquet(ledger)
        done.append(str(day))
    return done


def monitor(stream: DataFrame, max_drawdown: float, max_daily_loss: float) -> DataFrame:
    """Kill-switch events from equity marks (account, ts, equity).

    State per account: peak, last day's closing equity and the day; the daily
    reference only rolls when a new day begins.  A batch's marks of an account are
    put in order over all its Arrow frames before the state is moved on.
    """

    def step(key, frames: Iterator[pd.DataFrame], state):
        account = key[0]
        peak, close, day, last = state.get if state.exists else (float("-inf"), None, None, None)
        rows = []
        marks = [f[["ts", "equity"]] for f in frames]  # numbers only, of one account and batch
        for f in [pd.concat(marks)] if marks else []:
            for r in f.sort_values("ts", kind="stable").itertuples():
                today = r.ts.date().isoformat()
                if day is not None and today != day:
                    close = last
                day, last, peak = today, float(r.equity), max(peak, float(r.equity))
                fall = r.equity / peak - 1 if peak > 0 else 0.0
                loss = r.equity / close - 1 if close else 0.0
                reason = "drawdown" if fall <= -max_drawdown else "daily loss" if loss <= -max_daily_loss else None
                if reason:
                    rows.append((account, r.ts, reason, float(fall), float(loss)))
        state.update((peak, close, day, last))
        yield pd.DataFrame(rows, columns=["account", "ts", "reason", "drawdown", "day_loss"])

    return stream.groupBy("account").applyInPandasWithState(
        step, "account string, ts timestamp, reason string, drawdown double, day_loss double",
        "peak double, close double, day string, last double", "append", "NoTimeout",
    )
