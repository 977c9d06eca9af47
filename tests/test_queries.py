"""Registered queries against their SQL on the smallest tables, and the driver contract."""

import collections

import pytest

import __spark_entry__ as contract
from tests.conftest import DATA
from tessera import registry

#: A spread of queries; the others are compared by the same code at larger scale.
CHOSEN = [
    "panel_bars", "panel_grid", "panel_last_value", "panel_quarter_samples", "join_interval", "join_interval_overlap", "join_asof", "join_full_alignment",
    "formula_b_ts_corr", "formula_g_ema", "formula_pool", "score_ic_summary", "score_half_life", "score_turnover", "select_combined_signal",
    "test_newey_west", "test_wilcoxon", "test_max_t", "portfolio_features", "portfolio_turnover_cap", "quality_report", "stream_daily_bars", "source_history",
]


def normal(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_its_sql(spark, duck, name):
    df = contract.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = collections.Counter(tuple(normal(r[c]) for c in columns) for r in df.collect())
    out = duck.sql(contract.oracle_sql()[name])
    assert sorted(out.columns) == columns
    at = [out.columns.index(c) for c in columns]
    assert got == collections.Counter(tuple(normal(r[i]) for i in at) for r in out.fetchall())


def test_contract_is_whole(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert len(registry.QUERIES) > 100
    assert contract.entry(spark).count() > 0


def test_search_repeats_itself():
    from tessera.search.evolve import Archive, Search

    def score(texts):
        return {t: (float(sum(map(ord, t)) % 97), {"turnover": len(t) % 2, "half_life": float(len(t) % 30)}) for t in texts}

    runs = [Search(score, seed=4, islands=3).run(8).dump() for _ in range(2)]
    assert runs[0] == runs[1] and runs[0]
    assert Archive.load(runs[0]).dump() == runs[0]
    assert max(Archive.load(runs[0]).summary().values()) <= 8


def test_monitor_equals_a_loop(spark, tmp_path):
    import datetime as dt

    from tessera.streaming import bars

    marks = [100, 101, 95, 94, 99, 90, 91, 85]
    rows = [("a", dt.datetime(2024, 1, 1 + i // 3, 9 + i % 3), float(v)) for i, v in enumerate(marks)]
    spark.createDataFrame(rows, "account string, ts timestamp, equity double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("account string, ts timestamp, equity double").parquet(str(tmp_path / "in"))
    out = bars.drain(bars.monitor(stream, 0.1, 0.05), str(tmp_path / "out"), "append").orderBy("ts").collect()
    expected, peak, close, day, last = [], 0, None, None, None
    for _, ts, v in rows:
        if day is not None and ts.date() != day:
            close = last
        day, last, peak = ts.date(), v, max(peak, v)
        reason = "drawdown" if v / peak - 1 <= -0.1 else "daily loss" if close and v / close - 1 <= -0.05 else None
        if reason:
            expected.append((ts, reason))
    assert [(r.ts, r.reason) for r in out] == expected


def test_ingest_keeps_the_last_and_puts_late_rows_aside(spark, tmp_path):
    import datetime as dt

    from tessera.streaming import bars

    kind = "date date, permno long, close double, seen int"
    day = lambda n: dt.date(2024, 1, n)
    batches = [[(day(10), 1, 1.0, 1), (day(11), 1, 2.0, 1)], [(day(11), 1, 3.0, 2), (day(2), 1, 9.0, 2), (day(12), 2, 4.0, 2)]]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in batches:
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(source)
        table = bars.ingest(spark.readStream.schema(kind).parquet(source), out, ["date", "permno"], "seen")
    assert {(r.date.day, r.permno, r.close) for r in table.collect()} == {(10, 1, 1.0), (11, 1, 3.0), (12, 2, 4.0)}
    assert [r.close for r in spark.read.parquet(f"{out}/late").collect()] == [9.0]


def test_a_batch_run_again_changes_nothing(spark, tmp_path):
    """A batch fails after its rows have reached the table; on the retry its own dates mustn't make its older rows late."""
    import datetime as dt

    from tessera.streaming import bars

    kind = "date date, permno long, close double, seen int"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    write = lambda rows: spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema(kind).parquet(source)
    write([(dt.date(2024, 1, 10), 1, 1.0, 1)])
    bars.ingest(stream(), out, ["date", "permno"], "seen")
    write([(dt.date(2024, 1, 8), 1, 2.0, 2), (dt.date(2024, 3, 1), 1, 3.0, 2), (dt.date(2023, 1, 1), 1, 9.0, 2)])
    real = bars.merge_daily

    def fails_after_some(spark, batch, *rest):
        real(spark, batch.where("date > '2024-02-01'"), *rest)  # one folder is written, then the driver dies
        raise RuntimeError("lost")

    bars.merge_daily = fails_after_some
    try:
        with pytest.raises(Exception, match="lost"):
            bars.ingest(stream(), out, ["date", "permno"], "seen")
    finally:
        bars.merge_daily = real
    table = bars.ingest(stream(), out, ["date", "permno"], "seen")
    assert {(str(r.date), r.close) for r in table.collect()} == {("2024-01-10", 1.0), ("2024-01-08", 2.0), ("2024-03-01", 3.0)}
    assert [r.close for r in spark.read.parquet(f"{out}/late").collect()] == [9.0]


def test_missing_file_is_an_empty_table(spark, tmp_path):
    from tessera.sources import tables

    assert tables.load_table(spark, str(tmp_path / "no.parquet"), tables.BARS, ["date", "close"]).count() == 0
    assert tables.read_numbered("# 1: a\nRANK($close)\n# 2 DROPPED\n$x\n# 3 c\n$open") == [(1, "a", "RANK($close)"), (3, "c", "$open")]
    (tmp_path / "x.jsonl").write_text('{"a": 1}\nbroken\n{"a": 2}\n')
    assert tables.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int").count() == 2
    tables.claim_once(spark, str(tmp_path / "claim"), {"x": b"1"})
    with pytest.raises(FileExistsError):
        tables.claim_once(spark, str(tmp_path / "claim"), {"x": b"1"})
    for day in ("02", "11", "05"):
        (tmp_path / f"log-{day}.json").write_text("")
    assert tables.latest_file(spark, str(tmp_path / "log-*.json")).endswith("log-11.json") and tables.latest_file(spark, str(tmp_path / "no-*")) is None


def test_run_logs_and_fallbacks(spark):
    from pyspark.sql import functions as F

    from tessera.sources import tables

    log = spark.createDataFrame([("p", 1, "timeout", None), ("p", 2, None, "a"), ("p", 3, None, "b"), ("q", 4, None, "c")], "prompt_hash string, seq int, error string, reply string")
    assert {(r.prompt_hash, r.reply) for r in tables.first_replies(log).collect()} == {("p", "a"), ("q", "c")}
    assert tables.up_to_round(log, 2, "seq").count() == 2
    members = spark.createDataFrame([("d1", "a", True), ("d1", "b", False), ("d2", "b", True)], "date string, symbol string, active boolean")
    told = lambda *days: {r.symbol for r in tables.active_symbols(members, spark.createDataFrame([(d,) for d in days], "date string")).collect()}
    assert told("d1") == {"a"} and told("d1", "d2") == {"a", "b"} and told("d3") == {"a", "b"}
    px = spark.createDataFrame([(None, 2.0), (0.0, 3.0), (1.0, 3.0)], "trade_open double, adj_close double")
    assert [r.p for r in px.select(tables.trade_price("trade_open", "adj_close").alias("p")).collect()] == [2.0, 3.0, 1.0]
