"""Panel operators: grids, membership, interval and as-of joins, label clocks, sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import rounded
from tessera.operators import panel
from tessera.queries.base import BARS, GRID, bars, grid, query, r, read


@query(f"WITH {BARS} SELECT date, permno, {r('open')} AS open, {r('high')} AS high, {r('low')} AS low, {r('close')} AS close, {r('adj_close')} AS adj_close, volume, {r('dollar_volume', 2)} AS dollar_volume FROM bars")
def panel_bars(spark, sf_dir):
    b = bars(spark, sf_dir)
    prices = [rounded(c).alias(c) for c in ("open", "high", "low", "close", "adj_close")]
    return b.select("date", "permno", *prices, "volume", rounded("dollar_volume", 2).alias("dollar_volume"))


@query(f"WITH {GRID} SELECT key, date, {r('open')} AS open, {r('close')} AS close, volume, {r('return')} AS ret FROM grid")
def panel_grid(spark, sf_dir):
    """Dense adjusted grid with returns."""
    return grid(spark, sf_dir).select("key", "date", rounded("open").alias("open"), rounded("close").alias("close"), "volume", rounded("return").alias("ret"))


@query(f"WITH {GRID} SELECT key, date, close IS NOT NULL AS active FROM grid")
def panel_membership_mask(spark, sf_dir):
    """Yes or no for every date and key."""
    return grid(spark, sf_dir).select("key", "date", F.col("close").isNotNull().alias("active"))


@query("""SELECT l_suppkey AS permno, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, max_by(l_extendedprice, l_orderkey * 10 + l_linenumber + l_extendedprice / 1e8) AS last_price
          FROM lineitem GROUP BY l_suppkey, CAST(date_trunc('month', l_shipdate) AS DATE)""")
def panel_last_value(spark, sf_dir):
    """One value for each key and date: the last by a sequence."""
    line = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("permno"), F.trunc("l_shipdate", "month").alias("date"), F.col("l_extendedprice").alias("last_price"),
                                                  (F.col("l_orderkey") * 10 + F.col("l_linenumber") + F.col("l_extendedprice") / 1e8).alias("seq"))
    return panel.one_value(line, ["permno", "date"], ["last_price"], F.col("seq"))


@query("""SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM
          (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1""")
def panel_keep_last(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return panel.last_by_key(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"])


#: Active interval of each customer: first to last order, less the last month for every third.
_INTERVALS = """iv AS (SELECT o_custkey AS custkey, CAST(min(o_orderdate) AS DATE) AS begin_date,
     CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE CAST(max(o_orderdate) AS DATE) END AS end_date FROM orders GROUP BY o_custkey)"""


def intervals(spark, sf_dir):
    out = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(
        F.min("o_orderdate").cast("date").alias("begin_date"), F.max("o_orderdate").cast("date").alias("last")
    )
    return out.select("custkey", "begin_date", F.when(F.col("custkey") % 5 != 0, F.col("last")).alias("end_date"))


@query(f"""WITH {_INTERVALS} SELECT o_orderkey, o_custkey AS custkey, begin_date, end_date FROM orders JOIN iv ON iv.custkey = o_custkey
           AND CAST(o_orderdate AS DATE) + 30 >= begin_date AND (end_date IS NULL OR CAST(o_orderdate AS DATE) + 30 <= end_date)""")
def join_interval(spark, sf_dir):
    """A point in a key's interval, open ends included."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("custkey"), F.date_add(F.col("o_orderdate").cast("date"), 30).alias("at"))
    return panel.interval_join(orders, intervals(spark, sf_dir), "custkey", "at", "begin_date", "end_date").drop("at")


@query(f"""WITH {_INTERVALS}, half AS (SELECT custkey, begin_date + 200 AS b2, begin_date + 900 AS e2 FROM iv)
     SELECT iv.custkey, greatest(begin_date, b2) AS begin_date, least(coalesce(end_date, DATE '9999-12-31'), e2) AS end_date
     FROM iv JOIN half ON half.custkey = iv.custkey AND begin_date <= e2 AND b2 <= coalesce(end_date, DATE '9999-12-31')""")
def join_interval_overlap(spark, sf_dir):
    iv = intervals(spark, sf_dir)
    half = iv.select("custkey", F.date_add("begin_date", 200).alias("b2"), F.date_add("begin_date", 900).alias("e2"))
    out = panel.overlap_join(iv, half, "custkey", ("begin_date", "end_date"), ("b2", "e2"))
    return out.select("custkey", F.col("begin").alias("begin_date"), F.col("end").alias("end_date"))


@query(f"""WITH {GRID}, {_INTERVALS}, d AS (SELECT DISTINCT date FROM grid)
     SELECT custkey, date FROM iv JOIN d ON date BETWEEN begin_date AND coalesce(end_date, (SELECT max(date) FROM d))""")
def join_expand_intervals(spark, sf_dir):
    """Membership: one row for each calendar date inside each interval."""
    days = bars(spark, sf_dir).select("date").distinct()
    return panel.expand_intervals(intervals(spark, sf_dir), days, "begin_date", "end_date").select("custkey", "date")


_EVENTS = """ev AS (SELECT o_custkey % 100 AS key, o_orderkey, CAST(o_orderdate AS DATE) + CAST(o_custkey % 45 AS INTEGER) AS known, o_totalprice AS total FROM orders)"""


@query(f"""WITH {GRID}, {_EVENTS}, lst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key, known ORDER BY o_orderkey DESC) AS k FROM ev) WHERE k = 1)
     SELECT g.key, g.date, total FROM grid g ASOF LEFT JOIN lst ON g.key = lst.key AND g.date >= lst.known""")
def join_asof(spark, sf_dir):
    """The latest value known on or before each date."""
    events = read(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 100).alias("key"), "o_orderkey", F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_custkey") % 45).cast("int")).alias("known"),
        F.col("o_totalprice").alias("total"),
    )
    days = grid(spark, sf_dir).select("key", "date")
    return panel.asof_join(days, events, "key", "date", "known", ["total"], ["o_orderkey"])


@query(f"""WITH {BARS}, m AS (SELECT date, permno, volume > 100 AS active FROM bars)
     SELECT b.date, b.permno, volume FROM bars b SEMI JOIN m ON m.date = b.date AND m.permno = b.permno AND m.active""")
def panel_members_only(spark, sf_dir):
    """Point-in-time filter by (date, key)."""
    b = bars(spark, sf_dir)
    members = b.select("date", "permno", (F.col("volume") > 100).alias("active"))
    return panel.members_only(b, members, ["date", "permno"]).select("date", "permno", "volume")


@query(f"""WITH {GRID}, l AS (SELECT key, date, CASE WHEN lead(open, 1) OVER s > 0 THEN lead(open, 4) OVER s / lead(open, 1) OVER s - 1 END AS f FROM grid WINDOW s AS (PARTITION BY key ORDER BY date)),
     e AS (SELECT date, lead(date, 4) OVER (ORDER BY date) AS e FROM (SELECT DISTINCT date FROM grid))
     SELECT key, l.date, {r('CASE WHEN e <= DATE ' + "'1997-06-01'" + ' THEN f END')} AS label FROM l JOIN e ON e.date = l.date""")
def panel_purged_labels(spark, sf_dir):
    """Labels of horizon 3 that end before a cutoff."""
    labelled = panel.forward_returns(grid(spark, sf_dir), [3])
    out = panel.purge(labelled, labelled.select("date").distinct(), "1997-06-01", [3])
    return out.select("key", "date", rounded("fwd_3").alias("label"))


@query(f"WITH {BARS}, d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM (SELECT DISTINCT date FROM bars)) SELECT a.date, b.date AS next FROM d a JOIN d b ON b.pos = a.pos + 3 WHERE a.pos % 2 = 0")
def panel_stride_and_next(spark, sf_dir):
    """Every second date with the date three positions later."""
    days = panel.calendar(bars(spark, sf_dir))
    later = panel.nth_next_date(days, 3)
    return panel.stride(days, 2).select("date").join(later, "date")


@query(f"""WITH {GRID}, v AS (SELECT key, date, CAST(floor(log10(volume)) AS BIGINT) AS band FROM grid WHERE volume IS NOT NULL),
     c AS (SELECT key, date, band, lag(band) OVER (PARTITION BY key ORDER BY date) AS old FROM v) SELECT key, old, band AS new, date FROM c WHERE old <> band""")
def panel_changes(spark, sf_dir):
    """Dates on which a key's class changes."""
    v = grid(spark, sf_dir).where("volume is not null").select("key", "date", F.floor(F.log10("volume")).alias("band"))
    return panel.changes(v, "key", "band", "date")


@query(f"WITH {GRID} SELECT key, date, {r('last_value(close IGNORE NULLS) OVER (PARTITION BY key ORDER BY date ROWS UNBOUNDED PRECEDING)')} AS close FROM grid")
def panel_forward_fill(spark, sf_dir):
    return panel.forward_fill(grid(spark, sf_dir).select("key", "date", "close"), "key", "date", ["close"]).select("key", "date", rounded("close").alias("close"))


@query(f"""WITH {BARS}, q AS (SELECT permno, date, volume, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY permno, date_trunc('quarter', date)) AS n FROM bars
       WINDOW w AS (PARTITION BY permno, date_trunc('quarter', date) ORDER BY date)),
     s AS (SELECT *, 'first' AS sample FROM q WHERE i = 0 UNION ALL SELECT *, 'mid' FROM q WHERE i = n // 2 UNION ALL SELECT *, 'last' FROM q WHERE i = n - 1)
     SELECT sample, count(*) AS n, {r('avg(volume)', 4)} AS mean, {r('stddev_samp(volume)', 4)} AS spread FROM s GROUP BY sample""")
def panel_quarter_samples(spark, sf_dir):
    out = panel.quarter_samples(bars(spark, sf_dir).select("permno", "date", "volume"), "permno")
    return out.groupBy("sample").agg(F.count("*").alias("n"), rounded(F.avg("volume"), 4).alias("mean"), rounded(F.stddev_samp("volume"), 4).alias("spread"))


@query(f"""WITH {BARS}, s AS (SELECT s_suppkey, n_name AS sector, s_acctbal AS balance FROM supplier JOIN nation ON n_nationkey = s_nationkey)
     SELECT date, permno, coalesce(sector, 'Unknown') AS sector FROM bars LEFT JOIN s ON s_suppkey = permno AND balance > 0""")
def join_sector_map(spark, sf_dir):
    """Lookup with a default for keys that the map lacks."""
    sectors = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).where("s_acctbal > 0")
    b = bars(spark, sf_dir).select("date", "permno")
    return b.join(sectors.select(F.col("s_suppkey").alias("permno"), F.col("n_name").alias("sector")), "permno", "left").select("date", "permno", F.coalesce("sector", F.lit("Unknown")).alias("sector"))


@query("""SELECT c_custkey, CAST(coalesce(sum(o_totalprice), 0) > 0 AS BOOLEAN) AS has_order FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def join_left_flag(spark, sf_dir):
    """Left join with a flag for what was found."""
    found = read(spark, sf_dir, "orders").where("o_totalprice > 0").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("f")).distinct()
    return read(spark, sf_dir, "customer").join(found, "c_custkey", "left").select("c_custkey", F.coalesce("f", F.lit(False)).alias("has_order"))


@query("SELECT c_custkey FROM customer ANTI JOIN orders ON o_custkey = c_custkey")
def join_anti(spark, sf_dir):
    return read(spark, sf_dir, "customer").join(read(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query(f"""WITH {BARS}, a AS (SELECT date, permno, volume FROM bars), b AS (SELECT CAST(date + INTERVAL 1 MONTH AS DATE) AS date, permno, volume FROM bars)
     SELECT coalesce(a.date, b.date) AS date, coalesce(a.permno, b.permno) AS permno, coalesce(b.volume, 0) AS before, coalesce(a.volume, 0) AS after FROM a FULL OUTER JOIN b ON a.permno = b.permno AND a.date = b.date""")
def join_full_alignment(spark, sf_dir):
    """Union of each month's keys with those of the month before, absent sides counted as 0."""
    b = bars(spark, sf_dir)
    after = b.select("date", "permno", F.col("volume").alias("after"))
    before = b.select(F.add_months("date", 1).alias("date"), "permno", F.col("volume").alias("before"))
    return before.join(after, ["date", "permno"], "full_outer").select("date", "permno", F.coalesce("before", F.lit(0.0)).alias("before"), F.coalesce("after", F.lit(0.0)).alias("after"))


@query("""SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey AND abs(a.p_size - b.p_size) <= 1""")
def join_band(spark, sf_dir):
    """Pairs of one brand whose sizes differ by one at most."""
    return panel.band_pairs(read(spark, sf_dir, "part"), "p_partkey", "p_brand", "p_size", 1)


@query(f"""WITH {BARS}, a AS (SELECT permno, date, close FROM bars), b AS (SELECT permno, CAST(date + INTERVAL 1 MONTH AS DATE) AS date, CASE WHEN volume > 20 THEN close END AS close FROM bars)
     SELECT a.permno, a.date, (a.close IS NULL AND b.close IS NULL) OR coalesce(abs(a.close - b.close) <= 0.5 + 0.05 * abs(b.close), FALSE) AS same FROM a JOIN b ON a.permno = b.permno AND a.date = b.date""")
def join_tolerance(spark, sf_dir):
    """Two tables matched on their keys, values compared within an absolute and a relative tolerance; missing equals missing."""
    b = bars(spark, sf_dir)
    later = b.select("permno", F.add_months("date", 1).alias("date"), F.when(F.col("volume") > 20, F.col("close")).alias("other"))
    return panel.tolerance_match(b.select("permno", "date", "close"), later, ["permno", "date"], "close", "other", 0.5, 0.05).select("permno", "date", "same")


@query("""SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'""")
def set_difference(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey").subtract(read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")))


@query("""SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'""")
def set_intersection(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey").intersect(read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")))


@query("""SELECT s_suppkey AS key, 'supplier' AS origin, s_acctbal AS balance FROM supplier UNION ALL SELECT c_custkey, 'customer', NULL FROM customer""")
def set_union_by_name(spark, sf_dir):
    """Tagged union of two tables with different columns."""
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.lit("supplier").alias("origin"), F.col("s_acctbal").alias("balance"))
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.lit("customer").alias("origin"))
    return s.unionByName(c, allowMissingColumns=True)


@query("""SELECT p_type AS expression, p_brand AS first_set FROM (SELECT p_type, p_brand, row_number() OVER (PARTITION BY p_type ORDER BY p_brand, p_partkey) AS k FROM part) WHERE k = 1""")
def set_first_wins(spark, sf_dir):
    """Deduplicated pool: the first set that has an expression keeps it."""
    return read(spark, sf_dir, "part").groupBy(F.col("p_type").alias("expression")).agg(F.min_by("p_brand", F.struct("p_brand", "p_partkey")).alias("first_set"))


@query(f"WITH {BARS} SELECT permno, date, volume FROM (SELECT *, row_number() OVER (PARTITION BY permno ORDER BY volume DESC, date) AS k FROM bars) WHERE k <= 3")
def top_k_per_key(spark, sf_dir):
    """The three largest months of each key."""
    k = F.row_number().over(Window.partitionBy("permno").orderBy(F.col("volume").desc(), "date"))
    return bars(spark, sf_dir).select("permno", "date", "volume").withColumn("k", k).where("k <= 3").drop("k")
