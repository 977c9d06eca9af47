"""Reference data and run-log reports as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import rounded
from tessera.operators import reference
from tessera.queries.base import query, r, read

_CASES = " ".join(f"WHEN c BETWEEN {a} AND {b} THEN '{s}'" for a, b, s in reference.SIC_SECTORS)


@query(f"WITH p AS (SELECT p_partkey, (p_partkey * 37) % 10000 AS c FROM part) SELECT p_partkey, CASE {_CASES} ELSE 'Unknown' END AS sector FROM p")
def reference_sectors(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", reference.sector_of((F.col("p_partkey") * 37) % 10000).alias("sector"))


@query(f"""WITH i AS (SELECT o_custkey AS gvkey, date_trunc('quarter', o_orderdate) AS q, sum(o_totalprice) AS revt, count(*) AS n, max(o_totalprice) AS mx FROM orders GROUP BY o_custkey, date_trunc('quarter', o_orderdate)),
     f AS (SELECT gvkey, q, revt / 10 AS ni, revt * 3 AS at_, CASE WHEN n > 1 THEN mx END AS ceq, revt AS seq, revt, CAST(n AS DOUBLE) AS csho, revt / 8 AS oiadp, CASE WHEN n > 2 THEN mx / 2 END AS dltt FROM i)
     SELECT gvkey, CAST(q AS DATE) AS datadate, {r('ni / (at_ + 1e-9)')} AS roa, {r('ni / (coalesce(ceq, seq) + 1e-9)')} AS roe, {r('oiadp / (revt + 1e-9)')} AS operating_margin,
            {r('coalesce(dltt, 0) / (at_ + 1e-9)')} AS leverage, {r('coalesce(ceq, seq) / (csho + 1e-9)', 3)} AS book_per_share, {r('(ni - oiadp) / (at_ + 1e-9)')} AS accrual_gap FROM f""")
def reference_ratios(spark, sf_dir):
    """Ratios of customer-quarters that stand in for reports."""
    i = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("gvkey"), F.trunc("o_orderdate", "quarter").alias("datadate")).agg(
        F.sum("o_totalprice").alias("revt"), F.count("*").alias("n"), F.max("o_totalprice").alias("mx")
    )
    items = i.select(
        "gvkey", "datadate", (F.col("revt") / 10).alias("niq"), (F.col("revt") * 3).alias("atq"), F.when(F.col("n") > 1, F.col("mx")).alias("ceqq"), F.col("revt").alias("seqq"),
        F.col("revt").alias("revtq"), F.col("n").cast("double").alias("cshoq"), (F.col("revt") / 8).alias("oiadpq"), F.when(F.col("n") > 2, F.col("mx") / 2).alias("dlttq"),
        F.lit(None).cast("double").alias("dlcq"), F.lit(None).cast("double").alias("ibq"),
    )
    out = reference.ratios(items)
    named = ["roa", "roe", "operating_margin", "leverage", "accrual_gap"]
    return out.select("gvkey", "datadate", *[rounded(c).alias(c) for c in named], rounded("book_per_share", 3).alias("book_per_share"))


@query("""SELECT upper(replace(trim(s_name), '.', '-')) AS "Code", 'US' AS "Exchange", min(s_name) AS "Name" FROM supplier GROUP BY upper(replace(trim(s_name), '.', '-'))""")
def reference_snapshot(spark, sf_dir):
    snap = read(spark, sf_dir, "supplier").select(F.col("s_name").alias("Symbol"), F.col("s_name").alias("Security"))
    return reference.snapshot(snap).select("Code", "Exchange", "Name")


@query("""WITH k AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders),
     w AS (SELECT DISTINCT CAST(floor(j * (n - 1) / 31.0) AS BIGINT) AS i FROM (SELECT max(n) AS n FROM k) CROSS JOIN range(32) t(j)) SELECT o_orderkey FROM k JOIN w ON w.i = k.i""")
def reference_even_sample(spark, sf_dir):
    """Thirty-two rows at even distances: the sample is the feature."""
    return reference.even_sample(read(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 32)


@query("""SELECT event_type AS round, CASE WHEN user_id % 3 = 0 THEN 'archive' ELSE 'gate' || user_id % 3 END AS gate, count(*) AS n FROM events WHERE user_id % 5 <> 0 GROUP BY ALL""")
def report_gate_tallies(spark, sf_dir):
    reason = F.when(F.col("user_id") % 5 == 0, F.lit(None)).when(F.col("user_id") % 3 == 0, F.concat(F.lit("archive:"), "user_id")).otherwise(F.concat(F.lit("gate"), F.col("user_id") % 3))
    log = read(spark, sf_dir, "events").select(F.col("event_type").alias("round"), reason.alias("rejected_by"))
    return reference.gate_tallies(log, ("round",))


@query(f"SELECT event_type, {r('sum(value)', 2)} AS value, CAST(sum(user_id) AS BIGINT) AS user_id FROM events GROUP BY event_type")
def report_totals(spark, sf_dir):
    out = reference.totals(read(spark, sf_dir, "events"), ["value", "user_id"], ("event_type",))
    return out.select("event_type", rounded("value", 2).alias("value"), "user_id")


@query(f"""SELECT p_brand, count(*) AS n, count(*) FILTER (WHERE p_size > 25) AS survivors, {r('avg(CASE WHEN p_size > 25 THEN 1.0 ELSE 0.0 END)')} AS rate,
     {r('quantile_cont(CASE WHEN p_size > 25 THEN CAST(p_retailprice AS DOUBLE) END, 0.5)', 4)} AS median_retention FROM part GROUP BY p_brand""")
def report_survivors(spark, sf_dir):
    log = read(spark, sf_dir, "part").select("p_brand", (F.col("p_size") > 25).alias("ok"), F.col("p_retailprice").cast("double").alias("p"))
    out = reference.survivors(log, "p_brand", "ok", "p")
    return out.select("p_brand", "n", "survivors", rounded("rate").alias("rate"), rounded("median_retention", 4).alias("median_retention"))


@query("SELECT p_brand, p_partkey, p_size FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS k FROM part) WHERE k = 1")
def report_best_of_group(spark, sf_dir):
    return reference.best_of_group(read(spark, sf_dir, "part"), "p_brand", "p_size", "p_partkey")
