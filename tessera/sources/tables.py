"""Reading and writing tables: explicit schemas, missing files, JSON lines, IC directories."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BARS = T.StructType(
    [T.StructField("date", T.DateType()), T.StructField("symbol", T.StringType()), T.StructField("permno", T.LongType())]
    + [T.StructField(f, T.DoubleType()) for f in ("open", "high", "low", "close", "adj_close", "volume", "dollar_volume")]
)
MEMBERSHIP = T.StructType([T.StructField("date", T.DateType()), T.StructField("symbol", T.StringType()), T.StructField("permno", T.LongType()), T.StructField("active", T.BooleanType())])
CANDIDATES = "expression string, expression_id string, round int, island int, operator string, fitness double, ic_by_year map<string,double>, parents array<string>, niche array<string>, rejected_by string"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, asked of the file system that it names."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def load_table(spark: SparkSession, path: str, schema: T.StructType | str, columns: Iterable[str] | None = None) -> DataFrame:
    """Read parquet, CSV or JSON lines by suffix; a missing file is an empty table."""
    if not exists(spark, path):
        out = spark.createDataFrame([], schema)
    elif path.endswith((".csv", ".csv.gz")):
        out = spark.read.schema(schema).csv(path, header=True)
    elif path.endswith((".jsonl", ".json")):
        out = read_jsonl(spark, path, schema)
    else:
        out = spark.read.schema(schema).parquet(path)
    return out.select(*columns) if columns else out


def require(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """The table itself, or an error that names the columns it lacks."""
    if lacking := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    return df


def first_named(df: DataFrame, target: str, names: Iterable[str], magnitude: bool = False) -> DataFrame:
    """Rename the first of several synonyms to ``target`` (its absolute value with ``magnitude``)."""
    name = next((n for n in names if n in df.columns), None)
    if name is None:
        raise ValueError(f"none of {', '.join(names)} is there")
    return df.withColumn(target, F.abs(F.col(name)) if magnitude else F.col(name))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines; corrupt lines are left out."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def read_jsonl_tree(spark: SparkSession, root: str, schema: str, pattern: str = r"round[_-](\d+)/island[_-](\d+)/([a-z]+)") -> DataFrame:
    """JSON lines under ``root`` with round, island and operator from the path."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").json(root, mode="DROPMALFORMED")
    path = F.input_file_name()
    parts = {n: F.regexp_extract(path, pattern, i) for i, n in ((1, "round"), (2, "island"), (3, "operator"))}
    return rows.withColumns({"round": parts["round"].try_cast("int"), "island": parts["island"].try_cast("int"), "operator": parts["operator"]})


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_formulas(spark: SparkSession, path: str) -> DataFrame:
    """One formula a line; comments and blank lines are left out."""
    return spark.read.text(path).select(F.trim("value").alias("expression")).where("expression != '' and not startswith(expression, '#')")


def read_numbered(text: str) -> list[tuple[int, str, str]]:
    """(number, name, formula) of a sectioned file: ``# 12 name`` lines head the formulas after them."""
    out, head = [], None
    for line in text.splitlines():
        line = line.strip()
        if m := re.match(r"#\s*(?:alpha)?\s*#?(\d+)\s*[:.-]?\s*(.*)", line, re.IGNORECASE):
            head = None if "dropped" in m[2].lower() else (int(m[1]), m[2].strip())
        elif line and not line.startswith("#") and head:
            out.append((*head, line))
            head = None
    return out


def save_ic(ic: DataFrame, path: str) -> None:
    """Correlations in one folder for each kind and horizon."""
    ic.write.mode("overwrite").partitionBy("kind", "horizon").parquet(path)


def load_ic(spark: SparkSession, path: str, kind: str | None = None, horizon: int | None = None) -> DataFrame:
    """Correlations back, reading only the folders asked for."""
    out = spark.read.parquet(path)
    if kind is not None:
        out = out.where(F.col("kind") == kind)
    return out.where(F.col("horizon") == horizon) if horizon is not None else out


def claim_once(spark: SparkSession, path: str, inputs: dict[str, bytes]) -> dict[str, str]:
    """Write the digests of inputs to a new file of any Hadoop store; an error if it is there already."""
    digests = {k: hashlib.sha256(v).hexdigest() for k, v in sorted(inputs.items())}
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(target):
        raise FileExistsError(path)
    out = files.create(target, False)  # refuses a file that another run has made meanwhile
    try:
        out.write(bytearray(json.dumps(digests, indent=1).encode()))
    finally:
        out.close()
    return digests


def latest_file(spark: SparkSession, pattern: str) -> str | None:
    """The path, last by name, that a glob pattern matches; none if there is none."""
    glob = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = glob.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(glob) or []
    return max((f.getPath().toString() for f in found), default=None)


def up_to_round(log: DataFrame, last: int, column: str = "round") -> DataFrame:
    """The rows of a run log up to a round, from which a run is resumed."""
    return log.where(F.col(column) <= last)


def first_replies(log: DataFrame, prompt: str = "prompt_hash", order: str = "seq", error: str = "error") -> DataFrame:
    """The first reply without an error to each prompt."""
    good = log.where(F.col(error).isNull())
    rest = F.struct(*[c for c in log.columns if c != prompt])
    first = good.groupBy(prompt).agg(F.min_by(rest, F.col(order)).alias("r"))
    return first.select(prompt, "r.*").select(*log.columns)


def active_symbols(members: DataFrame, days: DataFrame, date: str = "date", key: str = "symbol") -> DataFrame:
    """Keys that are active on one of the dates; all keys if none is."""
    hit = members.where("active").join(days.select(date).distinct(), date, "left_semi").select(key).distinct()
    none = hit.limit(1).agg((F.count("*") == 0).alias("__none"))
    every = members.select(key).distinct().join(F.broadcast(none)).where("__none").select(key)
    return hit.union(every)


def trade_price(*prices: str) -> Column:
    """The first price that is there and positive."""
    return F.coalesce(*[F.when(F.col(p) > 0, F.col(p)) for p in prices])


def digest_of(parts: list[Column]) -> Column:
    """SHA-256 of named columns as JSON, missing values told."""
    return F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}), 256)


def row_digest(df: DataFrame, columns: Iterable[str], name: str = "digest") -> DataFrame:
    """``df`` with the SHA-256 of its columns as JSON with normalised ids, dates and numbers.

    Numbers are told by 17 significant digits, which no two doubles share.
    """
    kinds = dict(df.dtypes)
    parts = []
    for c in columns:
        v = F.col(c)
        if kinds[c] in ("double", "float"):
            v = F.format_string("%.16e", v.cast("double"))
        elif kinds[c] in ("date", "timestamp"):
            v = F.date_format(v, "yyyy-MM-dd")
        else:
            v = F.trim(v.cast("string"))
        parts.append(v.alias(c))
    return df.withColumn(name, digest_of(parts))


def latest_slice(df: DataFrame, date: str, before: str | None = None) -> DataFrame:
    """Rows of the latest date (before a given one)."""
    past = df.where(F.col(date) < F.lit(before).cast("date")) if before else df
    return past.join(past.agg(F.max(date).alias(date)), date, "left_semi")


def history(spark: SparkSession, table: str, names: str, permnos: Iterable[int] | None = None, begin: str | None = None, end: str | None = None) -> DataFrame:
    """Daily rows with the name valid that day, by Spark SQL on registered tables; filters are pushed to the scan."""
    where = ["TRUE"]
    if permnos is not None:
        where.append(f"d.permno IN ({', '.join(str(int(p)) for p in permnos) or 'NULL'})")
    where += [f"d.date >= DATE '{begin}'"] if begin else []
    where += [f"d.date <= DATE '{end}'"] if end else []
    return spark.sql(
        f"""SELECT d.*, n.ticker FROM {table} d LEFT JOIN {names} n
            ON n.permno = d.permno AND d.date >= n.begin_date AND d.date <= coalesce(n.end_date, DATE '9999-12-31')
            WHERE {' AND '.join(where)}"""
    )


def resolve_table(spark: SparkSession, candidates: Iterable[str]) -> str:
    """The first of the candidate tables that the catalog has."""
    found = next((t for t in candidates if spark.catalog.tableExists(t)), None)
    if found is None:
        raise ValueError("none of the candidate tables exists")
    return found


def jdbc_tables(spark: SparkSession, url: str, properties: dict[str, str] | None = None) -> DataFrame:
    """(schema, table) of all tables that a database shows to its user."""
    jvm = spark.sparkContext._jvm
    told = jvm.java.util.Properties()
    for k, v in (properties or {}).items():
        told.setProperty(k, v)
    connection = jvm.java.sql.DriverManager.getConnection(url, told)
    try:
        rows, found = connection.getMetaData().getTables(None, None, None, None), []
        while rows.next():
            if rows.getString("TABLE_TYPE") in ("TABLE", "VIEW"):
                found.append((rows.getString("TABLE_SCHEM"), rows.getString("TABLE_NAME")))
    finally:
        connection.close()
    return spark.createDataFrame(found, "schema string, table string")  # a catalog, not data


def resolve_jdbc_table(spark: SparkSession, url: str, candidates: Iterable[tuple[str, str]], properties: dict[str, str] | None = None) -> str:
    """The first of (schema, table) that the database has, in whatever case it tells names."""
    there = {(s or "").upper() + "." + t.upper(): f"{s}.{t}" if s else t for s, t in jdbc_tables(spark, url, properties).collect()}
    found = next((there[f"{s}.{t}".upper()] for s, t in candidates if f"{s}.{t}".upper() in there), None)
    if found is None:
        raise ValueError("none of the candidate tables exists")
    return found


def pick_column(columns: Iterable[str], names: Iterable[str]) -> str | None:
    """The first of several names that a table has, in any case."""
    there = {c.lower(): c for c in columns}
    return next((there[n.lower()] for n in names if n.lower() in there), None)


def read_jdbc(
    spark: SparkSession, url: str, table: str, split: str | None = None, partitions: int = 8, properties: dict[str, str] | None = None, fetch: int = 10_000
) -> DataFrame:
    """A database's table, read in ranges of a number or date column; filters, columns and aggregates go to the database.

    The bounds of the ranges come from one query that the database answers; rows
    without a value of ``split`` are in the first range.
    """
    options = {"url": url, "dbtable": table, "fetchsize": str(fetch), **(properties or {})}
    whole = spark.read.format("jdbc").options(**options).load()
    if split is None:
        return whole
    low, high = whole.agg(F.min(split), F.max(split)).first()
    if low is None:
        return whole
    kind = dict(whole.dtypes)[split]
    bounds = (str(low), str(high)) if kind in ("date", "timestamp") else (str(int(low)), str(int(high) + 1))
    split_by = {"partitionColumn": split, "lowerBound": bounds[0], "upperBound": bounds[1], "numPartitions": str(partitions)}
    return spark.read.format("jdbc").options(**options, **split_by).load()


def write_jdbc(df: DataFrame, url: str, table: str, properties: dict[str, str] | None = None, writers: int = 8, mode: str = "overwrite") -> None:
    """Write a table with at most ``writers`` connections at once."""
    df.coalesce(writers).write.format("jdbc").options(url=url, dbtable=table, **(properties or {})).mode(mode).save()


def save_table(df: DataFrame, path: str) -> str:
    """Write parquet, or CSV beside it where parquet can't hold the table; the path that was written.

    Parquet refuses column types that it doesn't know (intervals, for one), and
    names that differ in case only; CSV takes their text.
    """
    from pyspark.errors import AnalysisException

    try:
        df.write.mode("overwrite").parquet(path)
    except AnalysisException:
        path = re.sub(r"(\.parquet)?$", ".csv", path, count=1)
        plain = [F.col(f"`{c}`").cast("string") if k not in ("string", "double", "bigint", "int", "boolean", "date", "timestamp") else F.col(f"`{c}`") for c, k in df.dtypes]
        df.select(*plain).write.mode("overwrite").csv(path, header=True)
    return path


def save_report(df: DataFrame, path: str, kind: str = "csv", order: Iterable[str] = ()) -> None:
    """A report as CSV, JSON lines or a YAML list of mappings, one file in the order given."""
    rows = df.orderBy(*order).coalesce(1) if (order := list(order)) else df.coalesce(1)  # a report is short
    if kind == "csv":
        rows.write.mode("overwrite").csv(path, header=True)
    elif kind == "json":
        rows.write.mode("overwrite").json(path)
    elif kind == "yaml":
        told = lambda c: F.coalesce(F.get_json_object(F.to_json(F.struct(F.col(c).alias("v"))), "$.v"), F.lit("null"))
        quoted = {c: F.when(F.col(c).isNull(), F.lit("null")).otherwise(F.concat(F.lit("'"), F.replace(F.col(c), F.lit("'"), F.lit("''")), F.lit("'"))) for c, k in df.dtypes if k == "string"}
        lines = [F.concat(F.lit(("- " if i == 0 else "  ") + c + ": "), quoted.get(c, told(c))) for i, c in enumerate(df.columns)]
        rows.select(F.concat_ws("\n", *lines)).write.mode("overwrite").text(path)
    else:
        raise ValueError(f"no such kind of report: {kind}")


def formula_sets(spark: SparkSession, sources: Iterable[tuple[str, str, str]]) -> DataFrame:
    """(set, group, path, expression) of files of formulas; an expression belongs to the first source that has it."""
    out = None
    for place, (name, group, path) in enumerate(sources):
        part = read_formulas(spark, path).select(F.lit(place).alias("__place"), F.lit(name).alias("set"), F.lit(group).alias("group"), F.lit(path).alias("path"), "expression")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no sources")
    first = out.groupBy("expression").agg(F.min_by(F.struct("set", "group", "path"), "__place").alias("s"))
    return first.select("s.set", "s.group", "s.path", "expression")
