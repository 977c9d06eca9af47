"""Helpers shared by the text operators: shared storage, word splitting, hashing."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import shutil
import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Words are maximal runs of characters other than these (space and \t to \r).
WHITESPACE = " \t\n\x0b\x0c\r"

_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_KEYS = ("tessera-words-01", "tessera-words-02")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a session without that setting (a local test) gets a temporary folder
    of this machine, removed at exit.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not set_dir:
        has = spark.sparkContext._jsc.sc().getCheckpointDir()
        set_dir = has.get() if has.isDefined() else None
    if not set_dir:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder shared by the cluster")
        set_dir = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, set_dir, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(set_dir)
    elif not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(set_dir)
    return set_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Tables:
    """Written tables of the shared folder that cut the lineage, until they are dropped.

    A written table is computed once (a checkpoint computes its last stage
    twice), is read back by columns, and goes when ``drop`` is called.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: dict[str, str] = {}
        self.known: dict[str, str] = {}

    def keep(self, df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
        """Write ``df`` and read it back; a former table of that name is dropped.

        With ``by`` the table is bucketed, so that joins on those columns needn't
        deal it out again.
        """
        path = scratch_path(self.spark, name)
        if by:
            known = f"tessera_{uuid.uuid4().hex}"
            buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            df.write.format("parquet").option("path", path).bucketBy(buckets, *by).saveAsTable(known)
            self.drop(name)
            self.paths[name], self.known[name] = path, known
            return self.spark.table(known)
        df.write.parquet(path)
        self.drop(name)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete the named tables, or all; their readers must be done."""
        for name in names or list(self.paths):
            if name in self.known:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.known.pop(name)}")
            if name in self.paths:
                drop_path(self.spark, self.paths.pop(name))

    def give(self, df: DataFrame, name: str) -> DataFrame:
        """The last table: it stays for the caller, all others go."""
        path = scratch_path(self.spark, name)
        df.write.parquet(path)
        self.drop()
        release(self.spark)
        return self.spark.read.schema(df.schema).parquet(path)


def grown(df: DataFrame) -> DataFrame:
    """``df``, whose joins are to be by shuffle: both sides grow with the input.

    Else the optimizer would plan small inputs by broadcast and large ones
    another way, and figures of small runs would tell nothing of large ones.
    """
    return df.hint("merge")


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files and broadcasts of plans that are done with.

    Long driver loops would keep them until the next collection of garbage.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Return what a Python worker has freed to the system at the end of a task.

    Idle workers stay beside their executor through the stages that follow.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and the number of words of each text.

    Null and blank texts have no words.  ``lower`` maps A-Z only.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.fill_null(texts, "")))
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    filled = pc.greater(pc.binary_length(flat), 0)
    if not pc.all(filled, min_count=0).as_py():
        kept = filled.to_numpy(zero_copy_only=False)
        before = np.concatenate([[0], np.cumsum(kept, dtype=np.int64)])
        ends = np.cumsum(counts)
        counts = before[ends] - before[ends - counts]
        flat = flat.filter(filled)
    return flat, counts


def word_hashes(words: pa.Array, keys: int = 1) -> list[np.ndarray]:
    """64-bit hashes of the words, equal in every process; one array for each key."""
    if len(words) == 0:
        return [np.zeros(0, np.uint64) for _ in range(keys)]
    coded = words.dictionary_encode()
    distinct = coded.dictionary.to_numpy(zero_copy_only=False)
    at = coded.indices.to_numpy(zero_copy_only=False)
    return [pd.util.hash_array(distinct, hash_key=k, categorize=False)[at] for k in _KEYS[:keys]]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive entries (runs may cross texts)."""
    n = max(0, len(hashes) - width + 1)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = out * _MULT + hashes[i : i + n]
        out ^= out >> np.uint64(29)
    return mix(out)


def starts_in(counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Word positions where a run of ``width`` words fits its text, and the text's row."""
    row = np.repeat(np.arange(len(counts)), counts)
    n = max(0, len(row) - width + 1)
    at = np.flatnonzero(row[:n] == row[width - 1 :]) if n else np.zeros(0, np.int64)
    return at, row[at]
