"""The trie of conversations by their turns, with counts and sums of every prefix.

A turn is known by the digest of its role and text, so tries are built from
short digests and texts are read once.  Equal conversations are one path with a
count; that aggregation runs before anything is grouped by first turn.

Paths are dealt by the digest of their first turn into buckets of bounded
expected size; in each, ``applyInPandas`` builds tries of dictionaries and sums
them up children first.  A first turn whose paths hold more than ``limit`` turns
is not dealt: the turns that all of them share become a stem, the paths behind
it are dealt by their next turn, and so on until every part is small enough.
Stems are summed up from the parts afterwards.  A path is a row, as a text is.

Members that end at a prefix are hashed in order: ids are sorted by ranges,
written as short strings in parallel, and only those strings of one prefix
meet in one task, which feeds them to SHA-256 one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Tables

LIMIT = 20_000  # turns of distinct paths that one trie may hold

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, path_id binary, above binary"


def turn_paths(turns: DataFrame, spread: Column | None = None) -> DataFrame:
    """(conv_id, path): one row per conversation, its turns' (digest, bytes) in order.

    Turns come by number, null first, and turns of one number by their digests; a
    null role or text is empty.  Rows with a null conv_id are left out.
    ``spread`` are values by which conversations are to be dealt, if not the id.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long"), F.struct(F.col("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes")).alias("t")
    )
    keys = ["conv_id"]
    if spread is not None:
        keys = ["spread", "conv_id"]
        rows = rows.withColumn("spread", spread).repartition("spread")
    paths = rows.groupBy(*keys).agg(F.sort_array(F.collect_list("t")).alias("t"))
    return paths.select(*keys, F.transform("t", lambda t: F.struct(t["digest"].alias("digest"), t["bytes"].alias("bytes"))).alias("path"))


def _joined(digests: Column) -> Column:
    return F.unhex(F.sha2(F.array_join(F.transform(digests, lambda d: F.hex(d)), ""), 256))


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one path's sorted ids as one string each."""
    for batch in batches:
        paths, ids = batch.column("path_id"), batch.column("conv_id").to_numpy()
        if not len(ids):
            continue
        new = pc.not_equal(paths[1:], paths[:-1]).to_numpy(zero_copy_only=False)
        begins = np.concatenate([[0], np.flatnonzero(new) + 1])
        texts = [",".join(map(str, part.tolist())) for part in np.split(ids, begins[1:])]
        yield pa.RecordBatch.from_arrays([paths.take(pa.array(begins)), pa.array(ids[begins]), pa.array(texts)], ["path_id", "first", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each path's strings, which come in order."""
    now, sha = None, None
    for batch in batches:
        done = []
        for path, text in zip(batch.column("path_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if path == now:
                sha.update(b",")
            else:
                if now is not None:
                    done.append((now, sha.hexdigest()))
                now, sha = path, hashlib.sha256()
            sha.update(text.encode())
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.binary()), pa.array([x for _, x in done], pa.string())], ["path_id", "ends_sha256"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([sha.hexdigest()])], ["path_id", "ends_sha256"])


def ends(paths: DataFrame) -> DataFrame:
    """(path_id, ends_sha256): for each whole path the SHA-256 of its members' ids."""
    ids = paths.select("path_id", "conv_id").repartitionByRange("path_id", "conv_id").sortWithinPartitions("path_id", "conv_id")
    strings = ids.mapInArrow(_strings, "path_id binary, first long, ids string")
    return strings.repartition("path_id").sortWithinPartitions("path_id", "first").mapInArrow(_hashed, "path_id binary, ends_sha256 string")


def _tries(group: pd.DataFrame) -> pd.DataFrame:
    """Nodes of the tries of one bucket: dictionaries of children, summed up in postorder."""
    conv, depth, parent, n, size, path, above, children = [], [], [], [], [], [], [], []

    def node(at: int, up: int, least: int, bytes_: int, stem: bytes | None) -> int:
        for values, v in zip((conv, depth, parent, n, size, path, above, children), (least, at, up, 0, bytes_, None, stem, {}), strict=True):
            values.append(v)
        return len(conv) - 1

    tops: dict[bytes, int] = {}
    outer: dict[int, int] = {}
    for row in group.itertuples(index=False):
        at = tops.get(row.key)
        if at is None:
            at = tops[row.key] = node(row.depth, -1, row.least, int(row.bytes[row.depth - 1]), row.above)
            outer[at] = row.up
        for k in range(row.depth - 1, len(row.digests)):
            if k >= row.depth:
                down = children[at].get(row.digests[k])
                if down is None:
                    down = children[at][row.digests[k]] = node(k + 1, at, row.least, int(row.bytes[k]), None)
                at = down
            n[at] += row.n
            conv[at] = min(conv[at], row.least)
        path[at] = row.path_id
    leaves, saved = [0] * len(conv), [0] * len(conv)
    for top in tops.values():
        stack = [(top, False)]
        while stack:
            at, done = stack.pop()
            if not done:
                stack.append((at, True))
                stack.extend((down, False) for down in children[at].values())
                continue
            leaves[at] = sum(leaves[x] for x in children[at].values()) or 1
            saved[at] = sum(saved[x] for x in children[at].values()) + (n[at] - 1) * size[at]
    return pd.DataFrame(
        {
            "conv_id": conv, "depth": depth, "parent_conv_id": [conv[p] if p >= 0 else outer[i] for i, p in enumerate(parent)], "n_convs": n,
            "n_children": [len(c) for c in children], "n_leaves": leaves, "saved_tokens": saved, "path_id": path, "above": above,
        }
    )


def _shared(a: Column, b: Column) -> Column:
    """How many first entries two arrays have in common."""
    n = F.least(F.size(a), F.size(b))
    differs = F.array_position(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x == y), False)
    return F.when(differs == 0, n).otherwise(differs - 1).cast("int")


def trie(paths: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row for each distinct prefix of the paths, the empty one included.

    ``paths`` has conv_id (one row each) and path, as ``turn_paths`` makes them.
    Columns: conv_id (smallest member), depth, parent_conv_id (null for the
    root), n_convs, n_children, n_leaves, saved_tokens (bytes of last texts that
    members share, over the subtree) and ends_sha256 (of the ids of members that
    end there, ascending, joined by commas).  Empty paths end at the root; null
    paths count as empty; rows with a null id are left out; other columns are not
    read; without rows there are no prefixes, not even the empty one.
    """
    spark = paths.sparkSession
    tables = Tables(spark)
    path = F.coalesce("path", F.array().cast("array<struct<digest: binary, bytes: bigint>>"))
    rows = paths.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long"), path["digest"].alias("digests"), path["bytes"].alias("bytes"))
    rows = tables.keep(rows.withColumn("path_id", _joined(F.col("digests"))), "trie-paths")
    whole = tables.keep(
        rows.groupBy("path_id").agg(F.first("digests").alias("digests"), F.first("bytes").alias("bytes"), F.count("*").alias("n"), F.min("conv_id").alias("least")),
        "trie-whole",
    )
    total = whole.agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.sum(F.size("digests")).alias("turns")).first()
    if not total.n:
        return rows.select(
            "conv_id", *(F.lit(0).cast("long").alias(c) for c in ("depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")), F.lit("").alias("ends_sha256")
        )
    # Parts: paths from turn ``depth`` on, grouped by ``key``; ``above`` is the stem they hang on and ``up`` its conv_id.
    part = whole.where(F.size("digests") > 0).select(
        "*", F.lit(1).alias("depth"), F.col("digests")[0].alias("key"), F.lit(b"").alias("above"), F.lit(total.least).alias("up")
    )
    root = whole.where(F.size("digests") == 0).select("path_id").unionByName(spark.range(1).select(F.lit(None).cast("binary").alias("path_id")))
    root = root.agg(F.max("path_id").alias("path_id"))
    stems = [
        root.select(
            F.lit(b"").alias("key"), F.lit(None).cast("binary").alias("above"), F.lit(None).cast("long").alias("up"), F.lit(0).alias("depth"), F.lit(0).alias("last"),
            F.lit(total.n).alias("n"), F.lit(total.least).alias("least"), F.array(F.lit(0).cast("long")).alias("bytes"), "path_id",
        )
    ]
    small, turn = [], 0
    while True:
        turn += 1
        sizes = part.groupBy("key", "depth").agg(
            F.sum(F.size("digests") - F.col("depth") + 1).alias("turns"), F.min("digests").alias("a"), F.max("digests").alias("b"), F.sum("n").alias("all"), F.min("least").alias("conv")
        )
        large = sizes.where((F.col("turns") > limit) & (F.col("a") != F.col("b")))
        large = tables.keep(large.select("key", _shared(F.col("a"), F.col("b")).alias("last"), "all", "conv"), f"trie-large-{turn}")
        if large.isEmpty():
            small.append(part)
            break
        small.append(part.join(large, "key", "left_anti"))
        rest = tables.keep(part.join(large, "key"), f"trie-rest-{turn}")
        ended = F.max(F.when(F.size("digests") == F.col("last"), F.col("path_id")))
        shared = F.first(F.slice("bytes", F.col("depth"), F.col("last") - F.col("depth") + 1))
        found = rest.groupBy("key").agg(
            F.first("above").alias("above"), F.first("up").alias("up"), F.first("depth").alias("depth"), F.first("last").alias("last"),
            F.first("all").alias("n"), F.first("conv").alias("least"), shared.alias("bytes"), ended.alias("path_id"),
        )
        stems.append(tables.keep(found, f"trie-stems-{turn}"))
        part = rest.where(F.size("digests") > F.col("last")).select(
            "path_id", "digests", "bytes", "n", "least", (F.col("last") + 1).alias("depth"), _joined(F.slice("digests", F.lit(1), F.col("last") + 1)).alias("key"),
            F.col("key").alias("above"), F.col("conv").alias("up"),
        )
    buckets = max(1, -(-int(total.turns or 0) // limit))
    dealt = reduce(DataFrame.unionByName, small).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    nodes = [tables.keep(dealt.groupBy("bucket").applyInPandas(_tries, NODE), "trie-nodes")]
    # Stems from the last to the root: their parts' sums, then their own turns from the last to the first.
    tops = nodes[0].where("above is not null").select("above", "n_leaves", "saved_tokens")
    for k in reversed(range(len(stems))):
        below = tops.groupBy(F.col("above").alias("key")).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below"), F.count("*").alias("parts"))
        s = stems[k].join(below, "key", "left").fillna(0, ["below", "parts"]).fillna(1, ["n_leaves"])
        s = s.select("*", F.explode(F.sequence("depth", "last")).alias("at"))
        rest_of = F.slice("bytes", F.col("at") - F.col("depth") + 1, F.col("last") - F.col("at") + 1)
        last, first = F.col("at") == F.col("last"), F.col("at") == F.col("depth")
        made = s.select(
            F.col("least").alias("conv_id"), F.col("at").cast("long").alias("depth"), F.when(first, F.col("up")).otherwise(F.col("least")).alias("parent_conv_id"),
            F.col("n").alias("n_convs"), F.when(last, F.col("parts")).otherwise(1).cast("long").alias("n_children"), "n_leaves",
            (F.col("below") + (F.col("n") - 1) * F.aggregate(rest_of, F.lit(0).cast("long"), lambda x, y: x + y)).alias("saved_tokens"),
            F.when(last, F.col("path_id")).alias("path_id"), F.when(first, F.col("above")).alias("above"),
        )
        made = tables.keep(made, f"trie-made-{k}")
        nodes.append(made)
        tops = tops.unionByName(made.where("above is not null").select("above", "n_leaves", "saved_tokens"))
    every = reduce(DataFrame.unionByName, nodes).drop("above")
    ended = every.where("path_id is not null").join(ends(rows), "path_id").drop("path_id")
    through = every.where("path_id is null").drop("path_id").withColumn("ends_sha256", F.sha2(F.lit(b""), 256))
    return tables.give(ended.unionByName(through), "trie")
