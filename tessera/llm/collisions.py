"""Nearest neighbours by counting collisions in sorted projections.

Vectors get one more coordinate, so that of all vectors of a block the largest
inner product with a query is the smallest distance to it.  A block of vectors
is projected on ``PROJECTIONS`` Gaussian directions (orthogonal by groups), and
each projection is one sorted array.  A query opens a window around its own
place in every array and counts, for each vector, the windows that hold it; wider
radii widen the windows (virtual rehashing), and only the ends that are new are
counted.  A vector whose collisions reach ``_threshold`` is verified: its inner
product is computed on the original vectors.  The search ends at the radius at
which a vector as near as the k-th best verified one is found with a chance of
``CHANCE``; the last radius opens every window whole, so a block without k near
vectors is compared throughout and nothing is capped.

Blocks are dealt by a hash and hold about ``BLOCK_ROWS`` vectors each; every
query meets every block once.  Of copies of a vector only the k + 1 with the
smallest ids can be among anyone's k nearest, so no more enter the blocks; that
limit is applied before rows are dealt out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Tables

BLOCK_ROWS = 65_536
PROJECTIONS = 64
CHANCE = 0.9
REACH = 1.2816  # half width over radius: a vector at the radius is in four of five windows
GROWTH = 1.1  # of the radius from level to level
LEVELS = 30
STRIDE = 3  # levels at once while windows are narrow


def _threshold(m: int, p: float = 0.8, chance: float = CHANCE) -> int:
    """The most collisions of m that a vector in each window with probability p reaches with that chance."""
    below = 0.0
    for hits in range(m + 1):
        below += math.comb(m, hits) * p**hits * (1 - p) ** (m - hits)
        if below > 1 - chance:
            return hits
    return m


def directions(dims: int, m: int, seed: int = 1) -> np.ndarray:
    """m Gaussian directions, orthogonal in groups of ``dims``; the same in every task."""
    rng = np.random.default_rng((seed, dims))
    groups = []
    for begin in range(0, m, dims):
        q, _ = np.linalg.qr(rng.standard_normal((dims, dims)))
        lengths = np.linalg.norm(rng.standard_normal((dims, dims)), axis=1)
        groups.append((q.T * lengths[:, None])[: m - begin])
    return np.concatenate(groups)


class Block:
    """Sorted projections of some vectors of one length."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, m: int = PROJECTIONS) -> None:
        order = np.argsort(ids, kind="stable")  # equal scores come by id
        self.ids, self.vectors, self.k, self.m = ids[order], vectors[order], k, m
        squares = np.einsum("ij,ij->i", self.vectors, self.vectors)
        self.top = float(squares.max())
        self.directions = directions(vectors.shape[1] + 1, m)
        places = np.column_stack([self.vectors, np.sqrt(np.maximum(self.top - squares, 0))]) @ self.directions.T
        self.order = np.ascontiguousarray(np.argsort(places, axis=0).T)
        self.places = np.take_along_axis(places.T, self.order, axis=1)
        self.least = _threshold(m)

    def search(self, ids: np.ndarray, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query the ids and scores of its k nearest of this block, itself left out."""
        own = queries @ self.directions[:, :-1].T
        lengths = np.einsum("ij,ij->i", queries, queries)
        far = np.sqrt(self.top + lengths)  # the distance of what has no part in common with the query
        radii = far[:, None] * 1.1 * GROWTH ** np.arange(1 - LEVELS, 1)
        ends = np.empty((2, len(queries), LEVELS + 1, self.m), np.int64)
        for i in range(self.m):
            reach = radii * REACH
            ends[0, :, :LEVELS, i] = np.searchsorted(self.places[i], own[:, i, None] - reach, side="left")
            ends[1, :, :LEVELS, i] = np.searchsorted(self.places[i], own[:, i, None] + reach, side="right")
        ends[0, :, LEVELS], ends[1, :, LEVELS] = 0, len(self.ids)
        for j in range(len(queries)):
            yield self._one(ids[j], queries[j], far[j] ** 2, radii[j], ends[0, j], ends[1, j])

    def _one(self, own: int, query: np.ndarray, far: float, radii: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hits = np.zeros(len(self.ids), np.int16)
        hits[self.ids == own] = -self.m - 1  # never reaches the threshold
        known, scores = [], []
        best, kth = np.zeros(0), -np.inf
        volume = (high - low).sum(axis=1)
        level = int(np.argmax(volume >= min(volume[-1], self.k * self.least)))  # fewer collisions can't make k vectors
        inner_low = inner_high = low[level]
        while True:
            new = [o[a:b] for o, a, b in zip(self.order, low[level].tolist(), inner_low.tolist(), strict=True) if a < b]
            new += [o[a:b] for o, a, b in zip(self.order, inner_high.tolist(), high[level].tolist(), strict=True) if a < b]
            inner_low, inner_high = low[level], high[level]
            if new:
                hits += np.bincount(np.concatenate(new), minlength=len(hits)).astype(np.int16)
            found = np.flatnonzero(hits >= self.least)
            if len(found):
                hits[found] = -self.m - 1
                known.append(found)
                scores.append(self.vectors[found] @ query)
                best = np.concatenate([best, scores[-1]])
                if len(best) > self.k:
                    best = np.partition(best, -self.k)[-self.k :]
                if len(best) == self.k:
                    kth = best.min()
            done, level = level, level + (1 if volume[level] > 0.3 * volume[-1] else STRIDE)
            if level > LEVELS and done < LEVELS:
                level = LEVELS
            if level > LEVELS or (done < LEVELS and far - 2 * kth <= radii[done] ** 2):
                return self._best(query, *map(np.concatenate, (known, scores))) if known else (self.ids[:0], best)

    def _best(self, query: np.ndarray, known: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k best, summed component by component, so that equal vectors have equal scores."""
        if len(known) > self.k:
            kth = np.partition(scores, -self.k)[-self.k]
            known = known[scores >= kth - 1e-9 * max(1.0, self.top, float(query @ query))]
        known = np.sort(known)  # that is, by id
        exact = np.zeros(len(known))
        for x, y in zip(self.vectors[known].T, query, strict=True):
            exact += x * y
        best = np.argsort(-exact, kind="stable")[: self.k]
        return self.ids[known[best]], exact[best]


def usable(vector: Column | str) -> Column:
    """Whether a vector takes part: not null, not zero, all its components there and finite."""
    v = F.col(vector) if isinstance(vector, str) else vector
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _doubles(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, block = None, [], None
        for batch in batches:
            keys = np.column_stack([batch.column(c).to_numpy() for c in ("dims", "cell", "asks")])
            edges = [0, *(np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1).tolist(), len(keys)]
            for begin, end in zip(edges, edges[1:], strict=False):
                if begin == end:
                    continue
                part, (dims, number, asks) = batch.slice(begin, end - begin), keys[begin].tolist()
                if (dims, number) != cell:
                    cell, held, block = (dims, number), [], None
                ids, vectors = part.column("id").to_numpy(), _doubles(part.column("vector"), end - begin)
                if not asks:
                    held.append((ids, vectors))
                    continue
                if block is None:
                    if not held:
                        continue
                    block, held = Block(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]), k), []
                keyed = part.column("row").to_numpy()
                for at in range(0, len(ids), 256):
                    own = slice(at, at + 256)
                    found = list(block.search(ids[own], vectors[own]))
                    n = [len(x) for x, _ in found]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.repeat(ids[own], n)), pa.array(np.repeat(keyed[own], n)),
                            pa.array(np.concatenate([x for x, _ in found])), pa.array(np.concatenate([x for _, x in found])),
                        ],
                        ["query_id", "row", "vec_id", "score"],
                    )

    return run


def nearest(
    vectors: DataFrame, asks: Column, k: int = 20, *, id_column: str = "vec_id", vector_column: str = "embedding", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of every row for which ``asks`` holds.

    ``asks`` is a condition on the id, which is named ``id`` there.  The score is
    the inner product in double precision; equal scores come by the smaller id.
    Rows with the query's own id aren't candidates, and vectors of another length
    aren't either.  Rows with a null id, and vectors that are null, zero, or hold
    null or non-finite components take no part; repeated rows are one; rows that
    share an id with different vectors are searched each; other columns are not
    read; an empty table gives no rows.

    Expected recall is at least ``CHANCE`` for each neighbour; the test measures
    it against brute force.
    """
    spark = vectors.sparkSession
    tables = Tables(spark)
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & usable("vector")).groupBy("id", "vector").agg(F.lit(1).alias("one")).drop("one")
    rows = tables.keep(rows.withColumns({"dims": F.size("vector"), "row": F.xxhash64("vector")}), "vectors")
    copies = Window.partitionBy("row", "vector").orderBy("id")
    base = tables.keep(rows.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).drop("copy"), "vectors-once")
    ask = rows.where(asks)
    n, n_asks = base.count(), ask.count()
    blocks = max(1, -(-n // block_rows))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(1, min(-(-2 * tasks // blocks), -(-n_asks // 256)))
    # Queries go to every block; slabs of them keep what is dealt out at once near the size of the vectors.
    slabs = max(1, -(-n_asks * blocks // max(1, 2 * n)))
    number = lambda of, salt: F.pmod(F.xxhash64("id", "row", F.lit(salt)), F.lit(of))
    held = base.withColumns({"asks": F.lit(0), "cell": F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))})
    held = held.withColumn("cell", number(blocks, 1) * groups + F.col("cell"))
    found = []
    for slab in range(slabs):
        part = ask.where(number(slabs, 3) == slab).withColumns({"asks": F.lit(1), "cell": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
        part = part.withColumn("cell", F.col("cell") * groups + number(groups, 2))
        cells = held.unionByName(part).repartitionByRange(tasks, "dims", "cell").sortWithinPartitions("dims", "cell", "asks")
        near = cells.mapInArrow(_search(k), "query_id long, row long, vec_id long, score double")
        best = Window.partitionBy("query_id", "row").orderBy(F.desc("score"), "vec_id")
        near = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        found.append(tables.keep(near.select("query_id", "rank", "vec_id", "score"), f"nearest-{slab}"))
    out = found[0]
    for part in found[1:]:
        out = out.union(part)
    return tables.give(out, "nearest")
