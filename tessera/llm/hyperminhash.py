"""Near-duplicate detection with HyperMinHash sketches.

A document is its set of distinct word 5-shingles (64-bit hashes).  Its sketch
has ``REGISTERS`` buckets; each holds, for the smallest hash of the bucket, the
count of leading zeros (6 bits) and the mantissa bits after them (10 bits).
Empty buckets borrow from a filled one chosen by a hash of the bucket, so that
small sets have full sketches too.

1. Documents with equal sets become one class, represented by its smallest id.
2. Registers are banded (``ROWS`` at a time).  The classes that share a band are
   a bucket; each is paired with the bucket's smallest id only, so a bucket of n
   makes n - 1 pairs.
3. Pairs whose collision-corrected Jaccard estimate is far below the threshold
   are left out; the rest are confirmed on their full sets and joined.
4. Buckets whose classes are still in several parts are compared throughout (all
   but the largest part with itself), in blocks of bounded rows: first the registers alone, which leaves the classes
   that may have another partner, then the full sets of those.  A pair is looked
   at in the first band that it shares only.  So no link is lost to a large
   bucket, and no bucket emits its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Tables, give_back, grown, mix, release, split_words, starts_in, window_hashes, word_hashes
from tessera.llm.graph import components, contracted
from tessera.llm.packing import slices

WIDTH = 5
REGISTERS = 128
MANTISSA = 10
ROWS = 4
BANDS = REGISTERS // ROWS
#: Below this many shingles the estimate is too rough, and the sets are compared at once.
SMALL = 24
#: The estimate is short of the true value by more than this with a chance below 1e-6.
MARGIN = 0.22
#: Members of a bucket that one block holds, and their full sets in bytes.
BLOCK_ROWS = 256
BLOCK_BYTES = 4_000_000


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and the set sizes."""
    words, counts = split_words(texts, lower=True)
    hashes = word_hashes(words)[0]
    ends = np.cumsum(counts)
    at, row = starts_in(counts, width)
    grams = window_hashes(hashes, width)[at]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):  # the whole sequence is the only shingle
        whole = np.array([mix(window_hashes(hashes[ends[r] - counts[r] : ends[r]], counts[r]) + np.uint64(counts[r]))[0] for r in short])
        order = np.argsort(np.concatenate([row, short]), kind="stable")
        grams, row = np.concatenate([grams, whole])[order], np.concatenate([row, short])[order]
    sizes = np.bincount(row, minlength=len(counts))
    edge = np.concatenate([[0], np.cumsum(sizes)])
    for i in np.flatnonzero(sizes > 1):
        grams[edge[i] : edge[i + 1]].sort()
    if not len(grams):
        return grams, sizes
    new = np.concatenate([[True], (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])])
    return grams[new], np.bincount(row[new], minlength=len(counts))


def registers(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """HyperMinHash registers (uint16), one row for each set; sets must not be empty."""
    n = len(sizes)
    row = np.repeat(np.arange(n), sizes)
    values = mix(values)
    bucket = (values & np.uint64(REGISTERS - 1)).astype(np.int64)
    rest = values >> np.uint64(7)  # 57 bits
    least = np.full(n * REGISTERS, np.uint64(2**63))
    np.minimum.at(least, row * REGISTERS + bucket, rest)
    least = least.reshape(n, REGISTERS)
    filled = least < np.uint64(2**63)
    _, exponent = np.frexp(least.astype(np.float64))
    length = np.maximum(exponent, MANTISSA + 1)  # bits from the leading one on
    zeros = np.where(filled, 57 - length, 0)
    mantissa = (least >> (length - 1 - MANTISSA).astype(np.uint64)) & np.uint64((1 << MANTISSA) - 1)
    packed = ((zeros.astype(np.uint64) << np.uint64(MANTISSA)) | mantissa).astype(np.uint16)
    rows, holes = np.nonzero(~filled)
    attempt = 0
    while len(rows):
        attempt += 1
        source = (mix(holes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt)) & np.uint64(REGISTERS - 1)).astype(np.int64)
        there = filled[rows, source]
        packed[rows[there], holes[there]] = packed[rows[there], source[there]]
        rows, holes = rows[~there], holes[~there]
    return packed


def estimated_jaccard(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimates of register rows, less the matches expected by chance.

    The chance that different minima give equal registers follows the
    approximation of the HyperMinHash paper for sets of sizes n and m.
    """
    ratio = np.maximum(n, m) / np.minimum(n, m)
    chance = 0.169919487159739093975315012348 * 4 * ratio / (1 + ratio) ** 2 / (1 << MANTISSA) * 4
    share = (a == b).mean(axis=1)
    return (share - chance) / (1 - chance)


def sketches(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, f1, f2, registers): sizes, set fingerprints and sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                values, sizes = shingle_sets(batch.column("text"), width)
                full = sizes > 0
                sums = [np.concatenate([[0], np.cumsum(mix(values + np.uint64(k)), dtype=np.uint64)]).astype(np.uint64) for k in (1, 2)]
                ends = np.cumsum(sizes)
                f1, f2 = ((s[ends] - s[ends - sizes]).view(np.int64) for s in sums)
                data: list = [None] * len(sizes)
                if full.any():
                    for i, r in zip(np.flatnonzero(full), registers(values, sizes[full]), strict=True):
                        data[i] = r.astype("<u2").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(sizes.astype(np.int64)), pa.array(f1), pa.array(f2), pa.array(data, pa.binary())],
                    ["doc_id", "n_shingles", "f1", "f2", "registers"],
                )
        give_back()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_shingles long, f1 long, f2 long, registers binary"
    )


def _keys_of(marks: np.ndarray) -> np.ndarray:
    """The band keys of register rows, one column for each band."""
    r = marks.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = reduce(lambda x, i: (x << np.uint64(16)) | r[:, :, i], range(1, ROWS), r[:, :, 0])
    return mix(key + mix(np.arange(BANDS, dtype=np.uint64))[None, :]).view(np.int64)


def band_keys(reps: DataFrame) -> DataFrame:
    """(key, doc_id): one row for each band of each sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 4000):
                part = batch.slice(begin, 4000)
                key = _keys_of(_marks(part.column("registers")))
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.repeat(ids, BANDS))], ["key", "doc_id"])

    return reps.select("doc_id", "registers").mapInArrow(run, "key long, doc_id long")


def _marks(column: pa.Array) -> np.ndarray:
    """A column of registers as rows of numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, REGISTERS)


def _may_link(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether sizes and registers of pairs allow a link."""
    small, large = np.minimum(n, m), np.maximum(n, m)
    may = 100 * small >= percent * large
    rough = small < SMALL
    at = np.flatnonzero(may & ~rough)
    may[at] = estimated_jaccard(a[at], b[at], n[at], m[at]) >= percent / 100 - MARGIN
    return may


def _likely(pairs: DataFrame, sketch: DataFrame, percent: int) -> DataFrame:
    """The pairs that sizes and estimates allow to be links."""
    side = lambda x: sketch.select(F.col("doc_id").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("registers").alias(f"r{x}"))
    both = grown(grown(pairs).join(side("b"), "b")).join(side("a"), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (_marks(batch.column(x)) for x in ("ra", "rb"))
                n, m = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("na", "nb"))
                yield batch.select(["a", "b"]).filter(pa.array(_may_link(a, b, n, m, percent)))

    return both.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(run, "a long, b long").distinct()


def full_sets(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, shingles): the whole sorted sets as little-endian 64-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                values, sizes = shingle_sets(batch.column("text"), width)
                ends = np.cumsum(sizes)
                data = [values[e - n : e].astype("<u8").tobytes() for e, n in zip(ends, sizes, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(data, pa.binary())], ["doc_id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, shingles binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [
                _linked(np.frombuffer(a.as_buffer(), "<u8"), np.frombuffer(b.as_buffer(), "<u8"), percent)
                for a, b in zip(batch.column("sa"), batch.column("sb"), strict=True)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("shingles").alias(f"s{x}"))
    return grown(grown(pairs).join(side("b"), "b")).join(side("a"), "a").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _blocks(members: DataFrame, filled: Column) -> DataFrame:
    """``members`` (key, doc_id, root, ...) dealt to the pairs of blocks of their bucket that may hold a new link.

    ``filled`` tells how many blocks a set of rows fills.  A bucket that fits one
    block is that block.  Else its largest part (the members of one root) needn't
    be compared with itself: the blocks of the other members come first and meet
    all, those of the largest part meet the others' only.  So a bucket of n rows
    makes about n as long as the others fit one block.

    ``own`` is a row's block and (key, low, high) the pair of blocks; pairs of
    rows inside one block belong to the pair (block, block).
    """
    parts = members.groupBy("key", "root").agg(filled.alias("filled"))
    sized = parts.groupBy("key").agg(F.max_by("root", F.struct("filled", "root")).alias("main"), F.max("filled").alias("most"), F.sum("filled").alias("all"))
    one = F.col("all") <= 1
    others = F.when(one, F.lit(1)).otherwise(F.ceil(F.col("all") - F.col("most"))).cast("int")
    sized = sized.select("key", F.when(~one, F.col("main")).alias("main"), others.alias("others"), F.ceil("most").cast("int").alias("mains"))
    dealt = grown(members).join(sized, "key").withColumn("in_main", F.coalesce(F.col("root") == F.col("main"), F.lit(False)))
    at = lambda blocks: F.pmod(F.xxhash64("doc_id"), F.col(blocks)).cast("int")
    dealt = dealt.withColumn("own", F.when(F.col("in_main"), F.col("others") + at("mains")).otherwise(at("others")))
    met = F.when(F.col("in_main") | F.col("main").isNull(), F.col("others")).otherwise(F.col("others") + F.col("mains"))
    dealt = dealt.where("others > 0").withColumn("other", F.explode(F.sequence(F.lit(0), met - 1)))
    return dealt.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).drop("main", "others", "mains", "in_main", "other")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Whole groups of rows sorted by (key, low, high), several at once, and where each begins."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        held = batch if held is None else pa.concat_batches([held, batch])
        edge = _edges(held)
        if len(edge) > 1:
            yield held.slice(0, edge[-1]), edge[:-1]
            held = held.slice(edge[-1])
    if held is not None:
        yield held, _edges(held)


def _edges(batch: pa.RecordBatch) -> np.ndarray:
    columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "low", "high")]
    new = reduce(np.logical_or, [c[1:] != c[:-1] for c in columns])
    return np.concatenate([[0], np.flatnonzero(new) + 1])


def plausible(members: DataFrame, percent: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(key, doc_id) of members that may have a partner with another root in their bucket.

    ``members`` has key, doc_id, root, n_shingles and registers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, begin in _groups(batches):
            marks = _marks(batch.column("registers"))
            key, own, ids, root, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "own", "doc_id", "root", "n_shingles"))
            keys = _keys_of(marks)
            end = np.append(begin[1:], len(ids))
            last = np.repeat(end, end - begin)
            mixed = np.repeat(batch.column("low").to_numpy(zero_copy_only=False)[begin] != batch.column("high").to_numpy(zero_copy_only=False)[begin], end - begin)
            hit = np.zeros(len(ids), bool)
            for step in range(1, int((end - begin).max())):  # row i with row i + step, in all groups at once
                i = np.flatnonzero(np.arange(len(ids)) + step < last)
                j = i + step
                fits = (root[i] != root[j]) & ~(mixed[i] & (own[i] == own[j]))
                small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
                fits &= 100 * small >= percent * large
                i, j = i[fits], j[fits]
                for a in range(0, len(i), 20_000):
                    x, y = i[a : a + 20_000], j[a : a + 20_000]
                    may = _may_link(marks[x], marks[y], n[x], n[y], percent)
                    x, y = x[may], y[may]
                    first = keys[x, (keys[x] == keys[y]).argmax(axis=1)] == key[x]
                    hit[x[first]] = hit[y[first]] = True
            yield pa.RecordBatch.from_arrays([pa.array(key[hit]), pa.array(ids[hit])], ["key", "doc_id"])

    dealt = _blocks(members, F.count("*") / F.lit(block_rows))
    dealt = dealt.select("key", "low", "high", "own", "doc_id", "root", "n_shingles", "registers")
    rows = dealt.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return rows.mapInArrow(run, "key long, doc_id long").distinct()


def bucket_links(members: DataFrame, sets: DataFrame, percent: int, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Links (a, b) between members of one bucket that have different roots.

    ``members`` has key, doc_id, root, n_shingles and registers.  A bucket is
    cut into blocks of bounded rows and bytes and every pair of blocks (but those
    of the largest part alone) is one group; it looks at registers first and at full sets where they allow a link.
    Members that a group has joined are not compared again, so it returns fewer
    links than it has members, and those are enough to connect what is linked.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, begin in _groups(batches):
            found = []
            for a, b in zip(begin, np.append(begin[1:], batch.num_rows), strict=True):
                found += _compared(batch.slice(a, b - a), percent)
            x, y = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])

    full = grown(members).join(sets, "doc_id")
    filled = F.greatest(F.count("*") / F.lit(block_rows), F.sum(F.octet_length("shingles")) / F.lit(block_bytes))
    dealt = _blocks(full, filled).select("key", "low", "high", "own", "doc_id", "root", "n_shingles", "registers", "shingles")
    rows = dealt.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return rows.mapInArrow(run, "a long, b long").distinct()


def _compared(group: pa.RecordBatch, percent: int) -> list[tuple[int, int]]:
    """The links that connect what is linked in one pair of blocks."""
    ids, root, n, own = (group.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "root", "n_shingles", "own"))
    marks, sets = _marks(group.column("registers")), group.column("shingles")
    keys, key = _keys_of(marks), group.column("key")[0].as_py()
    label = np.unique(root, return_inverse=True)[1]
    one = group.column("low")[0].as_py() == group.column("high")[0].as_py()
    found = []
    for i in range(len(ids) - 1):
        j = np.arange(i + 1, len(ids))
        fits = label[j] != label[i]
        if not one:
            fits &= own[j] != own[i]
        j = j[fits]
        j = j[_may_link(marks[i][None, :].repeat(len(j), axis=0), marks[j], np.full(len(j), n[i]), n[j], percent)]
        shared = keys[j] == keys[i]
        for k in j[keys[i][shared.argmax(axis=1)] == key]:
            if label[i] != label[k] and _linked(_set(sets, i), _set(sets, k), percent):
                found.append((int(ids[i]), int(ids[k])))
                label[label == label[k]] = label[i]
    return found


def _set(sets: pa.Array, i: int) -> np.ndarray:
    return np.frombuffer(sets[int(i)].as_buffer(), "<u8")


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int((y[at] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def near_duplicates(docs: DataFrame, percent: int = 75, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``.

    Links join documents with 100 * intersection >= ``percent`` * union of
    their shingle sets; ``component_id`` is the smallest id that links reach and
    ``kept`` marks that document.  Texts without words (null, empty or blank)
    are linked with nothing; a row with a null id is its own group, kept, with a
    null component; rows that share an id count as linked; other columns are not
    read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    tables = Tables(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    every = tables.keep(sketches(docs, width), "sketches")
    full = every.where("n_shingles > 0 and doc_id is not null")
    smallest = F.min(F.struct("doc_id", "registers")).alias("m")
    classes = tables.keep(full.groupBy("n_shingles", "f1", "f2").agg(smallest).select("n_shingles", "f1", "f2", "m.*"), "classes")

    keys = band_keys(classes)
    shared = keys.groupBy("key").agg(F.min("doc_id").alias("centre"), F.count("*").alias("members")).where("members > 1")
    buckets = tables.keep(grown(keys).join(shared, "key").where("doc_id != centre"), "buckets")
    pairs = buckets.select(F.col("centre").alias("a"), F.col("doc_id").alias("b")).distinct()
    pairs = tables.keep(_likely(pairs, classes, percent), "pairs")
    release(spark)
    # every full set that may be needed, so that texts are dealt out once
    ids = buckets.select(F.explode(F.array("centre", "doc_id")).alias("doc_id")).distinct()
    sets = tables.keep(full_sets(grown(docs).join(ids, "doc_id", "left_semi"), width), "sets")
    release(spark)
    links = confirmed(pairs, sets, percent).union(_same_id(full, classes))
    roots = components(links, tables, "roots")
    keys = shared = pairs = ids = links = None
    tables.drop("pairs")
    release(spark)

    # what the centres have not joined: buckets whose other members are in several parts
    of = grown(buckets.where("members > 2").select("key", "doc_id")).join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    of = of.withColumn("root", F.coalesce("root", "doc_id"))
    parts = of.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("key")
    rest = tables.keep(grown(grown(of).join(parts, "key")).join(classes.select("doc_id", "n_shingles", "registers"), "doc_id"), "rest")
    left = tables.keep(grown(rest).join(plausible(rest, percent), ["key", "doc_id"]), "left")
    tables.drop("buckets", "rest")
    release(spark)
    more = tables.keep(contracted(bucket_links(left, sets, percent), roots), "more")
    of = parts = rest = left = sets = None
    tables.drop("left", "sets")
    release(spark)
    beyond = components(more, tables, "beyond").select(F.col("node").alias("root"), F.col("root").alias("beyond"))

    node = roots.withColumnRenamed("node", "doc_id")
    classed = grown(classes.select("n_shingles", "f1", "f2", "doc_id")).join(node, "doc_id", "left")
    classed = classed.withColumn("root", F.coalesce("root", "doc_id")).join(beyond, "root", "left")
    classed = classed.select("n_shingles", "f1", "f2", F.coalesce("beyond", "root").alias("root"))
    out = grown(every.select("doc_id", "n_shingles", "f1", "f2")).join(classed, ["n_shingles", "f1", "f2"], "left")
    component = F.when((F.col("n_shingles") == 0) | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("root"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    out = out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    return tables.give(out, "near-duplicates")


def _same_id(full: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of rows that share a doc_id."""
    twice = full.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    of = classes.select("n_shingles", "f1", "f2", F.col("doc_id").alias("class"))
    held = full.join(twice, "doc_id").select("doc_id", "n_shingles", "f1", "f2").join(of, ["n_shingles", "f1", "f2"])
    least = held.groupBy("doc_id").agg(F.min("class").alias("a"))
    return held.join(least, "doc_id").where("a != class").select("a", F.col("class").alias("b")).distinct()
