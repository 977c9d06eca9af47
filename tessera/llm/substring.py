"""Removal of word windows that also occur in an earlier document.

1. Exact copies of a text are set aside: every window of a copy starts in the
   copy with the smallest id, so all its words go when it has a full window.
2. Count-min prefilter.  Each task sketches the windows that it reads: every
   window is counted through its anchor, the 8-word run of smallest hash inside
   it, so neighbouring windows share one counter and a window's count is never
   underestimated.  Task sketches (sparse, sorted cells) are merged by ranges of
   cells; the merged sketch keeps only which cells reach two.
3. Second pass.  Windows whose every cell reaches two are grouped exactly by a
   128-bit hash to find the smallest id.  Each task first resolves windows that
   it holds in several documents, so a window adds one row for each task
   chunk, however many copies there are.

The sketch grows with the text, so its load stays the same.  Beyond
``2 ** max_bits`` cells a row it is probed in passes: a hash of the anchor picks
its range of cells, the same in every row, and each pass ships one range and
decides the windows whose anchors fall into it.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, mix, split_words, starts_in, window_hashes, word_hashes
from tessera.llm.packing import slices

ANCHOR = 8
DEPTH = 2
SHARD_BITS = 20  # cells of one shard of the merged sketch: 2 ** SHARD_BITS
CHUNK_CHARS = 3_000_000


def _anchors(grams: np.ndarray, window: int, anchor: int, at: np.ndarray) -> np.ndarray:
    """Position of the smallest anchor hash inside each window that starts in ``at``."""
    best, where = grams[at], at.copy()
    for i in range(1, window - anchor + 1):
        other = grams[at + i]
        less = other < best
        best = np.where(less, other, best)
        where = np.where(less, at + i, where)
    return where


def _ranges(grams: np.ndarray, bits: int) -> np.ndarray:
    """The range of cells, of ``2 ** bits``, of each anchor hash."""
    return (mix(grams) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(grams), np.int64)


def _cells(grams: np.ndarray, bits: int) -> list[np.ndarray]:
    """The cell of each anchor hash inside its range in each row of the sketch."""
    return [(mix(grams + np.uint64(row + 1)) >> np.uint64(64 - bits)).astype(np.int64) for row in range(DEPTH)]


def _sketch_bits(size: int, max_bits: int) -> tuple[int, int]:
    """Bits of the ranges' number and of a range's cells, for a text of that many bytes."""
    expected = max(1, size // 18)  # anchors: about one for three words
    bits = max(SHARD_BITS, int(expected * 3).bit_length())
    inside = min(bits, max(SHARD_BITS, max_bits))
    return bits - inside, inside


def _anchor_width(window: int) -> int:
    return min(ANCHOR, window)


def _pack(cells: np.ndarray, seen: np.ndarray) -> bytes:
    """Sorted cells and whether each was seen twice, as bytes: gaps of 7 bits each."""
    gap = np.diff(cells, prepend=0) * 2 + seen
    more = gap
    n = np.ones(len(gap), np.int64)
    while (more := more >> 7).any():
        n += more > 0
    ends = np.cumsum(n)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for i in range(int(n.max()) if len(n) else 0):
        has = n > i
        out[(ends - n)[has] + i] = ((gap[has] >> (7 * i)) & 127) | np.where(n[has] > i + 1, 128, 0)
    return out.tobytes()


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(data, np.uint8)
    last = raw < 128
    first = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1]) if len(raw) else np.zeros(0, np.int64)
    which = np.concatenate([[0], np.cumsum(last)[:-1]]) if len(raw) else np.zeros(0, np.int64)
    shift = (np.arange(len(raw)) - first[which] if len(raw) else np.zeros(0, np.int64)) * 7
    gap = np.zeros(len(first), np.int64)
    np.add.at(gap, which, (raw & 127).astype(np.int64) << shift)
    return np.cumsum(gap >> 1), (gap & 1).astype(bool)


def _chunks(batches: Iterator[pa.RecordBatch], chars: int) -> Iterator[pa.Table]:
    """Rows regrouped into tables of about ``chars`` bytes of text."""
    held, size = [], 0
    for whole in batches:
        for batch in slices(whole, "text", chars):
            held.append(batch)
            size += pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0
            if size >= chars:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def sketch_windows(docs: DataFrame, window: int, outer: int, bits: int) -> DataFrame:
    """Merged sketch: for each shard of cells, a bitmap of the cells that reach two.

    A shard is numbered row << 40 and its place in the row, ranges one after the other.
    """
    anchor = _anchor_width(window)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _chunks(batches, CHUNK_CHARS):
            words, counts = split_words(table.column("text"))
            hashes = word_hashes(words)[0]
            at, _ = starts_in(counts, window)
            if not len(at):
                continue
            grams = window_hashes(hashes, anchor)
            grams = grams[np.unique(_anchors(grams, window, anchor, at))]
            shards, data = [], []
            base = _ranges(grams, outer) << bits
            for row, cell in enumerate(_cells(grams, bits)):
                cell, n = np.unique(base + cell, return_counts=True)
                edges = np.flatnonzero(np.diff(cell >> SHARD_BITS)) + 1
                for part, seen in zip(np.split(cell, edges), np.split(n > 1, edges), strict=True):
                    shards.append((row << 40) + int(part[0] >> SHARD_BITS))
                    data.append(_pack(part & ((1 << SHARD_BITS) - 1), seen))
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), pa.array(data, pa.binary())], ["shard", "cells"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Sorted by shard, so one shard's counters are held at a time.
        now, counts = None, None

        def done() -> pa.RecordBatch:
            packed = np.packbits(counts > 1, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([packed], pa.binary())], ["shard", "cells"])

        for batch in batches:
            for shard, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if shard != now:
                    if now is not None:
                        yield done()
                    now, counts = shard, np.zeros(1 << SHARD_BITS, np.uint8)
                cell, twice = _unpack(data)
                counts[cell] = np.minimum(counts[cell] + 1 + twice, 2)
        if now is not None:
            yield done()

    kind = "shard long, cells binary"
    parts = docs.select("text").mapInArrow(count, kind)
    shards = DEPTH << max(0, outer + bits - SHARD_BITS)
    return parts.repartition(min(shards, _tasks(docs)), "shard").sortWithinPartitions("shard").mapInArrow(merge, kind)


def _one_range(sketch: DataFrame, which: int, bits: int) -> dict[int, bytes]:
    """The shards of one range, numbered inside it."""
    each = 1 << (bits - SHARD_BITS)
    place = F.col("shard").bitwiseAND(F.lit((1 << 40) - 1))
    rows = sketch.where((place >= which * each) & (place < (which + 1) * each))
    return {r.shard - which * each: bytes(r.cells) for r in rows.toLocalIterator()}


def _tasks(docs: DataFrame) -> int:
    return max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _repeated(sketch: dict[int, bytes], bits: int) -> list[np.ndarray]:
    """The bitmaps of the sketch's rows, side by side."""
    size = 1 << min(SHARD_BITS, bits)
    rows = [np.zeros(max(1, (1 << bits) // 8), np.uint8) for _ in range(DEPTH)]
    for shard, data in sketch.items():
        row, part = shard >> 40, shard & ((1 << 40) - 1)
        rows[row][part * size // 8 : (part + 1) * size // 8] = np.frombuffer(data, np.uint8)[: size // 8]
    return rows


_HERE: dict[str, list[np.ndarray]] = {}


def _unshipped(key: str, rows: list[bytes]) -> list[np.ndarray]:
    """The bitmaps of a broadcast, unpacked once in each Python process."""
    if key not in _HERE:
        _HERE.clear()
        _HERE[key] = [np.frombuffer(zlib.decompress(r), np.uint8) for r in rows]
    return _HERE[key]


def _has(bitmap: np.ndarray, cell: np.ndarray) -> np.ndarray:
    return (bitmap[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 > 0


def repeated_starts(docs: DataFrame, window: int = 13, max_bits: int = 30, bits: tuple[int, int] | None = None) -> DataFrame:
    """(doc_id, text_key, starts): word positions whose window also starts in a smaller doc_id.

    The sketch is made of 2 ** bits[0] ranges of 2 ** bits[1] cells a row; if not
    given, as the text's size asks for, with ranges of 2 ** max_bits cells at most.

    Rows with a null doc_id or text take no part.  Rows that share a doc_id are
    told apart by ``text_key``, a hash of the text that is 0 where ids are unique.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null and text is not null")
    shared_ids = not docs.groupBy("doc_id").count().where("count > 1").isEmpty()
    key = F.crc32(F.col("text").cast("binary")) if shared_ids else F.lit(0).cast("long")
    if bits is None:
        total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
        outer, inside = _sketch_bits(total, max_bits)
    else:
        outer, inside = bits
    sketch = sketch_windows(docs, window, outer, inside)
    if outer:
        sketch = cut(sketch)
    anchor = _anchor_width(window)

    def second(batches: Iterator[pa.RecordBatch], which: int, shipped) -> Iterator[pa.RecordBatch]:
        for table in _chunks(batches, CHUNK_CHARS):
            ids = table.column("doc_id").to_numpy()
            keys = table.column("text_key").to_numpy()
            words, counts = split_words(table.column("text"))
            first, other = word_hashes(words, 2)
            at, row = starts_in(counts, window)
            if len(at):
                grams = window_hashes(first, anchor)
                anchors, back = np.unique(_anchors(grams, window, anchor, at), return_inverse=True)
                keep = _ranges(grams[anchors], outer) == which
                mine = np.flatnonzero(keep)
                for bitmap, cell in zip(_unshipped(*shipped.value), _cells(grams[anchors[mine]], inside), strict=True):
                    keep[mine] &= _has(bitmap, cell)
                at, row = at[keep[back]], row[keep[back]]
            if len(at):
                yield _resolve(
                    window_hashes(first, window)[at],
                    window_hashes(other, window)[at],
                    ids[row],
                    keys[row],
                    at - (np.cumsum(counts) - counts)[row],
                )

    passes = []
    keyed = docs.withColumn("text_key", key)
    for which in range(1 << outer):
        # few cells are repeated, so the bitmaps shrink to a third
        rows = [zlib.compress(r, 1) for r in _repeated(_one_range(sketch, which, inside), inside)]
        shipped = spark.sparkContext.broadcast((uuid.uuid4().hex, rows))
        passes.append(
            keyed.mapInArrow(
                partial(second, which=which, shipped=shipped), "h1 long, h2 long, doc_id long, text_key long, starts array<int>"
            )
        )
    found = reduce(DataFrame.union, passes)
    # h2 holds 32 more bits of the window's hash, and in its lower half the place.
    group = Window.partitionBy("h1", F.shiftright("h2", 32), F.col("starts").isNull())
    place = F.when(F.col("starts").isNull(), F.col("h2").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))
    return (
        found.withColumn("least", F.min("doc_id").over(group))
        .where("starts is not null or least < doc_id")
        .groupBy("doc_id", "text_key")
        .agg(F.concat(F.collect_list(place), F.flatten(F.collect_list("starts"))).alias("starts"))
    )


def _resolve(h1, h2, doc, key, place) -> pa.RecordBatch:
    """Rows to group: the windows of their smallest document here, and the rest by document."""
    h2 = h2 >> np.uint64(32)
    order = np.lexsort((doc, h2, h1))
    h1, h2, doc, key, place = h1[order], h2[order], doc[order], key[order], place[order]
    new = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
    head = doc == doc[np.flatnonzero(new)][np.cumsum(new) - 1]
    packed = ((h2 << np.uint64(32)) | place.astype(np.uint64)).view(np.int64)
    order = np.lexsort((key[~head], doc[~head]))
    d, k, p = (x[~head][order] for x in (doc, key, place))
    edge = np.flatnonzero((np.diff(d) != 0) | (np.diff(k) != 0)) + 1
    begins = np.concatenate([[0], edge]).astype(np.int64) if len(d) else np.zeros(0, np.int64)
    n, m = int(head.sum()), len(begins)
    offsets = np.concatenate([begins, [len(p)]]).astype(np.int32)
    starts = pa.ListArray.from_arrays(pa.array(offsets), pa.array(p.astype(np.int32)))
    spread = mix(d[begins].astype(np.uint64)).view(np.int64)  # so that these rows are dealt evenly
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([h1[head].view(np.int64), spread])),
            pa.array(np.concatenate([packed[head], np.zeros(m, np.int64)])),
            pa.array(np.concatenate([doc[head], d[begins]])),
            pa.array(np.concatenate([key[head], k[begins]])),
            pa.concat_arrays([pa.nulls(n, pa.list_(pa.int32())), starts.cast(pa.list_(pa.int32()))]),
        ],
        ["h1", "h2", "doc_id", "text_key", "starts"],
    )


def remove_repeats(docs: DataFrame, window: int = 13, max_bits: int = 30, bits: tuple[int, int] | None = None) -> DataFrame:
    """Every row of ``docs`` as (doc_id, n_words, n_removed, kept).

    ``kept`` is the text's words that no repeated window covers, joined by one
    space.  A null text has no words; a null doc_id is neither earlier nor later
    than another, so its text is kept whole; rows with one doc_id are one
    document, so neither is earlier; other columns are left out; an empty table
    gives no rows.
    """
    starts = repeated_starts(docs, window, max_bits, bits)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                words, counts = split_words(batch.column("text"))
                ends = np.cumsum(counts)
                lists = batch.column("starts")
                begins = np.repeat(ends - counts, pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
                at = begins + lists.flatten().to_numpy(zero_copy_only=False)
                cover = np.zeros(len(words) + 1, np.int64)
                np.add.at(cover, at, 1)
                np.add.at(cover, at + window, -1)
                gone = np.cumsum(cover[:-1]) > 0
                upto = np.concatenate([[0], np.cumsum(gone)])
                removed = upto[ends] - upto[ends - counts]
                offsets = np.concatenate([[0], np.cumsum(counts - removed)]).astype(np.int32)
                kept = pa.ListArray.from_arrays(pa.array(offsets), words.filter(pa.array(~gone)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(counts), pa.array(removed), pc.binary_join(kept, " ")],
                    ["doc_id", "n_words", "n_removed", "kept"],
                )

    docs = docs.select(F.col("doc_id").cast("long"), "text")
    keyed = docs.join(starts.withColumnRenamed("doc_id", "of"), (F.col("doc_id") == F.col("of")) & (
        (F.col("text_key") == 0) | (F.col("text_key") == F.crc32(F.col("text").cast("binary")))
    ), "left")
    return keyed.select("doc_id", "text", "starts").mapInArrow(
        apply, "doc_id long, n_words long, n_removed long, kept string"
    )
