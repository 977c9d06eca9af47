"""Whole groups of sorted partitions in Arrow batches, for passes that numpy does better than windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def edges_of(column: pa.Array) -> np.ndarray:
    """Where runs of equal values begin, and the length of all; missing values are equal."""
    codes = pc.fill_null(column.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
    if not len(codes):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1, [len(codes)]])


def whole_groups(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(rows, edges): batches cut at the borders of groups, and where each group begins.

    A group that goes over several batches is held until it is complete, so memory
    is one group and one batch.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        edges = edges_of(batch.column(by))
        if held and held[-1].column(by)[-1] != batch.column(by)[0]:
            whole, held = _joined(held, by), []  # parts aren't kept beside the whole
            yield whole
            del whole
        if len(edges) == 2:
            held.append(batch)
            continue
        last = int(edges[-2])
        held.append(batch.slice(0, last))
        whole, held = _joined(held, by), [batch.slice(last)]
        yield whole
        del whole
    if held:
        whole, held = _joined(held, by), []
        yield whole


def _joined(parts: list[pa.RecordBatch], by: str) -> tuple[pa.RecordBatch, np.ndarray]:
    whole = parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
    return whole, edges_of(whole.column(by))


def numbers(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    """Columns as rows of an array of doubles, missing values as NaN."""
    out = np.empty((len(columns), batch.num_rows))
    for i, c in enumerate(columns):
        out[i] = batch.column(c).to_numpy(zero_copy_only=False)
    return out


def map_groups(df: DataFrame, by: str, order: str | None, f: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch], schema) -> DataFrame:
    """``f`` over whole groups of ``by``, in the order of ``order``; ``df`` must be dealt out by ``by`` already, and without an order in whole groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, edges in whole_groups(batches, by):
            yield f(rows, edges)

    return (df.sortWithinPartitions(by, order) if order else df).mapInArrow(run, schema)
