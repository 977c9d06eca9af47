"""Benchmark decontamination by pigeonhole edit matching.

A test item of n characters may differ from a passage by ``rate * n`` edits (k).
It is split into k + 2 pieces, two of which must stand in the passage unchanged,
in order and shifted against each other by k at most.  One automaton finds all
pieces of all items in a document; where a second piece confirms a first, the
whole item is verified with Myers' bit-parallel distance.  Items under
``min_chars`` characters are found by exact match between word boundaries.
Texts are compared in lower case with white space collapsed.

Documents are read once and never shuffled.  Items are shipped in blocks of at
most ``block_chars`` characters, so a large test set means more passes, not a
larger broadcast.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import give_back
from tessera.llm.packing import slices

RATE = 0.10
MIN_CHARS = 24
BLOCK_CHARS = 16_000_000
SCHEMA = "doc_id long, item_id long, start long, end long, distance long"


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


class Pattern:
    """One item with its character masks for Myers' algorithm."""

    def __init__(self, item_id: int, text: str, rate: float, min_chars: int) -> None:
        self.item_id, self.text, self.size = item_id, text, len(text)
        self.budget = int(rate * self.size)
        self.exact = self.size < max(min_chars, self.budget + 2)
        self.masks = self._masks(text)
        self.back = None

    @staticmethod
    def _masks(text: str) -> dict[str, int]:
        masks: dict[str, int] = {}
        for i, c in enumerate(text):
            masks[c] = masks.get(c, 0) | (1 << i)
        return masks

    def pieces(self) -> Iterator[tuple[int, str]]:
        """(offset, piece): the item cut into budget + 2 parts of even length, an exact one whole."""
        n = 1 if self.exact else self.budget + 2
        for i in range(n):
            a, b = self.size * i // n, self.size * (i + 1) // n
            yield a, self.text[a:b]

    def stands_alone(self, text: str, begin: int) -> bool:
        """Whether the item at ``begin`` cuts no word of ``text``."""
        return not any(0 < at < len(text) and _in_word(text[at - 1]) and _in_word(text[at]) for at in (begin, begin + self.size))

    def search(self, text: str) -> tuple[int, int]:
        """(distance, end) of the best match that ends anywhere in ``text``."""
        return _scan(self.masks, self.size, text, 0)

    def begin(self, text: str, end: int, distance: int) -> int:
        """Start of the match of that distance which ends at ``end``."""
        if distance == 0:
            return end - self.size
        self.back = self.back or self._masks(self.text[::-1])
        return end - _scan(self.back, self.size, text[max(0, end - self.size - self.budget) : end][::-1], 1)[1]


def _in_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def _scan(masks: dict[str, int], size: int, text: str, anchored: int) -> tuple[int, int]:
    """Smallest distance of the pattern to a part of ``text``, and the part's end.

    Anchored parts begin at the text's start, others anywhere.
    """
    full, high = (1 << size) - 1, 1 << (size - 1)
    plus, minus, score = full, 0, size
    best, at, get = size, 0, masks.get
    for j, c in enumerate(text):
        equal = get(c, 0)
        vertical = equal | minus
        horizontal = (((equal & plus) + plus) ^ plus) | equal
        up = (minus | ~(horizontal | plus)) & full
        down = plus & horizontal
        if up & high:
            score += 1
        elif down & high:
            score -= 1
        up, down = (up << 1) | anchored, down << 1
        plus = (down | ~(vertical | up)) & full
        minus = up & vertical & full
        if score < best:
            best, at = score, j + 1
    return best, at


class Matcher:
    """Finds items in documents; built once in each Python process and block."""

    def __init__(self, items: list[tuple[int, str]], rate: float, min_chars: int = MIN_CHARS) -> None:
        import ahocorasick

        self.patterns = [Pattern(i, t, rate, min_chars) for i, t in items]
        where: dict[str, list[tuple[int, int]]] = {}
        for n, p in enumerate(self.patterns):
            for offset, piece in p.pieces():
                where.setdefault(piece, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, start, end, distance): the first passage of each item found."""
        found: dict[int, tuple[int, int, int, int]] = {}
        clean: set[tuple[int, int]] = set()
        seen: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for last, (length, places) in self.automaton.iter(text):
            for n, offset in places:
                if n in found:
                    continue
                p = self.patterns[n]
                begin = last + 1 - length - offset
                if p.exact:
                    if p.stands_alone(text, begin):
                        found[n] = (p.item_id, begin, begin + p.size, 0)
                    continue
                shift = begin // (p.budget + 1)
                confirmed = any(
                    before < offset and abs(other - begin) <= p.budget
                    for near in (shift - 1, shift, shift + 1)
                    for other, before in seen.get((n, near), ())
                )
                seen.setdefault((n, shift), []).append((begin, offset))
                if not confirmed or (n, begin) in clean:
                    continue
                clean.add((n, begin))
                a, b = max(0, begin - p.budget), begin + p.size + p.budget
                distance, end = p.search(text[a:b])
                if distance <= p.budget:
                    start = p.begin(text, a + end, distance)
                    found[n] = (p.item_id, start, a + end, distance)
        return list(found.values())


_BUILT: dict[tuple, Matcher] = {}


def _matcher(key: tuple, items: list[tuple[int, str]], rate: float, min_chars: int) -> Matcher:
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Matcher(items, rate, min_chars)
    return _BUILT[key]


def _blocks(items: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The usable items as (item_id, normal text), in blocks of bounded size."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").distinct()
    total = items.agg(F.sum(F.length("text")).alias("n")).first().n or 0
    blocks = int(total // block_chars) + 1
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).collect()
        usable = sorted((r.item_id, normal(r.text)) for r in rows if r.item_id is not None)
        usable = [x for x in usable if x[1]]
        if usable:
            yield usable


def matches(
    docs: DataFrame, items: DataFrame, rate: float = RATE, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """(doc_id, item_id, start, end, distance) for each item found in a document.

    Places are code points of the normal text.  Null and empty texts hold
    nothing; a null doc_id stays null; items with null id and null or empty text
    are not looked for, those under ``min_chars`` characters only unchanged, as
    whole words; repeated rows give repeated results; other columns are not
    read; empty tables give no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = []
    for block in _blocks(items, block_chars):
        shipped = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped, key=(uuid.uuid4().hex, rate, min_chars)) -> Iterator[pa.RecordBatch]:
            matcher = None
            for whole in batches:
                for batch in slices(whole, "text"):
                    matcher = matcher or _matcher(key, shipped.value, rate, min_chars)
                    rows = [
                        (doc_id, *hit)
                        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                        if text
                        for hit in matcher.find(normal(text))
                    ]
                    columns = zip(*rows, strict=True) if rows else [[]] * 5
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "start", "end", "distance"]
                    )

        parts.append(docs.mapInArrow(run, SCHEMA))
    if not parts:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    return reduce(DataFrame.union, parts)


def without_matches(docs: DataFrame, items: DataFrame, rate: float = RATE, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item."""
    for block in _blocks(items, block_chars):
        shipped = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped, key=(uuid.uuid4().hex, rate, min_chars)) -> Iterator[pa.RecordBatch]:
            matcher = None
            for whole in batches:
                for batch in slices(whole, "text"):
                    matcher = matcher or _matcher(key, shipped.value, rate, min_chars)
                    clean = [not (text and matcher.find(normal(text))) for text in batch.column("text").to_pylist()]
                    yield batch.filter(pa.array(np.array(clean, bool)))
            give_back()

        docs = docs.mapInArrow(run, docs.schema)
    return docs
