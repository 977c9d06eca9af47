"""Periodic runs of words: where a text repeats itself at a fixed distance.

A run is a stretch of words with smallest period q (words q apart are equal)
that no neighbouring word extends, of at least ``min_length`` words and
``min_repeats`` periods.

1. Narrowing, which loses no run: of a run at least ``_gram`` words stand q
   apart from equal ones, so every window of that many words in it has an equal
   window at most q words before.  Windows are hashed and sorted for a slice of
   texts at once; stretches of windows that have a near enough equal one before
   are zones, and a zone also bounds the period of the runs inside it.
2. Each zone gets a suffix automaton.  Its states are folded into their suffix
   links from the longest to the shortest, and the ordered sets of end positions
   are merged small to large.  Two ends that become neighbours in a state as
   long as their distance or longer are a square.
3. Squares are extended in both directions, and of runs over the same stretch
   the one of smallest period counts.

Nothing is shuffled: a task holds one slice of texts and the automaton of one
zone, about 400 bytes for each word of the zone.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import mix, split_words, starts_in, window_hashes
from tessera.llm.packing import slices

CHUNK = 1024  # end positions of one part of an ordered set


class Ends:
    """An ordered set of end positions, in parts of at most 2 * CHUNK."""

    __slots__ = ("parts", "size")

    def __init__(self, first: int) -> None:
        self.parts, self.size = [[first]], 1

    def __iter__(self) -> Iterator[int]:
        for part in self.parts:
            yield from part

    def add(self, end: int) -> tuple[int | None, int | None]:
        """Insert an end that isn't there yet; its neighbours."""
        parts, k = self.parts, 0
        if len(parts) > 1:
            k = max(0, bisect_left(parts, end, key=lambda part: part[0]) - 1)
        part = parts[k]
        i = bisect_left(part, end)
        before = part[i - 1] if i else None
        after = part[i] if i < len(part) else parts[k + 1][0] if k + 1 < len(parts) else None
        part.insert(i, end)
        self.size += 1
        if len(part) > 2 * CHUNK:
            parts[k : k + 1] = [part[:CHUNK], part[CHUNK:]]
        return before, after


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Length, suffix link and end position (-1 for a clone) of each state of the suffix automaton."""
    length, link, end, following = [0], [-1], [-1], [{}]
    last = 0
    for i, word in enumerate(words):
        new = len(length)
        length.append(i + 1)
        end.append(i)
        following.append({})
        at = last
        while at >= 0 and word not in following[at]:
            following[at][word] = new
            at = link[at]
        if at < 0:
            link.append(0)
        else:
            target = following[at][word]
            if length[target] == length[at] + 1:
                link.append(target)
            else:
                clone = new + 1
                link.append(clone)
                length.append(length[at] + 1)
                link.append(link[target])
                end.append(-1)
                following.append(dict(following[target]))
                link[target] = clone
                while at >= 0 and following[at].get(word) == target:
                    following[at][word] = clone
                    at = link[at]
        last = new
    return length, link, end


def squares(words: list[int], repeats: int = 2) -> Iterator[tuple[int, int]]:
    """(end, period) of squares found as neighbours of end positions.

    Each run of at least ``repeats`` periods holds one of them: at its last word
    the longest common suffix with the word a period before is the run less one
    period, and the two are neighbours in that state.
    """
    length, link, end = automaton(words)
    ends: list[Ends | None] = [Ends(e) if e >= 0 else None for e in end]
    for state in sorted(range(1, len(length)), key=length.__getitem__, reverse=True):
        mine, up = ends[state], link[state]
        ends[state] = None
        if up == 0:
            continue  # the root's string is empty: nothing is near enough
        other, bound = ends[up], length[up] // (repeats - 1)
        if other is None:
            ends[up] = mine
            continue
        small, large = (mine, other) if mine.size <= other.size else (other, mine)
        for e in small:
            before, after = large.add(e)
            if before is not None and e - before <= bound:
                yield e, e - before
            if after is not None and after - e <= bound:
                yield after, after - e
        ends[up] = large


def _equal_for(words: np.ndarray, i: int, j: int, step: int) -> int:
    """How many words from i and from j on, forwards or backwards, are equal one by one."""
    done, chunk = 0, 64
    while True:
        a, b = i + step * done, j + step * done
        room = min(len(words) - max(a, b), chunk) if step > 0 else min(min(a, b) + 1, chunk)
        if room <= 0:
            return done
        one, two = (words[a : a + room], words[b : b + room]) if step > 0 else (words[a - room + 1 : a + 1][::-1], words[b - room + 1 : b + 1][::-1])
        other = np.flatnonzero(one != two)
        if len(other):
            return done + int(other[0])
        done, chunk = done + room, chunk * 2


def runs_of(words: np.ndarray, low: int, high: int, repeats: int, least: int) -> dict[tuple[int, int], int]:
    """{(start, length): period} of the runs whose squares lie in words[low:high]."""
    found: dict[tuple[int, int], int] = {}
    spans: dict[int, list[tuple[int, int]]] = {}  # by period, ordered: (start, end) of stretches extended before
    _, codes = np.unique(words[low:high], return_inverse=True)
    for end, period in squares(codes.tolist(), repeats):
        end += low
        known = spans.setdefault(period, [])
        k = bisect_left(known, (end - period + 1,)) - 1  # runs of one period overlap by less than it
        if k >= 0 and known[k][1] >= end:
            continue
        right = end + _equal_for(words, end + 1, end + 1 - period, 1)
        left = end - period - _equal_for(words, end, end - period, -1) + 1
        insort(known, (left, right))
        size = right - left + 1
        if size >= max(least, repeats * period):
            found[left, size] = min(period, found.get((left, size), period))
    return found


def _gram(repeats: int, least: int) -> int:
    """The words of a run that surely have an equal one a period before."""
    return min(max(least, repeats * q) - q for q in range(1, least + 1))


def zones(codes: np.ndarray, counts: np.ndarray, repeats: int, least: int) -> list[tuple[int, int, int]]:
    """(text, first word, end) of the stretches of word positions that can hold runs."""
    gram = _gram(repeats, least)
    at, row = starts_in(counts, gram)
    if not len(at):
        return []
    key = window_hashes(codes.astype(np.uint64), gram)[at] ^ mix(row.astype(np.uint64))
    order = np.argsort(key, kind="stable")
    near = np.full(len(at), np.iinfo(np.int64).max)
    same = (key[order[1:]] == key[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
    near[order[1:][same]] = at[order[1:]][same] - at[order[:-1]][same]
    keep = near <= counts[row] // repeats
    at, row, near = at[keep], row[keep], near[keep]
    while len(at):
        # a block of windows with an equal one before: it bounds the period of what it holds
        new = np.concatenate([[True], (np.diff(at) != 1) | (np.diff(row) != 0)])
        block = np.cumsum(new) - 1
        most = (np.bincount(block)[block] + gram - 1) // (repeats - 1)
        keep = near <= most
        if keep.all():
            first = np.flatnonzero(new)
            last = np.concatenate([first[1:], [len(at)]]) - 1
            begins = (np.cumsum(counts) - counts)[row[first]]
            low = np.maximum(begins, at[first] - most[first])
            return list(zip(row[first].tolist(), low.tolist(), (at[last] + gram).tolist(), strict=True))
        at, row, near = at[keep], row[keep], near[keep]
    return []


def periodic_runs(docs: DataFrame, min_repeats: int = 4, min_length: int = 6) -> DataFrame:
    """Every row of ``docs`` as (doc_id, n_words, runs, collapsed).

    ``runs`` are structs of start (a word's number from 0), length and period, by
    start, then period; ``collapsed`` is the text's words, joined by one space,
    without those that a run holds after its first period.  A null or empty text
    has no words and no runs; null ids stay null; repeated rows are judged each;
    other columns are left out; an empty table gives no rows.
    """
    if min_repeats < 2 or min_length < 2:
        raise ValueError("a run repeats: two periods and two words at least")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                words, counts = split_words(batch.column("text"))
                codes = np.zeros(0, np.int64)
                if len(words):
                    codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
                begins = np.cumsum(counts) - counts
                found: dict[int, dict[tuple[int, int], int]] = {}
                for text, low, high in zones(codes, counts, min_repeats, min_length):
                    begin = int(begins[text])
                    own = codes[begin : begin + int(counts[text])]
                    mine = found.setdefault(text, {})
                    for stretch, period in runs_of(own, low - begin, high - begin, min_repeats, min_length).items():
                        mine[stretch] = min(period, mine.get(stretch, period))
                cover = np.zeros(len(words) + 1, np.int64)
                runs: list[list[dict]] = [[] for _ in range(len(counts))]
                for text, mine in found.items():
                    for (start, size), period in sorted(mine.items(), key=lambda x: (x[0][0], x[1])):
                        runs[text].append({"start": start, "length": size, "period": period})
                        cover[begins[text] + start + period] += 1
                        cover[begins[text] + start + size] -= 1
                gone = np.cumsum(cover[:-1]) > 0
                upto = np.concatenate([[0], np.cumsum(gone)])
                left = counts - (upto[begins + counts] - upto[begins])
                offsets = np.concatenate([[0], np.cumsum(left)]).astype(np.int32)
                kept = pa.ListArray.from_arrays(pa.array(offsets), words.filter(pa.array(~gone)))
                kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(counts), pa.array(runs, kind), pc.binary_join(kept, " ")],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )

    run = "array<struct<start: bigint, length: bigint, period: bigint>>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        find, f"doc_id long, n_words long, runs {run}, collapsed string"
    )
