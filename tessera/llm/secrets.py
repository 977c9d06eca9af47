"""Secret scans: fixed patterns, and character windows of high entropy.

Candidate strings are maximal runs of characters that secrets are made of.  In
each, the maximal runs of every class (hex, letters and digits, base64) are
looked at by themselves.  A window slides over each run and its Shannon entropy
is kept by incremental counts: a step changes two counts, so two terms of the
sum.  Windows over the class's threshold become spans, unless they are on the
allow-list (identifiers such as UUIDs, digests that are announced as such,
placeholders, plain words); spans that meet are one.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.packing import slices

# The base patterns, their least lengths, and their order.
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "entropy")
# Maximal runs of the class, so that only runs long enough are looked at.
_LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")

#: Stretches of a candidate that look random and are none: UUIDs.
UUID = re.compile(
    r"(?<![0-9a-fA-F])[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}(?![0-9a-fA-F])"
)
#: Runs that look random and are none: dates and numbers, plain words.
PLAIN = (re.compile(r"[0-9_=+/-]+\Z"), re.compile(r"[A-Za-z_/=+-]+\Z"))
#: Windows that hold a placeholder.
PLACEHOLDER = re.compile(r"example|placeholder|changeme|your[_-]|xxxx|0000000|1234567|abcdefgh", re.IGNORECASE)
#: What stands before a digest that is announced as such.
ALLOW_BEFORE = re.compile(r"(sha-?(1|256|512)|md5|integrity|checksum|digest|etag)[\"']?\s*[-:=]?\s*[\"']?\Z", re.IGNORECASE)


@dataclass(frozen=True)
class CharacterClass:
    """A class of candidates: its window and the entropy (bits) that flags it."""

    name: str
    pattern: re.Pattern
    window: int
    threshold: float


CLASSES = (
    CharacterClass("hex", re.compile(r"[0-9a-fA-F]{24,}"), 24, 3.0),
    CharacterClass("alnum", re.compile(r"[A-Za-z0-9]{20,}"), 20, 3.7),
    CharacterClass("base64", re.compile(r"[A-Za-z0-9+/_=-]{20,}"), 20, 3.9),
)


def entropy_windows(text: str, window: int) -> Iterator[tuple[int, float]]:
    """(start, entropy in bits) of each window, from counts that are updated in steps."""
    if len(text) < window:
        return
    term = [0.0, *(c * math.log2(c) for c in range(1, window + 1))]
    counts: dict[str, int] = {}
    total = 0.0
    for i, c in enumerate(text):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += term[n + 1] - term[n]
        if i >= window:
            old = text[i - window]
            n = counts[old]
            counts[old] = n - 1
            total += term[n - 1] - term[n]
        if i >= window - 1:
            yield i - window + 1, math.log2(window) - total / window


def entropy_spans(text: str) -> list[tuple[int, int]]:
    """Spans whose windows are too even for words or numbers, sorted and apart."""
    found = []
    for m in _CANDIDATE.finditer(text):
        candidate = m.group()
        if any(p.match(candidate) for p in PLAIN):
            continue
        runs = [(kind, run) for kind in CLASSES for run in kind.pattern.finditer(candidate)]
        known = [u.span() for u in UUID.finditer(candidate)]
        for _, run in runs:
            start = m.start() + run.start()
            if ALLOW_BEFORE.search(text, max(0, start - 24), start):
                known.append(run.span())
        for kind, run in runs:
            if any(p.match(run.group()) for p in PLAIN):
                continue
            for at, bits in entropy_windows(run.group(), kind.window):
                if bits < kind.threshold:
                    continue
                a = run.start() + at
                b = a + kind.window
                if not any(x < b and a < y for x, y in known) and not PLACEHOLDER.search(candidate, a, b):
                    found.append((m.start() + a, m.start() + b))
    return _joined(found)


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans that overlap or touch."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, sorted."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in _LONG_HEX.finditer(text)]
    return sorted(found)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_entropy, base, spans) for each row.

    ``spans`` is an array of (kind, start, end) in code points, ``base`` those of
    the fixed patterns; both are sorted by start, then kind.  A null text is
    empty and has none; a null doc_id stays null; repeated rows give repeated
    results; other columns are not read; an empty table gives no rows.
    """
    span = "array<struct<kind:string,start:long,end:long>>"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                base, every = [], []
                for text in batch.column("text").to_pylist():
                    b = base_spans(text) if text else []
                    e = sorted(b + [(s, 3, t) for s, t in entropy_spans(text)]) if text else []
                    base.append(b)
                    every.append(e)
                count = lambda k: pa.array([sum(x[1] == k for x in e) for e in every], pa.int64())
                told = lambda lists: pa.array([[{"kind": KINDS[k], "start": s, "end": t} for s, k, t in x] for x in lists], kind)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), *map(count, range(4)), told(base), told(every)],
                    ["doc_id", "n_assign", "n_access", "n_hex", "n_entropy", "base", "spans"],
                )

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(
        run, f"doc_id long, n_assign long, n_access long, n_hex long, n_entropy long, base {span}, spans {span}"
    )


def joined(spans: str) -> object:
    """A column of spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(F.col(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
