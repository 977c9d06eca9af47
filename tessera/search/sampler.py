"""Random formulas that are shaped like a given set: as many of each (calls, depth) as the set has.

Drawing is by cell of that histogram.  A draw is seeded by the cell and its
number, so any task can make it and the set doesn't depend on how rows are dealt;
draws of another shape are refused, and of the rest each cell keeps its share.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.plans.formula import FUNCTIONS, FormulaError, Node, canonical, depth, parse, render, walk
from tessera.search.evolve import PRICE, WINDOWS, round_rng

BATCH = 100  # distinct formulas that one row asks for
ATTEMPTS = 400  # draws for each formula asked for


def shape(node: Node) -> tuple[int, int]:
    """(function calls, depth)."""
    return sum(n.label in FUNCTIONS for n in walk(node)), depth(node)


def profile(formulas: Iterable[str]) -> Counter:
    """How many formulas have each shape."""
    out = Counter(shape(parse(text)) for text in formulas)
    if not out:
        raise ValueError("a profile needs formulas")
    return out


def quotas(profile: Counter, n: int) -> dict[tuple[int, int], int]:
    """n formulas shared out like the profile, by largest remainders."""
    total = sum(profile.values())
    exact = {cell: n * k / total for cell, k in profile.items()}
    out = {cell: int(x) for cell, x in exact.items()}
    for cell in sorted(exact, key=lambda c: (out[c] - exact[c], c))[: n - sum(out.values())]:
        out[cell] += 1
    return {cell: k for cell, k in sorted(out.items()) if k}


def _split(rng: random.Random, total: int, parts: int) -> list[int]:
    cuts = sorted(rng.randint(0, total) for _ in range(parts - 1))
    return [b - a for a, b in zip([0, *cuts], [*cuts, total], strict=True)]


def draw(rng: random.Random, calls: int, levels: int) -> Node:
    """A panel with so many calls, no deeper than so many levels where that is possible."""
    operator = rng.random() < (0.35 if calls else 0.3) and levels > 1
    if not calls and not operator:
        return Node(rng.choice(PRICE))
    if operator:
        a, b = _split(rng, calls, 2)
        return Node(rng.choice("+-*/"), (draw(rng, a, levels - 1), draw(rng, b, levels - 1)))
    name = rng.choice([f for f in FUNCTIONS if f not in ("DELAY", "POWER", "BOUND")])
    slots = FUNCTIONS[name][0].replace("P+", "PP")
    inner = [s for s in slots if s in "PC"]
    shares = iter(_split(rng, calls - 1, len(inner)))
    children = []
    for s in slots:
        if s == "P":
            children.append(draw(rng, next(shares), levels - 1))
        elif s == "C":
            children.append(Node(rng.choice("><"), (draw(rng, next(shares), levels - 2), Node("0"))))
        else:
            children.append(Node(str(rng.choice(WINDOWS))))
    return Node(name, tuple(children))


def _drawn(rng: random.Random, calls: int, levels: int, asked: int) -> list[str]:
    """Up to ``asked`` distinct formulas of exactly this shape that the language allows."""
    found: dict[str, None] = {}
    for _ in range(ATTEMPTS * asked):
        if len(found) == asked:
            break
        try:
            node = parse(render(canonical(draw(rng, calls, max(1, levels)))))
        except (FormulaError, RecursionError):
            continue
        if shape(node) == (calls, levels):
            found.setdefault(render(node))
    return list(found)


def sample_set(spark: SparkSession, like: Counter, n: int, seed: int, rounds: int = 3) -> DataFrame:
    """(calls, depth, expression): n distinct random formulas, as many of each shape as ``like`` asks for.

    The histogram is of a published set, so its cells are few.  A cell that isn't
    filled after some rounds of drawing is an error, not a smaller set.
    """
    wanted = quotas(like, n)

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                texts = _drawn(round_rng(seed, row.calls, row.depth, row.batch), row.calls, row.depth, row.asked)
                if texts:
                    yield pd.DataFrame({"calls": row.calls, "depth": row.depth, "batch": row.batch, "place": range(len(texts)), "expression": texts})

    for turn in range(1, rounds + 1):
        asks = [(c, d, b, BATCH) for (c, d), k in wanted.items() for b in range(turn * 2 * -(-k // BATCH))]
        rows = spark.createDataFrame(asks, "calls int, depth int, batch int, asked int").repartition(max(1, min(len(asks), spark.sparkContext.defaultParallelism * 2)))
        made = rows.mapInPandas(fill, "calls int, depth int, batch int, place int, expression string")
        first = made.groupBy("expression").agg(F.min(F.struct("calls", "depth", "batch", "place")).alias("f")).select("expression", "f.*")
        order = Window.partitionBy("calls", "depth").orderBy("batch", "place")
        quota = spark.createDataFrame([(c, d, k) for (c, d), k in wanted.items()], "calls int, depth int, quota int")
        kept = first.withColumn("__k", F.row_number().over(order)).join(F.broadcast(quota), ["calls", "depth"]).where(F.col("__k") <= F.col("quota"))
        kept = kept.select("calls", "depth", "expression").persist()
        got = {(r.calls, r.depth): r["count"] for r in kept.groupBy("calls", "depth").count().collect()}
        if got == wanted:
            return kept
        kept.unpersist()
    missing = {cell: k - got.get(cell, 0) for cell, k in wanted.items() if got.get(cell, 0) < k}
    raise ValueError(f"no such formulas found: {missing}")
