"""Connected components of a table of links, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Tables


def components(links: DataFrame, tables: Tables, name: str, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): for each node of a link the smallest node that it reaches.

    Each round takes the smallest label around a node and then follows the
    label's own label, so chains halve in length and stars end in one round.
    The minimum around a node is aggregated before rows are dealt out; the
    lookup of labels is a plain equi-join whose links side is the large one, so
    the optimizer may split a hub's links over tasks.  The result is a table of
    ``tables``, named after ``name``.
    """
    ends = F.array(F.struct(F.col(a).alias("node"), F.col(b).alias("near")), F.struct(F.col(b).alias("node"), F.col(a).alias("near")))
    both = tables.keep(links.select(F.explode(ends).alias("e")).select("e.node", "e.near"), f"{name}-links")
    least = F.least(F.col("node"), F.min("near"))
    labels = tables.keep(both.groupBy("node").agg(least.alias("root")), f"{name}-0")
    turn = 0
    while True:
        turn += 1
        around = both.join(labels.select(F.col("node").alias("near"), "root"), "near").groupBy("node").agg(F.min("root").alias("least"))
        lower = labels.select("node", "root").join(around, "node", "left").select("node", F.col("root").alias("was"), F.least("root", "least").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("beyond"))
        labels = tables.keep(lower.join(jump, "root", "left").select("node", "was", F.least("root", "beyond").alias("root")), f"{name}-{turn}")
        tables.drop(f"{name}-{turn - 1}")
        if labels.where("root < was").isEmpty():
            tables.drop(f"{name}-links")
            return labels.select("node", "root")


def contracted(links: DataFrame, roots: DataFrame) -> DataFrame:
    """Links between the roots of what ``links`` joins, those inside one part left out."""
    of = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"__{x}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    ends = ends.select(F.coalesce("__a", "a").alias("a"), F.coalesce("__b", "b").alias("b"))
    return ends.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
