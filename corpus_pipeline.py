"""From raw documents to packed training sequences, in five stages.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept; its result is written as Parquet in the shared folder and read
again, so that a lost executor never reaches back over a stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, hyperminhash, linededup, packing, toxicity
from tessera.llm.common import drop_path, scratch_path, table
from tessera.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score below one half; the model learns from labels that aren't held out.

    Null and empty texts score as texts without words; repeated rows and null ids
    are scored like any others; without labels the fixed lexicon decides; an empty
    table stays empty.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, at_most=0.5)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier one has; those with nothing left go.

    Null texts and rows with a null id stay as they are; rows that share id and
    text are one; a line of the smaller id (then number) stays.
    """
    return linededup.remove_repeated_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id.

    Texts without words and rows with a null id stay; rows that share the id of a
    document that goes, go.
    """
    copies = hyperminhash.near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias("__copy")).distinct()
    return docs.join(copies, F.col("doc_id").cast("long") == F.col("__copy"), "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none, an empty benchmark drops nothing."""
    return decontaminate.without_matches(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences; one row for each piece, its ids as little-endian 32-bit numbers.

    A null or empty text is the end id alone; repeated rows are packed each.
    """
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Tokenising and learned scores are beyond SQL; tests hold every stage and run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's table is deleted once the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop_path(spark, before)
        before = path
    return docs
