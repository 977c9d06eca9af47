"""Line deduplication by deletion neighbourhoods, with DataFrame functions only.

Two lines within one edit (insert, delete or replace a character) share a
variant: the line with one character, at most, deleted.  Emitting every variant
of every long line would multiply the text by its line length, so variants are
narrowed in rounds.  A slot is a stretch of a line that the deletion may fall in
(at first the two halves); its key hashes the line without the slot, the slot's
place and the length.  Lines whose key no other line shares can have no partner
with an edit there and are dropped; the slots of the others are cut into finer
ones.  In the last round slots are single characters: the keys are the deletion
neighbourhood itself, lines that share one are within one edit, which an edit
distance then verifies against the earliest of them.

Slots of a line of n characters are placed for length n and, with one character
missing, for n + 1, so that insertions and deletions line up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Tables, grown, release

MIN_CHARS = 20  # for lines that are similar; equal lines are found from one character on
FAN = 8  # finer slots for each slot and round
_BLANKS = " \t\n\x0b\x0c\r"


def _key(text: Column, size: Column, missing: Column, begin: Column, end: Column) -> Column:
    """Hash of a line without the slot [begin, end) of its aligned length."""
    head = F.substr(text, F.lit(1), begin)
    tail = F.substr(text, end - missing + 1)
    return F.xxhash64(size, missing * 0 + begin, end, head, tail)


def _half_slots(size: Column) -> list[tuple[int, Column, Column, Column]]:
    """(missing, aligned length, begin, end) of the four first slots of a line: two halves, as it is and with one character missing."""
    out = []
    for missing in (0, 1):
        whole = size + missing
        half = F.floor(whole / 2).cast("int")
        out += [(missing, whole, F.lit(0), half), (missing, whole, half, whole)]
    return out


def _halves(text: Column) -> Column:
    """The keys of the four first slots."""
    return F.array(*[_key(text, whole, F.lit(missing), begin, end) for missing, whole, begin, end in _half_slots(F.length(text))])


def _placed(size: Column) -> Column:
    """The four first slots, in the order of their keys."""
    return F.array(
        *[F.struct(F.lit(missing).alias("missing"), begin.alias("begin"), end.alias("end")) for missing, _, begin, end in _half_slots(size)]
    )


def _finer(size_column: str = "size") -> Column:
    """The slots that a slot is cut into, without their keys."""
    begin, end = F.col("begin"), F.col("end")
    step = F.ceil((end - begin) / F.lit(FAN)).cast("int")
    return F.transform(
        F.sequence(begin, end - 1, step),
        lambda b: F.struct(b.alias("begin"), F.least(b + step, end).alias("end")),
    )


def _shared(slots: DataFrame) -> DataFrame:
    """The slots whose key stands in two different lines or more."""
    several = (
        slots.groupBy("key")
        .agg(F.min("line_key").alias("low"), F.max("line_key").alias("high"))
        .where("low < high")
        .select("key")
    )
    return grown(slots).join(several, "key")


def repeated_lines(docs: DataFrame, min_chars: int | None = None, max_edits: int = 1) -> DataFrame:
    """(doc_id, row, line, first_doc, first_line, distance) of lines that an earlier line repeats.

    Lines are what \\n separates, numbered from 1 and compared without white
    space around them; blank lines are never repeats.  Equal lines of any length
    are repeats, similar ones from ``MIN_CHARS`` characters on; a ``min_chars``
    that is given is the least length for both.
    A line repeats an earlier one (smaller doc_id, then smaller number) if they
    are ``max_edits`` (0 or 1) edits apart at most; the earliest found is given,
    equal lines before similar ones.  Null texts have no lines and rows with a
    null doc_id take no part.  ``row`` is a hash of the whole text: rows that
    share a doc_id are ordered by it, and those that share both are one row.
    """
    if max_edits not in (0, 1):
        raise ValueError("max_edits must be 0 or 1")
    spark = docs.sparkSession
    tables = Tables(spark)
    least, least_near = (1, MIN_CHARS) if min_chars is None else (max(1, min_chars), min_chars)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    lines = docs.select("doc_id", F.xxhash64("text").alias("row"), F.posexplode(F.split("text", "\n")).alias("at", "raw"))
    lines = lines.select("doc_id", "row", (F.col("at") + 1).alias("line"), F.btrim("raw", F.lit(_BLANKS)).alias("value"))
    lines = lines.where(F.length("value") >= least)
    keyed = lines.withColumns({"line_key": F.xxhash64("value"), "check": F.xxhash64(F.lit(7), F.reverse("value"))})
    place = F.struct("doc_id", "row", "line")
    long_enough = F.lit(max_edits > 0) & (F.length("value") >= least_near)
    firsts = tables.keep(
        keyed.select("line_key", "check", place.alias("place"), F.when(long_enough, F.col("value")).alias("value"))
        .groupBy("line_key", "check")
        .agg(F.min("place").alias("first"), F.count("*").alias("n"), F.first("value").alias("value")),
        "firsts",
        ("line_key", "check"),
    )
    release(spark)
    equal = (
        grown(keyed.select("doc_id", "row", "line", "line_key", "check"))
        .join(firsts.where("n > 1").select("line_key", "check", "first"), ["line_key", "check"])
        .where(F.col("first") < place)
        .select("doc_id", "row", "line", F.col("first.doc_id").alias("first_doc"), F.col("first.line").alias("first_line"), F.lit(0).alias("distance"))
    )
    if max_edits == 0:
        return tables.give(equal, "repeated-lines")
    equal = tables.keep(equal, "equal")
    release(spark)

    # the first slots are told by their number alone; what they share decides which texts are looked at
    halves = F.posexplode(_halves(F.col("value"))).alias("slot", "key")
    kept = tables.keep(_shared(firsts.where("value is not null").select("line_key", "check", halves)).select("line_key", "check", "slot"), "kept")
    release(spark)
    slots = kept.groupBy("line_key", "check").agg(F.collect_set("slot").alias("slots"))
    texts = grown(firsts.where("value is not null").select("line_key", "check", "first", "value")).join(slots, ["line_key", "check"])
    texts = tables.keep(texts, "texts", ("line_key", "check"))
    tables.drop("kept", "firsts")
    slots = kept = None
    release(spark)
    placed = F.explode(F.transform("slots", lambda i: F.get(_placed(F.length("value")), i)))
    state = texts.select("line_key", "check", "value", placed.alias("s")).where("s.begin < s.end").select("line_key", "check", "value", "s.*")
    turn = 0
    while True:
        turn += 1
        size = F.length("value") + F.col("missing")
        finer = (
            state.select("line_key", "check", "missing", "value", size.alias("size"), F.explode(_finer()).alias("s"))
            .select("line_key", "check", "missing", "value", "size", "s.*")
            .withColumn("key", _key(F.col("value"), F.col("size"), F.col("missing"), F.col("begin"), F.col("end")))
        )
        narrow = tables.keep(_shared(finer.select("line_key", "check", "missing", "begin", "end", "key")), f"narrow-{turn}")
        tables.drop(f"narrow-{turn - 1}")
        state = finer = None
        release(spark)
        if narrow.where("end - begin > 1").isEmpty():
            break
        state = grown(narrow.drop("key")).join(texts.select("line_key", "check", "value"), ["line_key", "check"])

    variants = narrow.join(texts.select("line_key", "check", "first"), ["line_key", "check"]).select("key", "line_key", "check", "first")
    earliest = variants.groupBy("key").agg(F.min(F.struct("first", "line_key", "check")).alias("e"))
    near = variants.join(earliest, "key").where(F.col("e.first") < F.col("first")).groupBy("line_key", "check").agg(F.min("e").alias("e"))
    near = near.select("line_key", "check", F.col("e.first").alias("near"), F.col("e.line_key").alias("other_key"), F.col("e.check").alias("other_check"))
    other = texts.select(F.col("line_key").alias("other_key"), F.col("check").alias("other_check"), F.col("value").alias("other"))
    # the first of equal lines is the only one left to remove; its copies are gone already
    similar = (
        near.join(texts.select("line_key", "check", "first", "value"), ["line_key", "check"])
        .join(other, ["other_key", "other_check"])
        .withColumn("distance", F.levenshtein("value", "other", max_edits))
        .where("distance >= 0")
        .select(
            "first.doc_id", "first.row", "first.line",
            F.col("near.doc_id").alias("first_doc"), F.col("near.line").alias("first_line"), "distance",
        )
    )
    return tables.give(equal.unionByName(similar), "repeated-lines")


def remove_repeated_lines(docs: DataFrame, min_chars: int | None = None, max_edits: int = 1, drop_emptied: bool = True) -> DataFrame:
    """``docs``, all columns, with repeated lines taken out of ``text``.

    With ``drop_emptied`` a document that loses lines and has no word left goes;
    documents that lose nothing always stay, nulls included.
    """
    gone = repeated_lines(docs, min_chars, max_edits).groupBy(F.col("doc_id").alias("__of"), F.col("row").alias("__row")).agg(
        F.collect_set("line").alias("__gone")
    )
    lines = F.split("text", "\n")
    left = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col("__gone"), i + 1)), "\n")
    of_row = (F.col("doc_id").cast("long") == F.col("__of")) & (F.xxhash64("text") == F.col("__row"))
    out = docs.join(gone, of_row, "left")
    out = out.withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(left))
    if drop_emptied:
        out = out.where(F.col("__gone").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.select(*[F.col(c) for c in docs.columns])
