"""Line-first quality rules, with DataFrame functions only.

Each line is judged by itself: marks (too many symbols), navigation (a row of
short entries between separators), boilerplate (phrases that pages carry) and
punctuation (a line as long as a sentence without any).  Of the lines left, runs
of short ones without punctuation are navigation too, one entry to a line.
Lines that fail go, and a document is rejected when too little of it is left, or
when it fails a rule for whole texts.

Everything is local to a row: one scan, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
_BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Phrases of page furniture, looked for in lower case.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service",
    "enable javascript", "lorem ipsum", "subscribe to our newsletter", "click here", "sign in to continue",
    "tous droits réservés", "politique de confidentialité", "mentions légales", "cliquez ici",
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "hier klicken",
    "todos los derechos reservados", "política de privacidad", "política de cookies", "haga clic aquí",
)
SEPARATORS = "|»•›"
PUNCTUATION = ".,;:!?…。，、；：！？،؛؟۔।"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Share of a document's words that must be left, in percent.
MIN_LEFT_PERCENT = 50
#: A line may have this many symbols for each 100 characters, and so many words without any punctuation.
MAX_SYMBOL_PERCENT = 10
MAX_PLAIN_WORDS = 15
MIN_SEPARATORS = 3
#: So many lines in a run (blank ones aside), of so many words at most and without punctuation, are a menu.
MENU_LINES = 5
ENTRY_WORDS = 3


def words_of(text: Column) -> Column:
    """Words (runs of other characters than space and \\t to \\r) as an array."""
    return F.array_remove(F.split(F.translate(text, _BLANKS[1:], " " * 5), " "), "")


def _without(text: Column, marks: str) -> Column:
    return F.translate(text, marks, "")


def _has(text: Column, marks: str) -> Column:
    return text.rlike(f"[{marks}]")


def _count(text: Column, marks: str) -> Column:
    # most lines have none, which a search shows sooner than a translation
    return F.when(_has(text, marks), F.length(text) - F.length(_without(text, marks))).otherwise(F.lit(0))


def _furnished(lower: Column) -> Column:
    """Whether a text in lower case holds a phrase of page furniture."""
    found = F.lit(False)
    for phrase in BOILERPLATE:
        found = found | lower.contains(phrase)
    return found


def _bare(line: Column) -> Column:
    return ~_has(line, PUNCTUATION)


def line_fails(line: Column, phrases: bool = True) -> Column:
    """Whether a line fails a rule; lines without words don't.

    ``phrases=False`` leaves out the boilerplate rule, for texts known to hold no phrase.
    """
    n = F.size(words_of(line))
    separators = _count(line, SEPARATORS)
    fails = (
        (_count(line, SYMBOLS) * 100 > MAX_SYMBOL_PERCENT * F.length(line))
        | ((separators >= MIN_SEPARATORS) & (separators * 5 >= n))
        | (_bare(line) & (n > MAX_PLAIN_WORDS))
    )
    return (n > 0) & (fails | _furnished(F.lower(line)) if phrases else fails)


def _good(lines: Column, phrases: bool) -> Column:
    return F.filter(lines, lambda x: ~line_fails(x, phrases))


def _without_menus(lines: Column) -> Column:
    """The lines without runs of ``MENU_LINES`` entries or more; blank lines don't end a run."""

    def entry(line: Column) -> Column:
        n = F.size(words_of(line))
        return _bare(line) & (n > 0) & (n <= ENTRY_WORDS)

    def entries(some: Column) -> Column:
        return F.size(F.filter(some, entry))

    def ends_run(line: Column) -> Column:
        return (F.size(words_of(line)) > 0) & ~entry(line)

    several = F.size(lines)
    # numbers of the lines that end a run, and one past the last line
    ends = F.concat(F.filter(F.sequence(F.lit(1), several), lambda i: ends_run(F.get(lines, i - 1))), F.array(several + 1))
    begins = F.concat(F.array(F.lit(0)), F.slice(ends, 1, F.size(ends) - 1))
    runs = F.zip_with(begins, ends, lambda a, b: F.struct(F.slice(lines, a + 1, b - a - 1).alias("run"), F.slice(lines, b, F.lit(1)).alias("end")))
    left = F.transform(runs, lambda r: F.when(entries(r["run"]) >= MENU_LINES, r["end"]).otherwise(F.concat(r["run"], r["end"])))
    return F.when(entries(lines) >= MENU_LINES, F.flatten(left)).otherwise(lines)


def _window_key(words: Column, i: Column) -> Column:
    """128 bits for the window that starts after i words: the words in both orders."""
    entries = [F.get(words, i + k) for k in range(WINDOW)]
    return F.struct(F.xxhash64(*entries).alias("h"), F.xxhash64(*entries[::-1]).alias("g"))


def _windows(words: Column, count: Column) -> Column:
    """All windows as (key, start), sorted, so that equal ones are neighbours."""
    start = F.sequence(F.lit(0), count - 1)
    return F.sort_array(F.transform(start, lambda i: F.struct(_window_key(words, i).alias("k"), i.alias("i"))))


def _repeats(windows: Column) -> Column:
    """Words under windows that stand twice or more, from the sorted windows."""
    same = F.zip_with(
        windows, F.slice(windows, F.lit(2), F.greatest(F.size(windows) - 1, F.lit(0))), lambda a, b: F.when(a["k"] == b["k"], F.array(a["i"], b["i"]))
    )
    return _covered(F.array_sort(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull())))))


def _covered(starts: Column) -> Column:
    """Words under windows at the sorted starts."""
    state = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    return F.aggregate(
        starts,
        state,
        lambda s, i: F.struct((s["n"] + F.least(F.lit(WINDOW), i - s["last"])).alias("n"), i.alias("last")),
        lambda s: s["n"],
    )


def judge(docs: DataFrame) -> DataFrame:
    """(doc_id, counts, base_failed, words_left, kept, cleaned) for each row.

    ``cleaned`` is the text without failing lines.  A null text has no words and
    fails; a null doc_id stays null; repeated rows give repeated results; other
    columns are not read; an empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    base = docs.select(F.col("doc_id"), text.alias("t"))
    base = base.withColumns({"words": words_of(F.col("t")), "lines": F.split("t", "\n"), "lower": F.lower("t")})
    n = F.size("words")
    windows = F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW)).otherwise(F.array().cast("array<int>"))
    base = base.withColumns(
        {
            "n_words": n.cast("long"),
            "hashes": F.transform(windows, lambda i: F.xxhash64(*[F.get(F.col("words"), i + k) for k in range(WINDOW)])),
            "full": F.filter("lines", lambda x: F.length(_without(x, _BLANKS)) > 0),
            # phrases are looked for once in a text, and line by line only where there is one
            "good": F.when(_furnished(F.col("lower")), _good(F.col("lines"), True)).otherwise(_good(F.col("lines"), False)),
        }
    )
    count = F.size("hashes")
    # Most texts repeat no window, which the hashes show; only the others are sorted, by 128 bits.
    repeats = F.size(F.array_distinct("hashes")) < count
    base = base.withColumn(
        "windows", F.when(repeats, _windows(F.col("words"), count)).otherwise(F.lit(None))
    )
    keyed = base.withColumns(
        {
            "word_chars": F.length(_without(F.col("t"), _BLANKS)).cast("long"),
            "n_symbols": _count(F.col("t"), SYMBOLS).cast("long"),
            "n_dup_lines": (F.size("full") - F.size(F.array_distinct("full"))).cast("long"),
            "n_repeat_words": F.coalesce(_repeats(F.col("windows")), F.lit(0)).cast("long"),
            "cleaned": F.array_join(_without_menus(F.col("good")), "\n"),
        }
    )
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    out = keyed.withColumns({"base_failed": failed, "words_left": F.size(words_of(F.col("cleaned"))).cast("long")})
    enough = F.col("words_left") * 100 >= F.col("n_words") * MIN_LEFT_PERCENT
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "words_left",
        (~F.col("base_failed") & enough).alias("kept"), "cleaned",
    )
