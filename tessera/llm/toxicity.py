"""Toxicity scores from gradient-boosted trees over dense text features.

The features are rates: hits of a fixed and of a learned lexicon, closeness of
hits to second-person words, capitals, punctuation and obfuscated spellings.
Lexicon and trees are fitted on a bounded sample of labelled rows
(``sample_rows``, taken by a hash of the id); an isotonic fit on a part of the
sample that the trees don't see turns raw scores into probabilities.  Scoring
covers every row in one pass, with no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import give_back, split_words
from tessera.llm.packing import slices

#: Common English insults, the fixed part of the lexicon.
SEED_WORDS = (
    "bastard bigot clown coward creep cretin degenerate despicable disgusting dimwit dumb dumbass "
    "fool filth freak garbage hate idiot idiotic ignorant imbecile jerk kill liar loser lunatic moron "
    "moronic nasty pathetic pig psycho retard retarded scum shut sick sickening stupid trash ugly vermin "
    "vile worthless"
).split()
#: Second-person words of the corpus languages.
SECOND_PERSON = (
    "you your yours yourself youre u ur thou thee thy tu te ti toi vous votre vos ton ta tes "
    "du dich dir dein deine ihr euch euer usted ustedes vosotros tus su"
).split()
#: Signs and digits that stand for letters.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": ""}
PREFIXES = (3, 4, 5, 6, 7)
FEATURES = (
    "log_words lexicon lexicon_log loose seed near_second second capitals all_caps exclaim punctuation symbols "
    "obfuscated disguised digits long_words stretched"
).split()
SAMPLE_ROWS = 20_000
MOST_STEMS = 4_000
#: A stem is kept if its split over labels has a smaller chance than this.
CHANCE = 1e-7


def _bare(words: pa.Array) -> pa.Array:
    """Lower-case words without marks around them."""
    return pc.utf8_lower(pc.replace_substring_regex(words, r"^[^\pL\pN]+|[^\pL\pN]+$", ""))


def _stems(bare: pa.Array) -> list[pa.Array]:
    """The prefixes of words, marked as such, and the whole words; null where too short."""
    length = pc.utf8_length(bare)
    out = []
    for k in PREFIXES:
        head = pc.binary_join_element_wise("^", pc.utf8_slice_codeunits(bare, 0, k), "")
        out.append(pc.if_else(pc.greater_equal(length, k), head, pa.scalar(None, pa.string())))
    return [*out, pc.if_else(pc.greater(length, 1), bare, pa.scalar(None, pa.string()))]


def _per_row(flags: np.ndarray, counts: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0.0], np.cumsum(flags, dtype=np.float64)])
    ends = np.cumsum(counts)
    return upto[ends] - upto[ends - counts]


def features(texts: pa.Array, stems: pa.Array, loose: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` for each text; ``stems`` and ``loose`` are the learned lexicons."""
    words, counts = split_words(texts)
    n = np.maximum(counts, 1)
    out = np.zeros((len(counts), len(FEATURES)))
    out[:, 0] = np.log1p(counts)
    if not len(words):
        return out
    coded = words.dictionary_encode()
    distinct, at = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    bare = _bare(distinct)
    number = lambda a: a.to_numpy(zero_copy_only=False).astype(np.float64)
    seed_set = pa.array(SEED_WORDS)
    learned = np.zeros(len(distinct), bool)
    hints = np.zeros(len(distinct), bool)
    for part in _stems(bare):
        learned |= pc.is_in(part, value_set=stems).to_numpy(zero_copy_only=False)
        hints |= pc.is_in(part, value_set=loose).to_numpy(zero_copy_only=False)
    seed = pc.is_in(bare, value_set=seed_set).to_numpy(zero_copy_only=False)
    mixed = pc.match_substring_regex(bare, r"\pL[\pN@$!*]+\pL|^[\pN@$]+\pL{2}|\pL{2}[\pN@$]+$")
    plain = bare
    for sign, letter in LEET.items():
        plain = pc.replace_substring(plain, sign, letter)
    disguised = pc.and_(mixed, pc.is_in(plain, value_set=seed_set)).to_numpy(zero_copy_only=False)
    for part in _stems(plain):
        disguised |= (pc.and_(mixed, pc.is_in(part, value_set=stems))).to_numpy(zero_copy_only=False)
    hit_word = learned | seed | disguised
    second = pc.is_in(bare, value_set=pa.array(SECOND_PERSON)).to_numpy(zero_copy_only=False)
    length = np.maximum(number(pc.utf8_length(distinct)), 1)
    upper = number(pc.count_substring_regex(distinct, r"\p{Lu}"))
    letters = number(pc.count_substring_regex(distinct, r"\pL"))
    rate = lambda flags: _per_row(np.asarray(flags, np.float64)[at], counts)
    hits = rate(hit_word)
    out[:, 1] = hits / n
    out[:, 2] = np.log1p(hits)
    out[:, 3] = np.log1p(rate(hints))
    out[:, 4] = rate(seed) / n
    out[:, 5] = _nearness(hit_word[at], second[at], counts)
    out[:, 6] = rate(second) / n
    out[:, 7] = rate(upper) / np.maximum(rate(letters), 1)
    out[:, 8] = rate((upper == letters) & (letters > 1)) / n
    out[:, 9] = rate(number(pc.count_substring_regex(distinct, "[!?]"))) / n
    out[:, 10] = rate(number(pc.count_substring_regex(distinct, r"[.,;:'\"()-]"))) / n
    out[:, 11] = rate(number(pc.count_substring_regex(distinct, r"[#*$%&|<>@^~]"))) / n
    out[:, 12] = rate(mixed.to_numpy(zero_copy_only=False)) / n
    out[:, 13] = np.log1p(rate(disguised))
    out[:, 14] = rate(number(pc.count_substring_regex(distinct, r"\pN"))) / n
    out[:, 15] = rate(length) / n
    out[:, 16] = rate(number(pc.match_substring_regex(bare, "aaa|eee|iii|ooo|uuu|sss|yyy|!!!"))) / n
    return out


def _nearness(hit: np.ndarray, second: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """1 / (1 + words between the closest hit and second-person word), 0 without both."""
    row = np.repeat(np.arange(len(counts)), counts)
    h, s = np.flatnonzero(hit), np.flatnonzero(second)
    out = np.zeros(len(counts))
    if len(h) and len(s):
        at = np.searchsorted(s, h)
        for side in (np.minimum(at, len(s) - 1), np.maximum(at - 1, 0)):
            same = row[s[side]] == row[h]
            np.maximum.at(out, row[h][same], 1 / (1 + np.abs(s[side] - h)[same]))
    return out


@dataclass
class Trees:
    """Boosted depth-limited trees for the logistic loss, on binned features."""

    rounds: int = 60
    depth: int = 3
    rate: float = 0.2
    bins: int = 48
    least: float = 3.0
    ridge: float = 1.0
    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(share / (1 - share)))
        self.edges = []
        for column in x.T:
            cuts = np.unique(np.quantile(column, np.linspace(0, 1, self.bins)[1:-1]))
            rare = np.unique(np.quantile(column[column > 0], [0, 0.25, 0.5, 0.75])) if (column > 0).any() else []
            self.edges.append(np.unique(np.concatenate([cuts, np.nextafter(rare, -1), [0.0]])))
        b, raw = self._binned(x), np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            raw += self._grow(b, p - y, np.maximum(p * (1 - p), 1e-6))
        return self

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Add one tree (complete, by levels); its output for the training rows."""
        size = (1 << self.depth) - 1
        feature, cut = np.zeros(size, np.int64), np.full(size, 1 << 30)
        node = np.zeros(len(g), np.int64)
        for level in range(self.depth):
            first, n = (1 << level) - 1, 1 << level
            best = np.full(n, 1e-9)
            local = node - first
            for j, edge in enumerate(self.edges):
                k = len(edge) + 1
                where = local * k + b[:, j]
                sums = [np.bincount(where, w, n * k).reshape(n, k).cumsum(axis=1) for w in (g, h)]
                (gl, hl), (gt, ht) = (s[:, :-1] for s in sums), (s[:, -1:] for s in sums)
                gain = gl**2 / (hl + self.ridge) + (gt - gl) ** 2 / (ht - hl + self.ridge) - gt**2 / (ht + self.ridge)
                gain[(hl < self.least / 10) | (ht - hl < self.least / 10)] = -1
                if gain.size:
                    top = gain.argmax(axis=1)
                    better = gain[np.arange(n), top] > best
                    best[better] = gain[np.arange(n), top][better]
                    feature[first : first + n][better], cut[first : first + n][better] = j, top[better]
            node = 2 * node + 1 + (b[np.arange(len(g)), feature[node]] > cut[node])
        leaf = node - size
        n = 1 << self.depth
        value = -self.rate * np.bincount(leaf, g, n) / (np.bincount(leaf, h, n) + self.ridge)
        self.trees.append((feature, cut, value))
        return value[leaf]

    def raw(self, x: np.ndarray) -> np.ndarray:
        b, out = self._binned(x), np.full(len(x), self.base)
        rows, size = np.arange(len(x)), (1 << self.depth) - 1
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
            out += value[node - size]
        return out


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators fit: knots and non-decreasing values."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # sum, weight, lowest, highest
    for x, t in zip(raw[order], y[order], strict=True):
        blocks.append([t, 1.0, x, x])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, w, _, high = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + w, blocks[-1][2], high]
    # one half-observation of the mean keeps pure blocks short of 0 and 1
    mean = float(y.mean())
    knots = np.array([v for b in blocks for v in (b[2], b[3])])
    values = np.array([(b[0] + 0.5 * mean) / (b[1] + 0.5) for b in blocks for _ in "ab"])
    return knots, np.maximum.accumulate(values)


@dataclass
class Model:
    """A fitted lexicon, trees and calibration; small and of bounded size."""

    stems: list[str]
    loose: list[str]
    trees: Trees | None
    knots: np.ndarray | None = None
    values: np.ndarray | None = None

    def score(self, texts: pa.Array) -> np.ndarray:
        x = features(texts, pa.array(self.stems, pa.string()), pa.array(self.loose, pa.string()))
        if self.trees is None:  # nothing to learn from: the fixed lexicon decides
            return np.where(x[:, 2] > 0, 0.9, 0.05)
        raw = self.trees.raw(x)
        calm = np.interp(raw, self.knots, self.values)
        return np.clip(0.998 * calm + 0.002 / (1 + np.exp(-raw)), 0, 1)


def _label_sample(labels: DataFrame, rows: int) -> DataFrame:
    """(doc_id, toxic) of the labelled rows to learn from, at most ``rows``."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    return (
        labels.where("doc_id is not null and toxic is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .where(fold != 0)
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )


def _learn_stems(sample: DataFrame, positives: int, rows: int) -> tuple[list[str], list[str]]:
    """Stems that stand in toxic texts far more often than chance allows: pure ones, all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                words, counts = split_words(batch.column("text"))
                if not len(words):
                    continue
                coded = words.dictionary_encode()
                at = coded.indices.to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(counts)), counts)
                toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
                for part in _stems(_bare(coded.dictionary)):
                    stem = part.dictionary_encode()
                    code = stem.indices.fill_null(-1).to_numpy(zero_copy_only=False)[at].astype(np.int64)
                    pair = np.unique(row[code >= 0] * len(stem.dictionary) + code[code >= 0])
                    r, c = np.divmod(pair, max(1, len(stem.dictionary)))
                    pos, neg = (np.bincount(c, toxic[r] == v, len(stem.dictionary)).astype(np.int64) for v in (1, 0))
                    yield pa.RecordBatch.from_arrays([stem.dictionary, pa.array(pos), pa.array(neg)], ["stem", "pos", "neg"])

    base = positives / max(rows, 1)
    chance = F.col("pos") * F.lit(-np.log(max(base, 1e-6))) - F.col("neg") * F.log1p(F.col("pos") * F.lit(2.0))
    kept = (
        sample.select("text", "toxic")
        .mapInArrow(count, "stem string, pos long, neg long")
        .groupBy("stem")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        .where((F.col("pos") >= 4) & (F.col("neg") * 4 <= F.col("pos")) & (chance >= F.lit(-np.log(CHANCE))))
        .orderBy(chance.desc(), "stem")
        .limit(MOST_STEMS)
    )
    found = kept.collect()  # bounded by MOST_STEMS
    return [r.stem for r in found if r.neg * 20 <= r.pos], [r.stem for r in found]


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``sample_rows`` labelled rows, none of them held out.

    A row is held out if crc32 of its doc_id as text leaves 0 on division by 5.
    A quarter of the sample, by a hash of the id, is for calibration alone: the
    lexicon and the trees learn from the other rows.  A quarter with fewer than
    30 rows or one label only can't calibrate; then all rows do both.  Of rows
    that share a doc_id the one with the smallest features counts.  Without rows
    of both labels the fixed lexicon alone decides.
    """
    chosen = _label_sample(labels, sample_rows).collect()  # bounded by sample_rows
    spark = docs.sparkSession
    positives = sum(r.toxic for r in chosen)
    if not 0 < positives < len(chosen):
        return Model([], [], None)
    apart = [_calibrates(r.doc_id) for r in chosen]
    held = [r.toxic for r, c in zip(chosen, apart, strict=True) if c]
    learned = [r.toxic for r, c in zip(chosen, apart, strict=True) if not c]
    if len(held) < 30 or len(set(held)) < 2 or len(set(learned)) < 2:
        apart = [False] * len(chosen)
    few = spark.createDataFrame([(r.doc_id, r.toxic, c) for r, c in zip(chosen, apart, strict=True)], "of long, toxic int, apart boolean")
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        F.broadcast(few), F.col("doc_id") == F.col("of")
    )
    rest = [r.toxic for r, c in zip(chosen, apart, strict=True) if not c]
    stems, loose = _learn_stems(sample.where("not apart"), sum(rest), len(rest))
    lexicons = pa.array(stems, pa.string()), pa.array(loose, pa.string())

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                x = features(batch.column("text"), *lexicons)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in ("doc_id", "toxic", "apart")), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "toxic", "apart", "x"]
                )

    rows = sample.select("doc_id", "toxic", "apart", "text").mapInArrow(measure, "doc_id long, toxic int, apart boolean, x array<double>")
    one = rows.groupBy("doc_id").agg(F.min(F.struct("toxic", "apart", "x")).alias("r")).select("doc_id", "r.*")
    data = one.toPandas().sort_values("doc_id", ignore_index=True)  # bounded by sample_rows
    if data.toxic.nunique() < 2:
        return Model(stems, loose, None)
    x, y = np.stack(data.x.to_numpy()), data.toxic.to_numpy(np.float64)
    part = data.apart.to_numpy(bool)
    if len(np.unique(y[~part])) < 2 or (part.any() and len(np.unique(y[part])) < 2):  # labels without texts
        part[:] = False
    trees = Trees().fit(x[~part], y[~part])
    calibration = part if part.any() else ~part
    return Model(stems, loose, trees, *isotonic(trees.raw(x[calibration]), y[calibration]))


def _calibrates(doc_id: int) -> bool:
    """Whether a row is of the quarter that calibrates, by a hash of its id."""
    return (doc_id * 0x9E3779B97F4A7C15 % 2**64 >> 40) % 4 == 0


def score(docs: DataFrame, model: Model, at_most: float | None = None) -> DataFrame:
    """``docs`` with a double column ``score``; or only its rows scored below ``at_most``.

    With ``at_most`` the columns are those of ``docs``.  Null and empty texts
    score as texts without words; rows are never joined, so null or repeated ids
    are fine; a column already named ``score`` is replaced; an empty table gives
    no rows.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.drop("score") if at_most is None else docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                s = shipped.value.score(batch.column("text"))
                if at_most is not None:
                    yield batch.filter(pa.array(s < at_most))
                else:
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s)], [*batch.schema.names, "score"])
        give_back()

    schema = source.schema if at_most is not None else source.withColumn("score", F.lit(0.0)).schema
    return source.mapInArrow(run, schema)
