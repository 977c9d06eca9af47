"""Vector bin packing of token sequences under several limits at once.

Bins are filled one at a time.  Among the waiting examples that fit, the one
whose demand vector (tokens, segments, loss-bearing tokens) has the largest dot
product with the bin's free capacity is placed, so examples go where the scarce
dimension still has room.  Where cutting is allowed, texts longer than a bin
give full sequences first, a bin that nothing fits is filled by cutting the
longest waiting example, and what is left at a task's end is cut into sequences
whose lengths are powers of two, which need no padding.

Each task packs the rows it reads, with a bounded number waiting, so no shuffle
is needed and a lost task is simply run again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import give_back, split_words

SCHEMA = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, "
    "sequence_id long, offset long"
)


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold, and how the packer behaves.

    ``waiting`` bounds the examples held back for a better fit, ``min_cut`` is
    the smallest gap that is filled by cutting another example.
    """

    tokens: int = 4096
    segments: int = 256
    loss: int = 4096
    waiting: int = 384
    cut: bool = True
    min_cut: int = 16


@dataclass
class Piece:
    """A run of one example's ids."""

    key: object
    ids: np.ndarray
    start: int
    total: int
    loss: np.ndarray | None = None  # mask; None: every id bears loss

    def __len__(self) -> int:
        return len(self.ids)

    def loss_tokens(self) -> int:
        return len(self.ids) if self.loss is None else int(self.loss.sum())

    def split(self, n: int) -> tuple[Piece, Piece]:
        head = None if self.loss is None else self.loss[:n]
        tail = None if self.loss is None else self.loss[n:]
        return (
            Piece(self.key, self.ids[:n], self.start, self.total, head),
            Piece(self.key, self.ids[n:], self.start + n, self.total, tail),
        )


@dataclass
class Packer:
    """Packs a stream of pieces; ``add`` and ``finish`` yield closed sequences."""

    limits: Limits = field(default_factory=Limits)

    def __post_init__(self) -> None:
        n = self.limits.waiting + 1
        self.room = np.array([self.limits.tokens, self.limits.segments, self.limits.loss], float)
        self.items: list[Piece | None] = [None] * n
        self.demand = np.zeros((n, 3))
        self.free = list(range(n))[::-1]

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        lim = self.limits
        if lim.cut:
            while len(piece) >= lim.tokens and self._within(piece, lim.tokens):
                head, piece = piece.split(lim.tokens)
                yield [head]
            while piece.loss_tokens() > lim.loss or len(piece) > lim.tokens:
                n = self._longest(piece, lim.tokens, lim.loss)
                head, piece = piece.split(n)
                yield from self._wait(head)
        elif len(piece) > lim.tokens or piece.loss_tokens() > lim.loss:
            raise ValueError(f"example {piece.key!r} exceeds the limits of a sequence")
        if len(piece):
            yield from self._wait(piece)

    def _within(self, piece: Piece, n: int) -> bool:
        return (n if piece.loss is None else int(piece.loss[:n].sum())) <= self.limits.loss

    @staticmethod
    def _longest(piece: Piece, tokens: int, loss: int) -> int:
        """Length of the longest head within both bounds."""
        if piece.loss is None:
            return min(len(piece), tokens, loss)
        return min(tokens, int(np.searchsorted(np.cumsum(piece.loss), loss, side="right")), len(piece))

    def _wait(self, piece: Piece) -> Iterator[list[Piece]]:
        at = self.free.pop()
        self.items[at], self.demand[at] = piece, (len(piece), 1, piece.loss_tokens())
        if not self.free:
            yield from self._fill()

    def _take(self, at: int) -> Piece:
        piece, self.items[at] = self.items[at], None
        self.demand[at] = 0
        self.free.append(at)
        return piece

    def _fill(self) -> Iterator[list[Piece]]:
        """Close one bin from the waiting examples."""
        lim, content, left = self.limits, [], self.room.copy()
        while left[0] > 0 and left[1] > 0:
            there = self.demand[:, 0] > 0
            fits = there & (self.demand <= left).all(axis=1)
            if fits.any():
                score = np.where(fits, (self.demand / self.room) @ (left / self.room), -1)
                piece = self._take(int(score.argmax()))
            elif lim.cut and left[0] >= lim.min_cut and there.any():
                at = int(self.demand[:, 0].argmax())
                n = self._longest(self.items[at], int(left[0]), int(left[2]))
                if n < lim.min_cut or n >= len(self.items[at]):
                    break
                piece, rest = self._take(at).split(n)
                spot = self.free.pop()
                self.items[spot], self.demand[spot] = rest, (len(rest), 1, rest.loss_tokens())
            else:
                break
            content.append(piece)
            left -= (len(piece), 1, piece.loss_tokens())
        yield from self._close(content)

    def _close(self, content: list[Piece]) -> Iterator[list[Piece]]:
        used = sum(map(len, content))
        if not self.limits.cut or self.limits.tokens - used < self.limits.min_cut:
            yield content
            return
        while used:  # the binary digits of what is there, largest first
            size = 1 << (used.bit_length() - 1)
            out, need = [], size
            while need:
                piece = content.pop(0)
                if len(piece) > need:
                    piece, rest = piece.split(need)
                    content.insert(0, rest)
                out.append(piece)
                need -= len(piece)
            used -= size
            yield out

    def finish(self) -> Iterator[list[Piece]]:
        while len(self.free) < len(self.items):
            yield from self._fill()


class WordTokenizer:
    """Ids of whole texts by a tokenizer that never joins across white space.

    Distinct words are encoded once and kept; ``keep`` bounds the words kept.
    When there are more, those stay that came again since they were learned.
    """

    def __init__(self, path: str, keep: int = 250_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.keep = Tokenizer.from_file(path), keep
        ids = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        probe = "Ab c1-Dé\t\n ZZ.  x"
        alone = [ids(word.lower()) for word in probe.split()]
        if ids(probe) != list(chain.from_iterable(alone)) or self._coded(probe.split())[1].tolist() != list(map(len, alone)):
            raise ValueError(f"{path} joins words over white space or tells letter case, so words can't be encoded by themselves")
        self.known: dict[str, int] = {}
        self.lengths = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.again = np.zeros(0, bool)

    def _coded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in order and their number for each word, from one text of all words."""
        found = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        at = np.fromiter((begin for begin, _ in found.offsets), np.int64, len(found.ids))
        starts = np.cumsum([0, *(len(w) + 1 for w in words[:-1])])
        lengths = np.bincount(np.searchsorted(starts, at, side="right") - 1, minlength=len(words))
        return np.array(found.ids, np.uint32), lengths

    def _learn(self, words: list[str]) -> None:
        n = len(self.known)
        self.known.update(zip(words, range(n, n + len(words)), strict=True))
        found = [self._coded(words[i : i + 500]) for i in range(0, len(words), 500)]
        self.ids = np.concatenate([self.ids, *(ids for ids, _ in found)])
        self.lengths = np.concatenate([self.lengths, *(lengths for _, lengths in found)])
        self.again = np.concatenate([self.again, np.zeros(len(words), bool)])

    def _forget(self) -> None:
        """Leave at most half of the words to be kept: those met again, the newest first."""
        stay = np.flatnonzero(self.again)[-(self.keep // 2) :]
        words = list(self.known)
        self.known = {words[i]: n for n, i in enumerate(stay.tolist())}
        self.ids = self._gather(stay)
        self.lengths, self.again = self.lengths[stay], np.zeros(len(stay), bool)

    def _gather(self, at: np.ndarray) -> np.ndarray:
        """The ids of the known words at the given places, in order."""
        lengths = self.lengths[at]
        first = np.concatenate([[0], np.cumsum(self.lengths)])[at]
        ends = np.cumsum(lengths)
        return self.ids[np.repeat(first - ends + lengths, lengths) + np.arange(lengths.sum())]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the number of ids of each text."""
        if len(self.known) > self.keep:
            self._forget()
        # The tokenizer lowers case itself, but for its special tokens, whose strings hold "<|".
        plain = not pc.any(pc.match_substring(texts, "<|"), min_count=0).as_py()
        words, counts = split_words(texts, lower=plain)
        if len(words) == 0:
            return np.zeros(0, np.uint32), np.zeros(len(counts), np.int64)
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        n = len(self.known)
        if missing := [w for w in distinct if w not in self.known]:
            self._learn(missing)
        places = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
        self.again[places[places < n]] = True
        at = places[coded.indices.to_numpy(zero_copy_only=False)]
        ids, ends = self._gather(at), np.cumsum(self.lengths[at])
        upto, ends_w = np.concatenate([[0], ends]), np.cumsum(counts)
        return ids, upto[ends_w] - upto[ends_w - counts]


@lru_cache(maxsize=2)
def tokenizer_here(path: str) -> WordTokenizer:
    """One tokenizer for all tasks that this Python process runs."""
    return WordTokenizer(path)


def slices(batch: pa.RecordBatch, column: str, chars: int = 1_500_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with a bounded size of text (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    upto, begin = np.cumsum(sizes, dtype=np.int64), 0
    while begin < len(sizes):
        done = upto[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(upto, done + chars, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    end_id: int = 2,
    limits: Limits = Limits(),
) -> DataFrame:
    """Tokenise whole texts and pack every id into sequences.

    One row for each piece: its ids (little-endian unsigned 32-bit), the place
    in the document and in the sequence.  A null or empty text is the end id
    alone; a null id column stays null; other columns are not read; repeated
    rows are packed like any others; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokenizer, packer = tokenizer_here(tokenizer_path), Packer(limits)
        number = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []

        def emit(sequences: Iterator[list[Piece]]) -> None:
            nonlocal number
            for sequence in sequences:
                at = 0
                for p in sequence:
                    rows.append((p.key, p.start, len(p), p.ids.astype("<u4").tobytes(), p.total, number, at))
                    at += len(p)
                number += 1

        def flush() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
            rows.clear()
            return out

        for whole in batches:
            for batch in slices(whole, "text"):
                ids, counts = tokenizer.encode(batch.column("text"))
                ends = np.cumsum(counts)
                for key, begin, end in zip(batch.column("id").to_pylist(), ends - counts, ends, strict=True):
                    full = np.append(ids[begin:end], np.uint32(end_id))
                    emit(packer.add(Piece(key, full, 0, len(full))))
                yield flush()
        emit(packer.finish())
        yield flush()
        give_back()

    columns = docs.select(docs[id_column].cast("long").alias("id"), docs[text_column].alias("text"))
    return columns.mapInArrow(run, SCHEMA)


def pack_conversations(
    turns: DataFrame,
    tokenizer_path: str,
    *,
    loss_roles: tuple[str, ...] = ("assistant",),
    end_id: int = 2,
    limits: Limits = Limits(segments=64, loss=2048),
) -> DataFrame:
    """Pack instruction data (conv_id, turn, role, text) under all three limits at once.

    Turns follow each other as examples of at most ``limits.tokens`` ids; only
    those of ``loss_roles`` bear loss.  One row for each piece: the conversation,
    the turn and place in it where the piece begins, its ids and its loss mask
    (a byte for each id).  Rows are dealt by ranges of (conv_id, turn), so a
    conversation of any length is spread over tasks and never held whole.  A null
    text is the end id alone, a null role bears no loss, null ids come first;
    repeated turns are packed each; other columns are not read; an empty table
    gives no rows.
    """
    kind = "conv_id long, turn long, start long, length long, ids binary, loss binary, sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokenizer, packer = tokenizer_here(tokenizer_path), Packer(limits)
        number = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []
        held: list[tuple] = []  # (turn, ids, bears loss) of the example that is being gathered
        gathered, now = 0, None

        def emit(sequences: Iterator[list[Piece]]) -> None:
            nonlocal number
            for sequence in sequences:
                at = 0
                for p in sequence:
                    conv, begins = p.key
                    turn, first = next(x for x in reversed(begins) if x[1] <= p.start)
                    rows.append((conv, turn, p.start - first, len(p), p.ids.astype("<u4").tobytes(), p.loss.astype(np.uint8).tobytes(), number, at))
                    at += len(p)
                number += 1

        def close() -> None:
            nonlocal gathered
            if held:
                ids = np.concatenate([x[1] for x in held])
                mask = np.concatenate([np.full(len(x[1]), x[2]) for x in held])
                starts = np.cumsum([0, *(len(x[1]) for x in held[:-1])])
                # a turn's first ids may stand in the example before; x[3] of them do
                begins = [(x[0], int(s) - x[3]) for x, s in zip(held, starts, strict=True)]
                emit(packer.add(Piece((now, begins), ids, 0, len(ids), mask)))
            held.clear()
            gathered = 0

        def flush() -> pa.RecordBatch:
            kinds = [pa.int64()] * 4 + [pa.binary()] * 2 + [pa.int64()] * 2
            names = ["conv_id", "turn", "start", "length", "ids", "loss", "sequence_id", "offset"]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
            rows.clear()
            return out

        for whole in batches:
            for batch in slices(whole, "text"):
                ids, counts = tokenizer.encode(batch.column("text"))
                ends = np.cumsum(counts)
                told = zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role")), ends - counts, ends, strict=True)
                for conv, turn, role, begin, end in told:
                    if conv != now or conv is None:
                        close()
                        now = conv
                    full, before = np.append(ids[begin:end], np.uint32(end_id)), 0
                    while len(full):
                        part = full[: limits.tokens - gathered]
                        held.append((turn, part, role in loss_roles, before))
                        gathered, before, full = gathered + len(part), before + len(part), full[len(part) :]
                        if gathered == limits.tokens:
                            close()
                yield flush()
        close()
        emit(packer.finish())
        yield flush()
        give_back()

    columns = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    dealt = columns.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn")
    return dealt.mapInArrow(run, kind)
