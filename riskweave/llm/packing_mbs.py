"""Packing token sequences by minimum bin slack.

Every document's ids (its tokens and one end id) are cut at every multiple of the capacity.  A full piece is a
sequence of its own; what is left of a document is shorter than the capacity, so what has to be packed is a
histogram of at most ``capacity - 1`` lengths, however many documents there are.  On it, window after window:
the longest piece left is taken, a bitset subset-sum over the lengths left (bit ``s``: a multiset of them sums
to ``s``) finds the multiset that fills the window closest to capacity, walking back through the bitsets gives
its counts, and the multiset is repeated as often as the counts allow.  A window that no multiset fills exactly
is completed with the head of another piece, whose tail goes back into the histogram (documents may be cut
anywhere); only when nothing is left to cut does a window stay short.

Which document gets which place is arithmetic on ranks: a piece knows its rank among the pieces of its length
within its task; counts per (task, length), summed in task order, give its rank over all; the plan, a table of
rank intervals per length of bounded size, says where that rank lies.  Texts and ids never meet in one task.

Defined results: a null text is an empty one and packs its end id alone; an empty table gives no pieces;
repeated rows are packed each; only the id and the text are read; long texts are tokenised whole (memory of a
small multiple of the text).  Rerunning on the same input files gives the same sequences.
"""

from __future__ import annotations

import base64
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.session import materialise

CAPACITY = 1024
END_ID = 0
TOKENIZER = "byte_bpe_50k.json"
#: Rows of the (task, length) table up to which it is broadcast; beyond it is joined by key.
BROADCAST_ROWS = 1_000_000
RANKS = "byte_bpe_50k.tiktoken"
#: Characters beyond visible ASCII, common white space and Latin letters.
BEYOND = re.compile("[^\t\n\r\x20-\x7e\xa1-\u024f]")
#: White space that ``\s+(?!\S)`` would keep on one stack; the lookbehind keeps the search linear.
LONG_RUN = 100_000
RUN = re.compile(f"(?<![\t\n\r ])[\t\n\r ]{{{LONG_RUN}}}")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def default_tokenizer() -> tuple[str, str, str]:
    """The tokenizer's file, its vocabulary as ranks, and the pattern that cuts text."""
    import public_tokenizers

    return tokenizer_path(), tokenizer_path(RANKS), public_tokenizers.PATTERN


class Ids:
    """Ids of texts by a byte-level BPE tokenizer.

    With ``ranks``, the same vocabulary as ranked byte strings, plain Latin text is encoded by them: the result is the same
    and several times faster.  Text with characters in which two libraries' character classes might differ, with
    one of the tokenizer's special strings, or with a run of ``LONG_RUN`` white space, on which the ranked encoder's
    pattern overflows its stack (at about a million), goes to the tokenizer itself.
    """

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.ranked = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.ranked = tiktoken.Encoding("ranked", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def plain(self, text: str) -> bool:
        """Whether the ranked encoder gives the tokenizer's ids of a text."""
        if BEYOND.search(text) or any(token in text for token in self.special):
            return False
        return len(text) < LONG_RUN or RUN.search(text) is None

    def encode(self, texts: list[str]) -> list[bytes]:
        """Unsigned 32-bit little-endian ids of each text."""
        out: list[bytes] = []
        for text in texts:
            if self.ranked and self.plain(text):
                ids = self.ranked.encode_ordinary(text)
            else:
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            out.append(array("I", ids).tobytes())
        return out


PIECE = {
    "doc_id": pa.int64(), "start": pa.int64(), "length": pa.int32(), "doc_tokens": pa.int64(), "ids": pa.binary(), "task": pa.int32(),
    "rank": pa.int64(),
}


def cut_pieces(documents: DataFrame, tokenizer: tuple[str | None, ...], capacity: int = CAPACITY) -> DataFrame:
    """Pieces ``doc_id, start, length, doc_tokens, ids, task, rank`` of all documents, written once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Ids(*tokenizer)
        seen = np.zeros(capacity + 1, np.int64)
        task = TaskContext.get().partitionId()
        end = array("I", [END_ID]).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = ["" if text is None else text for text in part.column(1).to_pylist()]
                columns: list[list] = [[] for _ in PIECE]
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode(texts), strict=True):
                    ids += end
                    tokens = len(ids) // 4
                    for start in range(0, tokens, capacity):
                        length = min(capacity, tokens - start)
                        piece = ids[4 * start : 4 * (start + length)]
                        for column, value in zip(columns, (doc_id, start, length, tokens, piece, task, int(seen[length])), strict=True):
                            column.append(value)
                        seen[length] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, PIECE.values(), strict=True)], list(PIECE))

    schema = "doc_id long, start long, length int, doc_tokens long, ids binary, task int, rank long"
    return materialise(documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, schema), compression="zstd")


class Plan:
    """Where the pieces of each length go: per length, intervals of ranks in rank order.

    An interval ``(first, last, per, sequence, offset, head, onward)``: ranks ``first <= r < last``, ``per`` of them in
    each sequence from ``sequence`` on, side by side from ``offset``; ``head`` is 0 for whole pieces, otherwise
    the length cut off at the front, and the tail has in its own length the rank ``onward + r - first``.
    """

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        self.capacity = capacity
        self.left = {length: n for length, n in counts.items() if n and length < capacity}
        self.used = dict.fromkeys(range(capacity + 1), 0)  # ranks handed out so far, per length
        self.supply = dict(counts)  # ranks that exist so far, per length
        self.intervals: dict[int, list[tuple[int, ...]]] = {}
        self.sequences = counts.get(capacity, 0)
        if self.sequences:
            self.intervals[capacity] = [(0, self.sequences, 1, 0, 0, 0, 0)]
        while self.left:
            self._window()

    def _fill(self, seed: int) -> dict[int, int]:
        """Counts of lengths that with ``seed`` come closest to capacity: subset sums, then the way back."""
        room = self.capacity - seed
        full, reach = (1 << (room + 1)) - 1, 1
        steps: list[tuple[int, int, int]] = []
        for length in sorted((x for x in self.left if x <= room), reverse=True):
            copies = min(self.left[length] - (length == seed), room // length)
            step = 1
            while copies > 0:  # so many copies in powers of two
                take = min(step, copies)
                if take * length <= room:
                    steps.append((length, take, reach))
                    reach |= (reach << (take * length)) & full
                copies -= take
                step *= 2
            if reach >> room & 1:
                break
        at = reach.bit_length() - 1
        chosen = {seed: 1}
        for length, take, before in reversed(steps):
            if not before >> at & 1:
                at -= take * length
                chosen[length] = chosen.get(length, 0) + take
        return chosen

    def _take(self, length: int, n: int, per: int, offset: int, head: int = 0, onward: int = 0) -> None:
        first = self.used[length]
        self.intervals.setdefault(length, []).append((first, first + n, per, self.sequences, offset, head, onward))
        self.used[length] = first + n
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]

    def _window(self) -> None:
        chosen = self._fill(max(self.left))
        filled = sum(length * n for length, n in chosen.items())
        times = min(self.left[length] // n for length, n in chosen.items())
        slack, donor = self.capacity - filled, None
        if slack:
            spare = {x: n - chosen.get(x, 0) for x, n in self.left.items() if x > slack and n > chosen.get(x, 0)}
            donor = min(spare, default=None)
            if donor is not None:
                times = max(1, min([times, spare[donor], self.left[donor] // (chosen.get(donor, 0) + 1)]))
        offset = 0
        for length in sorted(chosen, reverse=True):
            self._take(length, times * chosen[length], chosen[length], offset)
            offset += length * chosen[length]
        if donor is not None:
            tail = donor - slack
            onward = self.supply.get(tail, 0)
            self._take(donor, times, 1, offset, slack, onward)
            self.supply[tail] = onward + times
            self.left[tail] = self.left.get(tail, 0) + times
        self.sequences += times

    def places(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """Cuts of one piece: (start within it, length, sequence, offset)."""
        out, start = [], 0
        while True:
            spans = self.intervals[length]
            low, high = 0, len(spans) - 1
            while low < high:
                middle = (low + high + 1) // 2
                low, high = (middle, high) if spans[middle][0] <= rank else (low, middle - 1)
            first, _, per, sequence, offset, head, onward = spans[low]
            turn, place = divmod(rank - first, per)
            if not head:
                out.append((start, length, sequence + turn, offset + place * length))
                return out
            out.append((start, head, sequence + turn, offset))
            start, length, rank = start + head, length - head, onward + rank - first


def pack(documents: DataFrame, tokenizer: tuple[str | None, ...] | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Every piece with its ids and its place: ``doc_id, start, length, doc_tokens, sequence_id, offset, ids``."""
    pieces = cut_pieces(documents, tokenizer or default_tokenizer(), capacity)
    counts = materialise(pieces.groupBy("length", "task").agg(F.count("*").alias("n")))
    totals = {row["length"]: row["n"] for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = Plan(totals, capacity)
    # Tasks in order, per length: rows follow the number of tasks.
    before = F.coalesce(F.expr("sum(n) over (partition by length order by task rows between unbounded preceding and 1 preceding)"), F.lit(0))
    starts = counts.select("length", "task", before.alias("before"))
    if counts.count() <= BROADCAST_ROWS:
        starts = F.broadcast(starts)
    ranked = pieces.join(starts, ["length", "task"]).withColumn("rank", F.col("rank") + F.col("before"))

    def place(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for lengths, ranks in batches:
            yield pd.Series(
                [
                    [{"s": s, "n": n, "q": q, "o": o} for s, n, q, o in plan.places(int(length), int(rank))]
                    for length, rank in zip(lengths, ranks, strict=True)
                ]
            )

    placed = ranked.withColumn("place", F.pandas_udf(place, "array<struct<s: int, n: int, q: long, o: int>>")("length", "rank"))
    cut = placed.select("doc_id", "start", "doc_tokens", "ids", F.explode("place").alias("p"))
    return cut.select(
        "doc_id", (F.col("start") + F.col("p.s")).alias("start"), F.col("p.n").cast("long").alias("length"), "doc_tokens",
        F.col("p.q").alias("sequence_id"), F.col("p.o").cast("long").alias("offset"),
        F.expr("substring(ids, 4 * p.s + 1, 4 * p.n)").alias("ids"),
    )


def packing(documents: DataFrame) -> DataFrame:
    """Every piece with its place and the crc32 of its ids."""
    packed = pack(documents)
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
