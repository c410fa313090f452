"""What the operators share: words, held-out rows, and small helpers over bytes.

A word is a run of bytes other than space and ``\\t \\n \\v \\f \\r``, which is what ``bytes.split()``
splits on.  Lower-casing is A-Z only, which is what ``bytes.lower()`` does.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Words that a worker remembers while it reads texts: a worker lives on and keeps what it has taken.
WORDS_HELD = 1 << 17


def words_of(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8; none for null."""
    return encoded(text).split()


def encoded(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def held_out(doc_id: Column, modulus: int, remainder: int = 2) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``.  A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


class Numbers(dict):
    """Word -> number, in the order of first sight."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


class Hashes(dict):
    """Word -> 64-bit hash, remembered up to ``limit`` words (only the memory, never the value)."""

    limit = 400_000

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < self.limit:
            self[word] = value
        return value


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words: neighbours in, unrelated numbers out."""
    with np.errstate(over="ignore"):
        values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of every window of ``width`` consecutive word hashes, in order."""
    count = len(hashes) - width + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(count, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(width):
            out += hashes[at : at + count] * np.uint64(ODD[at])
    return out


#: Odd multipliers of the places in a window.
ODD = [int(value) | 1 for value in mixed(np.arange(1, 17, dtype=np.uint64))]

#: SQL of crc32 of an ASCII string, bit by bit; the polynomial is a fixed value.
CRC_SQL = (
    "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)), "
    "lambda x, y: list_reduce([xor(x, y), 0, 0, 0, 0, 0, 0, 0, 0], lambda k, z: xor(k >> 1, 3988292384 * (k & 1)))), 4294967295)"
)
