"""Monotone sequences in Elias-Fano form over one flat buffer, read in batches.

``n`` values below ``universe`` are split into ``low`` bits, packed, and high parts, written in unary: value ``i``
sets bit ``high(i) + i``.  That is about ``2 + log2(universe / n)`` bits a value.  Reads are vectorised: access by
position (a select over a directory of ones per word) and successor search within a range of positions.
"""

from __future__ import annotations

import numpy as np

WORD = 64
ONES = np.array([bin(x).count("1") for x in range(256)], np.uint8)
#: Position of the k-th one of a byte.
NTH = np.array([[([i for i in range(8) if byte >> i & 1] + [8] * 8)[k] for k in range(8)] for byte in range(256)], np.uint8)


class EliasFano:
    """A sequence over ``buffer`` (bytes, or a memory map); ``parts`` says where its arrays lie."""

    def __init__(self, buffer, header: dict):
        self.n, self.low_bits, self.offset = header["n"], header["low_bits"], header["offset"]
        at = self.offset
        self.lows = np.frombuffer(buffer, np.uint64, header["low_words"], at)
        at += 8 * header["low_words"]
        self.highs = np.frombuffer(buffer, np.uint64, header["high_words"], at)
        at += 8 * header["high_words"]
        self.ones_before = np.frombuffer(buffer, np.uint32, header["high_words"], at)

    @staticmethod
    def build(values: np.ndarray, universe: int) -> tuple[bytes, dict]:
        """The bytes of a sequence and its header (without ``offset``)."""
        n = len(values)
        low_bits = max(0, int(universe // max(n, 1)).bit_length() - 1)
        values = values.astype(np.uint64)
        lows = np.zeros(n * low_bits // WORD + 2, np.uint64)
        if low_bits and n:
            low = values & np.uint64((1 << low_bits) - 1)
            bit = np.arange(n, dtype=np.uint64) * np.uint64(low_bits)
            word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
            np.bitwise_or.at(lows, word, low << shift)
            spill = shift + np.uint64(low_bits) > WORD
            np.bitwise_or.at(lows, word[spill] + 1, low[spill] >> (np.uint64(WORD) - shift[spill]))
        place = (values >> np.uint64(low_bits)) + np.arange(n, dtype=np.uint64)
        highs = np.zeros((int(place[-1]) if n else 0) // WORD + 2, np.uint64)
        np.bitwise_or.at(highs, (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
        counts = ONES[highs.view(np.uint8)].reshape(-1, 8).sum(axis=1, dtype=np.int64)
        before = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.uint32)
        data = lows.tobytes() + highs.tobytes() + before.tobytes()
        data += bytes(-len(data) % 8)
        return data, {"n": n, "low_bits": low_bits, "low_words": len(lows), "high_words": len(highs)}

    def access(self, at: np.ndarray) -> np.ndarray:
        """Values at positions."""
        at = at.astype(np.int64)
        word = np.searchsorted(self.ones_before, at, side="right") - 1
        left = at - self.ones_before[word]
        octets = np.ascontiguousarray(self.highs[word]).view(np.uint8).reshape(-1, 8)
        upto = np.cumsum(ONES[octets], axis=1, dtype=np.int64)
        octet = (upto <= left[:, None]).sum(axis=1)
        rows = np.arange(len(at))
        within = left - np.where(octet > 0, upto[rows, np.maximum(octet - 1, 0)], 0)
        place = word * WORD + octet * 8 + NTH[octets[rows, octet], within]
        high = (place - at).astype(np.uint64)
        if not self.low_bits:
            return high
        bit = at.astype(np.uint64) * np.uint64(self.low_bits)
        index, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        low = self.lows[index] >> shift
        more = np.where(shift > 0, self.lows[index + 1] << ((np.uint64(WORD) - shift) & np.uint64(63)), np.uint64(0))
        return high << np.uint64(self.low_bits) | (low | more) & np.uint64((1 << self.low_bits) - 1)

    def successor(self, begin: np.ndarray, end: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Per row, the first position in ``begin .. end`` whose value is at least ``wanted`` (``end`` if none)."""
        low, high = begin.astype(np.int64).copy(), end.astype(np.int64).copy()
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) // 2
            below = self.access(middle) < wanted[open_]
            low[open_] = np.where(below, middle + 1, low[open_])
            high[open_] = np.where(below, high[open_], middle)
            open_ = open_[low[open_] < high[open_]]
        return low
