"""The rows of one key in a micro-batch, in order, without holding frames of them."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd

#: Rows of an output frame.
CHUNK = 50_000


def in_order(frames: Iterator[pd.DataFrame], by: tuple[str, ...], more: tuple[str, ...] = ()) -> Iterator[tuple[int, ...]]:
    """Whole-number columns ``by`` and ``more`` of all rows, sorted by ``by``.

    Frames are read one after another and only these columns are kept, eight bytes a number; the stream's ``maxFilesPerTrigger`` or
    ``maxBytesPerTrigger`` bounds how many rows a micro-batch has.
    """
    names = (*by, *more)
    kept = [array("q") for _ in names]
    for frame in frames:
        for numbers, name in zip(kept, names, strict=True):
            numbers.frombytes(frame[name].to_numpy(np.int64).tobytes())
    columns = [np.frombuffer(numbers, np.int64) for numbers in kept]
    order = np.lexsort(columns[: len(by)][::-1]) if len(columns[0]) else np.zeros(0, np.int64)
    for at in range(0, len(order), CHUNK):
        part = order[at : at + CHUNK]
        yield from zip(*[column[part].tolist() for column in columns], strict=True)


def framed(rows: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    """Rows as frames of at most ``CHUNK``."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == CHUNK:
            yield pd.DataFrame(held, columns=columns)
            held = []
    if held:
        yield pd.DataFrame(held, columns=columns)
