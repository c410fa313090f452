"""A Bloom filter over ids: picks rows while a table is scanned, so that rows which can't matter are never shuffled.

It has a fixed size, whatever the ids: with more of them it lets more rows through, and never stops one of the ids.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 64-bit words of the filter; the driver and every task hold them.
WORDS = 1 << 19
SEEDS = (1, 2)


def may_be_one_of(ids: DataFrame) -> Callable[[Column], Column]:
    """A test for being one of ``ids (id)``, true for each of them and for few others; null is none."""
    bits = 64 * WORDS

    def places(column: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(column, F.lit(seed)), F.lit(bits)) for seed in SEEDS]

    at = ids.filter("id is not null").select(F.explode(F.array(*places(F.col("id")))).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("set"))
    table = np.zeros(WORDS, np.int64)
    for part in words.toArrow().to_batches():
        table[part.column("word").to_numpy()] = part.column("set").to_numpy()
    table = table.view(np.uint64)

    @F.pandas_udf("boolean")
    def hit(one: pd.Series, two: pd.Series) -> pd.Series:
        found = np.ones(len(one), bool)
        for part in (one.to_numpy(), two.to_numpy()):
            found &= ((table[part >> 6] >> (part & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
        return pd.Series(found)

    return lambda column: column.isNotNull() & hit(*places(column))
