"""At most N hits per key in a sliding window, where a rejected hit does not count."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from riskweave.streaming.ordered import framed, in_order

# --- fixed values: the default limit ---
MAX_HITS = 10
WINDOW_SECONDS = 300

DECISIONS = "key string, event_id bigint, at_us bigint, allowed boolean, remaining int, retry_after int"


def decide(recent: deque, at: int, limit: int, window: int) -> tuple[bool, int, int]:
    """One hit against the accepted ones still in the window; ``recent`` is updated."""
    while recent and recent[0] < at - window:
        recent.popleft()
    if len(recent) >= limit:
        return False, 0, max(1, int((recent[0] + window - at) // 1_000_000) + 1)
    recent.append(at)
    return True, limit - len(recent), 0


def _stretches(hits: DataFrame, window: int) -> DataFrame:
    """Add ``stretch``: hits with a pause longer than the window between them are independent.

    Pauses are found on (key, window-long bucket) summaries, which are few; a busy key is then as
    many groups as it has quiet moments, not one.
    """
    rows = hits.withColumn("bucket", F.floor(F.col("at_us") / window))
    summary = rows.groupBy("key", "bucket").agg(F.min("at_us").alias("first"), F.max("at_us").alias("last"))
    order = Window.partitionBy("key").orderBy("bucket")
    broke = F.coalesce(F.col("first") - F.lag("last").over(order) > window, F.lit(True))
    summary = summary.withColumn("broke", broke.cast("int")).withColumn("stretch", F.sum("broke").over(order))
    return rows.join(summary.select("key", "bucket", "stretch"), ["key", "bucket"]).drop("bucket")


def sliding_rate_limit(hits: DataFrame, limit: int = MAX_HITS, window_seconds: int = WINDOW_SECONDS) -> DataFrame:
    """``hits(key, event_id, at_us)`` -> a decision per hit.

    The decision depends on earlier decisions, so the hits of one stretch are walked in order; the
    walk keeps ``limit`` numbers and streams its rows, so no group is ever held in memory.
    """
    window = window_seconds * 1_000_000
    placed = _stretches(hits.select(F.col("key").cast("string").alias("key"), "event_id", "at_us"), window)
    walked = placed.repartition("key", "stretch").sortWithinPartitions("key", "stretch", "at_us", "event_id")

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, recent = None, deque()
        for frame in frames:
            out = []
            for key, event, at, stretch in zip(
                frame["key"], frame["event_id"], frame["at_us"], frame["stretch"], strict=True
            ):
                if (key, stretch) != current:
                    current, recent = (key, stretch), deque()
                out.append((key, event, at, *decide(recent, at, limit, window)))
            yield pd.DataFrame(out, columns=["key", "event_id", "at_us", "allowed", "remaining", "retry_after"])

    return walked.mapInPandas(walk, DECISIONS)


def sliding_rate_limit_stream(
    hits: DataFrame, limit: int = MAX_HITS, window_seconds: int = WINDOW_SECONDS
) -> DataFrame:
    """The same over a stream ``(key, event_id, ts)``: state is the accepted times of a key.

    Hits of a key must arrive in time order (within a micro-batch they are put in order, two numbers a hit);
    state is dropped one window after a key falls silent.
    """
    window = window_seconds * 1_000_000

    def update(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent = deque(state.get[0]) if state.exists else deque()
        latest = 0

        def decided() -> Iterator[tuple]:
            nonlocal latest
            for at, event in in_order(frames, ("at_us", "event_id")):
                latest = at
                yield (key[0], event, at, *decide(recent, at, limit, window))

        yield from framed(decided(), ["key", "event_id", "at_us", "allowed", "remaining", "retry_after"])
        state.update((list(recent),))
        state.setTimeoutTimestamp(max(latest // 1000 + window_seconds * 1000, state.getCurrentWatermarkMs() + 1))

    timed = hits.withWatermark("ts", f"{window_seconds} seconds").select(
        F.col("key").cast("string").alias("key"), "event_id", F.unix_micros("ts").alias("at_us"), "ts"
    )
    return timed.groupBy("key").applyInPandasWithState(
        update, DECISIONS, "recent array<bigint>", "append", GroupStateTimeout.EventTimeTimeout
    )
