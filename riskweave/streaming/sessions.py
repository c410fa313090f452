"""Refresh-token reuse over a stream of presentations."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from riskweave.streaming.ordered import framed, in_order

ALERTS = "family_id bigint, token_id bigint, event_id bigint, at_us bigint, outcome string"


def refresh_reuse_stream(presentations: DataFrame) -> DataFrame:
    """One row per presentation: ``rotated``, ``reuse`` (the family is revoked) or ``refused``.

    State of a family is the tokens already rotated and whether it was revoked; a revoked family
    forgets its tokens.
    """

    def update(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used, revoked = (set(state.get[0]), state.get[1]) if state.exists else (set(), False)

        def judged() -> Iterator[tuple]:
            nonlocal used, revoked
            for at, event, token in in_order(frames, ("at_us", "event_id"), ("token_id",)):
                if revoked:
                    outcome = "refused"
                elif token in used:
                    outcome, revoked, used = "reuse", True, set()
                else:
                    outcome = "rotated"
                    used.add(token)
                yield key[0], token, event, at, outcome

        yield from framed(judged(), ["family_id", "token_id", "event_id", "at_us", "outcome"])
        state.update((sorted(used), revoked))

    timed = presentations.select("family_id", "token_id", "event_id", F.unix_micros("presented_at").alias("at_us"))
    return timed.groupBy("family_id").applyInPandasWithState(
        update, ALERTS, "used array<bigint>, revoked boolean", "append", GroupStateTimeout.NoTimeout
    )
