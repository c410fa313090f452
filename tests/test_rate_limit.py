import random
from collections import defaultdict, deque

from pyspark.sql import functions as F

from riskweave.streaming.rate_limit import sliding_rate_limit, sliding_rate_limit_stream

LIMIT, WINDOW = 3, 60


def brute(rows):
    accepted, out = defaultdict(deque), {}
    for key, event, at in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        q = accepted[key]
        while q and q[0] < at - WINDOW * 1_000_000:
            q.popleft()
        out[event] = len(q) < LIMIT
        if out[event]:
            q.append(at)
    return out


def hits(seed=3, n=3000):
    rng = random.Random(seed)
    # One key has most of the rows, as an attacker would.
    return [(0 if rng.random() < 0.6 else rng.randint(1, 9), i, rng.randint(0, 40_000) * 1_000_000) for i in range(n)]


def test_batch_equals_brute_force(spark):
    rows = hits()
    out = sliding_rate_limit(spark.createDataFrame(rows, "key bigint, event_id bigint, at_us bigint"), LIMIT, WINDOW)
    assert {r.event_id: r.allowed for r in out.collect()} == brute(rows)


def test_stream_equals_batch(spark, tmp_path):
    rows = sorted(hits(7, 600), key=lambda r: r[2])
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in range(3):
        piece = spark.createDataFrame(rows[part * 200 : part * 200 + 200], "key bigint, event_id bigint, at_us bigint")
        piece.select("key", "event_id", F.timestamp_micros("at_us").alias("ts")).coalesce(1).write.parquet(f"{source}/p{part}")
        stream = spark.readStream.schema("key bigint, event_id bigint, ts timestamp").parquet(f"{source}/*")
        sliding_rate_limit_stream(stream, LIMIT, WINDOW).writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", str(tmp_path / "ck")
        ).trigger(availableNow=True).start().awaitTermination()
    got = {r.event_id: r.allowed for r in spark.read.parquet(out).collect()}
    assert got == brute(rows)


def test_rows_come_in_order_and_in_bounded_frames(monkeypatch):
    import pandas as pd

    from riskweave.streaming import ordered

    monkeypatch.setattr(ordered, "CHUNK", 7)
    rng = random.Random(1)
    rows = [(rng.randint(0, 9), i, 2**62 + i) for i in range(60)]
    frames = (pd.DataFrame(rows[at : at + 11], columns=["a", "b", "c"]) for at in range(0, 60, 11))
    read = iter(ordered.in_order(frames, ("a", "b"), ("c",)))
    assert list(read) == sorted(rows) and list(ordered.in_order(iter([]), ("a",))) == []
    sizes = [len(frame) for frame in ordered.framed(iter(rows), ["a", "b", "c"])]
    assert sum(sizes) == 60 and max(sizes) == 7
