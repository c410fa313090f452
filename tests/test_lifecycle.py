import random

import pytest
from pyspark.sql import functions as F

from riskweave.operators import lifecycle
from riskweave.sinks.state import read_state
from riskweave.streaming.lifecycle import apply_scan_stream

OBS = "repository_id bigint, scan_id bigint, fingerprint string, line_start int"


def as_dict(state):
    return {(r.repository_id, r.fingerprint): (r.status, r.first_seen, r.last_seen, r.fixed_in, r.is_regression, r.line_start) for r in state.collect()}


def test_new_open_fixed_and_back(spark):
    rows = [(1, 1, "a", 5), (1, 1, "b", 6), (1, 2, "a", 7), (1, 3, "b", 8), (1, 3, "a", 9)]
    seen = spark.createDataFrame(rows, OBS)
    assert as_dict(lifecycle.apply_scans(None, seen)) == {
        (1, "a"): ("OPEN", 1, 3, None, False, 9), (1, "b"): ("NEW", 3, 3, None, True, 8),
    }
    counts = [tuple(r)[3:] for r in lifecycle.replay_scans(seen).orderBy("scan_id").collect()]
    assert counts == [(2, 2, 0, 0, 0), (1, 0, 1, 1, 0), (2, 1, 1, 0, 1)]


def history(seed, scans=9):
    rng = random.Random(seed)
    return [
        (repo, scan, f"f{f}", rng.randint(1, 50))
        for repo in (1, 2, 3) for scan in range(1, scans + 1) for f in range(8) if rng.random() < 0.5
    ]


@pytest.mark.parametrize("seed", [1, 2])
def test_one_by_one_equals_all_at_once(spark, seed):
    rows = history(seed, 5)
    seen = spark.createDataFrame(rows, OBS)
    scans = spark.createDataFrame([(r, s) for r in (1, 2, 3) for s in range(1, 6)], "repository_id bigint, scan_id bigint")
    state = None
    for scan in range(1, 6):
        state = lifecycle.apply_scans(state, seen.filter(F.col("scan_id") == scan), scans.filter(F.col("scan_id") == scan))
        kept = [tuple(r) for r in state.collect()]
        state = spark.createDataFrame(kept, state.schema)
    assert as_dict(state) == as_dict(lifecycle.apply_scans(None, seen, scans))


def test_a_scan_that_found_nothing_fixes_everything(spark):
    seen = spark.createDataFrame([(1, 1, "a", 1)], OBS)
    scans = spark.createDataFrame([(1, 1), (1, 2)], "repository_id bigint, scan_id bigint")
    assert as_dict(lifecycle.apply_scans(None, seen, scans))[(1, "a")][:4] == ("FIXED", 1, 1, 2)


def test_other_repositories_are_untouched(spark):
    first = lifecycle.apply_scans(None, spark.createDataFrame([(1, 1, "a", 1), (2, 1, "b", 1)], OBS))
    state = spark.createDataFrame([tuple(r) for r in first.collect()], first.schema)
    after = as_dict(lifecycle.apply_scans(state, spark.createDataFrame([(1, 2, "c", 1)], OBS)))
    assert after[(2, "b")] == ("NEW", 1, 1, None, False, 1) and after[(1, "a")][0] == "FIXED"


def test_stream_equals_batch_and_late_scans_are_counted(spark, tmp_path):
    rows = history(5, 6)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = OBS + ", status string"
    for part, scans in enumerate([(1, 2), (3,), (4, 5, 6), (2,)]):
        piece = [(*r, "COMPLETED") for r in rows if r[1] in scans] + [(1, 90 + part, "zz", 1, "FAILED")]
        piece += [(repo, scan, None, None, "COMPLETED") for repo, scan in {r[:2] for r in rows if r[1] in scans}]
        spark.createDataFrame(piece, schema).coalesce(1).write.parquet(f"{source}/p{part}")
        stream = spark.readStream.schema(spark.createDataFrame(piece, schema).schema).parquet(f"{source}/*")
        apply_scan_stream(stream, out, str(tmp_path / "ck")).awaitTermination()
    batch = lifecycle.apply_scans(None, spark.createDataFrame(rows, OBS))
    assert as_dict(read_state(spark, out)) == as_dict(batch)
    late = read_state(spark, out, table="late").collect()
    assert sorted((r.repository_id, r.scan_id) for r in late) == [(1, 2), (2, 2), (3, 2)]


def test_one_scan_over_three_files_is_one_scan(spark, tmp_path):
    rows = [(1, 1, f, i) for i, f in enumerate("abcdef")] + [(1, 2, f, i) for i, f in enumerate("bcx")]
    source, out, schema = str(tmp_path / "in"), str(tmp_path / "out"), OBS + ", status string"
    end = lambda scan: (1, scan, None, None, "COMPLETED")
    told = [(*r, "COMPLETED") for r in rows]
    for part, piece in enumerate([told[:2], told[2:4] + told[6:7], [*told[4:6], end(1)], [*told[7:], end(2)]]):
        frame = spark.createDataFrame(piece, schema)
        frame.coalesce(1).write.parquet(f"{source}/p{part}")
        stream = spark.readStream.schema(frame.schema).parquet(f"{source}/*")
        apply_scan_stream(stream, out, str(tmp_path / "ck")).awaitTermination()
        if part < 2:
            assert read_state(spark, out) is None
    assert as_dict(read_state(spark, out)) == as_dict(lifecycle.apply_scans(None, spark.createDataFrame(rows, OBS)))


def test_reuse_revokes_the_family(spark):
    rows = [(1, 10, 1, 1), (1, 11, 2, 2), (1, 10, 3, 3), (1, 12, 4, 4), (2, 20, 1, 5)]
    out = lifecycle.refresh_reuse(spark.createDataFrame(rows, "family_id bigint, token_id bigint, presented_at bigint, event_id bigint"))
    assert [tuple(r) for r in out.collect()] == [(1, 10, 3, 2, 1)]


def test_held_rows_leave_with_their_scan(spark, tmp_path):
    from riskweave.sinks.state import read_held
    from riskweave.streaming.lifecycle import merge_batch

    schema, path = "repository_id bigint, scan_id bigint, status string, fingerprint string, line_start int", str(tmp_path / "s")
    batches = [
        [(1, 1, "COMPLETED", "a", 1), (2, 1, "COMPLETED", "b", 2)],
        [(1, 1, "COMPLETED", "c", 3), (1, 1, "COMPLETED", None, None)],
        [(2, 1, "COMPLETED", "d", 4)],
        [(2, 1, "COMPLETED", None, None)],
    ]
    held = []
    for epoch, rows in enumerate(batches):
        for _ in range(2):  # a micro-batch may be repeated
            merge_batch(spark.createDataFrame(rows, schema), epoch, path)
        held.append(sorted(r["fingerprint"] for r in read_held(spark, path, epoch + 1).collect()))
    assert held == [["a", "b"], ["b"], ["b", "d"], []]
    assert sorted(p.name for p in (tmp_path / "s" / "held").iterdir()) == ["epoch=2", "epoch=3"]
