"""The lifecycle over a stream of completed scans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskweave.operators import lifecycle
from riskweave.sinks.state import bucket_of, read_held, read_state, write_findings_state, write_held

SCAN_COLUMNS = ("repository_id", "scan_id", "status")


def merge_batch(batch: DataFrame, epoch: int, path: str) -> None:
    """Merge one micro-batch: rows ``(repository_id, scan_id, status, fingerprint, ..payload)``.

    A scan is its rows, in any number of batches, and one end mark: a row with a NULL fingerprint, which
    comes last (a scan that found nothing is its end mark alone).  Rows of scans that have not ended are held
    back and applied with the batch that brings the mark; then they are held no longer, so a batch costs what is held and not
    the history.  Scans that did not complete change
    nothing.  A scan no newer than the last one applied to its repository is not applied and is
    written to ``late``.
    """
    spark = batch.sparkSession
    done = batch.filter("status = 'COMPLETED'").persist()
    try:
        key = ["repository_id", "scan_id"]
        scans = done.filter("fingerprint is null").select(*key).distinct()
        rows = done.filter("fingerprint is not null").drop("status")
        held = read_held(spark, path, epoch)
        if held is not None:
            rows = rows.unionByName(held)
        write_held(rows.join(scans, key, "left_anti"), path, epoch)
        ledger = read_state(spark, path, epoch, "ledger")
        late = None
        if ledger is not None:
            scans, late = lifecycle.late_scans(scans, ledger.select("repository_id", "scan_id"))
        if late is not None and not late.isEmpty():
            write_findings_state(late, path, epoch, table="late")
        if scans.isEmpty():
            return
        observations = rows.join(scans, key, "left_semi").dropDuplicates([*key, "fingerprint"])
        stored = read_state(spark, path, epoch)
        if stored is not None:
            # Whole buckets are written again, so every repository of a touched bucket is read.
            touched = scans.select(bucket_of(F.col("repository_id")).alias("b")).distinct()
            stored = stored.withColumn("b", bucket_of(F.col("repository_id"))).join(
                F.broadcast(touched), "b", "left_semi"
            ).drop("b")
        counts = lifecycle.replay_scans(observations, scans, stored)
        write_findings_state(lifecycle.apply_scans(stored, observations, scans), path, epoch)
        write_findings_state(counts, path, epoch, table="ledger")
    finally:
        done.unpersist()


def apply_scan_stream(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Run ``merge_batch`` for every micro-batch; exactly once, because an epoch is repeatable."""
    writer = stream.writeStream.foreachBatch(lambda batch, epoch: merge_batch(batch, epoch, path)).option(
        "checkpointLocation", checkpoint
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()
