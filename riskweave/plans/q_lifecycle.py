"""Scan lifecycle, sessions and streams."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from riskweave.operators import filters, lifecycle
from riskweave.plans.adapters import Tables, now
from riskweave.plans.q_sources import scratch
from riskweave.plans.registry import query
from riskweave.plans.views import NOW
from riskweave.sinks.state import read_state
from riskweave.streaming.lifecycle import apply_scan_stream
from riskweave.streaming.rate_limit import sliding_rate_limit, sliding_rate_limit_stream
from riskweave.streaming.sessions import refresh_reuse_stream

STATE_SQL = """SELECT repository_id, fingerprint, CASE WHEN last < scans THEN 'FIXED' WHEN event = 'open' THEN 'OPEN' ELSE 'NEW' END AS status, first_seen, last_seen,
 CASE WHEN last < scans THEN nx END AS fixed_in, last = scans AND event = 'returned' AS is_regression, line_start FROM (
 SELECT t.repository_id, fingerprint, max(ordinal) AS last, max(scans) AS scans, arg_max(event, ordinal) AS event, arg_max(scan_id, ordinal) AS last_seen,
 arg_max(scan_id, ordinal) FILTER (WHERE event IN ('new','returned')) AS first_seen, arg_max(line_start, ordinal) AS line_start,
 arg_max((SELECT scan_id FROM v_ordinals o WHERE o.repository_id = t.repository_id AND o.ordinal = t.ordinal + 1), ordinal) AS nx FROM v_timeline t GROUP BY 1, 2)"""
COLUMNS = ["repository_id", "fingerprint", "status", "first_seen", "last_seen", "fixed_in", "is_regression", "line_start"]


@query("apply_scan", STATE_SQL)
def apply_scan(t: Tables):
    """All scans but the last of each repository at once, then the last one merged into that state."""
    last = t.observations.groupBy("repository_id").agg(F.max("scan_id").alias("last"))
    marked = t.observations.join(last, "repository_id")
    before = marked.filter("scan_id < last").drop("last")
    final = marked.filter("scan_id = last").drop("last")
    state = lifecycle.apply_scans(None, before)
    return lifecycle.apply_scans(state, final).select(*COLUMNS)


REPLAY_SQL = """SELECT o.repository_id, o.scan_id, coalesce(s.total, 0) AS total, coalesce(s.new, 0) AS new, coalesce(s.open, 0) AS open, coalesce(f.fixed, 0) AS fixed, coalesce(s.returned, 0) AS returned FROM v_ordinals o
 LEFT JOIN (SELECT repository_id, ordinal, count(*) AS total, count(*) FILTER (WHERE event <> 'open') AS new, count(*) FILTER (WHERE event = 'open') AS open, count(*) FILTER (WHERE event = 'returned') AS returned FROM v_timeline GROUP BY 1, 2) s USING (repository_id, ordinal)
 LEFT JOIN (SELECT repository_id, fixed_at AS ordinal, count(*) AS fixed FROM v_timeline WHERE fixed_at IS NOT NULL GROUP BY 1, 2) f USING (repository_id, ordinal)"""


@query("replay_scans", REPLAY_SQL)
def replay_scans(t: Tables):
    return lifecycle.replay_scans(t.observations).drop("ordinal")


def last_two(t: Tables):
    last = t.observations.groupBy("repository_id").agg(F.max("scan_id").alias("last"))
    marked = t.observations.join(last, "repository_id")
    return lifecycle.apply_scans(None, marked.filter("scan_id < last").drop("last")), marked.filter("scan_id = last").drop("last")


@query("scan_merge_join", """SELECT repository_id, fingerprint, CASE WHEN o = m THEN CASE WHEN p IS NULL THEN 'new' WHEN m - p > 1 THEN 'returned' ELSE 'open' END WHEN o = m - 1 THEN 'fixed' ELSE 'still_fixed' END AS outcome FROM (
 SELECT repository_id, fingerprint, max(scans) AS m, max(ordinal) AS o, arg_max(prev, ordinal) AS p FROM v_timeline GROUP BY 1, 2)""")
def scan_merge_join(t: Tables):
    state, final = last_two(t)
    return lifecycle.scan_merge(state, final)


@query("fingerprint_set_difference", """SELECT repository_id, fingerprint, CASE WHEN last = m THEN 'new' ELSE 'fixed' END AS side FROM (SELECT repository_id, fingerprint, max(scans) AS m, max(ordinal) AS last, min(ordinal) AS first FROM v_timeline GROUP BY 1, 2) WHERE last < m OR first = m""")
def fingerprint_set_difference(t: Tables):
    state, final = last_two(t)
    return lifecycle.fingerprint_set_difference(state, final)


@query("apply_scan_stream", STATE_SQL)
def apply_scan_stream_query(t: Tables):
    """The same history as a stream of files: rows of a scan lie in several files, its end mark in a later one."""
    source, state = scratch(t, "scans"), scratch(t, "findings")
    rows = t.observations.withColumn("status", F.lit("COMPLETED"))
    failed = t.observations.withColumn("status", F.lit("FAILED")).withColumn("scan_id", F.date_add("scan_id", 400))
    # Scans are in order by date; the halves are by their order, so any span of time is cut in two.
    middle = rows.agg(F.percentile_approx("scan_id", 0.5)).first()[0]
    early = F.col("scan_id") <= F.lit(middle)
    ahead = early | (F.crc32(F.col("fingerprint").cast("binary")) % 3 == 0)  # some rows of later scans come early
    others = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name not in ("repository_id", "scan_id", "status")]
    marks = rows.select("repository_id", "scan_id", "status").distinct().select("repository_id", "scan_id", "status", *others)
    pieces = (rows.filter(ahead).unionByName(failed), marks.filter(early), rows.filter(~ahead), marks.filter(~early))
    for number, piece in enumerate(pieces):
        piece.write.parquet(os.path.join(source, f"p{number}"))
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 3).parquet(os.path.join(source, "*"))
    # Files arrive in the order they were written, so a mark comes after the rows it ends.
    apply_scan_stream(stream, state, scratch(t, "checkpoint")).awaitTermination()
    return read_state(t.spark, state).select(*COLUMNS)


@query("late_scans", """SELECT repository_id, scan_id, scan_id <= mid AS late FROM v_ordinals JOIN (SELECT repository_id, max(scan_id) AS mid FROM v_ordinals WHERE ordinal % 7 = 0 GROUP BY 1) USING (repository_id)""")
def late_scans(t: Tables):
    ordinals = lifecycle.scan_ordinals(t.observations)
    applied = ordinals.filter("ordinal % 7 = 0")
    fresh, late = lifecycle.late_scans(ordinals.select("repository_id", "scan_id"), applied)
    return fresh.withColumn("late", F.lit(False)).unionByName(late.withColumn("late", F.lit(True)))


def hits(t: Tables):
    return t.events.select(F.col("user_id").alias("key"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"))


@query("sliding_rate_limit")
def sliding_rate_limit_query(t: Tables):
    """At most 3 hits per user in 12 hours."""
    return sliding_rate_limit(hits(t), limit=3, window_seconds=43_200)


@query("sliding_rate_limit_stream")
def sliding_rate_limit_stream_query(t: Tables):
    rows = t.spark.readStream.schema(t.read("events").schema).parquet(t.folder + "/events.parquet*")
    stream = rows.select(F.col("user_id").alias("key"), "event_id", F.col("ts").cast("timestamp").alias("ts"))
    out, checkpoint = scratch(t, "decisions"), scratch(t, "checkpoint")
    decided = sliding_rate_limit_stream(stream, limit=3, window_seconds=43_200)
    decided.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(
        availableNow=True
    ).start().awaitTermination()
    return t.spark.read.parquet(out)


@query("refresh_reuse_detect", """WITH u AS (SELECT user_id AS family_id, k AS token_id, ts, event_id, row_number() OVER (PARTITION BY user_id, k ORDER BY ts, event_id) AS use FROM ev WHERE event_type = 'purchase'),
 r AS (SELECT family_id, arg_min(token_id, (ts, event_id)) AS reused_token, min(ts) AS revoked_at, arg_min(event_id, (ts, event_id)) AS revoked_by FROM u WHERE use = 2 GROUP BY 1)
 SELECT r.family_id, r.reused_token::BIGINT AS reused_token, r.revoked_at, count(*) FILTER (WHERE (ts, event_id) < (revoked_at, revoked_by)) AS rotations_before, count(*) FILTER (WHERE (ts, event_id) > (revoked_at, revoked_by)) AS refused_after FROM r JOIN u USING (family_id) GROUP BY 1, 2, 3""")
def refresh_reuse_detect(t: Tables):
    return lifecycle.refresh_reuse(t.presentations)


@query("refresh_reuse_stream", """WITH u AS (SELECT user_id AS family_id, k AS token_id, ts, event_id, row_number() OVER (PARTITION BY user_id, k ORDER BY ts, event_id) AS use FROM ev WHERE event_type = 'purchase'),
 r AS (SELECT family_id, min(ts) AS at, arg_min(event_id, (ts, event_id)) AS by FROM u WHERE use = 2 GROUP BY 1)
 SELECT u.family_id, event_id, CASE WHEN r.at IS NULL OR (ts, event_id) < (r.at, r.by) THEN 'rotated' WHEN event_id = r.by THEN 'reuse' ELSE 'refused' END AS outcome FROM u LEFT JOIN r USING (family_id)""")
def refresh_reuse_stream_query(t: Tables):
    rows = t.spark.readStream.schema(t.read("events").schema).parquet(t.folder + "/events.parquet*")
    stream = rows.filter("event_type = 'purchase'").select(
        F.col("user_id").alias("family_id"), F.get_json_object("props", "$.k").cast("bigint").alias("token_id"),
        F.col("ts").cast("timestamp").alias("presented_at"), "event_id",
    )
    out, checkpoint = scratch(t, "alerts"), scratch(t, "checkpoint")
    refresh_reuse_stream(stream).writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", checkpoint
    ).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(out).select("family_id", "event_id", "outcome")


@query("stale_jobs", f"""SELECT id, CASE WHEN attempts >= 2 THEN 'FAILED' ELSE 'QUEUED' END AS next_status FROM v_scans WHERE status = 'RUNNING' AND started_at < {NOW} - INTERVAL 20 DAY""")
def stale_jobs(t: Tables):
    return filters.stale_jobs(t.scans, now(), 20 * 86_400, 2).select("id", "next_status")


@query("job_durations", "SELECT id, CAST((epoch_us(finished_at) - epoch_us(started_at)) // 1000 AS BIGINT) AS duration_ms FROM v_scans WHERE finished_at IS NOT NULL")
def job_durations(t: Tables):
    return filters.job_durations(t.scans).select("id", "duration_ms")
