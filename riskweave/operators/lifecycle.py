"""Scan lifecycle: NEW, OPEN, FIXED and back again.

One formulation serves one scan, many scans at once and a stream: what was seen is laid on a
per-repository scan order, and each sighting is judged by the sighting before and after it.  A
stored finding takes part as a sighting at order 0 (still live) or far before it (FIXED).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave import dims

REFRESHED = ("line_start", "line_end", "severity", "confidence", "message", "snippet")
STATE = ("status", "first_seen", "last_seen", "fixed_in", "is_regression")
KEY = ["repository_id", "fingerprint"]
LONG_AGO = -10


def scan_ordinals(scans: DataFrame) -> DataFrame:
    """``(repository_id, scan_id, ordinal)``; one row per scan, so the window stays small."""
    order = Window.partitionBy("repository_id").orderBy("scan_id")
    return scans.select("repository_id", "scan_id").distinct().withColumn(
        "ordinal", F.row_number().over(order)
    )


def _timeline(observations: DataFrame, ordinals: DataFrame, state: DataFrame | None) -> DataFrame:
    payload = [c for c in observations.columns if c not in ("repository_id", "scan_id", "fingerprint")]
    seen = observations.join(ordinals, ["repository_id", "scan_id"]).select(
        *KEY, "ordinal", "scan_id", *payload,
        F.lit(None).cast("string").alias("was"), F.lit(None).alias("was_first").cast("string"),
        F.lit(None).alias("was_fixed").cast("string"), F.lit(None).cast("boolean").alias("was_regression"),
    )
    scan_type = dict(observations.dtypes)["scan_id"]
    seen = seen.withColumn("was_first", F.col("was_first").cast(scan_type)).withColumn(
        "was_fixed", F.col("was_fixed").cast(scan_type)
    )
    if state is not None:
        live = F.when(F.col("status") == dims.FIXED, LONG_AGO).otherwise(0)
        stored = state.select(
            *KEY, live.alias("ordinal"), F.col("last_seen").alias("scan_id"), *payload,
            F.col("status").alias("was"), F.col("first_seen").alias("was_first"),
            F.col("fixed_in").alias("was_fixed"), F.col("is_regression").alias("was_regression"),
        )
        seen = seen.unionByName(stored)
    counts = ordinals.groupBy("repository_id").agg(F.max("ordinal").alias("scans"))
    seen = seen.join(counts, "repository_id", "left").withColumn("scans", F.coalesce("scans", F.lit(0)))
    # A fingerprint is seen at most once per scan: the window holds no more rows than scans.
    order = Window.partitionBy(*KEY).orderBy("ordinal")
    seen = seen.withColumn("previous", F.lag("ordinal").over(order)).withColumn(
        "following", F.lead("ordinal").over(order)
    )
    event = (
        F.when(F.col("ordinal") <= 0, F.lit(None).cast("string"))
        .when(F.col("previous").isNull(), "new")
        .when(F.col("ordinal") - F.col("previous") > 1, "returned")
        .otherwise("open")
    )
    gone = F.coalesce(F.col("following") - F.col("ordinal") > 1, F.col("ordinal") < F.col("scans"))
    return seen.withColumn("event", event).withColumn(
        "fixed_at", F.when((F.col("ordinal") >= 0) & gone, F.col("ordinal") + 1)
    )


def replay_scans(
    observations: DataFrame, scans: DataFrame | None = None, state: DataFrame | None = None
) -> DataFrame:
    """``(repository_id, scan_id, total, new, open, fixed, returned)`` for every scan.

    ``new`` counts returned findings too; a scan that found nothing has a row when ``scans``
    names it.
    """
    ordinals = scan_ordinals(observations if scans is None else scans)
    timeline = _timeline(observations.select(*KEY, "scan_id"), ordinals, _keys_only(state))
    sighted = timeline.filter("ordinal > 0").groupBy("repository_id", "ordinal").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("event").isin("new", "returned")).alias("new"),
        F.count_if(F.col("event") == "open").alias("open"),
        F.count_if(F.col("event") == "returned").alias("returned"),
    )
    fixed = timeline.filter("fixed_at is not null").groupBy(
        "repository_id", F.col("fixed_at").alias("ordinal")
    ).agg(F.count("*").alias("fixed"))
    keys = ["repository_id", "ordinal"]
    out = ordinals.join(sighted, keys, "left").join(fixed, keys, "left")
    zero = F.lit(0).cast("bigint")
    return out.select(
        "repository_id", "scan_id", "ordinal",
        *[F.coalesce(c, zero).alias(c) for c in ("total", "new", "open", "fixed", "returned")],
    )


def _keys_only(state: DataFrame | None) -> DataFrame | None:
    return None if state is None else state.select(*KEY, *STATE)


def apply_scans(
    state: DataFrame | None, observations: DataFrame, scans: DataFrame | None = None
) -> DataFrame:
    """The state after one or more scans: ``(.., status, first_seen, last_seen, fixed_in, is_regression)``.

    A finding seen again refreshes its line, severity, confidence, message and snippet; everything
    else keeps its first value.  Repositories without a scan keep their rows as they are.
    """
    ordinals = scan_ordinals(observations if scans is None else scans)
    payload = [c for c in observations.columns if c not in ("repository_id", "scan_id", "fingerprint")]
    timeline = _timeline(observations, ordinals, state)
    entered = F.col("event").isin("new", "returned")
    merged = timeline.groupBy(*KEY).agg(
        F.max("scans").alias("scans"),
        F.max("ordinal").alias("last"),
        F.max_by("event", "ordinal").alias("event"),
        F.max_by("scan_id", "ordinal").alias("last_seen"),
        F.max_by("scan_id", F.when(entered, F.col("ordinal"))).alias("entered_in"),
        F.max("was").alias("was"), F.max("was_first").alias("was_first"),
        F.max("was_fixed").alias("was_fixed"), F.max("was_regression").alias("was_regression"),
        *[
            (F.max_by(c, "ordinal") if c in REFRESHED else F.min_by(c, "ordinal")).alias(c)
            for c in payload
        ],
    )
    next_scan = ordinals.select(
        "repository_id", (F.col("ordinal") - 1).alias("last"), F.col("scan_id").alias("next_scan")
    )
    merged = merged.join(next_scan, ["repository_id", "last"], "left")
    missing = (F.col("last") < F.col("scans")) | ((F.col("last") < 0) & F.col("event").isNull())
    status = (
        F.when(missing, dims.FIXED)
        .when(F.col("event").isin("new", "returned"), "NEW")
        .when(F.col("event") == "open", "OPEN")
        .otherwise(F.col("was"))
    )
    still_fixed = (F.col("last") < 0) & F.col("event").isNull()
    fixed_in = F.when(still_fixed, F.col("was_fixed")).when(missing, F.col("next_scan"))
    regression = F.when(F.col("event").isNull() & ~missing, F.coalesce("was_regression", F.lit(False))).otherwise(
        F.coalesce(F.col("event") == "returned", F.lit(False)) & ~missing
    )
    return merged.select(
        *KEY, *payload, status.alias("status"),
        F.coalesce("entered_in", "was_first").alias("first_seen"), "last_seen",
        fixed_in.alias("fixed_in"), regression.alias("is_regression"),
    )


def fingerprint_set_difference(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """``side``: fixed (stored and not seen) or new (seen and not stored), as sets."""
    keys = ["repository_id", "fingerprint"]
    fixed = stored.select(*keys).distinct().join(seen, keys, "left_anti")
    new = seen.select(*keys).distinct().join(stored, keys, "left_anti")
    return fixed.withColumn("side", F.lit("fixed")).unionByName(new.withColumn("side", F.lit("new")))


def late_scans(scans: DataFrame, applied: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scans to apply, late ones): a scan no newer than the last applied one is not applied."""
    last = applied.groupBy("repository_id").agg(F.max("scan_id").alias("last_applied"))
    joined = scans.join(last, "repository_id", "left")
    late = F.coalesce(F.col("scan_id") <= F.col("last_applied"), F.lit(False))
    return joined.filter(~late).drop("last_applied"), joined.filter(late).drop("last_applied")


def scan_merge(state: DataFrame, observations: DataFrame) -> DataFrame:
    """The merge of one scan as a full outer join, row by row: what each side says."""
    keys = ["repository_id", "fingerprint"]
    left = state.select(*keys, "status")
    right = observations.select(*keys, F.lit(True).alias("seen"))
    touched = observations.select("repository_id").distinct()
    joined = left.join(touched, "repository_id", "left_semi").join(right, keys, "full_outer")
    seen = F.coalesce("seen", F.lit(False))
    outcome: Column = (
        F.when(F.col("status").isNull(), "new")
        .when(seen & (F.col("status") == dims.FIXED), "returned")
        .when(seen, "open")
        .when(F.col("status") == dims.FIXED, "still_fixed")
        .otherwise("fixed")
    )
    return joined.select(*keys, outcome.alias("outcome"))


def refresh_reuse(presentations: DataFrame) -> DataFrame:
    """Families in which a token was presented after it had been rotated.

    ``presentations(family_id, token_id, presented_at, event_id)``.  The second use of a token is
    the reuse; the family is revoked then, and every later use in it is refused.
    """
    order = Window.partitionBy("family_id", "token_id").orderBy("presented_at", "event_id")
    second = presentations.withColumn("use", F.row_number().over(order)).filter(F.col("use") <= 2).filter(
        F.col("use") == 2
    )
    first = second.groupBy("family_id").agg(
        F.min_by(F.struct("token_id", "presented_at", "event_id"), F.struct("presented_at", "event_id")).alias("r")
    )
    revoked = first.select(
        "family_id", F.col("r.token_id").alias("reused_token"), F.col("r.presented_at").alias("revoked_at"),
        F.col("r.event_id").alias("revoked_by"),
    )
    at = F.struct("presented_at", "event_id")
    per = presentations.join(revoked, "family_id").groupBy("family_id").agg(
        F.first("reused_token").alias("reused_token"), F.first("revoked_at").alias("revoked_at"),
        F.count_if(at < F.struct("revoked_at", "revoked_by")).alias("rotations_before"),
        F.count_if(at > F.struct("revoked_at", "revoked_by")).alias("refused_after"),
    )
    return per
