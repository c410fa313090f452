"""Filters: ownership, search, exclusions and what may be worked on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave import dims
from riskweave.functions import paths
from riskweave.functions.scoring import is_credential, seconds_between


def owner_scope(
    rows: DataFrame, repositories: DataFrame, projects: DataFrame, owner_id: int | None = None
) -> DataFrame:
    """Attach ``project_id`` and ``owner_id`` through the chain; keep one owner when asked to."""
    homes = repositories.select(F.col("id").alias("repository_id"), "project_id").join(
        projects.select(F.col("id").alias("project_id"), "owner_id"), "project_id"
    )
    scoped = rows.join(homes, "repository_id")
    return scoped if owner_id is None else scoped.filter(F.col("owner_id") == owner_id)


def filter_findings(findings: DataFrame, severity: str | None = None, status: str | None = None) -> DataFrame:
    if severity is not None:
        findings = findings.filter(F.col("severity") == severity)
    return findings if status is None else findings.filter(F.col("status") == status)


def search_projects(projects: DataFrame, term: str | None, owner_id: int | None = None) -> DataFrame:
    """Case-insensitive contains; ``%`` and ``_`` in the term are ordinary characters."""
    if owner_id is not None:
        projects = projects.filter(F.col("owner_id") == owner_id)
    return projects.filter(F.contains(F.lower("name"), F.lower(F.lit(term)))) if term else projects


def project_name_taken(projects: DataFrame, wanted: DataFrame) -> DataFrame:
    """Which ``wanted(owner_id, name)`` an owner already has, ignoring case."""
    have = projects.select("owner_id", F.lower("name").alias("folded")).distinct().withColumn(
        "taken", F.lit(True)
    )
    asked = wanted.withColumn("folded", F.lower("name"))
    return asked.join(have, ["owner_id", "folded"], "left").select(
        *wanted.columns, F.coalesce("taken", F.lit(False)).alias("taken")
    )


def exclude_paths(findings: DataFrame, patterns: tuple[str, ...], column: str = "file_path") -> DataFrame:
    """Keep what no pattern matches; ``excluded_counts`` says what was left out."""
    return findings.filter(~paths.is_excluded(F.col(column), patterns))


def excluded_counts(findings: DataFrame, patterns: tuple[str, ...], column: str = "file_path") -> DataFrame:
    hit = paths.is_excluded(F.col(column), patterns)
    return findings.groupBy("repository_id").agg(
        F.count_if(hit).alias("excluded"), F.count_if(~hit).alias("kept")
    )


def patchable(findings: DataFrame) -> DataFrame:
    """Open findings whose fix is a change to code (a leaked credential is rotated instead)."""
    return findings.filter((F.col("status") != dims.FIXED) & ~is_credential(F.col("cwe_id")))


def scannable_repositories(repositories: DataFrame, scans: DataFrame) -> DataFrame:
    """READY repositories with a workspace and no scan queued or running."""
    busy = scans.filter(F.col("status").isin(*dims.ACTIVE)).select(F.col("repository_id").alias("id"))
    ready = repositories.filter("status = 'READY' and workspace_path is not null and workspace_path <> ''")
    return ready.join(busy, "id", "left_anti")


def outstanding_sessions(sessions: DataFrame, now: Column) -> DataFrame:
    return sessions.filter(F.col("revoked_at").isNull() & (F.col("expires_at") > now))


def stale_jobs(scans: DataFrame, now: Column, older_than_seconds: int, max_attempts: int) -> DataFrame:
    """Jobs left RUNNING past a cutoff, and what becomes of each."""
    stale = (
        (F.col("status") == "RUNNING") & F.col("started_at").isNotNull()
        & (seconds_between(F.col("started_at"), now) > older_than_seconds)
    )
    next_status = F.when(F.col("attempts") >= max_attempts, dims.FAILED).otherwise("QUEUED")
    return scans.filter(stale).withColumn("next_status", next_status)


def job_durations(jobs: DataFrame) -> DataFrame:
    """``duration_ms`` of every finished job, in whole milliseconds."""
    micros = F.timestamp_diff(
        "MICROSECOND", F.col("started_at").cast("timestamp"), F.col("finished_at").cast("timestamp")
    )
    return jobs.filter("started_at is not null and finished_at is not null").withColumn(
        "duration_ms", F.floor(micros / 1000).cast("bigint")
    )
