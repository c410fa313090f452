"""Orders, pages and trends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions.scoring import severity_rank


def severity_order(findings: DataFrame) -> DataFrame:
    """Worst severity first, then path, line, rule and id: never alphabetical by severity."""
    return findings.withColumn("severity_rank", severity_rank(F.col("severity"))).orderBy(
        "severity_rank", "file_path", "line_start", "rule_id", "id"
    )


def page(rows: DataFrame, per: list[str], order: list, limit: int, offset: int) -> DataFrame:
    """One page of every group.  The row-number bound is pushed below the shuffle."""
    ordered = Window.partitionBy(*per).orderBy(*order)
    numbered = rows.withColumn("position", F.row_number().over(ordered))
    return numbered.filter((F.col("position") > offset) & (F.col("position") <= offset + limit))


def list_findings_page(findings: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of each repository's findings with the repository's whole counts beside it."""
    ranked = findings.withColumn("severity_rank", severity_rank(F.col("severity")))
    rows = page(
        ranked, ["repository_id"], ["severity_rank", "file_path", "line_start", "id"], limit, offset
    )
    totals = findings.groupBy("repository_id").agg(F.count("*").alias("total"))
    return rows.join(totals, "repository_id")


def scan_history_page(scans: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    return page(scans, ["repository_id"], [F.desc("created_at"), F.desc("id")], limit, offset)


def recent_audit(events: DataFrame, limit: int = 50) -> DataFrame:
    """The latest events of all: a top-N, not a sort of everything."""
    return events.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def risk_trend(scans: DataFrame, points: int = 12) -> DataFrame:
    """The last scored scans of each repository, oldest first; unscored ones are left out."""
    scored = scans.filter("status = 'COMPLETED' and finished_at is not null and risk_score is not null")
    latest = Window.partitionBy("repository_id").orderBy(F.desc("finished_at"), F.desc("id"))
    kept = scored.withColumn("back", F.row_number().over(latest)).filter(F.col("back") <= points)
    order = Window.partitionBy("repository_id").orderBy(F.desc("back"))
    return kept.withColumn("point", F.row_number().over(order)).drop("back")


def repository_ranking(summaries: DataFrame, per: str = "owner_id") -> DataFrame:
    """Worst repository first within an owner; those never scanned come last."""
    return summaries.orderBy(per, F.col("score").desc_nulls_last(), "repository_id")


def report_order(scored: DataFrame) -> DataFrame:
    """Reading order of a report: risk, severity, path, line, id."""
    return scored.withColumn("severity_rank", severity_rank(F.col("severity"))).orderBy(
        F.desc("score"), "severity_rank", "file_path", "line_start", "id"
    )
