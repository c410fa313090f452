"""Report rows: every finding of a repository described once, for every format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave import dims
from riskweave.functions.paths import path_context
from riskweave.functions.scoring import case_of, is_credential, severity_rank
from riskweave.operators.joins import finding_fix_state
from riskweave.operators.risk import score_explanation, score_findings

FIX_LABELS = {
    "none": "No fix has been asked for.",
    "rotate": "Rotate this credential: changing the code does not take it out of the history.",
    "generating": "A fix is being written.",
    "refused": "A fix was asked for and none was acceptable.",
    "unchecked": "A fix was proposed and never checked.",
    "checking": "A proposed fix is being checked.",
    "passed": "In a trial scan the latest fix removed this finding; it has yet to reach the repository.",
    "rejected": "A proposed fix was rejected by the re-scan.",
    "not_judged": "The trial scan of the latest fix failed: the file differs from the one it was written for.",
}
LIMITATIONS = (
    "Rules read code without running it: a finding names a dangerous construct, not a proven attack.",
    "No findings means that these rules did not match; it does not show that the code is secure.",
    "The score is a stated policy with its arithmetic shown; it is not CVSS.",
    "A fix that passed was applied to a copy; the finding stays open until the real code is scanned.",
    "Credentials are redacted before they are stored: at most four characters are kept.",
)


def fix_label(state: Column) -> Column:
    return case_of(state, FIX_LABELS, "")


def build_report(
    findings: DataFrame, patches: DataFrame, validations: DataFrame, check_order: list[str], now: Column
) -> DataFrame:
    """One row per finding: score, its arithmetic, fix state, label and place in reading order."""
    scored = score_findings(findings, now)
    stated = finding_fix_state(scored, patches, validations, check_order)
    kind = path_context(F.col("rule_id"), F.col("file_path"))
    fixed = F.col("status") == dims.FIXED
    return stated.select(
        *scored.columns, "fix_state",
        F.when(fixed, "").otherwise(fix_label(F.col("fix_state"))).alias("fix_label"),
        is_credential(F.col("cwe_id")).alias("is_credential"),
        score_explanation(kind).alias("score_explanation"),
        F.when(fixed, "fixed").otherwise("open").alias("part"),
        severity_rank(F.col("severity")).alias("severity_rank"),
    )


def reading_order() -> list[Column]:
    """Open findings by risk; fixed ones by place."""
    is_open = F.col("part") == "open"
    return [
        F.when(is_open, -F.col("score")), F.when(is_open, F.col("severity_rank")), F.col("file_path"),
        F.col("line_start"), F.col("id"),
    ]
