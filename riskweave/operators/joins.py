"""Joins: latest rows, fix states, regions, citations and case files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave import dims
from riskweave.functions import paths
from riskweave.functions.scoring import is_credential


def latest_per_parent(rows: DataFrame, parent: str, order: list[str], keep: list[str]) -> DataFrame:
    """The last row of each parent by ``order``, whose last column must break every tie."""
    return rows.groupBy(parent).agg(F.max_by(F.struct(*keep), F.struct(*order)).alias("last")).select(
        parent, "last.*"
    )


def latest_completed_scan(scans: DataFrame) -> DataFrame:
    done = scans.filter("status = 'COMPLETED' and finished_at is not null")
    return latest_per_parent(done, "repository_id", ["finished_at", "id"], ["id", "finished_at", "status"])


def patch_with_latest_check(patches: DataFrame, validations: DataFrame, order: list[str]) -> DataFrame:
    """Every patch with the status of its latest check, NULL when it was never checked."""
    latest = latest_per_parent(validations, "patch_id", order, ["status"]).select(
        F.col("patch_id").alias("id"), F.col("status").alias("check_status")
    )
    return patches.join(latest, "id", "left")


def fix_state(credential: Column, patch_status: Column, check_status: Column) -> Column:
    """One word for where a finding's fix stands."""
    return (
        F.when(credential, "rotate")
        .when(patch_status.isNull(), "none")
        .when(patch_status.isin(*dims.ACTIVE), "generating")
        .when(patch_status == dims.FAILED, "refused")
        .when(check_status.isNull(), "unchecked")
        .when(check_status.isin(*dims.ACTIVE), "checking")
        .when(check_status == dims.PASSED, "passed")
        .when(check_status == dims.REJECTED, "rejected")
        .otherwise("not_judged")
    )


def finding_fix_state(
    findings: DataFrame, patches: DataFrame, validations: DataFrame, order: list[str]
) -> DataFrame:
    """Each finding with the state of its latest patch and that patch's latest check."""
    last_patch = latest_per_parent(patches, "finding_id", ["created_at", "id"], ["id", "status"])
    checked = patch_with_latest_check(last_patch, validations, order).select(
        F.col("finding_id").alias("id"), F.col("id").alias("patch_id"),
        F.col("status").alias("patch_status"), "check_status",
    )
    joined = findings.join(checked, "id", "left")
    return joined.withColumn(
        "fix_state",
        F.when(F.col("status") == dims.FIXED, F.lit("none")).otherwise(
            fix_state(is_credential(F.col("cwe_id")), F.col("patch_status"), F.col("check_status"))
        ),
    )


def rule_dimension_join(rows: DataFrame, rules: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(rules), "rule_id")


def baseline_anti_join(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    return findings.join(baseline.select("fingerprint"), "fingerprint", "left_anti")


def baseline_state(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    known = baseline.select("fingerprint").distinct().withColumn("known", F.lit(True))
    joined = findings.join(known, "fingerprint", "left")
    return joined.withColumn(
        "baseline_state", F.when(F.col("known"), "unchanged").otherwise("new")
    ).drop("known")


def lines_for_finding(findings: DataFrame, lines: DataFrame, context: int = 6) -> DataFrame:
    """Lines around each finding.  The range becomes an equi-join: one key per wanted line."""
    wanted = findings.select(
        "finding_id", "repository_id", "path", "line_start", "line_end",
        F.explode(
            F.sequence(
                F.greatest(F.col("line_start") - context, F.lit(1)),
                F.greatest("line_end", "line_start") + context,
            )
        ).alias("line_no"),
    )
    part = (
        F.when(F.col("line_no") < F.col("line_start"), "before")
        .when(F.col("line_no") > F.greatest("line_end", "line_start"), "after").otherwise("replaceable")
    )
    return wanted.join(lines, ["repository_id", "path", "line_no"]).withColumn("part", part)


def patchable_in_place(findings: DataFrame, lines: DataFrame, context: int = 6) -> DataFrame:
    """Patchable findings and whether their code is still where it was recorded."""
    from riskweave.operators.filters import patchable

    wanted = patchable(findings)
    first = F.trim(F.get(F.split("snippet", "\n"), F.lit(0)))
    region = lines_for_finding(wanted, lines, context)
    found = region.join(wanted.select("finding_id", first.alias("code")), "finding_id").groupBy("finding_id").agg(
        F.bool_or((F.col("part") == "replaceable") & F.contains("line", F.col("code"))).alias("in_place")
    )
    return wanted.join(found, "finding_id", "left").withColumn(
        "in_place", F.coalesce("in_place", F.lit(False))
    )


def citation_resolve(explanations: DataFrame, chunks: DataFrame) -> DataFrame:
    """Cited numbers as passages: position in the shown list, missing passages dropped."""
    shown = explanations.select(
        "explanation_id", "citations", F.posexplode("passage_chunk_ids").alias("pos", "chunk_id")
    ).withColumn("number", F.col("pos") + 1)
    cited = shown.filter(F.array_contains("citations", F.col("number")))
    return cited.select("explanation_id", "number", "chunk_id").join(chunks, "chunk_id")


def case_files(cases: DataFrame, files: DataFrame) -> DataFrame:
    """Each case with its source file: the one whose stem is the case's name."""
    sources = (*dims.PYTHON_SUFFIXES, *dims.SQL_HOST_SUFFIXES)
    kept = files.filter(paths.suffix(F.col("path")).isin(*sources)).select(
        paths.stem(F.col("path")).alias("name"), "path"
    )
    return cases.join(kept, "name")


def case_file_problems(cases: DataFrame, files: DataFrame) -> DataFrame:
    """Cases with no source file, or more than one.  Must be empty before anything is marked."""
    matched = case_files(cases, files).groupBy("name").agg(F.count("*").alias("files"))
    counted = cases.select("name").join(matched, "name", "left")
    problem = F.when(F.col("files").isNull(), "no source file").when(F.col("files") > 1, "several source files")
    return counted.select("name", problem.alias("problem")).filter("problem is not null")


def unpatched_findings(
    findings: DataFrame, patches: DataFrame, validations: DataFrame, again: bool = False,
    order: list[str] | None = None,
) -> DataFrame:
    """Open findings to ask a fix for: no active, unchecked or judged one (see ``again``).

    One aggregate over the patches of a finding replaces a chain of anti joins.
    """
    from riskweave.operators.filters import patchable

    order = order or ["created_at", "id"]
    checked = patch_with_latest_check(patches, validations, order)
    per = checked.groupBy(F.col("finding_id").alias("id")).agg(
        F.bool_or(F.col("status").isin(*dims.ACTIVE)).alias("active"),
        F.bool_or((F.col("status") == dims.PROPOSED) & F.col("check_status").isNull()).alias("unchecked"),
        F.max_by(
            "check_status",
            F.when(F.col("check_status").isNotNull(), F.struct("created_at", "id")),
        ).alias("verdict"),
    )
    joined = patchable(findings).join(per, "id", "left")
    blocked = F.coalesce("active", F.lit(False)) | F.coalesce("unchecked", F.lit(False))
    if again:
        judged = F.coalesce(F.col("verdict") == dims.PASSED, F.lit(False))
    else:
        judged = F.col("verdict").isNotNull()
    return joined.filter(~blocked & ~judged).drop("active", "unchecked", "verdict")
