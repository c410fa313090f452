"""Counts and shares behind a dashboard or a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave import dims
from riskweave.functions.scoring import severity_name, severity_rank


def open_only(findings: DataFrame) -> DataFrame:
    return findings.filter(F.col("status") != dims.FIXED)


def counts_by_severity(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Open findings per severity; every severity is present, with zero where there is none."""
    wide = findings.groupBy(*keys).agg(
        *[
            F.count_if((F.col("status") != dims.FIXED) & (F.col("severity") == s)).alias(s)
            for s in dims.SEVERITIES
        ]
    )
    pairs = F.array(*[F.struct(F.lit(s).alias("severity"), F.col(s).alias("n")) for s in dims.SEVERITIES])
    return wide.select(*keys, F.explode(pairs).alias("pair")).select(*keys, "pair.severity", "pair.n")


def counts_by_status(findings: DataFrame, keys: list[str]) -> DataFrame:
    return findings.groupBy(*keys, "status").agg(F.count("*").alias("n"))


def dashboard_totals(
    projects: DataFrame, repositories: DataFrame, scans: DataFrame, findings: DataFrame
) -> DataFrame:
    """Per owner: projects, repositories, scanned ones, completed scans, open and fixed findings.

    Inputs carry ``owner_id`` (see ``owner_scope``).  Each table is aggregated before it is
    joined, so the joins are between one row per owner.
    """
    per_project = projects.groupBy("owner_id").agg(F.count("*").alias("projects"))
    per_repository = repositories.groupBy("owner_id").agg(F.count("*").alias("repositories"))
    done = scans.filter("status = 'COMPLETED' and finished_at is not null")
    per_scan = done.groupBy("owner_id", "repository_id").agg(F.count("*").alias("n")).groupBy("owner_id").agg(
        F.count("*").alias("repositories_scanned"), F.sum("n").alias("scans_completed")
    )
    per_finding = findings.groupBy("owner_id").agg(
        F.count_if(F.col("status") != dims.FIXED).alias("open_findings"),
        F.count_if(F.col("status") == dims.FIXED).alias("fixed_findings"),
    )
    out = per_project
    for other in (per_repository, per_scan, per_finding):
        out = out.join(other, "owner_id", "left")
    return out.select(
        "owner_id",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in out.columns if c != "owner_id"],
    )


def weakness_groups(findings: DataFrame, keys: list[str], limit: int | None = 6) -> DataFrame:
    """Open findings per CWE: count, commonest title and category, worst severity.

    A missing CWE is a group of its own.  Counts per (CWE, title, category, severity) come
    first, so what is grouped again is a handful of rows however many findings there are.
    """
    small = open_only(findings).groupBy(*keys, "cwe_id", "title", "owasp_category", "severity").agg(
        F.count("*").alias("n")
    )
    titles = small.groupBy(*keys, "cwe_id", "title").agg(F.sum("n").alias("n"))
    modal_title = titles.groupBy(*keys, "cwe_id").agg(
        F.min_by("title", F.struct((-F.col("n")).alias("n"), "title")).alias("title"), F.sum("n").alias("count")
    )
    areas = small.filter("owasp_category is not null").groupBy(*keys, "cwe_id", "owasp_category").agg(
        F.sum("n").alias("n")
    )
    modal_area = areas.groupBy(*keys, "cwe_id").agg(
        F.min_by("owasp_category", F.struct((-F.col("n")).alias("n"), "owasp_category")).alias("owasp_category")
    )
    worst = small.groupBy(*keys, "cwe_id").agg(F.min(severity_rank(F.col("severity"))).alias("worst"))

    def on(left: str, right: str) -> Column:
        same = F.col(f"{left}.cwe_id").eqNullSafe(F.col(f"{right}.cwe_id"))
        for key in keys:
            same = same & (F.col(f"{left}.{key}") == F.col(f"{right}.{key}"))
        return same

    joined = (
        modal_title.alias("t").join(worst.alias("w"), on("t", "w"))
        .join(modal_area.alias("a"), on("t", "a"), "left")
    )
    out = joined.select(
        *[F.col(f"t.{key}") for key in keys], "t.cwe_id", "t.title", "a.owasp_category", "t.count",
        severity_name(F.col("w.worst")).alias("worst_severity"),
    )
    order = Window.partitionBy(*keys).orderBy(F.desc("count"), F.coalesce("cwe_id", F.lit("")))
    ranked = out.withColumn("position", F.row_number().over(order))
    return ranked if limit is None else ranked.filter(F.col("position") <= limit)


def fix_outcomes(patches: DataFrame, keys: list[str]) -> DataFrame:
    """What became of every requested fix, from ``patch_with_latest_check``."""
    status, check = F.col("status"), F.col("check_status")
    active = status.isin(*dims.ACTIVE)
    refused = status == dims.FAILED
    proposed = ~active & ~refused
    settled = F.coalesce(check.isin(*dims.ACTIVE, dims.PASSED, dims.REJECTED), F.lit(False))
    return patches.groupBy(*keys).agg(
        F.count("*").alias("requested"),
        F.count_if(active).alias("generating"),
        F.count_if(refused).alias("refused"),
        F.count_if(proposed).alias("proposed"),
        F.count_if(proposed & check.isNull()).alias("unchecked"),
        F.count_if(proposed & check.isin(*dims.ACTIVE)).alias("checking"),
        F.count_if(proposed & (check == dims.PASSED)).alias("passed"),
        F.count_if(proposed & (check == dims.REJECTED)).alias("rejected"),
        F.count_if(proposed & check.isNotNull() & ~settled).alias("not_judged"),
    )


def pass_rate(passed: Column, rejected: Column) -> Column:
    """Whole percent of judged fixes that passed; NULL when none was judged."""
    share = F.try_divide(passed.cast("double"), (passed + rejected).cast("double")) * 100
    return F.floor(share + 0.5).cast("bigint")


def bar_shares(counts: DataFrame, keys: list[str], value: str = "n") -> DataFrame:
    """Bar length against the largest value of a group, and the share of its total in words."""
    totals = counts.groupBy(*keys).agg(F.max(value).alias("_largest"), F.sum(value).alias("_total"))
    v, largest, total = F.col(value), F.col("_largest"), F.col("_total")
    percent = F.when((v <= 0) | (largest <= 0), 0.0).otherwise(
        F.greatest(F.lit(2.0), F.least(F.lit(100.0), v / largest * 100))
    )
    share = v / total * 100
    words = (
        F.when(total <= 0, "0%").when((share > 0) & (share < 1), "under 1%")
        .otherwise(F.concat(F.floor(share + 0.5).cast("string"), F.lit("%")))
    )
    return counts.join(totals, keys).select(
        *counts.columns, percent.alias("percent"), words.alias("share")
    )


def report_rules(findings: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """Open findings per rule and repository: count, worst severity, the team's own notes."""
    per = open_only(findings).groupBy("repository_id", "rule_id").agg(
        F.count("*").alias("count"), F.min(severity_rank(F.col("severity"))).alias("severity_rank"),
        F.min_by(
            F.struct("title", "cwe_id", "owasp_category"), F.struct((-F.col("score")).alias("s"), "id")
        ).alias("first"),
    )
    out = per.select(
        "repository_id", "rule_id", "count", "severity_rank",
        severity_name(F.col("severity_rank")).alias("worst_severity"), "first.*",
    )
    if notes is not None:
        one = F.min(F.struct("risk", "fix")).alias("note")  # a rule with two notes gives one row all the same
        kept = notes.groupBy("rule_id").agg(one).select(
            "rule_id", F.col("note.risk").alias("risk_note"), F.col("note.fix").alias("fix_note")
        )
        return out.join(kept, "rule_id", "left")
    return out.withColumn("risk_note", F.lit(None).cast("string")).withColumn(
        "fix_note", F.lit(None).cast("string")
    )


def report_header(findings: DataFrame) -> DataFrame:
    """Open, new and fixed counts per repository, and the open ones by severity."""
    is_open = F.col("status") != dims.FIXED
    return findings.groupBy("repository_id").agg(
        F.count_if(is_open).alias("open_count"),
        F.count_if(F.col("status") == "NEW").alias("new_count"),
        F.count_if(~is_open).alias("fixed_count"),
        *[F.count_if(is_open & (F.col("severity") == s)).alias(s.lower()) for s in dims.SEVERITIES],
    )


def knowledge_status(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row per source: documents, versions, passages, embedded passages, models."""
    per_document = documents.groupBy("source").agg(
        F.count("*").alias("documents"), F.count_distinct("source_version").alias("versions"),
        F.max("updated_at").alias("built_at"),
    )
    per_chunk = chunks.groupBy("source").agg(
        F.count("*").alias("chunks"), F.count_if(F.col("embedding").isNotNull()).alias("embedded"),
        F.count_distinct("embedding_model").alias("models"),
    )
    return per_document.join(per_chunk, "source", "full_outer").select(
        "source", F.coalesce("documents", F.lit(0)).alias("documents"), "versions", "built_at",
        F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("embedded", F.lit(0)).alias("embedded"),
        F.coalesce("models", F.lit(0)).alias("models"),
    )


def example_census(patches: DataFrame) -> DataFrame:
    """Per rule: what became of each requested fix, most judged first."""
    out = fix_outcomes(patches, ["rule_id"])
    return out.select(
        "rule_id", "requested", "generating", "refused", "unchecked", "checking", "not_judged",
        "passed", "rejected",
    )
