"""SARIF 2.1.0, one log per repository, written as ordered lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions.scoring import case_of
from riskweave.sinks.documents import lines, union

# --- fixed values of the format ---
VERSION = "2.1.0"
SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"
FINGERPRINT_KEY = "riskweave/v1"
LEVELS = {"CRITICAL": "error", "HIGH": "error", "MEDIUM": "warning", "LOW": "note", "INFO": "note"}
SECURITY_SEVERITY = {"CRITICAL": "9.5", "HIGH": "8.0", "MEDIUM": "5.5", "LOW": "3.0", "INFO": "1.0"}
TOOL = "riskweave"


def level(severity: Column) -> Column:
    return case_of(severity, LEVELS, "warning")


def rule_index(rules: DataFrame) -> DataFrame:
    """``rule_index`` per repository: worst severity, commonest, then id; at most 43 rows each."""
    order = Window.partitionBy("repository_id").orderBy("severity_rank", F.desc("count"), "rule_id")
    return rules.withColumn("rule_index", F.row_number().over(order) - 1)


def results(report: DataFrame, rules: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """Open findings as SARIF results, still as columns (what the text form is built from)."""
    rows = report.filter("part = 'open'").join(
        rule_index(rules).select("repository_id", "rule_id", "rule_index"), ["repository_id", "rule_id"]
    )
    state = F.lit(None).cast("string")
    if baseline is not None:
        known = baseline.select("fingerprint").distinct().withColumn("known", F.lit(True))
        rows = rows.join(known, "fingerprint", "left")
        state = F.when(F.col("known"), "unchanged").otherwise("new")
    return rows.select(
        "repository_id", "id", "rule_id", "rule_index", level(F.col("severity")).alias("level"),
        "message", "file_path", F.greatest("line_start", F.lit(1)).alias("start_line"),
        F.greatest("line_start", "line_end", F.lit(1)).alias("end_line"),
        F.when(F.trim("snippet") != "", F.col("snippet")).alias("snippet"), "fingerprint",
        state.alias("baseline_state"), "severity", "confidence", "status", "score", "fix_state",
        "severity_rank", "line_start",
    )


def _result_json(key: str) -> Column:
    region = F.struct(
        F.col("start_line").alias("startLine"), F.col("end_line").alias("endLine"),
        F.when(F.col("snippet").isNotNull(), F.struct(F.col("snippet").alias("text"))).alias("snippet"),
    )
    location = F.struct(
        F.struct(
            F.struct(F.col("file_path").alias("uri"), F.lit("%SRCROOT%").alias("uriBaseId")).alias("artifactLocation"),
            region.alias("region"),
        ).alias("physicalLocation")
    )
    return F.to_json(
        F.struct(
            F.col("rule_id").alias("ruleId"), F.col("rule_index").alias("ruleIndex"), "level",
            F.struct(F.col("message").alias("text")).alias("message"), F.array(location).alias("locations"),
            F.create_map(F.lit(key), F.col("fingerprint")).alias("partialFingerprints"),
            F.col("baseline_state").alias("baselineState"),
            F.struct(
                "severity", "confidence", F.col("status").alias("state"), F.col("score").alias("riskScore"),
                F.col("fix_state").alias("fix"),
            ).alias("properties"),
        )
    )


def export_sarif(
    report: DataFrame, rules: DataFrame, risk: DataFrame, header: DataFrame,
    baseline: DataFrame | None = None, key: str = FINGERPRINT_KEY, version: str = "0.1.0",
) -> DataFrame:
    """The log of every repository as ordered lines (see ``sinks.documents``).

    ``header(repository_id, origin, branch, commit_hash, truncated)`` says where the code is.
    """
    rows = results(report, rules, baseline)
    tags = F.array_compact(
        F.array(
            F.lit("security"), F.when(F.col("cwe_id").isNotNull(), F.concat(F.lit("external/cwe/"), F.lower("cwe_id")))
        )
    )
    descriptor = F.struct(
        F.col("rule_id").alias("id"), F.col("rule_id").alias("name"),
        F.struct(F.col("title").alias("text")).alias("shortDescription"),
        F.struct(level(F.col("worst_severity")).alias("level")).alias("defaultConfiguration"),
        F.struct(
            tags.alias("tags"), case_of(F.col("worst_severity"), SECURITY_SEVERITY, "5.5").alias("security-severity")
        ).alias("properties"),
        F.when(F.col("risk_note").isNotNull(), F.struct(F.col("risk_note").alias("text"))).alias("fullDescription"),
        F.when(F.col("fix_note").isNotNull(), F.struct(F.col("fix_note").alias("text"))).alias("help"),
    )
    listed = rule_index(rules).groupBy("repository_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rule_index", descriptor.alias("d")))), lambda x: x["d"]
        ).alias("rules")
    )
    about = header.join(risk, "repository_id", "left").join(listed, "repository_id", "left")
    start = F.concat(
        F.lit(f'{{"$schema":"{SCHEMA}","version":"{VERSION}","runs":[{{"tool":{{"driver":{{"name":"{TOOL}",'
              f'"version":"{version}","rules":'),
        F.coalesce(F.to_json("rules"), F.lit("[]")), F.lit('}},"results":['),
    )
    address = F.col("commit_hash").isNotNull() & F.col("origin").contains("://")
    provenance = F.when(
        address,
        F.concat(
            F.lit(',"versionControlProvenance":'),
            F.to_json(
                F.array(
                    F.struct(
                        F.col("origin").alias("repositoryUri"), F.col("commit_hash").alias("revisionId"), "branch"
                    )
                )
            ),
        ),
    ).otherwise("")
    about_run = F.to_json(
        F.struct(
            F.coalesce("score", F.lit(0.0)).alias("riskScore"), F.coalesce("grade", F.lit("A")).alias("riskGrade"),
            F.col("policy_version").alias("riskPolicyVersion"), "truncated",
        )
    )
    end = F.concat(F.lit('],"columnKind":"utf16CodeUnits","properties":'), about_run, provenance, F.lit("}]}"))
    keys = [-F.col("score"), F.col("severity_rank"), F.col("file_path"), F.col("line_start"), F.col("id")]
    place = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)])
    first = rows.groupBy("repository_id").agg(F.min(place).alias("first"))
    comma = F.when(place == F.col("first"), "").otherwise(",")
    body = rows.join(first, "repository_id")
    return union(
        lines(about, 0, start), lines(body, 1, F.concat(comma, _result_json(key)), keys), lines(about, 2, end)
    )
