"""Risk factors as Columns, rendered from a policy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskweave import dims
from riskweave.functions.paths import path_context
from riskweave.policy import POLICY, RiskPolicy


def case_of(column: Column, table: dict, default) -> Column:
    out = None
    for key, value in table.items():
        out = F.when(column == key, F.lit(value)) if out is None else out.when(column == key, F.lit(value))
    return out.otherwise(F.lit(default))


def severity_rank(severity: Column) -> Column:
    return case_of(severity, {s: i for i, s in enumerate(dims.SEVERITIES)}, len(dims.SEVERITIES))


def confidence_rank(confidence: Column) -> Column:
    return case_of(confidence, {c: i for i, c in enumerate(dims.CONFIDENCES)}, len(dims.CONFIDENCES))


def severity_name(rank: Column) -> Column:
    return case_of(rank, dict(enumerate(dims.SEVERITIES)), None)


def seconds_between(start: Column, end: Column) -> Column:
    micros = F.timestamp_diff("MICROSECOND", start.cast("timestamp"), end.cast("timestamp"))
    return micros.cast("double") / 1e6


def age_days(created_at: Column, now: Column) -> Column:
    return F.greatest(F.lit(0.0), seconds_between(created_at, now) / 86400.0)


def age_factor(created_at: Column, now: Column, policy: RiskPolicy = POLICY) -> Column:
    capped = F.least(age_days(created_at, now), F.lit(policy.age_cap_days))
    value = F.bround(1.0 + (capped / policy.age_cap_days) * policy.age_bonus, 3)
    return F.coalesce(value, F.lit(1.0))


def path_factor(rule_id: Column, path: Column, policy: RiskPolicy = POLICY) -> Column:
    table = {
        "secret": policy.secret_path,
        "test": policy.test_path,
        "vendored": policy.vendored_path,
        "example": policy.example_path,
    }
    return case_of(path_context(rule_id, path, policy), table, policy.application_path)


def grade(score: Column, policy: RiskPolicy = POLICY) -> Column:
    out = F.when(score.isNull(), F.lit(None).cast("string"))
    for limit, letter in policy.grades:
        out = out.when(score < limit, F.lit(letter))
    return out.otherwise(F.lit(policy.last_grade))


def is_credential(cwe_id: Column) -> Column:
    return F.coalesce(cwe_id == dims.CREDENTIAL_CWE, F.lit(False))


def retrieval_query_text(title: Column, message: Column, cwe: Column, owasp: Column, path: Column) -> Column:
    """What is asked of the knowledge base: facts about the finding, never its code."""
    from riskweave.functions.paths import finding_language

    language = finding_language(path)
    parts = [title, message, cwe, owasp, F.when(language.isNotNull(), F.concat(F.lit("in "), language))]
    return F.concat_ws(" ", *[F.nullif(part, F.lit("")) for part in parts])
