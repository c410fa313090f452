"""Which matches are the same issue: collapse, number, fingerprint, deduplicate, truncate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave import dims
from riskweave.functions.hashing import fingerprint
from riskweave.functions.paths import walk_order_key
from riskweave.functions.scoring import confidence_rank, severity_rank
from riskweave.functions.text import normalise_space
from riskweave.operators.numbering import number_rows

FILE = ["repository_id", "path"]


def collapse_overlapping(findings: DataFrame) -> DataFrame:
    """One finding per (file, line, CWE): the strongest claim wins, then the first seen.

    A minimum by aggregation rather than a window, so it is combined before the shuffle.
    ``seq`` orders findings of equal strength; findings without a CWE are never collapsed.
    """
    columns = findings.columns
    keyed = findings.filter("cwe_id is not null and cwe_id <> ''")
    strength = F.struct(
        severity_rank(F.col("severity")), confidence_rank(F.col("confidence")), F.col("seq")
    )
    best = keyed.groupBy(*FILE, "line_start", "cwe_id").agg(
        F.min_by(F.struct(*columns), strength).alias("f")
    )
    return best.select("f.*").unionByName(findings.filter("cwe_id is null or cwe_id = ''"))


def number_repeats(findings: DataFrame, bucket: Column | None = None) -> DataFrame:
    """``occurrence``: which repeat of an identical line this is, within one file.

    Numbered bucket by bucket (4,096 lines by default), so a file or a copied line that holds a
    large share of all findings is spread over tasks.
    """
    if bucket is None:
        bucket = F.floor(F.col("line_start") / 4096)
    numbered = number_rows(
        findings.withColumn("normalised", normalise_space(F.col("snippet"))),
        [*FILE, "rule_id", "normalised"], bucket, ["line_start", "seq"], "occurrence",
    )
    return numbered.withColumn("occurrence", F.col("occurrence") - 1).drop("normalised")


def with_fingerprints(findings: DataFrame) -> DataFrame:
    return findings.withColumn(
        "fingerprint",
        fingerprint(F.col("rule_id"), F.col("path"), F.col("snippet"), F.col("occurrence")),
    )


def dedupe_fingerprints(findings: DataFrame) -> DataFrame:
    """The first finding of each fingerprint, in the order a folder walk reads."""
    columns = findings.columns
    order = F.struct(walk_order_key(F.col("path")), F.col("line_start"), F.col("rule_id"), F.col("seq"))
    first = findings.groupBy("repository_id", "fingerprint").agg(
        F.min_by(F.struct(*columns), order).alias("f")
    )
    return first.select("f.*")


def truncate_findings(findings: DataFrame, cap: int = dims.MAX_FINDINGS) -> DataFrame:
    """The first ``cap`` findings of each repository in walk order, and whether there were more.

    The cap is the feature: a scan records at most that many.  ``row_number() <= cap`` is pushed
    below the shuffle, so a repository with a third of all rows sends ``cap`` rows per task.
    """
    order = Window.partitionBy("repository_id").orderBy(
        walk_order_key(F.col("path")), "line_start", "rule_id", "seq"
    )
    kept = findings.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= cap)
    totals = findings.groupBy("repository_id").agg((F.count("*") >= cap).alias("truncated"))
    return kept.join(totals, "repository_id")


def identify(matches: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Matches -> findings: catalogue attached, collapsed, numbered, fingerprinted, deduplicated."""
    order = F.xxhash64("rule_id", "line_start", "snippet")
    findings = matches.join(F.broadcast(catalogue), "rule_id").withColumn("seq", order)
    return dedupe_fingerprints(with_fingerprints(number_repeats(collapse_overlapping(findings))))


def identity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy(
        "repository_id", "rule_id", "path", normalise_space(F.col("snippet")).alias("code")
    ).agg(F.count("*").alias("n"), F.min("line_start").alias("line"))


def finding_identity_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Findings before and after a change by (rule, file, code), with multiplicity."""
    keys = ["repository_id", "rule_id", "path", "code"]
    was = identity_counts(before).select(*keys, F.col("n").alias("n_before"))
    now = identity_counts(after).select(*keys, F.col("n").alias("n_after"), "line")
    joined = was.join(now, keys, "full_outer").select(
        *keys, F.coalesce("n_before", F.lit(0)).alias("n_before"),
        F.coalesce("n_after", F.lit(0)).alias("n_after"), "line",
    )
    return joined.withColumn("gone", F.greatest(F.col("n_before") - F.col("n_after"), F.lit(0))).withColumn(
        "appeared", F.greatest(F.col("n_after") - F.col("n_before"), F.lit(0))
    )


def appeared_findings(before: DataFrame, after: DataFrame, listed: int = 5) -> DataFrame:
    """Per repository: identities that are new after a change, the first five named."""
    new = finding_identity_diff(before, after).filter("appeared > 0")
    order = Window.partitionBy("repository_id").orderBy("path", "line", "rule_id", "code")
    named = new.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= listed)
    names = named.groupBy("repository_id").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("position", "rule_id", "path"))),
                lambda x: F.concat(x["rule_id"], F.lit(" "), x["path"]),
            ),
            "; ",
        ).alias("first_new")
    )
    totals = new.groupBy("repository_id").agg(
        F.count("*").alias("new_identities"), F.sum("appeared").alias("new_findings")
    )
    return totals.join(names, "repository_id")
