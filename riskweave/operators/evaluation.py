"""Evaluation against an answer key: verdicts, confusion tables, intervals, paired tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave import dims
from riskweave.functions import stats

COUNTS = ("tp", "fp", "tn", "fn")
# An answer set up to this many lines is hashed as one sorted text; above it as a tree.


def rule_suffixes(spark: SparkSession) -> DataFrame:
    """``(rule_id, category, suffix)``: what each rule reads; suffix NULL means every text file."""
    rows = [
        (rule_id, category, suffix)
        for (rule_id, *_rest, category, _message) in dims.rule_rows()
        for (other, suffix) in dims.rule_suffix_rows()
        if other == rule_id and category is not None
    ]
    return spark.createDataFrame(rows, "rule_id string, category string, suffix string")


def rules_for_category(categories: DataFrame, suffixes: DataFrame) -> DataFrame:
    """Rules able to report each category in files with the suffixes present; empty when none."""
    table = F.broadcast(rule_suffixes(categories.sparkSession))
    present = suffixes.select("suffix").distinct()
    able = table.join(present, "suffix").unionByName(table.filter("suffix is null").select("suffix", "rule_id", "category"))
    per = able.groupBy("category").agg(F.array_sort(F.collect_set("rule_id")).alias("rules"))
    return categories.select("category").distinct().join(per, "category", "left").select(
        "category", F.coalesce("rules", F.array().cast("array<string>")).alias("rules")
    )


def answering_rules(cases: DataFrame, findings: DataFrame, rules: DataFrame) -> DataFrame:
    """``(name, rules)``: rules of the case's own category that fired in its file."""
    tagged = findings.join(
        F.broadcast(rules.filter("category is not null").select("rule_id", "category")), "rule_id"
    )
    own = tagged.join(cases.select("name", "category"), ["name", "category"])
    return own.groupBy("name").agg(F.array_sort(F.collect_set("rule_id")).alias("rules"))


def verdict(vulnerable: Column, reported: Column) -> Column:
    return (
        F.when(vulnerable & reported, "TP").when(vulnerable, "FN").when(reported, "FP").otherwise("TN")
    )


def case_verdicts(cases: DataFrame, findings: DataFrame, rules: DataFrame) -> DataFrame:
    """``(name, category, cwe, vulnerable, rules, reported, verdict)`` for every case."""
    joined = cases.join(answering_rules(cases, findings, rules), "name", "left").withColumn(
        "rules", F.coalesce("rules", F.array().cast("array<string>"))
    )
    reported = F.size("rules") > 0
    return joined.withColumn("reported", reported).withColumn(
        "verdict", verdict(F.col("vulnerable"), F.col("reported"))
    )


def confusion_by_category(verdicts: DataFrame, able: DataFrame | None = None) -> DataFrame:
    per = verdicts.groupBy("category").agg(
        F.min("cwe").alias("cwe"),
        *[F.count_if(F.col("verdict") == name.upper()).alias(name) for name in COUNTS],
    )
    if able is None:
        return per.withColumn("has_rule", F.lit(True))
    return per.join(able, "category", "left").withColumn(
        "has_rule", F.coalesce(F.size("rules") > 0, F.lit(False))
    ).drop("rules")


def detector_rates(confusion: DataFrame) -> DataFrame:
    named = stats.rates(*[F.col(c) for c in COUNTS])
    return confusion.select("*", *[value.alias(name) for name, value in named.items()])


def intervals(confusion: DataFrame) -> DataFrame:
    tp, fp, tn, fn = (F.col(c) for c in COUNTS)
    recall_low, recall_high = stats.wilson(tp, tp + fn)
    rate_low, rate_high = stats.wilson(fp, fp + tn)
    precision_low, precision_high = stats.wilson(tp, tp + fp)
    score_low, score_high = stats.newcombe(tp, fp, tn, fn)
    return confusion.select(
        "*", recall_low.alias("recall_low"), recall_high.alias("recall_high"),
        rate_low.alias("rate_low"), rate_high.alias("rate_high"),
        precision_low.alias("precision_low"), precision_high.alias("precision_high"),
        score_low.alias("score_low"), score_high.alias("score_high"),
    )


def guessing_verdict(has_rule: Column, low: Column, high: Column) -> Column:
    return (
        F.when(~has_rule, "no rule").when(low.isNull(), "–")
        .when(low > 0, "better than guessing").when(high < 0, "worse than guessing")
        .otherwise("not distinguishable from guessing")
    )


def pooled_and_macro(confusion: DataFrame) -> DataFrame:
    """Pooled counts and per-category averages: over all categories, and those with a rule."""
    rated = detector_rates(confusion)

    def block(rows: DataFrame, scope: str) -> DataFrame:
        return rows.agg(
            F.lit(scope).alias("scope"), F.count("*").alias("categories"),
            *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS],
            F.avg("recall").alias("recall"), F.avg("false_positive_rate").alias("false_positive_rate"),
            F.avg("score").alias("score"),
        )

    return block(rated, "all categories").unionByName(
        block(rated.filter("has_rule"), "categories with a rule")
    )


def unscored_findings(cases: DataFrame, findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings the answer key has no opinion about: by rule in cases, and all those outside."""
    tagged = findings.join(F.broadcast(rules.select("rule_id", F.col("category").alias("kind"))), "rule_id", "left")
    joined = tagged.join(cases.select("name", "category"), "name", "left")
    inside = joined.filter("category is not null and not (kind <=> category)").groupBy("rule_id").agg(
        F.count("*").alias("findings")
    )
    outside = joined.filter("category is null").agg(F.count("*").alias("findings"))
    return inside.select(F.lit("in cases").alias("place"), "rule_id", "findings").unionByName(
        outside.select(F.lit("outside cases").alias("place"), F.lit(None).cast("string").alias("rule_id"), "findings")
    )


def compare_runs(earlier: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row: cases, broken, fixed, net, the paired p-value, and cases the earlier run lacks.

    ``missing`` above zero means the runs cannot be compared; the p-value is then NULL.
    """
    joined = verdicts.join(earlier.select("name", F.col("reported").alias("was")), "name", "left")
    right = F.col("reported") == F.col("vulnerable")
    was_right = F.col("was") == F.col("vulnerable")
    counted = joined.agg(
        F.count("*").alias("cases"),
        F.count_if(was_right & ~right).alias("broken"),
        F.count_if(right & ~was_right).alias("fixed"),
        F.count_if(F.col("was").isNull()).alias("missing"),
    )
    p = F.when(F.col("missing") == 0, stats.mcnemar_exact(F.col("broken"), F.col("fixed")))
    return counted.withColumn("net", F.col("fixed") - F.col("broken")).withColumn("p_value", p)


def outcomes_hash(verdicts: DataFrame) -> DataFrame:
    """One hash that changes if any single case is judged differently, built alike at every size.

    The sorted ``name,reported`` lines of each of 65,536 buckets (by SHA-256 of the name) are hashed, the
    hashes of each of 256 groups of buckets are hashed, and so are theirs: no task holds more than a bucket.
    """
    line = F.concat("name", F.lit(","), F.col("reported").cast("int").cast("string"))
    tree = verdicts.select(F.substring(F.sha2("name", 256), 1, 4).alias("at"), line.alias("leaf"), F.lit(1).cast("long").alias("n"))
    for digits in (4, 2, 0):
        joined = F.array_join(F.array_sort(F.collect_list("leaf")), "\n")
        tree = tree.groupBy(F.substring("at", 1, digits).alias("at")).agg(F.sum("n").alias("n"), F.sha2(joined, 256).alias("leaf"))
    return tree.select(F.col("n").alias("cases"), F.col("leaf").alias("outcomes_sha256"))


def outcomes_hash_flat(verdicts: DataFrame) -> DataFrame:
    """SHA-256 of all sorted ``name,reported`` lines, for answer keys that one task can hold."""
    line = F.concat("name", F.lit(","), F.col("reported").cast("int").cast("string"))
    joined = F.array_join(F.array_sort(F.collect_list(line)), "\n")
    return verdicts.agg(F.count("*").alias("cases"), F.sha2(joined, 256).alias("outcomes_sha256"))


def evaluation_guards(cases: DataFrame, files: DataFrame, unparsable: DataFrame, truncated: DataFrame) -> DataFrame:
    """``(problem, subject)``: anything here means nothing may be marked."""
    from riskweave.operators.joins import case_file_problems, case_files

    unread = case_file_problems(cases, files).select("problem", F.col("name").alias("subject"))
    repeated = cases.groupBy("name").agg(F.count("*").alias("n")).filter("n > 1").select(
        F.lit("case named twice").alias("problem"), F.col("name").alias("subject")
    )
    broken = case_files(cases, files).join(unparsable.select("path"), "path", "left_semi").select(
        F.lit("case file does not parse").alias("problem"), F.col("path").alias("subject")
    )
    cut = truncated.filter("truncated").select(
        F.lit("scan stopped at its limit").alias("problem"), F.col("repository_id").cast("string").alias("subject")
    )
    return unread.unionByName(repeated).unionByName(broken).unionByName(cut)
