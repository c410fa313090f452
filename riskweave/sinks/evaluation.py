"""Evaluation results as tables: cases as CSV, rates as rows, JSON and Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions.hashing import DEFAULT_SPLIT_SALT, split_half
from riskweave.operators import evaluation

RATES = ("recall", "false_positive_rate", "precision", "accuracy", "f1", "score")


def _yes(value: Column) -> Column:
    return F.when(value, "yes").otherwise("no")


def export_case_csv(verdicts: DataFrame, salt: str = DEFAULT_SPLIT_SALT) -> DataFrame:
    """Every case with its verdict, the rules that answered and its half, sorted by name."""
    return verdicts.select(
        "name", "category", "cwe", _yes(F.col("vulnerable")).alias("vulnerable"),
        _yes(F.col("reported")).alias("reported"), "verdict", F.array_join("rules", " ").alias("rules"),
        split_half(F.col("name"), salt).alias("split"),
    ).orderBy("name")


def write_case_csv(verdicts: DataFrame, path: str) -> None:
    export_case_csv(verdicts).write.mode("overwrite").option("header", True).csv(path)


def export_evaluation(confusion: DataFrame) -> DataFrame:
    """Per category: counts, rates to four decimals, intervals and the guessing verdict.

    There is no clock in it, so a changed file means a changed result.
    """
    rated = evaluation.intervals(evaluation.detector_rates(confusion))
    verdict = evaluation.guessing_verdict(F.col("has_rule"), F.col("score_low"), F.col("score_high"))
    return rated.select(
        "category", "cwe", "has_rule", *evaluation.COUNTS,
        *[F.bround(name, 4).alias(name) for name in RATES],
        F.bround("score_low", 4).alias("score_low"), F.bround("score_high", 4).alias("score_high"),
        verdict.alias("reading"),
    ).orderBy("category")


def evaluation_json(confusion: DataFrame) -> DataFrame:
    rows = export_evaluation(confusion)
    return rows.select("category", F.to_json(F.struct(*rows.columns)).alias("json"))


def _percent(value: Column) -> Column:
    return F.coalesce(F.format_string("%.1f %%", value * 100), F.lit("–"))


def evaluation_markdown(confusion: DataFrame) -> DataFrame:
    """One Markdown table row per category."""
    rows = export_evaluation(confusion)
    points = F.coalesce(F.format_string("%+.1f", F.col("score") * 100), F.lit("–"))
    cells = F.concat_ws(
        " | ", "category", *[F.col(c).cast("string") for c in evaluation.COUNTS], _percent(F.col("recall")),
        _percent(F.col("false_positive_rate")), points, "reading",
    )
    return rows.select("category", F.concat(F.lit("| "), cells, F.lit(" |")).alias("line"))
