"""Fingerprints out of an earlier run's SARIF files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.sinks.sarif import FINGERPRINT_KEY

SCHEMA = (
    "runs array<struct<results: array<struct<ruleId: string, partialFingerprints: map<string, string>>>>>"
)


def read_sarif_fingerprints(
    spark: SparkSession, path: str, key: str = FINGERPRINT_KEY, multiline: bool = True
) -> DataFrame:
    """Distinct ``fingerprint`` values.  A file that is not a SARIF log is an error, never empty."""
    logs = (
        spark.read.schema(SCHEMA).option("multiLine", multiline).option("mode", "FAILFAST").json(path)
    )
    runs = F.when(F.col("runs").isNull(), F.raise_error(F.lit("not a SARIF log: it has no runs"))).otherwise(
        F.col("runs")
    )
    values = (
        logs.select(F.explode(runs).alias("run"))
        .select(F.explode("run.results").alias("result"))
        .select(F.element_at("result.partialFingerprints", key).alias("fingerprint"))
    )
    return values.filter("fingerprint is not null and fingerprint <> ''").distinct()
