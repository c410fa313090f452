"""Answer keys, recorded outcomes and recorded results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.functions import text

# --- fixed values: what a usable row looks like, and the size of a key file ---
NAME = r"^[A-Za-z][A-Za-z0-9_]{0,99}$"
CATEGORY = r"^[a-z][a-z0-9_-]{0,39}$"
CWE = r"^[0-9]{1,6}$"
VERSION = r"Benchmark version:\s*([0-9][0-9A-Za-z.]{0,19})"
MAX_KEY_BYTES = 5 * 1024 * 1024


def key_lines(spark: SparkSession, path: str) -> DataFrame:
    """Numbered lines of one key file.  A key file is at most 5 MB, which is checked."""
    raw = spark.read.text(path, wholetext=True).withColumnRenamed("value", "text")
    checked = raw.select(
        F.when(
            F.octet_length("text") > MAX_KEY_BYTES, F.raise_error(F.lit("the answer key is too large"))
        ).otherwise(F.regexp_replace("text", "^\ufeff", "")).alias("text")
    )
    return checked.select(F.posexplode(text.split_lines(F.col("text"))).alias("pos", "line")).select(
        (F.col("pos") + 1).alias("line_no"), "line"
    )


def key_version(lines: DataFrame) -> DataFrame:
    found = F.nullif(F.regexp_extract("line", VERSION, 1), F.lit(""))
    return lines.filter(F.ltrim("line").startswith("#")).agg(
        F.min_by(found, F.when(found.isNotNull(), F.col("line_no"))).alias("version")
    )


def parse_answer_key(lines: DataFrame) -> DataFrame:
    """``cases(line_no, name, category, vulnerable, cwe, reason)``; ``reason`` is NULL when usable."""
    fields = F.transform(F.split("line", ","), lambda x: F.trim(x))
    rows = lines.filter((F.regexp_replace("line", "[,\\s]", "") != "") & ~F.ltrim("line").startswith("#"))
    rows = rows.select(
        "line_no",
        F.get(fields, 0).alias("name"), F.get(fields, 1).alias("category"),
        F.lower(F.get(fields, 2)).alias("truth"), F.get(fields, 3).alias("number"),
    )
    first_use = rows.groupBy("name").agg(F.min("line_no").alias("first_line"))
    rows = rows.join(first_use, "name")
    reason = (
        F.when(F.col("number").isNull(), "fewer than four fields")
        .when(~F.col("name").rlike(NAME), "unusable test name")
        .when(~F.col("category").rlike(CATEGORY), "unusable category")
        .when(~F.col("truth").isin("true", "false"), "answer is not true or false")
        .when(~F.col("number").rlike(CWE), "unusable CWE number")
        .when(F.col("line_no") > F.col("first_line"), "repeats an earlier test name")
    )
    return rows.select(
        "line_no", "name", "category", (F.col("truth") == "true").alias("vulnerable"),
        F.col("number").try_cast("int").alias("cwe"), reason.alias("reason"),
    )


def read_answer_key(spark: SparkSession, path: str) -> DataFrame:
    return parse_answer_key(key_lines(spark, path))


def usable_outcomes(rows: DataFrame) -> DataFrame:
    """``(name, reported, reason)`` of an earlier run; a repeated name is never usable."""
    named = rows.select(
        F.trim("name").alias("name"), F.lower(F.trim("reported")).alias("reported")
    )
    counts = named.groupBy("name").agg(
        F.count("*").alias("copies"), F.min("reported").alias("reported"),
    )
    reason = (
        F.when(~F.coalesce(F.col("name").rlike(NAME), F.lit(False)), "unusable test name")
        .when(F.col("copies") > 1, "repeated test name")
        .when(~F.coalesce(F.col("reported").isin("yes", "no"), F.lit(False)), "reported is not yes or no")
    )
    return counts.select("name", (F.col("reported") == "yes").alias("reported"), reason.alias("reason"))


def read_outcomes(spark: SparkSession, path: str) -> DataFrame:
    """Outcomes of an earlier run from the CSV that ``export_case_csv`` writes."""
    return usable_outcomes(spark.read.option("header", True).csv(path).select("name", "reported"))


def recorded_result_diff(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """Categories whose four counts differ between a recorded run and this one."""
    was, now = recorded.alias("was"), current.alias("now")
    counts = ("tp", "fn", "fp", "tn")
    same = F.lit(True)
    for name in counts:
        same = same & F.col(f"was.{name}").eqNullSafe(F.col(f"now.{name}"))

    def shown(side: str):
        return F.concat_ws("/", *[F.col(f"{side}.{name}").cast("string") for name in counts])

    joined = was.join(now, F.col("was.category") == F.col("now.category"), "full_outer")
    message = (
        F.when(F.col("was.category").isNull(), "not in the recorded results")
        .when(F.col("now.category").isNull(), "recorded, and not in this run")
        .otherwise(F.concat(F.lit("recorded TP/FN/FP/TN "), shown("was"), F.lit(", now "), shown("now")))
    )
    return joined.filter(~same | F.col("was.category").isNull() | F.col("now.category").isNull()).select(
        F.coalesce("was.category", "now.category").alias("category"), message.alias("difference")
    )
