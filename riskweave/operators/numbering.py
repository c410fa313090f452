"""Numbering rows and running sums that do not put a whole group in one task.

Both work in two steps: totals per (group, bucket), which are few, give each bucket its starting
point; the rows are then numbered inside their own bucket.  ``bucket`` must rise with the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_rows(
    rows: DataFrame, group: list[str], bucket: Column, order: list, name: str = "position"
) -> DataFrame:
    """1-based ``name`` within ``group`` by ``order``, the same as ``row_number`` over the group."""
    tagged = rows.withColumn("_bucket", bucket)
    counts = tagged.groupBy(*group, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    keys = [*group, "_bucket"]
    same = F.lit(True)
    left, right = tagged.alias("l"), starts.alias("r")
    for key in keys:
        same = same & F.col(f"l.{key}").eqNullSafe(F.col(f"r.{key}"))
    joined = left.join(right, same).select("l.*", "r._start")
    inside = Window.partitionBy(*keys).orderBy(*order)
    return joined.withColumn(name, F.row_number().over(inside) + F.col("_start")).drop("_bucket", "_start")


def running_before(
    totals: DataFrame, group: list[str], bucket: Column, order: list, value: str, name: str
) -> DataFrame:
    """Sum of ``value`` over the rows of the group strictly before each row."""
    tagged = totals.withColumn("_bucket", bucket)
    sums = tagged.groupBy(*group, "_bucket").agg(F.sum(value).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    joined = tagged.join(starts, [*group, "_bucket"])
    inside = Window.partitionBy(*group, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.sum(value).over(inside), F.lit(0))
    return joined.withColumn(name, within + F.col("_start")).drop("_bucket", "_start")
