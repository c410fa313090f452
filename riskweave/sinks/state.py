"""The findings state on disk: whole buckets of repositories, one folder per epoch.

A merge reads the newest epoch of the buckets it touches and writes those buckets again under its
own epoch.  Nothing is overwritten while it is read, and repeating an epoch gives the same files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 256


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.exists(target)


def bucket_of(repository_id, buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(repository_id), F.lit(buckets)).cast("int")


def read_state(spark: SparkSession, path: str, before_epoch: int | None = None, table: str = "state") -> DataFrame | None:
    """The current rows: for every bucket, its newest epoch below ``before_epoch``."""
    root = f"{path.rstrip('/')}/{table}"
    if not _exists(spark, root):
        return None
    rows = spark.read.parquet(root)
    if before_epoch is not None:
        rows = rows.filter(F.col("epoch") < before_epoch)
    if table != "state":
        return rows.drop("epoch", "bucket")
    newest = rows.groupBy("bucket").agg(F.max("epoch").alias("epoch"))
    return rows.join(F.broadcast(newest), ["bucket", "epoch"], "left_semi").drop("epoch", "bucket")


def write_findings_state(
    state: DataFrame, path: str, epoch: int, buckets: int = BUCKETS, table: str = "state"
) -> None:
    """Write the full new state of the touched buckets under ``epoch`` (repeatable)."""
    placed = state.withColumn("epoch", F.lit(epoch)).withColumn("bucket", bucket_of(F.col("repository_id"), buckets))
    # Salted by fingerprint as well as bucket: one large repository is written by many tasks.
    salted = placed.repartition("bucket", F.pmod(F.xxhash64(*[c for c in ("fingerprint", "scan_id") if c in state.columns]), F.lit(8)))
    (
        salted.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("epoch", "bucket").parquet(f"{path.rstrip('/')}/{table}")
    )


def _epochs(spark: SparkSession, root: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(root)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [status.getPath().getName() for status in system.listStatus(target)] if system.exists(target) else []
    return sorted(int(name.partition("=")[2]) for name in names if name.startswith("epoch="))


def read_held(spark: SparkSession, path: str, before_epoch: int) -> DataFrame | None:
    """What the newest epoch below ``before_epoch`` held back."""
    root = f"{path.rstrip('/')}/held"
    earlier = [epoch for epoch in _epochs(spark, root) if epoch < before_epoch]
    return spark.read.parquet(f"{root}/epoch={earlier[-1]}") if earlier else None


def write_held(rows: DataFrame, path: str, epoch: int) -> None:
    """All rows held back after ``epoch`` (repeatable); what no repetition can read any more is deleted."""
    spark, root = rows.sparkSession, f"{path.rstrip('/')}/held"
    rows.write.mode("overwrite").parquet(f"{root}/epoch={epoch}")
    earlier = [e for e in _epochs(spark, root) if e < epoch]
    for old in earlier[:-1]:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/epoch={old}")
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def state_counts(state: DataFrame) -> DataFrame:
    """The row of counts a merge returns."""
    return state.agg(
        F.count("*").alias("rows"), F.count_if(F.col("status") == "NEW").alias("new"),
        F.count_if(F.col("status") == "OPEN").alias("open"), F.count_if(F.col("status") == "FIXED").alias("fixed"),
        F.count_if("is_regression").alias("regressions"),
    )
