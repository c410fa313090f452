"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "riskweave", cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; on a cluster the submitter's own settings are used."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named in ``spark.checkpoint.dir``; make one only where it is unset locally."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        context.setCheckpointDir(configured)
        return
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="riskweave-checkpoint-"))


def materialise(frame: DataFrame, **options: str) -> DataFrame:
    """Write a frame to the shared folder once and read it back: lineage ends, nothing is redone.

    ``options`` go to the writer.  ``checkpoint()`` runs its last stage twice, which matters when that stage parses or scores.
    """
    spark = frame.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/riskweave-{uuid.uuid4().hex}"
    frame.write.options(**options).parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


#: Bytes of a scan up to which it may be dealt out again.
SMALL_SCAN = 256 << 20


def spread_small(scan: DataFrame) -> DataFrame:
    """Deal a scan of at most ``SMALL_SCAN`` bytes out over the cores; larger ones are returned as they are.

    A file with one row group is read by one task however many cores there are; work per row that
    is heavy (rules, parsing, packing) then runs on one core.  The size is the planner's own statistic, so
    no plan is started for it, and rows are the same either way.  Only for plain scans.
    """
    size = scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return scan.repartition(scan.sparkSession.sparkContext.defaultParallelism) if int(size) <= SMALL_SCAN else scan
