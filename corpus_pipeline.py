"""The training-data pipeline: documents in, packed token sequences out.

Every stage is ``(spark, docs, sf_dir) -> DataFrame``; ``run`` writes each result and reads it again as the next stage's
documents.  All but the last return the columns of the documents.  Stages work on all rows they are given, whatever
the number: nothing is sampled but the labelled rows the classifier is fitted on (``quality_fm.TRAIN_ROWS``).

Defined results: rows with null text fail the quality rules and go; of rows that are near duplicates one
stays, also where they share an id or have none; an empty table passes through every stage; columns besides those of ``documents`` are kept.

Whole texts go to Python few at a time (``few_at_a_time``): an executor holds a batch of every task twice, and what was once
taken for one is not given back.  No result depends on it.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweave.llm import bbit_minhash, mixing_flow, packing_mbs, quality_fm, quality_ledger
from riskweave.llm.id_filter import may_be_one_of
from riskweave.session import materialise

#: Near duplicates of the pipeline: words of a shingle, and similarity in percent.
SHINGLE, PERCENT = 5, 80

#: Rows and bytes of a batch that goes to a Python worker, at most.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1024, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def few_at_a_time(spark: SparkSession) -> None:
    """Batches of at most ``BATCH``, for this session from now on: a stage is run after it has returned.  Smaller settings stay."""
    size = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for key, most in BATCH.items():
        now = spark.conf.get(key)
        # None or less is no bound; a size may have a unit.
        if now.startswith("-") or not 0 < size(now) <= most:
            spark.conf.set(key, str(most))



def _carried(docs: DataFrame) -> DataFrame:
    """Rows as one column, so that no column of theirs clashes with a computed one."""
    return docs.select(F.struct(*docs.columns).alias("_row"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the current policy of the rule ledger."""
    few_at_a_time(spark)
    judged = quality_ledger.ledger(_carried(docs).select("_row", F.col("_row.text").alias("text")))
    return judged.filter(quality_ledger.passes(quality_ledger.CURRENT)).select("_row.*")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine predicts to be good."""
    few_at_a_time(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    machine = quality_fm.learn(docs, labels)
    score = quality_fm.scorer(machine)(F.col("text"), F.col("n_chars").cast("double"))
    # Where nothing could be learnt, nothing is rejected.
    return docs.filter(score >= quality_fm.THRESHOLD) if machine else docs


def _numbered(docs: DataFrame) -> DataFrame:
    """``_number, _row``: rows known by their file and their place in it, the same in every scan.

    A frame that is not read from files is written first, so that it has them.
    """
    try:
        file = docs.metadataColumn("_metadata").alias("_file")
        rows = docs.select(F.struct(*docs.columns).alias("_row"), file).select("_row", "_file.file_path", "_file.row_index")
    except AnalysisException:
        return _numbered(materialise(docs))
    files = rows.select("file_path").distinct()
    # One row per file; the driver's list of files is no shorter.
    files = materialise(files.withColumn("file", F.row_number().over(Window.orderBy("file_path"))))
    number = F.shiftleft(F.col("file").cast("long"), 40) + F.col("row_index")
    return rows.join(files, "file_path").select(number.alias("_number"), "_row")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of near duplicates: one of least id, null last.

    Rows are numbered, and the numbers are what the operator knows them by, so rows that share an id or have none are
    told apart.  Whole rows are scanned, never copied; only those that may have to go are shuffled.
    """
    few_at_a_time(spark)
    numbered = _numbered(docs)
    found = bbit_minhash.near_duplicates(numbered.select(F.col("_number").alias("doc_id"), "_row.text"), SHINGLE, PERCENT)
    found = materialise(found.select(F.col("doc_id").alias("_number"), "component_id"))
    # Every join is by the number, so a group of many copies is never one key.
    named = found.join(numbered.select("_number", F.col("_row.doc_id").alias("id")), "_number")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "_number")
    least = named.groupBy("component_id").agg(F.min(order)["_number"].alias("_number")).select("_number")
    gone = materialise(found.select("_number").join(least, "_number", "left_anti"))
    may = may_be_one_of(gone.select(F.col("_number").alias("id")))(F.col("_number"))
    stays = numbered.filter(~may).unionByName(numbered.filter(may).join(gone, "_number", "left_anti"))
    return stays.select("_row.*")


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix uses it."""
    sizes = materialise(mixing_flow.sized(docs, F.array("source")))
    cuts, _ = mixing_flow.plan(sizes)
    marked = _carried(docs).select(
        "_row", F.col("_row.doc_id"), mixing_flow.pattern_of(F.array("_row.source")).alias("pattern"),
        F.xxhash64("_row.doc_id", F.lit(mixing_flow.SEED)).alias("hash"),
    )
    used = mixing_flow.copies(marked, cuts).filter("copies > 0")
    return used.select("_row", F.explode(F.expr("sequence(1L, copies)"))).select("_row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in the sequences."""
    few_at_a_time(spark)
    return packing_mbs.packing(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Learnt scores and tokenizer ids have no SQL form.
ORACLE_SQL = None
