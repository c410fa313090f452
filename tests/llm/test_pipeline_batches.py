"""The pipeline's stages hand whole texts to Python workers few at a time, and workers remember a bounded number of words."""

import corpus_pipeline
import pandas as pd
import pyarrow as pa
import pytest

from riskweave.llm import quality_fm, quality_ledger
from riskweave.llm.text import Hashes


@pytest.fixture
def default_batches(spark):
    """The session's batches as Spark has them, again as before afterwards."""
    before = {key: spark.conf.get(key) for key in corpus_pipeline.BATCH}
    for key in before:
        spark.conf.unset(key)
    yield spark
    for key, value in before.items():
        spark.conf.set(key, value)


def largest_batch(spark, text="'word'"):
    """Rows of the largest batch that a worker gets."""

    def rows(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    made = spark.range(0, 6000, numPartitions=1).selectExpr("id", f"{text} AS text").mapInArrow(rows, "n long")
    return max(row.n for row in made.collect())


def test_a_stage_leaves_batches_small(default_batches):
    spark = default_batches
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "doc_id long, text string")
    assert largest_batch(spark) == 6000
    assert corpus_pipeline.quality_rules(spark, docs, "").count() == 1
    assert largest_batch(spark) == 1024
    assert largest_batch(spark, "repeat('word ', 8000)") < 200


def test_smaller_batches_stay(default_batches):
    rows, size = corpus_pipeline.BATCH
    default_batches.conf.set(rows, "100")
    default_batches.conf.set(size, "1m")
    corpus_pipeline.few_at_a_time(default_batches)
    assert (default_batches.conf.get(rows), largest_batch(default_batches)) == ("100", 100)
    assert int(default_batches.conf.get(size).rstrip("bkm")) in (1, 1024, 1 << 20)


def test_no_bound_becomes_one(default_batches):
    default_batches.conf.set(next(iter(corpus_pipeline.BATCH)), "-1")
    corpus_pipeline.few_at_a_time(default_batches)
    assert largest_batch(default_batches) == 1024


def test_words_a_worker_remembers_are_bounded(monkeypatch):
    held = []

    class Watched(Hashes):
        def __init__(self):
            held.append(self)

    monkeypatch.setattr(quality_ledger, "Hashes", Watched)
    many = [" ".join(f"w{i}" for i in range(at, at + 50_000)) for at in range(0, 200_000, 50_000)]
    made = pd.concat(quality_ledger._measured(iter([pd.Series(many)])))
    assert made["n_words"].tolist() == [50_000] * 4 and made["n_repeat_words"].tolist() == [0] * 4
    assert len(held[0]) == 1 << 17
    buckets = quality_fm.Buckets()
    for text in many:
        quality_fm.features(text, None, buckets)
    assert len(buckets) == 1 << 17
