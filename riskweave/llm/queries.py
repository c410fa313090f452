"""The registered queries of this subpackage and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskweave.llm import (
    audit_dp,
    bbit_minhash,
    block_knn,
    chat_snapshots,
    language_id,
    mixing_flow,
    ngram_trie,
    packing_mbs,
    quality_fm,
    quality_ledger,
    size_aware_join,
    url_filters,
    word_runs,
)


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return url_filters.judge(_read(spark, folder, "pages"), url_filters.rule_table(spark))


def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.language_id(_read(spark, folder, "documents"))


def op3_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality_fm.quality_classifier(_read(spark, folder, "documents"), _read(spark, folder, "labels"))


def op4_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    return chat_snapshots.chat_documents(_read(spark, folder, "conversations"))


def op5_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_trie.score(_read(spark, folder, "documents"))


def op6_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return block_knn.nearest(_read(spark, folder, "embeddings"))


def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_ledger.quality_ledger(_read(spark, folder, "documents"))


def op8_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing_flow.mixing(_read(spark, folder, "documents"))


def op9_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return bbit_minhash.near_dedup(_read(spark, folder, "documents"))


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing_mbs.packing(_read(spark, folder, "documents"))


def op11_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return size_aware_join.jaccard_join(_read(spark, folder, "documents"))


def op12_period_runs(spark: SparkSession, folder: str) -> DataFrame:
    return word_runs.period_runs(_read(spark, folder, "documents"))


def op13_structure_repair(spark: SparkSession, folder: str) -> DataFrame:
    return audit_dp.structure_repair(_read(spark, folder, "conversations"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_url_filters, op2_language_id, op3_quality_classifier, op4_chat_formatting,
        op5_lm_scoring, op6_nearest_neighbours, op7_quality_rules, op8_source_mixing, op9_near_dedup, op10_packing,
        op11_jaccard_join, op12_period_runs, op13_structure_repair, pipeline,
    )
}
SQL: dict[str, str] = {
    "op1_url_filters": url_filters.SQL,
    "op4_chat_formatting": chat_snapshots.SQL,
    "op6_nearest_neighbours": block_knn.SQL,
    "op7_quality_rules": quality_ledger.SQL,
    "op9_near_dedup": bbit_minhash.SQL,
    "op11_jaccard_join": size_aware_join.SQL,
    "op12_period_runs": word_runs.SQL,
    "op13_structure_repair": audit_dp.SQL,
}
