"""Audit of archive manifests: which entries or archives must be refused, and why."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave import dims

# --- fixed values: budgets and Unix file types ---
MAX_UNCOMPRESSED_BYTES = 500 * 1024 * 1024
MAX_COMPRESSION_RATIO = 100
MAX_FILES = 20_000
MAX_ENTRY_BYTES = 5 * 1024 * 1024
TYPE_MASK, SYMLINK, REGULAR, DIRECTORY = 0o170000, 0o120000, 0o100000, 0o040000


def audit_entries(entries: DataFrame) -> DataFrame:
    """Add ``problem`` (why the entry must not be extracted) and ``ignored`` per entry."""
    name = F.col("name")
    flat = F.replace(name, F.lit("\\"), F.lit("/"))
    parts = F.split(flat, "/")
    first = F.element_at(parts, 1)
    kind = F.col("unix_mode").bitwiseAND(F.lit(TYPE_MASK))
    problem = (
        F.when(name.startswith("/") | name.startswith("\\"), "absolute path")
        .when((F.length(first) == 2) & first.contains(":"), "drive path")
        .when(F.array_contains(parts, ".."), "escapes the folder")
        .when(kind == SYMLINK, "symbolic link")
        .when((kind != 0) & ~kind.isin(REGULAR, DIRECTORY), "special file")
        .when(F.col("file_size") > MAX_ENTRY_BYTES, "entry too large")
    )
    ignored = F.arrays_overlap(parts, F.array(*map(F.lit, dims.IGNORED_DIRECTORIES)))
    return entries.withColumn("problem", problem).withColumn("ignored", ignored).withColumn("top", first)


def audit_archives(
    entries: DataFrame,
    max_bytes: int = MAX_UNCOMPRESSED_BYTES,
    max_ratio: int = MAX_COMPRESSION_RATIO,
    max_files: int = MAX_FILES,
) -> DataFrame:
    """One verdict per archive: unsafe entries, size and ratio budgets, the wrapping folder."""
    flat = F.replace(F.col("name"), F.lit("\\"), F.lit("/"))
    named = F.trim("name") != ""
    top = F.when(named & (F.col("top") != ""), F.col("top"))
    per = audit_entries(entries).groupBy("archive_id").agg(
        F.count("*").alias("entries"),
        F.count_if(F.col("problem").isNotNull()).alias("unsafe_entries"),
        F.count_if("ignored").alias("ignored_entries"),
        F.sum("file_size").alias("declared_bytes"),
        F.greatest(F.sum("compressed_size"), F.lit(1)).alias("compressed_bytes"),
        F.min(top).alias("first_top"),
        F.max(top).alias("last_top"),
        F.bool_or(named & flat.contains("/")).alias("has_folder"),
    )
    wrapped = (F.col("first_top") == F.col("last_top")) & F.col("has_folder")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("unsafe_entries") > 0, "unsafe entry"),
            F.when(F.col("declared_bytes") > max_bytes, "too many bytes"),
            F.when(F.col("declared_bytes") / F.col("compressed_bytes") > max_ratio, "expands too much"),
            F.when(F.col("entries") > max_files, "too many files"),
        )
    )
    return per.select(
        "archive_id", "entries", "unsafe_entries", "ignored_entries", "declared_bytes",
        "compressed_bytes", F.when(wrapped, F.col("first_top")).alias("root_prefix"),
        F.array_join(reasons, "; ").alias("reasons"),
    )
