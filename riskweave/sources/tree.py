"""Source trees: files, their text and their lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave import dims
from riskweave.functions import paths, text


def select_sources(files: DataFrame) -> DataFrame:
    """Keep the files an analysis would open, and add their suffix.

    Works on ``path`` alone, so a caller can apply it to a listing before any content is read.
    """
    return files.withColumn("ext", paths.suffix(F.col("path"))).filter(
        paths.is_source_candidate(F.col("path"))
    )


def scan_source_tree(spark: SparkSession, root: str, repository_id: int = 0) -> DataFrame:
    """``files(repository_id, path, ext, length, content)`` below ``root``.

    ``content`` is read only when a later step asks for it, so counting or listing stays cheap.
    """
    base = root.rstrip("/") + "/"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    relative = raw.select(
        F.lit(repository_id).cast("bigint").alias("repository_id"),
        F.regexp_replace(F.substring_index("path", base, -1), "%20", " ").alias("path"),
        "length",
        "content",
    )
    return select_sources(relative).select("repository_id", "path", "ext", "length", "content")


def decode_text(files: DataFrame, max_bytes: int = dims.MAX_FILE_BYTES) -> DataFrame:
    """Add ``text`` (NULL for what must not be analysed) and ``skipped`` (the reason, or NULL)."""
    head = F.substring(F.col("content"), 1, dims.BINARY_SNIFF_BYTES)
    as_text = F.col("content").cast("string")
    reason = F.when(F.col("length") > max_bytes, "too large").when(
        F.contains(head, F.lit(b"\x00")), "binary"
    )
    decoded = F.when(F.is_valid_utf8(as_text), as_text).otherwise(
        F.decode(F.col("content"), "ISO-8859-1")
    )
    return (
        files.withColumn("skipped", reason)
        .withColumn("text", F.when(F.col("skipped").isNull(), decoded))
        .drop("content")
    )


def explode_lines(files: DataFrame, column: str = "text") -> DataFrame:
    """``lines(.., line_no, line)`` with 1-based numbers; no shuffle, a file is one row."""
    kept = [F.col(c) for c in files.columns if c != column]
    return files.filter(F.col(column).isNotNull()).select(
        *kept, F.posexplode(text.split_lines(F.col(column))).alias("pos", "line")
    ).withColumn("line_no", F.col("pos") + 1).drop("pos")


def scan_counters(files: DataFrame, findings: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Per repository: files read, files skipped, files that do not parse, findings."""
    per_file = files.groupBy("repository_id").agg(
        F.count_if(F.col("skipped").isNull()).alias("files_scanned"),
        F.count_if(F.col("skipped").isNotNull()).alias("files_skipped"),
    )
    out = per_file.join(
        findings.groupBy("repository_id").agg(F.count("*").alias("total_findings")), "repository_id", "left"
    )
    if facts is None:
        out = out.withColumn("unparsable_files", F.lit(0).cast("bigint"))
    else:
        bad = facts.filter("fact = 'unparsable'").groupBy("repository_id").agg(
            F.count("*").alias("unparsable_files")
        )
        out = out.join(bad, "repository_id", "left")
    return out.select(
        "repository_id", "files_scanned", "files_skipped",
        F.coalesce("unparsable_files", F.lit(0)).alias("unparsable_files"),
        F.coalesce("total_findings", F.lit(0)).alias("total_findings"),
    )


def language_breakdown(files: DataFrame, size: str = "length") -> DataFrame:
    """Bytes per language and repository."""
    return files.groupBy(
        "repository_id", paths.classify_language(F.col("path")).alias("language")
    ).agg(F.sum(size).alias("bytes"), F.count("*").alias("files"))


def language_map(breakdown: DataFrame) -> DataFrame:
    """The breakdown as one map per repository (a few dozen languages at most)."""
    return breakdown.groupBy("repository_id").agg(
        F.map_from_entries(F.collect_list(F.struct("language", "bytes"))).alias("language_breakdown"),
        F.sum("files").alias("file_count"),
        F.sum("bytes").alias("total_bytes"),
    )


def primary_language(breakdown: DataFrame) -> DataFrame:
    """Largest programming language by bytes; ties go to the later name; NULL when there is none."""
    programming = ~F.col("language").isin(*dims.NON_PRIMARY_LANGUAGES) & (F.col("bytes") > 0)
    return breakdown.groupBy("repository_id").agg(
        F.max_by(
            F.when(programming, F.col("language")),
            F.when(programming, F.struct("bytes", "language")),
        ).alias("primary_language")
    )


def language_shares(breakdown: DataFrame) -> DataFrame:
    """Percent of a repository's bytes per language."""
    totals = breakdown.groupBy("repository_id").agg(F.sum("bytes").alias("total"))
    return breakdown.join(totals, "repository_id").filter("total > 0").select(
        "repository_id", "language", "bytes",
        (F.col("bytes") / F.col("total") * 100).alias("percent"),
    )
