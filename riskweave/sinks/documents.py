"""Documents as ordered lines: the form in which every report format is written.

A document is rows ``(repository_id, section, k1..k5, line)``.  Concatenating the lines in that
order gives the document, so a repository of any size can be written by many tasks; no row ever
holds a whole report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER = ["repository_id", "section", "k1", "k2", "k3", "k4", "k5"]
_TYPES = {"k1": "double", "k2": "int", "k3": "string", "k4": "int", "k5": "bigint"}


def lines(rows: DataFrame, section: int | Column, line: Column, keys: list[Column] | None = None) -> DataFrame:
    keys = keys or []
    columns = []
    for i, (name, kind) in enumerate(_TYPES.items()):
        value = keys[i] if i < len(keys) else F.lit(None)
        columns.append(value.cast(kind).alias(name))
    return rows.select("repository_id", F.lit(section).alias("section"), *columns, line.alias("line"))


def union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def write_documents(document: DataFrame, path: str, partitions: int | None = None) -> None:
    """One folder per repository; its part files, in name order, are the document."""
    spread = document.repartitionByRange(*([partitions] if partitions else []), *ORDER)
    spread.sortWithinPartitions(*ORDER).select("repository_id", "line").write.mode("overwrite").partitionBy(
        "repository_id"
    ).text(path)
