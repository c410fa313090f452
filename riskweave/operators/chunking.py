"""Passages: documents cut on natural boundaries, each under a budget of characters.

Packing is greedy and sequential, so it is a fold over the pieces of one section; nothing leaves
the JVM and every section is processed whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave import dims
from riskweave.functions.text import collapse

SENTENCE_BREAK = r"(?<=[.!?])\s+(?=[A-Z0-9])"
DASH = " — "


def _pack(parts: Column, separator: str, limit: Column) -> Column:
    """Join neighbouring parts while the result stays within the limit."""
    shape = "struct<done: array<string>, current: string>"
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("current")).cast(shape)

    def step(acc: Column, part: Column) -> Column:
        fits = F.length(acc["current"]) + len(separator) + F.length(part) <= limit
        empty = acc["current"] == ""
        return F.struct(
            F.when(empty | fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["current"]))).alias("done"),
            F.when(empty | ~fits, part).otherwise(F.concat(acc["current"], F.lit(separator), part)).alias("current"),
        ).cast(shape)

    def finish(acc: Column) -> Column:
        return F.when(acc["current"] == "", acc["done"]).otherwise(
            F.concat(acc["done"], F.array(acc["current"]))
        )

    return F.aggregate(parts, start, step, finish)


def _cut(word: Column, limit: Column) -> Column:
    """A single word longer than the limit, in slices."""
    last = F.floor((F.length(word) - 1) / limit).cast("int")
    slices = F.transform(
        F.sequence(F.lit(0), last), lambda i: F.substring(word, (i * limit + 1).cast("int"), limit)
    )
    return F.when(F.length(word) <= limit, F.array(word)).otherwise(slices)


def split_text(text: Column, limit: Column) -> Column:
    """Paragraphs, then sentences, then words, packed up to ``limit`` characters."""

    def wrap(sentence: Column) -> Column:
        words = F.flatten(F.transform(F.split(sentence, " "), lambda w: _cut(w, limit)))
        return F.when(F.length(sentence) <= limit, F.array(sentence)).otherwise(_pack(words, " ", limit))

    def fit(paragraph: Column) -> Column:
        sentences = F.flatten(F.transform(F.split(paragraph, SENTENCE_BREAK), wrap))
        return F.when(F.length(paragraph) <= limit, F.array(paragraph)).otherwise(_pack(sentences, " ", limit))

    paragraphs = F.filter(F.split(collapse(text), "\n\n"), lambda p: p != "")
    return _pack(F.flatten(F.transform(paragraphs, fit)), "\n\n", limit)


def chunk_documents(documents: DataFrame, max_chars: int = dims.MAX_CHUNK_CHARS) -> DataFrame:
    """One row per passage: ``(.., ordinal, section, text)``, the heading inside the budget.

    A document is one row in and its passages are exploded out of it: nothing is shuffled.
    """
    kept = [c for c in documents.columns if c not in ("sections", "title")]

    def passages(section: Column) -> Column:
        heading = F.concat("title", F.lit(DASH), section["name"])
        budget = F.greatest(F.lit(dims.MIN_TEXT_BUDGET), F.lit(max_chars) - F.length(heading) - 1)
        return F.transform(
            split_text(section["text"], budget),
            lambda p: F.struct(
                section["name"].alias("section"), F.concat(heading, F.lit("\n"), p).alias("text")
            ),
        )

    flat = F.flatten(F.transform("sections", passages))
    return documents.select(*kept, F.posexplode(flat).alias("ordinal", "c")).select(*kept, "ordinal", "c.*")


def drop_empty_sections(documents: DataFrame) -> DataFrame:
    from riskweave.sources.knowledge import non_empty_sections

    return documents.withColumn("sections", non_empty_sections(F.col("sections")))


def incremental_build_plan(
    incoming: DataFrame, stored: DataFrame, chunks: DataFrame | None = None, model: str | None = None
) -> DataFrame:
    """``action`` per incoming document: new, changed, model_changed or unchanged.

    Documents that left the source are not listed: they are kept as they are.
    """
    keys = ["source", "external_id"]
    joined = incoming.join(
        stored.select(*keys, F.col("content_hash").alias("stored_hash"), F.lit(True).alias("stored")), keys, "left"
    )
    stale = F.lit(False)
    if chunks is not None:
        old = chunks.filter(~F.col("embedding_model").eqNullSafe(F.lit(model))).select(*keys).distinct()
        joined = joined.join(old.withColumn("stale", F.lit(True)), keys, "left")
        stale = F.coalesce("stale", F.lit(False))
    action = (
        F.when(F.col("stored").isNull(), "new")
        .when(~F.col("content_hash").eqNullSafe(F.col("stored_hash")), "changed")
        .when(stale, "model_changed").otherwise("unchanged")
    )
    return joined.select(*keys, "content_hash", action.alias("action"))
