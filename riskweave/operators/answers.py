"""Stored model answers: what may be shown, what was cleaned, what is refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions import text

# --- fixed values: limits and shapes ---
MAX_FIELD = 2000
MAX_CITATIONS = 12
MAX_REPLACEMENT = 8000
MAX_RATIONALE = 600
URL = r"(?i)\b(?:https?|ftp)://\S+"
INLINE = r"\[\s*\d+(?:\s*,\s*\d+)*\s*\]"
FENCE = r"(?s)^\s*```[a-zA-Z0-9_+-]*\s*\n(.*?)\n?\s*```\s*$"
GUTTER = r"^\s*\d+\s*\|\s?"
MARKER = r"^\s*(?:>{6}\s*REPLACE THESE LINES|<{6}\s*END OF LINES TO REPLACE).*$"
PREAMBLE = (
    r"(?i)^\s*(?:here(?:'s| is)[^\n]*|the (?:fixed|corrected|updated)[^\n]*|sure[^\n]*)[:.]\s*\n"
)
FIELDS = ("summary", "impact", "remediation")


def _field(raw: Column, name: str) -> Column:
    """A field as text: a string, a number, or a list of sentences joined by blanks."""
    value = F.get_json_object(raw, f"$.{name}")
    items = F.from_json(value, "array<string>")
    return F.when(value.startswith("["), F.array_join(items, " ")).otherwise(value)


def _count(value: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(value, F.lit(pattern), F.lit(0)))


def _clean(value: Column) -> Column:
    cleaned = text.sanitise_code(F.regexp_replace(value, URL, ""))
    cleaned = F.regexp_replace(F.regexp_replace(cleaned, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n")
    return text.strip(cleaned)


def _inline(value: Column, passages: Column) -> tuple[Column, Column]:
    """(text without marks to passages never given, how many numbers were dropped)."""
    mark = "\ue001"
    pieces = F.split(
        F.regexp_replace(F.replace(value, F.lit(mark), F.lit(" ")), "(" + INLINE + ")", mark + "$1" + mark), mark
    )

    def numbers(piece: Column) -> Column:
        return F.transform(F.regexp_extract_all(piece, F.lit(r"\d+"), F.lit(0)), lambda n: n.try_cast("bigint"))

    def good(piece: Column) -> Column:
        return F.filter(numbers(piece), lambda n: F.coalesce(n.between(1, passages), F.lit(False)))

    def rewritten(piece: Column, i: Column) -> Column:
        kept = good(piece)
        shown = F.concat(F.lit("["), F.array_join(F.transform(kept, lambda n: n.cast("string")), ", "), F.lit("]"))
        return F.when(i % 2 == 0, piece).when(F.size(kept) == 0, F.lit("")).otherwise(shown)

    bad = F.aggregate(
        F.transform(
            pieces, lambda p, i: F.when(i % 2 == 1, F.size(numbers(p)) - F.size(good(p))).otherwise(0)
        ),
        F.lit(0), lambda acc, n: acc + n,
    )
    out = F.array_join(F.transform(pieces, rewritten), "")
    out = F.regexp_replace(F.regexp_replace(out, r"[ \t]{2,}", " "), r"\s+([.,;:])", "$1")
    return text.strip(out), bad


def screen_explanations(answers: DataFrame) -> DataFrame:
    """``answers(id, raw, passage_count)`` -> the cleaned fields, citations kept, and ``refused``."""
    raw = F.col("raw")
    is_object = F.coalesce(F.try_parse_json(raw).isNotNull(), F.lit(False)) & F.trim(raw).startswith("{")
    cited = F.get_json_object(raw, "$.citations")
    listed = F.when(cited.startswith("["), F.from_json(cited, "array<string>")).when(
        cited.isNotNull(), F.array(cited)
    )
    numbers = F.filter(
        F.transform(
            F.coalesce(listed, F.array().cast("array<string>")),
            lambda x: F.nullif(F.regexp_extract(x, r"\d+", 0), F.lit("")).try_cast("bigint"),
        ),
        lambda n: n.isNotNull(),
    )
    rows = answers.select(
        "id", "passage_count", is_object.alias("is_object"), numbers.alias("numbers"),
        *[_field(raw, name).alias(name) for name in FIELDS],
    )
    misfit = F.lit(False)
    for name in FIELDS:
        misfit = misfit | F.coalesce((F.col(name) == "") | (F.length(name) > MAX_FIELD), F.lit(True))
    misfit = misfit | (F.size("numbers") > MAX_CITATIONS)
    rows = rows.withColumn("misfit", misfit)
    for name in FIELDS:
        rows = rows.withColumn(f"{name}_links", _count(F.col(name), URL)).withColumn(name, _clean(F.col(name)))
    blank = (F.col("summary") == "") | (F.col("impact") == "") | (F.col("remediation") == "")
    refused = (
        F.when(~F.col("is_object"), "not a JSON object").when(F.col("misfit"), "does not fit the format")
        .when(blank, "empty after cleaning")
    )
    passages = F.col("passage_count")
    valid = F.array_distinct(F.filter("numbers", lambda n: n.between(1, passages)))
    dropped = F.size("numbers") - F.size(valid)
    columns = []
    for name in FIELDS:
        cleaned, bad = _inline(F.col(name), passages)
        columns.append(cleaned.alias(name))
        dropped = dropped + bad
    links = F.col("summary_links") + F.col("impact_links") + F.col("remediation_links")
    ok = refused.isNull()
    return rows.select(
        "id", refused.alias("refused"),
        *[F.when(ok, c).alias(n) for c, n in zip(columns, FIELDS, strict=True)],
        F.when(ok, valid).alias("citations"), F.when(ok, dropped).alias("dropped_citations"),
        F.when(ok, links).alias("links_removed"), F.when(ok, F.size(valid) > 0).alias("grounded"),
    )


def _draft_field(raw: Column, name: str) -> Column:
    value = F.get_json_object(raw, f"$.{name}")
    return F.when(value.startswith("["), F.array_join(F.from_json(value, "array<string>"), "\n")).otherwise(value)


def screen_patch_answers(answers: DataFrame) -> DataFrame:
    """``answers(id, raw)`` -> ``replacement, rationale, fences_stripped, gutters_stripped, refused``."""
    raw = F.col("raw")
    is_object = F.coalesce(F.try_parse_json(raw).isNotNull(), F.lit(False)) & F.trim(raw).startswith("{")
    rows = answers.select(
        "id", is_object.alias("is_object"), _draft_field(raw, "replacement").alias("replacement"),
        _draft_field(raw, "rationale").alias("rationale"),
    )
    misfit = F.coalesce(
        (F.col("replacement") == "") | (F.length("replacement") > MAX_REPLACEMENT)
        | (F.col("rationale") == "") | (F.length("rationale") > MAX_RATIONALE),
        F.lit(True),
    )
    rows = rows.withColumn("misfit", misfit)
    body = F.regexp_replace("replacement", PREAMBLE, "")
    rows = rows.withColumn("fences_stripped", body.rlike(FENCE)).withColumn(
        "replacement", F.when(body.rlike(FENCE), F.regexp_extract(body, FENCE, 1)).otherwise(body)
    )
    kept = F.filter(F.split("replacement", "\n"), lambda x: ~x.rlike(MARKER))
    rows = rows.withColumn("lines", kept)
    solid = F.filter("lines", lambda x: text.strip(x) != "")
    numbered = (F.size(solid) > 0) & F.forall(solid, lambda x: x.rlike(GUTTER))
    rows = rows.withColumn("gutters_stripped", F.when(numbered, F.size(solid)).otherwise(0)).withColumn(
        "lines", F.when(numbered, F.transform("lines", lambda x: F.regexp_replace(x, GUTTER, ""))).otherwise(F.col("lines"))
    )
    code = F.regexp_replace(text.sanitise_code(F.array_join("lines", "\n")), r"(?U)\s+$", "")
    reason = text.normalise_space(text.sanitise_code(F.col("rationale")))
    refused = (
        F.when(~F.col("is_object"), "not a JSON object").when(F.col("misfit"), "does not fit the format")
        .when(text.strip(code) == "", "no code to apply").when(reason == "", "no reason given")
    )
    ok = refused.isNull()
    return rows.select(
        "id", refused.alias("refused"), F.when(ok, code).alias("replacement"), F.when(ok, reason).alias("rationale"),
        F.when(ok, F.col("fences_stripped")).alias("fences_stripped"),
        F.when(ok, F.col("gutters_stripped")).alias("gutters_stripped"),
    )
