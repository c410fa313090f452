"""Detection over whole files in one pass: no shuffle until there are matches.

Every file becomes *units*: one per line, plus one per Java statement that was wrapped over
several lines.  All rules look at each unit once; the ids that fire are exploded.  Only matches
are ever shuffled, to drop a statement's match where its line already reported the same rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave import dims
from riskweave.functions import text
from riskweave.operators import pattern_rules as rules
from riskweave.operators import secrets

MARK = secrets.MARK


def near_secret_lines(lines: Column) -> Column:
    """For each line: does it, or one of the next five, hold a secret word?"""
    return F.transform(
        lines,
        lambda line, i: F.exists(
            F.slice(lines, i + 1, rules.SECRET_WINDOW + 1), lambda x: F.lower(x).rlike(rules.SECRET_WORDS)
        ),
    )


def statement_spans(cleaned: Column) -> Column:
    """``array<struct<first, n>>``: runs of non-blank lines up to ``;``, a brace or 12 lines.

    Single-line statements are left out; the line scan has read those.
    """
    shape = "struct<done: array<struct<first: int, n: int>>, first: int, n: int>"
    empty = F.array().cast("array<struct<first: int, n: int>>")
    start = F.struct(empty.alias("done"), F.lit(0).alias("first"), F.lit(0).alias("n")).cast(shape)
    elements = F.transform(
        cleaned,
        lambda line, i: F.struct(
            (i + 1).alias("no"),
            (line == "").alias("blank"),
            ((line == "") | F.substring(line, -1, 1).isin(";", "{", "}")).alias("ends"),
        ),
    )

    def closed(done: Column, first: Column, n: Column) -> Column:
        span = F.array(F.struct(first.alias("first"), n.alias("n")))
        return F.when(n > 1, F.concat(done, span)).otherwise(done)

    def step(acc: Column, e: Column) -> Column:
        n = acc["n"] + F.when(e["blank"], 0).otherwise(1)
        first = F.when(acc["n"] == 0, e["no"]).otherwise(acc["first"])
        ended = e["ends"] | (n >= rules.MAX_STATEMENT_LINES)
        return F.struct(
            F.when(ended, closed(acc["done"], first, n)).otherwise(acc["done"]).alias("done"),
            first.alias("first"),
            F.when(ended, 0).otherwise(n).alias("n"),
        ).cast(shape)

    return F.aggregate(elements, start, step, lambda acc: closed(acc["done"], acc["first"], acc["n"]))


def _units(files: DataFrame) -> DataFrame:
    ext = F.col("ext")
    kept = ["repository_id", "path", "ext"]
    lines = files.filter(F.col("text").isNotNull()).select(
        *kept, text.split_lines(F.col("text")).alias("lines"),
        (ext.isin(*dims.JAVA_SUFFIXES) & F.contains(F.lower("text"), F.lit("random"))).alias("random"),
    )
    lines = lines.withColumn(
        "cleaned", F.transform("lines", lambda x: text.strip(text.strip_line_comment(x)))
    ).withColumn("near", F.when(F.col("random"), near_secret_lines(F.col("lines"))))
    spans = F.when(ext.isin(*dims.WRAPPED_STATEMENT_SUFFIXES), statement_spans(F.col("cleaned")))
    lines = lines.withColumn("spans", spans)

    def line_unit(cleaned: Column, i: Column) -> Column:
        raw = F.get("lines", i)
        return F.struct(
            (i + 1).alias("first"), F.lit(1).alias("n"), cleaned.alias("statement"),
            F.array(raw).alias("raws"), F.slice("near", i + 1, 1).alias("near"),
            F.array(F.lit(0)).alias("starts"),
            F.when(
                raw.contains(secrets.PEM_NEEDLE), F.slice("lines", i + 2, F.size("lines"))
            ).alias("after"),
        )

    def statement_unit(span: Column) -> Column:
        parts = F.slice("cleaned", span["first"], span["n"])
        starts = F.transform(
            parts,
            lambda _p, j: F.aggregate(
                F.slice(parts, 1, j), F.lit(0), lambda acc, p: acc + F.length(p) + 1
            ),
        )
        return F.struct(
            span["first"].alias("first"), span["n"].alias("n"), F.array_join(parts, " ").alias("statement"),
            F.slice("lines", span["first"], span["n"]).alias("raws"),
            F.slice("near", span["first"], span["n"]).alias("near"), starts.alias("starts"),
            F.lit(None).cast("array<string>").alias("after"),
        )

    single = F.transform("cleaned", line_unit)
    wrapped = F.transform("spans", statement_unit)
    every = F.when(F.size(F.coalesce("spans", F.array())) > 0, F.concat(single, wrapped)).otherwise(single)
    # A file with wrapped statements leaves "ends with a plus" to the joined reading.
    whole = F.size(F.coalesce("spans", F.array())) > 0
    return lines.select(*kept, whole.alias("whole"), F.explode(every).alias("u")).select(*kept, "whole", "u.*")


def _matched_lines(rule_id: Column, registry: tuple[rules.LineRule, ...]) -> Column:
    """Indices, within a joined statement, of the lines on which a rule's matches begin."""
    pattern = F.lit("(?!)")
    for rule in registry:
        pattern = F.when(rule_id == rule.rule_id, F.lit("(" + rules.unicode(rule.pattern) + ")")).otherwise(pattern)
    pieces = F.split(F.regexp_replace("statement", pattern, F.lit(MARK + "$1")), MARK)
    offsets = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(1))),
        lambda i: F.aggregate(F.slice(pieces, 1, i), F.lit(0), lambda acc, p: acc + F.length(p)),
    )
    indices = F.array_distinct(
        F.transform(offsets, lambda o: F.size(F.filter("starts", lambda s: s <= o)) - 1)
    )
    first_only = rule_id.isin(*[r.rule_id for r in registry if r.first_match_only])
    some = F.when(first_only, F.slice(indices, 1, 1)).otherwise(indices)
    nowhere = F.when(first_only, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    return F.when(F.size(pieces) > 1, some).otherwise(nowhere)


def detect(
    files: DataFrame,
    registry: tuple[rules.LineRule, ...] = rules.PATTERN_RULES,
    with_secrets: bool = True,
) -> DataFrame:
    """``matches(repository_id, path, line_start, line_end, rule_id, snippet, analyzer)``."""
    units = _units(files)
    one = F.col("n") == 1
    raw = F.get("raws", F.lit(0))
    usable = (F.col("statement") != "") & (
        F.when(one, F.length(raw)).otherwise(F.length("statement")) <= rules.MAX_STATEMENT_LENGTH
    )
    fired = rules.pattern_rule_ids(F.col("ext"), F.col("statement"), F.col("whole"), usable, registry)
    if with_secrets:
        secret = F.when(one, secrets.secret_rule_id(F.col("path"), raw, F.col("after")))
        fired = F.concat(fired, F.array_compact(F.array(secret)))
    hits = units.withColumn("rule_id", F.explode(fired))

    near_rules = [r.rule_id for r in registry if r.near_secret]
    index = F.explode(
        F.when(one, F.array(F.lit(0))).otherwise(_matched_lines(F.col("rule_id"), registry))
    )
    hits = hits.withColumn("index", index)
    hits = hits.filter(~F.col("rule_id").isin(*near_rules) | F.coalesce(F.get("near", F.col("index")), F.lit(False)))
    line = F.get("raws", F.col("index"))
    is_secret = F.col("rule_id").startswith("SEC")
    hits = hits.select(
        "repository_id", "path", "first", "n", "rule_id",
        (F.col("first") + F.col("index")).alias("line_start"),
        F.when(is_secret, secrets.secret_snippet(F.col("rule_id"), F.col("path"), line))
        .otherwise(text.clean_snippet(line)).alias("snippet"),
        F.when(is_secret, "secrets").otherwise("pattern").alias("analyzer"),
    )

    # A file holds at most 1 MB, so a window over one rule of one file is bounded.
    per_rule = Window.partitionBy("repository_id", "path", "rule_id")
    reported = F.collect_set(F.when(F.col("n") == 1, F.col("line_start"))).over(per_rule)
    hits = hits.withColumn("reported", reported)
    decided = [r.rule_id for r in registry if r.first_match_only]
    inside = F.exists(
        "reported", lambda x: (x >= F.col("first")) & (x < F.col("first") + F.col("n"))
    )
    again = F.when(F.col("rule_id").isin(*decided), inside).otherwise(
        F.array_contains("reported", F.col("line_start"))
    )
    kept = hits.filter((F.col("n") == 1) | ~again)
    return kept.dropDuplicates(["repository_id", "path", "rule_id", "line_start"]).select(
        "repository_id", "path", "line_start", F.col("line_start").alias("line_end"), "rule_id",
        "snippet", "analyzer",
    )


def wrapped_statements(files: DataFrame) -> DataFrame:
    """``(repository_id, path, first_line, lines, statement)`` for every wrapped Java statement."""
    return _units(files).filter("n > 1").select(
        "repository_id", "path", F.col("first").alias("first_line"), F.col("n").alias("lines"), "statement"
    )


def attach_rules(matches: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Title, severity, confidence, CWE, OWASP and category from the 43-row catalogue."""
    return matches.join(F.broadcast(catalogue), "rule_id")


def union_analyzers(*matches: DataFrame) -> DataFrame:
    out = matches[0]
    for other in matches[1:]:
        out = out.unionByName(other)
    return out
