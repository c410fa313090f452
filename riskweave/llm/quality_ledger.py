"""Quality rules as a ledger: every rule is evaluated once, policies and ablations come after.

``measure`` reads each whole text once and leaves measurements.  ``ledger`` turns the registered rules
into one ``failed`` bit mask beside them.  ``apply_policy`` is a bitwise test of a versioned mask, so a
new policy never reads texts again; ``ablation`` counts masks first (at most one row per distinct mask)
and derives from them what each rule rejects, and what it alone rejects.

Defined results: a null text has no words, no lines and fails ``few_words``; an empty table gives an
empty ledger; repeated rows are judged row by row; other columns are kept, and a column of the table
named like a measurement is replaced by it.  Long texts are read whole, in memory of a small multiple of
the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.text import WORDS_HELD, Hashes, encoded, window_hashes

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters",
)
WINDOW = 5
SPACES = b" \t\n\r\x0b\f"


def _classes() -> np.ndarray:
    """Per byte value: 1 starts a code point of a word, 2 a symbol, 4 upper case, 8 a letter."""
    table = np.zeros(256, np.uint8)
    for byte in range(256):
        if (byte < 0x80 or byte >= 0xC0) and byte not in SPACES:
            table[byte] |= 1
        if byte in b"#*$%&|<>":
            table[byte] |= 2
        if 65 <= byte <= 90:
            table[byte] |= 4
        if 65 <= byte <= 90 or 97 <= byte <= 122 or byte >= 0xC0:
            table[byte] |= 8
    return table


CLASSES = _classes()


def measures_of(text: str | None, hashes: Hashes) -> tuple[int, ...]:
    """The measurements of one text, in the order of ``MEASURES``."""
    raw = encoded(text)
    words = raw.split()
    if not words:
        return (0,) * len(MEASURES)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    of = [int(counts[(CLASSES & bit) > 0].sum()) for bit in (1, 2, 4, 8)]
    lines = [line for line in raw.split(b"\n") if line.strip(SPACES)]
    repeated = 0
    if len(words) > WINDOW:
        windows = window_hashes(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)), WINDOW)
        ordered = np.sort(windows)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if len(twice):
            starts = np.flatnonzero(np.isin(windows, twice))
            change = np.zeros(len(words) + 1, np.int32)
            np.add.at(change, starts, 1)
            np.add.at(change, starts + WINDOW, -1)
            repeated = int((np.cumsum(change[:-1]) > 0).sum())
    return len(words), of[0], of[1], len(lines) - len(set(lines)), repeated, len(lines), of[2], of[3]


def _measured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    hashes = Hashes()
    hashes.limit = WORDS_HELD
    for texts in batches:
        rows = [measures_of(text, hashes) for text in texts]
        yield pd.DataFrame(np.array(rows, np.int64).reshape(-1, len(MEASURES)), columns=list(MEASURES))


@dataclass(frozen=True)
class Rule:
    """A rule fails a document where ``fails`` (SQL over the measurements) is true."""

    name: str
    bit: int
    fails: str


RULES = (
    Rule("few_words", 0, "n_words < 10"),
    Rule("repeated_windows", 1, "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", 2, "10 * n_symbols > n_words"),
    Rule("duplicate_lines", 3, "n_lines >= 4 AND 10 * n_dup_lines > 4 * n_lines"),
    Rule("word_length", 4, "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words)"),
    Rule("shouting", 5, "n_letters >= 40 AND 2 * n_upper > n_letters"),
)
BASE = ("few_words", "repeated_windows")


@dataclass(frozen=True)
class Policy:
    """A version of what counts: the rules whose failure rejects a document."""

    version: str
    rules: tuple[str, ...] = field(default_factory=tuple)

    def mask(self, rules: tuple[Rule, ...] = RULES) -> int:
        bits = {rule.name: rule.bit for rule in rules}
        return sum(1 << bits[name] for name in set(self.rules))


POLICIES = (Policy("base", BASE), Policy("2", tuple(rule.name for rule in RULES)))
CURRENT = POLICIES[-1]


def measure(documents: DataFrame, text: str = "text") -> DataFrame:
    """Documents with the measurements of their whole texts."""
    rest = [c for c in documents.columns if c.lower() not in MEASURES]
    measured_text = F.pandas_udf(_measured, ", ".join(f"{name} long" for name in MEASURES))
    measured = documents.withColumn("_measures", measured_text(F.col(f"`{text}`")))
    return measured.select(*[F.col(f"`{c}`") for c in rest], "_measures.*")


def ledger(documents: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``measure`` and ``failed``: bit r is set where rule r fails."""
    measured = measure(documents, text)
    bits = F.lit(0).cast("long")
    for rule in rules:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("failed", bits)


def passes(policy: Policy, failed: str = "failed", rules: tuple[Rule, ...] = RULES) -> Column:
    return F.col(failed).bitwiseAND(F.lit(policy.mask(rules)).cast("long")) == 0


def apply_policy(entries: DataFrame, policy: Policy = CURRENT, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger with ``kept`` under one policy."""
    return entries.withColumn("kept", passes(policy, rules=rules))


def ablation(
    entries: DataFrame, policies: tuple[Policy, ...] = POLICIES, rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """Per policy and rule: documents rejected, failing the rule, and kept if that rule were dropped."""
    masks = entries.groupBy("failed").agg(F.count("*").alias("n"))
    table = F.array(
        *[
            F.struct(
                F.lit(policy.version).alias("policy"), F.lit(rule.name).alias("rule"),
                F.lit(policy.mask(rules)).cast("long").alias("mask"), F.lit(1 << rule.bit).cast("long").alias("bit"),
            )
            for policy in policies for rule in rules if rule.name in policy.rules
        ]
    )
    hit = F.col("failed").bitwiseAND(F.col("mask"))
    return (
        masks.withColumn("_p", F.explode(table)).select("failed", "n", "_p.*")
        .groupBy("policy", "rule")
        .agg(
            F.sum("n").alias("documents"),
            F.sum(F.when(hit != 0, F.col("n")).otherwise(0)).alias("rejected"),
            F.sum(F.when(F.col("failed").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("failing"),
            F.sum(F.when(hit == F.col("bit"), F.col("n")).otherwise(0)).alias("only_this_rule"),
        )
    )


def quality_ledger(documents: DataFrame) -> DataFrame:
    """Per document: the measurements, the base verdict, the mask and the current policy's verdict."""
    judged = apply_policy(ledger(documents.select("doc_id", "text")))
    base = ~passes(POLICIES[0])
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), "kept", "failed",
    )


def _lines(text: str) -> str:
    return f"list_filter(string_split({text}, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))"


SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
m AS (
  SELECT *, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, {_lines("text")} AS lines,
    len(regexp_extract_all(text, '[A-Z]')) AS n_upper,
    len(regexp_extract_all(text, '[A-Za-z]|[^\\x00-\\x7F]')) AS n_letters FROM d),
g AS (
  SELECT r, i, list_slice(w, i, i + 4) AS gram FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS c FROM g) WHERE c > 1),
cover AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(5) AS t(k) GROUP BY r),
q AS (
  SELECT doc_id, n_words, word_chars, n_symbols, len(lines) AS n_lines, n_upper, n_letters,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(cover.n, 0) AS n_repeat_words
  FROM m LEFT JOIN cover USING (r)),
f AS (SELECT *, 0 {"".join(f" + CASE WHEN {rule.fails} THEN {1 << rule.bit} ELSE 0 END" for rule in RULES)} AS failed FROM q)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  (failed & {POLICIES[0].mask()}) <> 0 AS base_failed, (failed & {CURRENT.mask()}) = 0 AS kept, failed::BIGINT AS failed
FROM f
"""
