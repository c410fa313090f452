"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

``score(x) = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2))``: the pairwise
interactions of all features through rank-``RANK`` factors, in time linear in the features of a text.

Features of a whole text: every distinct word, hashed (weight ``1 + log tf``, scaled to unit length over the
text); structure statistics, each also as one of a few bins so that it can interact with words; the declared
length ``n_chars`` as metadata (missing counts as missing).  Labels, language, source and id are never inputs.

Learning: at most about ``rows`` labelled texts, chosen by a hash of the id, are turned to features in Spark;
those bounded rows are fitted on the driver by seeded mini-batches with per-weight step sizes, the rarer class
weighted up, and the intercept is then shifted so that mean score equals the share of good texts.

Defined results: null and empty texts are scored as texts without words; where no labelled row exists every
score is the neutral 0.5; repeated rows get equal scores; a label given twice counts once, and
two labels of one text both count; null labels are not learnt from; other columns of the documents are kept, one named like a result is replaced.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.text import WORDS_HELD, encoded, held_out

WORDS = 1 << 14
RANK = 8
#: Labelled rows learnt from, at most (about).
TRAIN_ROWS = 8_000
#: Predicted good from this score on.
THRESHOLD = 0.7
STATISTICS = (
    "symbols", "duplicate_lines", "word_length", "letters", "upper", "digits", "distinct", "top_word", "pairs", "stops",
    "marks", "bars", "length", "declared",
)
EDGES = (0.01, 0.03, 0.07, 0.15, 0.3, 0.45, 0.6, 0.75, 0.9)
BINS = len(EDGES) + 1
SIZE = WORDS + len(STATISTICS) * (BINS + 1)


class Buckets(dict):
    """Word -> bucket, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        value = zlib.crc32(word) % WORDS
        if len(self) < WORDS_HELD:
            self[word] = value
        return value


def features(text: str | None, n_chars: float | None, buckets: Buckets) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a text's features; an index may repeat."""
    raw = encoded(text)
    words = raw.split()
    tally = Counter(words)
    statistics = _statistics(raw, words, tally, n_chars)
    at = np.fromiter(map(buckets.__getitem__, tally), np.int32, len(tally))
    weight = 1 + np.log(np.fromiter(tally.values(), np.float32, len(tally)))
    if len(at):
        weight /= np.sqrt(np.square(weight).sum())
    first = WORDS + np.arange(len(STATISTICS), dtype=np.int32) * (BINS + 1)
    binned = first + 1 + np.searchsorted(EDGES, statistics).astype(np.int32)
    index = np.concatenate([at, first, binned]).astype(np.int32)
    value = np.concatenate([weight, statistics, np.full(len(STATISTICS), 0.5)]).astype(np.float32)
    return index, value


def _statistics(raw: bytes, words: list[bytes], tally: Counter, n_chars: float | None) -> np.ndarray:
    """Structure of a text, every statistic in 0..1."""
    n = max(len(words), 1)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    visible = max(int(counts[33:].sum()), 1)
    upper, lower, digits = int(counts[65:91].sum()), int(counts[97:123].sum()), int(counts[48:58].sum())
    letters = upper + lower + int(counts[128:].sum())
    symbols = int(counts[[35, 36, 37, 38, 42, 60, 62]].sum())
    lines = [line for line in raw.split(b"\n") if line.strip()]
    repeats = sum(map(bytes.__eq__, words[1:], words[:-1]))
    declared = 0.0 if n_chars is None or n_chars != n_chars else min(1.0, np.log1p(max(n_chars, 0)) / 12)
    return np.array(
        [
            min(1.0, symbols / n), 1 - len(set(lines)) / max(len(lines), 1), min(1.0, visible / n / 20), letters / visible,
            upper / max(upper + lower, 1), digits / visible, len(tally) / n, max(tally.values(), default=0) / n,
            repeats / n, min(1.0, int(counts[46]) / n), min(1.0, int(counts[[33, 63]].sum()) / n),
            min(1.0, int(counts[124]) / n), min(1.0, np.log1p(len(words)) / 12), declared,
        ]
    )


@dataclass(frozen=True)
class Machine:
    intercept: float
    linear: np.ndarray
    factors: np.ndarray

    def raw(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Scores before the sigmoid of rows laid end to end; every row has features."""
        by_factor = self.factors[index] * value[:, None]
        sums = np.add.reduceat(by_factor, starts, axis=0)
        squares = np.add.reduceat(np.square(by_factor), starts, axis=0)
        linear = np.add.reduceat(self.linear[index] * value, starts)
        return self.intercept + linear + 0.5 * (np.square(sums) - squares).sum(axis=1)


def sigmoid(raw: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 6, seed: int = 5) -> Machine:
    """Seeded mini-batches with per-weight (Adagrad) steps on the weighted log loss."""
    random = np.random.default_rng(seed)
    linear, factors = np.zeros(SIZE, np.float32), random.normal(0, 0.02, (SIZE, RANK)).astype(np.float32)
    linear_g, factors_g = np.full(SIZE, 1e-3, np.float32), np.full((SIZE, RANK), 1e-3, np.float32)
    good = float(labels.mean())
    weight = np.where(labels > 0, 0.5 / max(good, 1e-6), 0.5 / max(1 - good, 1e-6)) if 0 < good < 1 else np.ones(len(labels))
    intercept, intercept_g = 0.0, 1e-3
    for _ in range(epochs):
        order = random.permutation(len(rows))
        for at in range(0, len(order), 64):
            chosen = order[at : at + 64]
            index = np.concatenate([rows[r][0] for r in chosen])
            value = np.concatenate([rows[r][1] for r in chosen])
            lengths = np.array([len(rows[r][0]) for r in chosen])
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            of = np.repeat(np.arange(len(chosen)), lengths)
            by_factor = factors[index] * value[:, None]
            sums = np.add.reduceat(by_factor, starts, axis=0)
            raw = Machine(intercept, linear, factors).raw(index, value, starts)
            error = ((sigmoid(raw) - labels[chosen]) * weight[chosen] / len(chosen)).astype(np.float32)
            slope = error[of] * value
            places, inverse = np.unique(index, return_inverse=True)
            gradient = np.bincount(inverse, slope) + 1e-5 * linear[places]
            pull = slope[:, None] * (sums[of] - by_factor)
            pulls = np.stack([np.bincount(inverse, pull[:, f]) for f in range(RANK)], axis=1) + 1e-5 * factors[places]
            linear_g[places] += np.square(gradient)
            linear[places] -= 0.1 * gradient / np.sqrt(linear_g[places])
            factors_g[places] += np.square(pulls)
            factors[places] -= 0.02 * pulls / np.sqrt(factors_g[places])
            intercept_g += float(error.sum()) ** 2
            intercept -= 0.1 * float(error.sum()) / np.sqrt(intercept_g)
    raw = np.concatenate(
        [Machine(intercept, linear, factors).raw(index, value, np.zeros(1, int)) for index, value in rows]
    )
    low, high = -20.0, 20.0  # the shift at which the mean score is the share of good texts
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if sigmoid(raw + middle).mean() < good else (low, middle)
    return Machine(intercept + (low if 0 < good < 1 else 0.0), linear, factors)


def learn(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Machine | None:
    """A machine from ``(doc_id, text, n_chars)`` and ``(doc_id, quality)``; None without a labelled row.

    The sampled labels, at most about ``rows`` ids, go to the documents; texts are not shuffled by id.
    """
    usable = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 4))
    usable = usable.select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    total = usable.count()
    if not total:
        return None
    chance = F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    # Broadcast: bounded by ``rows``, the documented bound of the sample.
    sample = documents.join(F.broadcast(usable.filter(chance < rows / total)), "doc_id")
    # An id that stands on many rows is learnt once, from its least text.
    least = F.min(F.struct("text", F.col("n_chars").cast("double").alias("n_chars"))).alias("least")
    sample = sample.groupBy("doc_id", "quality").agg(least).select("doc_id", "quality", "least.*")

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        buckets = Buckets()
        for batch in batches:
            found = [features(t, n, buckets) for t, n in zip(batch["text"], batch["n_chars"], strict=True)]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"], "quality": batch["quality"], "i": [i.tobytes() for i, _ in found],
                    "x": [x.tobytes() for _, x in found],
                }
            )

    got = sample.mapInPandas(featured, "doc_id long, quality int, i binary, x binary").toPandas()
    if got.empty:
        return None
    got = got.sort_values(["doc_id", "quality", "i", "x"], kind="stable")
    parts = [(np.frombuffer(i, np.int32), np.frombuffer(x, np.float32)) for i, x in zip(got["i"], got["x"], strict=True)]
    return fit(parts, got["quality"].to_numpy(float))


def scorer(machine: Machine | None):
    """A Column function: (text, n_chars) -> score."""

    def scored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        buckets = Buckets()
        for texts, declared in batches:
            out = np.full(len(texts), 0.5)
            for at in range(0, len(texts) if machine else 0, 64):
                part = zip(texts.iloc[at : at + 64], declared.iloc[at : at + 64], strict=True)
                found = [features(text, n, buckets) for text, n in part]
                starts = np.concatenate([[0], np.cumsum([len(i) for i, _ in found])[:-1]])
                index, value = np.concatenate([i for i, _ in found]), np.concatenate([x for _, x in found])
                out[at : at + 64] = sigmoid(machine.raw(index, value, starts))
            yield pd.Series(out)

    return F.pandas_udf(scored, "double")


def with_quality(documents: DataFrame, machine: Machine | None) -> DataFrame:
    """Documents with ``score`` and ``predicted``; columns of those names are replaced."""
    rest: list[Column] = [F.col(f"`{c}`") for c in documents.columns if c.lower() not in ("score", "predicted")]
    scored = documents.select(*rest, scorer(machine)(F.col("text"), F.col("n_chars").cast("double")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def quality_classifier(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """Per document: whether it was held out, the score and the predicted label."""
    machine = learn(documents, labels, rows)
    chosen = documents.select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), "text", "n_chars")
    return with_quality(chosen, machine).drop("text", "n_chars")
