"""Language identification by error-correcting output codes.

Every language has a codeword of bits; every bit is one binary classifier over hashed character n-grams,
which says on which side of that bit's split of the languages a text lies.  A text's bits are decoded to the
codeword of least weighted loss, where a bit counts by how well it did on the calibration rows.  Two
codewords of nearly equal loss leave the prediction ``ambiguous``.

Learning: per language, n-gram counts of a sample of at most about ``per_language`` labelled texts (whole
texts, chosen by a hash of the id), summed in Spark; a bit's weights are the log ratios of the two sides'
mean n-gram probabilities; slope and offset of each bit come from a logistic fit on the sample.  What reaches
the driver is the counts (languages x ``BUCKETS``) and one margin per bit and sampled row.

With up to six languages the code is exhaustive (every split once); with more it is the best of 64 seeded
random codes of ``15 * ceil(log2(languages))`` bits by least distance between codewords.

Defined results: ``und`` with score 0 for a null text or one without a letter, and where nothing was learnt;
one learnt language is always predicted; repeated rows get equal predictions; null ids count as not held out;
columns other than the id, the text and the language are not read.  Long texts are read in pieces.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.text import held_out

BUCKETS = 1 << 15
ORDERS = (1, 2, 3, 4)
#: Bytes of a text that are hashed at once.
PIECE = 1 << 20
#: About so many labelled rows of each language are learnt from, at most.
PER_LANGUAGE = 6_000
MARGIN = 0.2
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")


def _folded() -> np.ndarray:
    """ASCII bytes other than letters become a space."""
    table = np.arange(256, dtype=np.uint8)
    for byte in range(128):
        if not bytes([byte]).isalpha():
            table[byte] = 32
    return table


FOLDED = _folded()


def grams(text: str) -> np.ndarray:
    """Counts of hashed byte n-grams of the lower-cased text, runs of non-letters as one space."""
    raw = FOLDED[np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)]
    counts = np.zeros(BUCKETS, np.float32)
    raw = np.concatenate([[np.uint8(32)], raw, [np.uint8(32)]])
    raw = raw[np.concatenate([[True], (raw[1:] != 32) | (raw[:-1] != 32)])]
    for at in range(0, len(raw), PIECE):
        piece = raw[max(0, at - max(ORDERS) + 1) : at + PIECE].astype(np.uint32)
        fresh = min(at, max(ORDERS) - 1)  # what was counted with the piece before
        code = np.zeros(len(piece), np.uint32)
        for order in range(1, max(ORDERS) + 1):
            code = (code[: len(piece) - order + 1] << np.uint32(8)) | piece[order - 1 :]
            if order in ORDERS and len(code):
                new = code[max(0, fresh - order + 1) :]
                hashed = ((new + np.uint32(order * 0x3C6EF372)) * np.uint32(0x9E3779B1)) >> np.uint32(17)
                counts += np.bincount(hashed, minlength=BUCKETS).astype(np.float32)
    return counts


@dataclass(frozen=True)
class Model:
    """Languages, their codewords (+1, -1), and each bit's weights, slope, offset and say."""

    languages: tuple[str, ...]
    code: np.ndarray
    weights: np.ndarray
    slope: np.ndarray
    offset: np.ndarray
    say: np.ndarray

    def margins(self, counts: np.ndarray) -> np.ndarray:
        """Raw margin per row and bit."""
        total = np.maximum(counts.sum(axis=1, keepdims=True), 1)
        return (counts @ self.weights) / np.sqrt(total)

    def decode(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, its share of belief, and whether the next is close."""
        if len(self.languages) == 1:
            return np.zeros(len(counts), int), np.ones(len(counts)), np.zeros(len(counts), bool)
        margin = self.margins(counts) * self.slope + self.offset
        loss = np.logaddexp(0, -margin[:, :, None] * self.code[None]) * self.say[None, :, None]
        loss = loss.sum(axis=1)
        belief = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
        belief /= belief.sum(axis=1, keepdims=True)
        best = belief.argmax(axis=1)
        ranked = np.sort(belief, axis=1)
        return best, ranked[:, -1], ranked[:, -1] - ranked[:, -2] < MARGIN


def codewords(languages: int, seed: int = 7) -> np.ndarray:
    """Bits x languages, +1 and -1; no bit is constant."""
    if languages < 2:
        return np.ones((0, languages))
    if languages <= 6:
        rows = [(1, *rest) for rest in itertools.product((1, -1), repeat=languages - 1) if -1 in rest]
        return np.array(rows, float)
    random = np.random.default_rng(seed)
    bits, best, least = 15 * int(np.ceil(np.log2(languages))), None, -1
    for _ in range(64):
        code = np.where(random.random((bits, languages)) < 0.5, 1.0, -1.0)
        code = code[(np.abs(code.sum(axis=1)) < languages)]
        apart = ((len(code) - code.T @ code) / 2)[~np.eye(languages, dtype=bool)].min()
        if apart > least:
            best, least = code, apart
    return best


def _weights(counts: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Per bit, log ratio of the mean smoothed n-gram probabilities of its two sides."""
    shares = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)
    columns = [np.log(shares[bit > 0].mean(axis=0) / shares[bit < 0].mean(axis=0)) for bit in code]
    return np.array(columns, np.float32).T.reshape(counts.shape[1], len(code))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(y = 1) = 1 / (1 + exp(-(slope x + offset))), lightly ridged, by Newton steps."""
    scale = max(float(np.abs(x).mean()), 1e-9)
    design = np.stack([x / scale, np.ones_like(x)], axis=1)
    beta, ridge = np.zeros(2), np.eye(2) * 1e-2
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + ridge, design.T @ (y - p) - ridge @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-6:
            break
    return beta[0] / scale, beta[1]


def learn(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """A model of ``(doc_id, text, lang)``; None where there is nothing to learn."""
    usable = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {row["lang"]: row["n"] for row in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    languages = tuple(sorted(sizes))
    share = F.create_map(*[x for name in languages for x in (F.lit(name), F.lit(min(1.0, per_language / sizes[name])))])
    chance = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = usable.filter(chance < F.element_at(share, F.col("lang"))).select("text", "lang")
    place = {name: at for at, name in enumerate(languages)}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((len(place), BUCKETS))
        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"], strict=True):
                sums[place[lang]] += grams(text)
        rows, columns = np.nonzero(sums)
        yield pd.DataFrame({"l": rows, "b": columns, "n": sums[rows, columns]})

    counts = np.zeros((len(languages), BUCKETS))
    counted = sample.mapInPandas(count, "l int, b int, n double").groupBy("l", "b").agg(F.sum("n").alias("n")).toPandas()
    counts[counted["l"], counted["b"]] = counted["n"]
    code = codewords(len(languages))
    none = np.ones(len(code))
    model = Model(languages, code, _weights(counts, code), none, none * 0, none)
    if len(languages) == 1:
        return model

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [model.margins(grams(text)[None])[0] for text in batch["text"]]
            yield pd.DataFrame({"l": [place[lang] for lang in batch["lang"]], "m": [list(map(float, x)) for x in found]})

    seen = sample.mapInPandas(measure, "l int, m array<double>").toPandas()
    margins, label = np.array(seen["m"].tolist()), seen["l"].to_numpy()
    # Languages weigh alike, however many rows each has: margins are centred between the two sides' means.
    slope, offset, say = none.copy(), none * 0, none.copy()
    for at, bit in enumerate(code):
        truth = (bit[label] > 0).astype(float)
        slope[at], offset[at] = _logistic(margins[:, at], truth)
        wrong = ((margins[:, at] * slope[at] + offset[at] > 0) != (truth > 0)).sum()
        rate = (wrong + 0.5) / (len(truth) + 1)
        say[at] = max(0.05, np.log((1 - rate) / rate))
    return Model(languages, code, model.weights, slope, offset, say / say.mean())


def identify(model: Model | None):
    """A Column function: text -> struct(lang_pred, score, ambiguous)."""

    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            names, scores, doubts = [], [], []
            for start in range(0, len(texts), 64):
                part = texts.iloc[start : start + 64]
                known = [model is not None and text is not None and bool(LETTER.search(text)) for text in part]
                rows = [grams(text) for text, ok in zip(part, known, strict=True) if ok]
                found = iter(zip(*model.decode(np.stack(rows)), strict=True)) if rows else iter(())
                for ok in known:
                    best, score, doubt = next(found) if ok else (None, 0.0, True)
                    names.append(UNKNOWN if best is None else model.languages[best])
                    scores.append(float(score))
                    doubts.append(bool(doubt))
            yield pd.DataFrame({"lang_pred": names, "score": scores, "ambiguous": doubts})

    return F.pandas_udf(predicted, "lang_pred string, score double, ambiguous boolean")


def with_language(documents: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Documents with ``lang_pred``, ``score`` and ``ambiguous``; columns of those names are replaced."""
    made = ("lang_pred", "score", "ambiguous")
    rest: list[Column] = [F.col(f"`{c}`") for c in documents.columns if c.lower() not in made]
    return documents.withColumn("_found", identify(model)(F.col(f"`{text}`"))).select(*rest, "_found.*")


def language_id(documents: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Per document: whether it was held out of learning, the language, the score, whether it is ambiguous."""
    rows = documents.select("doc_id", "text", "lang", held_out(F.col("doc_id"), 4).alias("held_out"))
    model = learn(rows.filter(~F.col("held_out")).select("doc_id", "text", "lang"), per_language)
    return with_language(rows.select("doc_id", "held_out", "text"), model).drop("text")
