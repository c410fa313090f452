"""Many logistic models in one aggregate.

A cross-validation fits one model per repeat and fold, each on all rows but one fold.  Their features differ only in
scales and vocabularies, so every model is a linear map of one common row: numbers, which of them are missing, flags, one
column per category value, and a one.  A Newton step of all models is then one job over the rows: gradient and curvature are
added up per model in the common columns, and the driver maps them to each model's own features and solves one small
system per model.  Means, spreads and vocabularies come from one grouping by repeat and fold: what a model is trained on is the
merge of the other folds.

The driver holds one matrix of (common columns)^2 per model, so category values that get a column are bounded by
``MOST_VALUES``; more of them are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.session import materialise

# --- fixed values: when a fit rests ---
MOST_STEPS, MOST_HALVINGS, RESTS, JITTER = 50, 30, 1e-8, 1e-9
MOST_VALUES = 400
#: A spread below this share of the mean is what rounding leaves of equal numbers.
NO_SPREAD = 1e-12
#: A model that is trained on all rows leaves out this fold.
NONE = -1


@dataclass(frozen=True)
class Layout:
    """What the columns of a row are: (feature, column, log-scaled), (feature, column), (category, column)."""

    numbers: tuple[tuple[str, str, bool], ...]
    flags: tuple[tuple[str, str], ...]
    categories: tuple[tuple[str, str], ...]
    least: int
    other: str

    def number(self, index: int) -> Column:
        _, name, log = self.numbers[index]
        value = F.col(name).cast("double")
        # greatest() would make a number of a null.
        return F.when(value.isNotNull(), F.log1p(F.greatest(value, F.lit(0.0)))) if log else value


@dataclass(frozen=True)
class Learned:
    """A fitted model: scales and vocabularies of its training rows, weights by feature, bias."""

    repeat: int
    fold: int
    rows: int
    passed: int
    scales: tuple[tuple[str, float, float], ...]
    vocabulary: tuple[tuple[str, tuple[str, ...]], ...]
    weights: tuple[float, ...] = ()
    bias: float = 0.0


def prepared(examples: DataFrame, layout: Layout) -> DataFrame:
    """``patch_id, passed, rule_id, numbers, flags, values, folds``: rows as every job reads them, written once."""
    numbers = [layout.number(i) for i in range(len(layout.numbers))]
    return materialise(examples.select(
        "patch_id", "passed", "rule_id", F.array(*numbers).alias("numbers"), F.array(*[F.col(c).cast("double") for _, c in layout.flags]).alias("flags"),
        F.array(*[F.col(c) for _, c in layout.categories]).alias("values"), "folds",
    ))


def _by_fold(rows: DataFrame) -> DataFrame:
    return rows.select("*", F.posexplode("folds").alias("repeat", "fold"))


@dataclass
class _Part:
    """Rows of one fold: counts, and per number how many, their mean and summed squares around it."""

    rows: int
    passed: int
    known: np.ndarray
    mean: np.ndarray
    squares: np.ndarray
    seen: dict[tuple[int, str], int]

    def merged(self, other: _Part) -> _Part:
        known = self.known + other.known
        share = np.divide(other.known, known, out=np.zeros(len(known)), where=known > 0)
        apart = other.mean - self.mean
        seen = {k: self.seen.get(k, 0) + other.seen.get(k, 0) for k in {**self.seen, **other.seen}}
        squares = self.squares + other.squares + apart**2 * self.known * share
        return _Part(self.rows + other.rows, self.passed + other.passed, known, self.mean + apart * share, squares, seen)


def _parts(rows: DataFrame, layout: Layout) -> dict[tuple[int, int], _Part]:
    count = len(layout.numbers)
    figures = [
        f(F.col("numbers")[i]).alias(f"{name}{i}") for i in range(count) for name, f in (("n", F.count), ("m", F.avg), ("v", F.var_pop))
    ]
    sums = _by_fold(rows).groupBy("repeat", "fold").agg(F.count("*").alias("rows"), F.count_if("passed").alias("passed"), *figures)
    pairs = rows.select("folds", F.posexplode("values").alias("category", "value")).filter("value is not null")
    often = pairs.groupBy("category", "value").agg(F.count("*").alias("n")).filter(F.col("n") >= layout.least).drop("n")
    if (kinds := often.count()) > MOST_VALUES:
        raise ValueError(f"{kinds} category values occur often enough for a column; at most {MOST_VALUES} can be fitted")
    each = _by_fold(pairs.join(often, ["category", "value"])).groupBy("repeat", "fold", "category", "value").count()
    seen: dict[tuple[int, int], dict[tuple[int, str], int]] = {}
    for r in each.collect():
        seen.setdefault((r["repeat"], r["fold"]), {})[r["category"], r["value"]] = r["count"]
    parts = {}
    for r in sums.collect():
        known = np.array([r[f"n{i}"] for i in range(count)], float)
        mean, variance = (np.array([r[f"{x}{i}"] or 0.0 for i in range(count)]) for x in "mv")
        parts[r["repeat"], r["fold"]] = _Part(r["rows"], r["passed"], known, mean, variance * known, seen.get((r["repeat"], r["fold"]), {}))
    return parts


def training_sets(rows: DataFrame, layout: Layout, left_out: list[tuple[int, int]]) -> list[Learned]:
    """Scales and vocabularies of the rows outside each (repeat, fold); a model without rows is left out."""
    parts = _parts(rows, layout)
    out = []
    for repeat, fold in left_out:
        total = None
        for (r, f), part in sorted(parts.items()):
            if r == repeat and f != fold:
                total = part if total is None else total.merged(part)
        if total is None:
            continue
        spread = np.sqrt(np.divide(total.squares, total.known, out=np.zeros(len(total.known)), where=total.known > 0))
        spread = np.where(spread > NO_SPREAD * np.maximum(1.0, np.abs(total.mean)), spread, 1.0)
        scales = tuple((name, float(m), float(s)) for (name, _c, _l), m, s in zip(layout.numbers, total.mean, spread, strict=True))
        vocabulary = tuple(
            (name, tuple(sorted(v for (c, v), n in total.seen.items() if c == i and n >= layout.least)))
            for i, (name, _c) in enumerate(layout.categories)
        )
        out.append(Learned(repeat, fold, total.rows, total.passed, scales, vocabulary))
    return out


def names(layout: Layout, learned: Learned) -> list[str]:
    """The features of a model, in the order of its weights."""
    out = [part for name, _m, _s in learned.scales for part in (name, f"{name}: not recorded")]
    out += [name for name, _c in layout.flags]
    for name, values in learned.vocabulary:
        out += [*(f"{name} = {value}" for value in values), f"{name} = {layout.other}"]
    return out


class Common:
    """The common columns of all models, and each model's features as a linear map of them."""

    def __init__(self, layout: Layout, models: list[Learned]) -> None:
        self.layout = layout
        self.values = [sorted({v for m in models for v in m.vocabulary[i][1]}) for i in range(len(layout.categories))]
        self.numbers, self.flags = len(layout.numbers), len(layout.flags)
        self.first = 2 * self.numbers + self.flags
        self.size = self.first + sum(map(len, self.values)) + 1

    def matrix(self, batch: pd.DataFrame) -> np.ndarray:
        """Rows in the common columns: numbers (0 if missing), missing, flags, category values, one."""
        out = np.zeros((len(batch), self.size))
        numbers = np.array([[np.nan if x is None else x for x in row] for row in batch["numbers"]], float)
        missing = np.isnan(numbers)
        out[:, : self.numbers] = np.where(missing, 0.0, numbers)
        out[:, self.numbers : 2 * self.numbers] = missing
        out[:, 2 * self.numbers : self.first] = np.array(batch["flags"].tolist(), float)
        at = self.first
        for i, known in enumerate(self.values):
            own = np.array([row[i] for row in batch["values"]], object)
            for value in known:
                out[:, at] = own == value
                at += 1
        out[:, -1] = 1.0
        return out

    def map(self, model: Learned) -> np.ndarray:
        """Common columns to features (columns, the bias last)."""
        columns = []

        def feature(**at: float) -> None:
            column = np.zeros(self.size)
            for place, value in at.items():
                column[int(place[1:])] = value
            columns.append(column)

        one = f"c{self.size - 1}"
        for i, (_name, mean, spread) in enumerate(model.scales):
            feature(**{f"c{i}": 1 / spread, f"c{self.numbers + i}": mean / spread, one: -mean / spread})
            feature(**{f"c{self.numbers + i}": 1.0})
        for i in range(self.flags):
            feature(**{f"c{2 * self.numbers + i}": 1.0})
        at = self.first
        for (_name, values), known in zip(model.vocabulary, self.values, strict=True):
            places = {value: f"c{at + k}" for k, value in enumerate(known)}
            for value in values:
                feature(**{places[value]: 1.0})
            feature(**{places[value]: -1.0 for value in values}, **{one: 1.0})
            at += len(known)
        feature(**{one: 1.0})
        return np.stack(columns, axis=1)


def _sigmoid(score: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * score))


def _inside(batch: pd.DataFrame, models: list[Learned]) -> np.ndarray:
    """Which rows each model is trained on."""
    folds = np.array(batch["folds"].tolist(), int)
    return np.stack([folds[:, m.repeat] != m.fold for m in models], axis=1)


def _sums(rows: DataFrame, common: Common, models: list[Learned], scores: np.ndarray) -> dict[int, tuple]:
    """Per model at the given weights in the common columns: loss, gradient, curvature, and sums of probability x column."""
    size, count = common.size, len(models)
    schema = "model int, loss double, gradient binary, curvature binary, expected binary"

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loss, gradient, expected, curvature = np.zeros(count), np.zeros((size, count)), np.zeros((size, count)), np.zeros((count, size, size))
        any_ = False
        for batch in batches:
            any_ |= len(batch) > 0
            z, y, inside = common.matrix(batch), batch["passed"].to_numpy(float)[:, None], _inside(batch, models)
            score = z @ scores
            p = _sigmoid(score)
            loss += (np.where(inside, np.logaddexp(0.0, score) - y * score, 0.0)).sum(axis=0)
            gradient += z.T @ np.where(inside, p - y, 0.0)
            expected += z.T @ np.where(inside, p, 0.0)
            weight = np.where(inside, p * (1 - p), 0.0)
            for k in range(count):
                curvature[k] += (z * weight[:, k : k + 1]).T @ z
        if any_:
            yield pd.DataFrame({
                "model": range(count), "loss": loss, "gradient": [gradient[:, k].tobytes() for k in range(count)],
                "curvature": [c.tobytes() for c in curvature], "expected": [expected[:, k].tobytes() for k in range(count)],
            })

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[int, list] = {}
        for frame in frames:
            for k, loss, *parts in frame.itertuples(index=False):
                arrays = [np.frombuffer(x) for x in parts]
                old = totals.get(k)
                totals[k] = [loss, *arrays] if old is None else [old[0] + loss, *[a + b for a, b in zip(old[1:], arrays, strict=True)]]
        if totals:
            rows_ = [(k, loss, *[np.ascontiguousarray(x).tobytes() for x in arrays]) for k, (loss, *arrays) in totals.items()]
            yield pd.DataFrame(rows_, columns=["model", "loss", "gradient", "curvature", "expected"])

    out = {}
    needed = rows.select("passed", "numbers", "flags", "values", "folds")
    for r in needed.mapInPandas(part, schema).repartition("model").mapInPandas(add, schema).collect():
        out[r["model"]] = (r["loss"], np.frombuffer(r["gradient"]), np.frombuffer(r["curvature"]).reshape(size, size), np.frombuffer(r["expected"]))
    return out


def fit(rows: DataFrame, layout: Layout, models: list[Learned], l2: float) -> list[Learned]:
    """The models with weights and bias of least penalised loss; the penalty is on the weights, not on the bias.

    Newton steps for all models at once, halved for a model whose loss would rise; a model rests when a full step
    moves no parameter by ``RESTS``.
    """
    if not models:
        return []
    common = Common(layout, models)
    maps = [common.map(m) for m in models]
    at = [np.zeros(m.shape[1]) for m in maps]
    for model, beta in zip(models, at, strict=True):
        beta[-1] = np.log((model.passed + 0.5) / (model.rows - model.passed + 0.5))
    loss, step, scale = [np.inf] * len(models), [np.zeros_like(b) for b in at], [1.0] * len(models)
    active = set(range(len(models)))
    for _ in range(MOST_STEPS + MOST_HALVINGS):
        order = sorted(active)
        if not order:
            break
        tried = {k: at[k] - scale[k] * step[k] for k in order}
        scores = np.stack([maps[k] @ tried[k] for k in order], axis=1)
        sums = _sums(rows, common, [models[k] for k in order], scores)
        for place, k in enumerate(order):
            value, gradient, curvature, _ = sums[place]
            beta, penalty = tried[k], np.full(len(tried[k]), l2)
            penalty[-1] = 0.0
            value += 0.5 * float(penalty @ beta**2)
            if value > loss[k] + 1e-12 * abs(loss[k]):
                scale[k] /= 2
                if scale[k] < 2.0**-MOST_HALVINGS:
                    active.discard(k)
                continue
            own = maps[k].T @ curvature @ maps[k] + np.diag(penalty) + JITTER * np.eye(len(beta))
            at[k], loss[k], scale[k] = beta, value, 1.0
            step[k] = np.linalg.solve(own, maps[k].T @ gradient + penalty * beta)
            if np.abs(step[k]).max() < RESTS:
                at[k] = beta - step[k]
                active.discard(k)
    return [
        Learned(m.repeat, m.fold, m.rows, m.passed, m.scales, m.vocabulary, tuple(map(float, b[:-1])), float(b[-1])) for m, b in zip(models, at, strict=True)
    ]


def expected_sums(rows: DataFrame, layout: Layout, models: list[Learned], l2: float) -> list[tuple[int, int, str, float]]:
    """(repeat, fold, feature, value): over the training rows, probability x feature, plus penalty x weight.

    At the optimum that is the sum of the feature over the rows that passed, feature by feature.
    """
    common = Common(layout, models)
    maps = [common.map(m) for m in models]
    betas = [np.array([*m.weights, m.bias]) for m in models]
    sums = _sums(rows, common, models, np.stack([a @ b for a, b in zip(maps, betas, strict=True)], axis=1))
    out = []
    for k, model in enumerate(models):
        values = maps[k].T @ sums[k][3] + l2 * np.array([*model.weights, 0.0])
        out += [(model.repeat, model.fold, n, float(v)) for n, v in zip([*names(layout, model), "bias"], values, strict=True)]
    return out


def held_out(rows: DataFrame, layout: Layout, models: list[Learned]) -> DataFrame:
    """``patch_id, passed, rule_id, repeat, fold, by_model, base_rate`` of every row and repeat, by the model that left it out."""
    common = Common(layout, models)
    scores = np.stack([common.map(m) @ np.array([*m.weights, m.bias]) for m in models], axis=1)
    place = {(m.repeat, m.fold): k for k, m in enumerate(models)}
    rates = np.array([m.passed / m.rows for m in models])
    repeats = sorted({m.repeat for m in models})

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            p, folds = _sigmoid(common.matrix(batch) @ scores), np.array(batch["folds"].tolist(), int)
            for repeat in repeats:
                which = np.array([place[repeat, f] for f in folds[:, repeat]], int)
                yield pd.DataFrame({
                    "patch_id": batch["patch_id"], "passed": batch["passed"], "rule_id": batch["rule_id"], "repeat": repeat,
                    "fold": folds[:, repeat], "by_model": p[np.arange(len(batch)), which], "base_rate": rates[which],
                })

    kind = rows.schema["patch_id"].dataType.simpleString()
    return rows.mapInPandas(score, f"patch_id {kind}, passed boolean, rule_id string, repeat int, fold int, by_model double, base_rate double")
