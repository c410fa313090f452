"""Statistics as Columns: rates, intervals and exact tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed value: two-sided 95 % ---
Z_95 = 1.959963984540054


def ratio(part: Column, whole: Column) -> Column:
    """NULL, not zero, when there is nothing to be a share of."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def rates(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    recall = ratio(tp, tp + fn)
    false_positive_rate = ratio(fp, fp + tn)
    return {
        "recall": recall,
        "false_positive_rate": false_positive_rate,
        "precision": ratio(tp, tp + fp),
        "accuracy": ratio(tp + tn, tp + fp + tn + fn),
        "f1": ratio(2 * tp, 2 * tp + fp + fn),
        "score": recall - false_positive_rate,
    }


def wilson(successes: Column, trials: Column, z: float = Z_95) -> tuple[Column, Column]:
    """Wilson interval of a proportion; exact at both ends, NULL without trials."""
    n = F.nullif(trials.cast("double"), F.lit(0.0))
    p = successes.cast("double") / n
    scale = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / scale
    margin = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / scale
    low = F.when(n.isNull(), None).when(successes == 0, 0.0).otherwise(F.greatest(F.lit(0.0), centre - margin))
    high = (
        F.when(n.isNull(), None).when(successes == trials, 1.0)
        .otherwise(F.least(F.lit(1.0), centre + margin))
    )
    return low, high


def newcombe(tp: Column, fp: Column, tn: Column, fn: Column) -> tuple[Column, Column]:
    """Interval of recall minus false-positive rate, from the two Wilson intervals."""
    named = rates(tp, fp, tn, fn)
    recall, rate = named["recall"], named["false_positive_rate"]
    recall_low, recall_high = wilson(tp, tp + fn)
    rate_low, rate_high = wilson(fp, fp + tn)
    below = F.hypot(recall - recall_low, rate_high - rate)
    above = F.hypot(recall_high - recall, rate - rate_low)
    return recall - rate - below, recall - rate + above


def _log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series, shifted so that small n are as exact as large ones."""
    x = n.cast("double") + 8.0
    series = (
        (x - 0.5) * F.ln(x) - x + 0.9189385332046727
        + 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3.0)))
        + 1 / (1260 * F.pow(x, F.lit(5.0))) - 1 / (1680 * F.pow(x, F.lit(7.0)))
    )
    shift = F.ln(
        (x - 1) * (x - 2) * (x - 3) * (x - 4) * (x - 5) * (x - 6) * (x - 7)
    )
    return series - shift


def mcnemar_exact(only_first: Column, only_second: Column) -> Column:
    """Exact two-sided McNemar p-value; NULL when no case was judged differently.

    The tail is summed in log space relative to its largest term.  Terms fall off from the
    largest one, and all of them are summed.
    """
    n = (only_first + only_second).cast("bigint")
    k = F.least(only_first, only_second).cast("bigint")
    log_top = _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) - n * F.ln(F.lit(2.0))
    steps = F.sequence(F.lit(0).cast("bigint"), k)

    start = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("total"))

    def step(acc: Column, j: Column) -> Column:
        i = (k - j).cast("double")
        return F.struct(
            (acc["term"] * i / (n.cast("double") - i + 1)).alias("term"),
            (acc["total"] + acc["term"]).alias("total"),
        )

    total = F.aggregate(steps, start, step, lambda acc: acc["total"])
    return F.when(n > 0, F.least(F.lit(1.0), F.exp(F.ln(F.lit(2.0)) + log_top + F.ln(total))))
