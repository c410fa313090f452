import math

import pytest
from pyspark.sql import functions as F

from riskweave.functions import hashing, stats


def one(spark, schema, values, *columns):
    return spark.createDataFrame([values], schema).select(*columns).first()


@pytest.mark.parametrize(("a", "b", "p"), [(0, 178, 5.22e-54), (100, 345, 1.31e-32), (0, 1, 1.0), (5, 5, 1.0), (0, 5, 0.0625), (1, 8, 0.0390625)])
def test_mcnemar(spark, a, b, p):
    got = one(spark, "a bigint, b bigint", (a, b), stats.mcnemar_exact(F.col("a"), F.col("b")).alias("p")).p
    assert got == pytest.approx(p, rel=5e-3)


def test_mcnemar_agrees_with_the_exact_sum(spark):
    rows = [(a, b) for a in range(0, 40, 3) for b in range(1, 60, 7)]
    got = spark.createDataFrame(rows, "a bigint, b bigint").select("a", "b", stats.mcnemar_exact(F.col("a"), F.col("b")).alias("p")).collect()
    for r in got:
        n, k = r.a + r.b, min(r.a, r.b)
        exact = min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)
        assert r.p == pytest.approx(exact, rel=1e-7)


def test_wilson_ends_are_exact(spark):
    low, high = stats.wilson(F.col("k"), F.col("n"))
    rows = spark.createDataFrame([(0, 10), (10, 10), (0, 0), (81, 263)], "k bigint, n bigint").select("k", low.alias("l"), high.alias("h")).collect()
    assert rows[0].l == 0.0 and rows[1].h == 1.0 and rows[2].l is None
    # A published worked example: 81 of 263.
    assert (round(rows[3].l, 4), round(rows[3].h, 4)) == (0.2553, 0.3662)


def test_newcombe_published_example(spark):
    # 56 of 70 against 48 of 80: 0.0524 to 0.3339.
    low, high = stats.newcombe(*[F.col(c) for c in ("tp", "fp", "tn", "fn")])
    r = one(spark, "tp bigint, fp bigint, tn bigint, fn bigint", (56, 48, 32, 14), low.alias("l"), high.alias("h"))
    assert (round(r.l, 4), round(r.h, 4)) == (0.0524, 0.3339)


def test_split_is_by_name_alone(spark):
    rows = spark.createDataFrame([(f"Case{i}",) for i in range(400)], "name string").select(hashing.split_half(F.col("name")).alias("s")).collect()
    assert 140 < sum(r.s == "development" for r in rows) < 260
