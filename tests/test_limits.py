"""Nothing is cut short or done otherwise by size."""

import hashlib

import pytest
from pyspark.sql import functions as F

from riskweave import dims
from riskweave.functions import stats
from riskweave.operators import diffs, evaluation, reachability, secrets


def test_long_diff_lines_are_whole(spark):
    long = "x" * 1_200_000
    diff = f"--- a/f.py\n+++ b/f.py\n@@ -1 +1 @@\n-a\n+{long}\n"
    table = spark.createDataFrame([(1, "f.py", diff)], "patch_id long, file_path string, diff string")
    added = diffs.diff_lines(table).filter("kind = '+'").select(F.length("text")).first()[0]
    assert added == 1_200_000
    moved = spark.createDataFrame([("  " + long, "    y")], "r string, o string")
    out = moved.select(F.length(diffs.reindent_replacement(F.col("r"), F.col("o")))).first()[0]
    assert out == 1_200_004


def test_a_flow_of_two_hundred_steps(spark):
    edges = [(i, i + 1, []) for i in range(200)]
    nodes = spark.createDataFrame([(0, dims.INPUT, 7, [])], "id long, origin string, line long, safe_for array<string>")
    table = spark.createDataFrame(edges, "src long, dst long, safe_for array<string>")
    state = reachability.propagate(nodes, table, kinds=dims.KINDS[:1])
    assert state.count() == 201 and state.filter("id = 200").first()["source"] == 7


@pytest.mark.parametrize("cases", [3, 120_000])
def test_one_hash_at_every_size(spark, cases):
    rows = spark.range(cases).select(F.concat(F.lit("c"), "id").alias("name"), (F.col("id") % 2 == 0).alias("reported"))
    found = evaluation.outcomes_hash(rows).first()
    level = {}
    for i in range(cases):
        name = f"c{i}"
        level.setdefault(hashlib.sha256(name.encode()).hexdigest()[:4], []).append(f"{name},{int(i % 2 == 0)}")
    for digits in (2, 0, 0):
        above = {}
        for key, leaves in level.items():
            above.setdefault(key[:digits], []).append(hashlib.sha256("\n".join(sorted(leaves)).encode()).hexdigest())
        level = above
    assert (found["cases"], found["outcomes_sha256"]) == (cases, level[""][0])


def test_mcnemar_of_large_counts(spark):
    row = spark.range(1).select(stats.mcnemar_exact(F.lit(499_000), F.lit(501_000)).alias("p")).first()
    assert 0.045 < row["p"] < 0.046


def test_secrets_past_many_lines_and_long_names(spark):
    header = "-----BEGIN RSA PRIVATE KEY-----"
    after = [f"X-Attribute: {i}" for i in range(9)] + [""] * 2 + ["A" * 64]
    row = spark.createDataFrame([(header, after)], "line string, after array<string>")
    assert row.select(secrets.private_key_body(F.col("line"), F.col("after"))).first()[0]
    name = "a_" * 60 + "password"
    line = spark.createDataFrame([(f'{name} = "S3cr3t-Value-99"',)], "line string")
    assert line.select(secrets.generic_assignment(F.lit("a.py"), F.col("line"))["name"]).first()[0] == name
