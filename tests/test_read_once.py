"""What is dear to make is made or moved once."""

from pyspark.sql import functions as F

from riskweave.operators import reachability
from riskweave.sinks import reports


def test_random_origins_are_not_moved(spark, monkeypatch):
    moved = []
    whole = reachability.propagate

    def propagate(nodes, edges):
        moved.extend(sorted(r.origin for r in nodes.select("origin").collect()))
        return whole(nodes, edges)

    monkeypatch.setattr(reachability, "propagate", propagate)
    shape = "id bigint, origin string, line bigint, safe_for array<string>"
    nodes = spark.createDataFrame([(1, "input", 5, []), (2, "random", 6, []), (3, "opaque", 7, [])], shape)
    edges = spark.createDataFrame([(i, 10 + i, []) for i in (1, 2, 3)], "src bigint, dst bigint, safe_for array<string>")
    sinks = spark.createDataFrame([(10 + i, "path") for i in (1, 2, 3)], "id bigint, kind string")
    found = {(r.id, r.level, r.source) for r in reachability.taint_reachability(nodes, edges, sinks).collect()}
    assert found == {(11, "tainted", 5), (12, "clean", None), (13, "unknown", None)}
    assert moved == ["input", "opaque"]


def test_a_json_report_is_read_once(spark):
    made = spark.range(4).select(
        F.lit(1).alias("repository_id"), *[F.lit("x").alias(n) for n in reports.JSON_FIELDS if n not in ("id", "score", "line_start")],
        "id", F.lit(2.0).alias("score"), F.lit(3).alias("line_start"), F.lit(0).alias("severity_rank"),
        F.when(F.col("id") == 0, "fixed").when(F.col("id") < 3, "open").alias("part"),
    )
    risk = spark.createDataFrame(
        [(1, 5.0, "A", 2, 1, 0, 0, 0, 0, 0, 1)],
        "repository_id int, score double, grade string, open int, fixed int, critical int, high int, medium int, low int, info int, policy_version int",
    )
    document = reports.export_report_json(made, risk)
    assert sorted((r.section, r.k5) for r in document.collect()) == [(0, None), (1, 1), (1, 2), (2, 0)]
    assert document._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 4") == 1
