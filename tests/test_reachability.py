"""Propagation over edge tables: against a plain worklist, and in few rounds."""

import numpy as np
import pytest

from riskweave import dims
from riskweave.operators import reachability

NODES, EDGES = "id long, origin string, line long, safe_for array<string>", "src long, dst long, safe_for array<string>"
KINDS = dims.KINDS[:3]


def plain(nodes, edges):
    best, waiting = {}, [(i, k, o, line) for i, o, line, safe in nodes for k in KINDS if k not in safe]
    after = {}
    for src, dst, safe in edges:
        after.setdefault(src, []).append((dst, safe))
    while waiting:
        i, k, o, line = waiting.pop()
        if (i, k, o) in best and best[i, k, o] <= line:
            continue
        best[i, k, o] = line
        waiting += [(dst, k, o, line) for dst, safe in after.get(i, []) if k not in safe]
    return best


def some(random):
    return [k for k in KINDS if random.random() < 0.2]


def graph(kind, random):
    """Edges of a shape that contraction has to get right."""
    if kind == "tree":
        return [(int(random.integers(0, i)), i, some(random)) for i in range(1, 90)]
    if kind == "ladder":  # two ways at every step, which merge again
        return [e for i in range(0, 90, 3) for e in ((i, i + 1, some(random)), (i, i + 2, some(random)), (i + 1, i + 3, some(random)), (i + 2, i + 3, some(random)))]
    if kind == "ring":  # a ring that nothing enters, a chain from it, and a ring that is entered
        ring = [(i, (i + 1) % 9, some(random)) for i in range(9)] + [(3, 20, []), (20, 21, [])]
        return ring + [(30, 31, []), (31, 32, []), (32, 33, []), (33, 31, some(random)), (33, 34, [])]
    if kind == "double":
        return [(0, 1, ["command"]), (0, 1, ["code"]), (1, 2, []), (2, 2, []), (2, 3, some(random)), (2, 3, [])]
    n = 40 if kind == "sparse" else 25
    return [(int(random.integers(0, n)), int(random.integers(0, n)), some(random)) for _ in range(45 if kind == "sparse" else 120)]


@pytest.mark.parametrize("kind", ["tree", "ladder", "ring", "double", "sparse", "dense"])
def test_states_against_a_worklist(spark, kind):
    random = np.random.default_rng(len(kind))
    edges = graph(kind, random)
    ids = sorted({e[0] for e in edges} | {e[1] for e in edges})
    nodes = [(int(random.choice(ids)), str(random.choice([dims.INPUT, dims.RANDOM, dims.OPAQUE])), int(random.integers(1, 50)), some(random)) for _ in range(4)]
    nodes += [(30, dims.INPUT, 5, [])] if kind == "ring" else [(0, dims.INPUT, 5, [])]
    nodes = [x for x in nodes if kind != "ring" or x[0] >= 20]
    state = reachability.propagate(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES), KINDS)
    assert {(r["id"], r["kind"], r["origin"]): r["source"] for r in state.collect()} == plain(nodes, edges)


def test_a_long_chain_in_few_rounds(spark, monkeypatch):
    edges = [(i, i + 1, ["code"] if i == 7000 else []) for i in range(10_000)]
    nodes = spark.createDataFrame([(0, dims.INPUT, 7, [])], NODES)
    written, plain_write = [], reachability.materialise
    monkeypatch.setattr(reachability, "materialise", lambda frame: written.append(frame) or plain_write(frame))
    state = reachability.propagate(nodes, spark.createDataFrame(edges, EDGES), ("command", "code")).checkpoint()
    assert len(written) <= 24
    assert state.filter("kind = 'command'").count() == 10_001 and state.filter("kind = 'code'").count() == 7001
    assert state.filter("id = 10000").first()["source"] == 7


def test_nothing_to_propagate(spark):
    empty = spark.createDataFrame([], EDGES)
    assert reachability.propagate(spark.createDataFrame([], NODES), empty).count() == 0
    assert reachability.propagate(spark.createDataFrame([(1, dims.INPUT, 2, [])], NODES), empty, KINDS).count() == 3
