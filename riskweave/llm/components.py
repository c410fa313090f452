"""Connected components of links, without collecting them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.session import materialise


def components(links: DataFrame) -> DataFrame:
    """``id, component`` for every end of ``links (a, b)``: the least id reachable.

    Every node hooks to its least smaller neighbour, which makes a forest; pointers are halved until they rest;
    the links between trees are contracted and the rest goes round again.  Every step is written to the shared
    folder, so lineage stays short and a lost executor repeats one step.
    """
    rest = materialise(_distinct(links.select("a", "b")))
    labels = None
    while not rest.isEmpty():
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = both.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("id"), F.least("a", "p").alias("p"))
        parents = materialise(parents)
        while True:
            up = parents.select(F.col("id").alias("p"), F.col("p").alias("pp"))
            jumped = materialise(parents.join(up, "p").select("id", F.col("pp").alias("p"), (F.col("p") != F.col("pp")).alias("moved")))
            parents = jumped.select("id", "p")
            if jumped.filter("moved").isEmpty():
                break
        if labels is None:
            labels = parents.select("id", F.col("p").alias("component"))
        else:
            labels = materialise(relabelled(labels, parents.select(F.col("id").alias("component"), "p")))
        to = parents.select(F.col("id"), F.col("p"))
        moved = rest.join(to.select(F.col("id").alias("a"), F.col("p").alias("pa")), "a")
        moved = moved.join(to.select(F.col("id").alias("b"), F.col("p").alias("pb")), "b")
        rest = materialise(_distinct(moved.select(F.col("pa").alias("a"), F.col("pb").alias("b"))))
    if labels is None:
        return rest.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return labels


def relabelled(labels: DataFrame, to: DataFrame) -> DataFrame:
    """``labels (id, component)`` with components replaced by ``to (component, p)`` where it names them."""
    joined = labels.join(to, "component", "left")
    return joined.select("id", F.coalesce("p", "component").alias("component"))


def _distinct(links: DataFrame) -> DataFrame:
    ends = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return ends.distinct()
