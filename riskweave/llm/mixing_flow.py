"""Mixing sources to target weights as a min-cost flow over overlapping sources.

Documents are aggregated by membership pattern (the set of sources they belong to).  The flow routes words
from patterns to the quotas of their sources; a pattern's first, second and third use are arcs of its size
with rising (convex) costs, so repetition is spread before any document is used again.  The flow says how many
words of each pattern are taken; which documents is a seeded choice: all of them as often as whole uses
say, and for the rest those of least seeded hash, up to the words left, then of the next ``OFFERED`` documents
that fit into what is still missing, the largest first; while others still fit, the cut and this choice are repeated
over them.  So what a pattern misses is less than any unused document of it (that isn't used once more already).

Per-document work is one pass for sizes, one histogram of (pattern, hash bucket) and one running sum over the
single bucket in which a pattern's cut lies; no document is ever sorted with the rest of its source.  What
reaches the driver is one row per pattern.

Sources are ordered by code point, null last (null is a source of its own), and weigh ``WEIGHTS`` in turn.
They share all words by weight; a target stops at ``MOST`` times its source's words and the excess is shared
again by weight.

Defined results: a null text has 0 words; an empty table gives no rows; documents of equal id are taken together
(equally often); a source without words has target 0; ties of hash are broken by id; other columns are not
read, nor clash.
"""

from __future__ import annotations

import heapq
import json
from collections import defaultdict
from fractions import Fraction
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm.text import WORD
from riskweave.session import materialise

WEIGHTS = (1, 2, 3)
MOST = 3
#: Cost of a word's first, second and third use.
USES = (1, 4, 16)
BUCKETS = 4096
#: Documents after the cut, in seeded order, among which the ones that fill what is still missing are sought.
OFFERED = 256
SEED = 17


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], total: int, weights=WEIGHTS, most: int = MOST) -> dict[str | None, Fraction]:
    """Words wanted of each source."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {source: weights[at % len(weights)] for at, source in enumerate(order)}
    wanted: dict[str | None, Fraction] = {}
    open_, left = list(order), Fraction(total)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        above = [s for s in open_ if unit * weight[s] > most * sizes[s]]
        if not above:
            wanted.update({s: unit * weight[s] for s in open_})
            break
        for source in above:
            wanted[source] = Fraction(most * sizes[source])
            left -= wanted[source]
        open_ = [s for s in open_ if s not in wanted]
    return wanted


def min_cost_flow(
    patterns: list[tuple[tuple, int]], quotas: dict[str | None, int], uses: tuple[int, ...] = USES
) -> list[dict[str | None, int]]:
    """Words each pattern gives to each of its sources: most words first, then least cost.

    Successive shortest paths with potentials; patterns that share no source, however indirectly, are solved
    apart.
    """
    lead: dict = {}

    def find(x):
        while lead.setdefault(x, x) != x:
            lead[x] = lead[lead[x]]
            x = lead[x]
        return x

    for at, (members, _) in enumerate(patterns):
        for source in members:
            lead[find(("p", at))] = find(("s", source))
    groups = defaultdict(list)
    for at in range(len(patterns)):
        groups[find(("p", at))].append(at)
    given: list[dict[str | None, int]] = [{} for _ in patterns]
    for group in groups.values():
        _solve(group, patterns, quotas, uses, given)
    return given


def _solve(group, patterns, quotas, uses, given) -> None:
    sources = sorted({s for at in group for s in patterns[at][0]}, key=lambda s: (s is None, s or ""))
    node = {("p", at): 2 + i for i, at in enumerate(group)}
    node |= {("s", s): 2 + len(group) + i for i, s in enumerate(sources)}
    arcs: list[list[int]] = []  # to, room, cost; the arc back is at the number with the last bit turned
    out = defaultdict(list)

    def arc(a: int, b: int, room: int, cost: int) -> int:
        out[a].append(len(arcs))
        arcs.append([b, room, cost])
        out[b].append(len(arcs))
        arcs.append([a, 0, -cost])
        return len(arcs) - 2

    kept = {}
    for at in group:
        members, size = patterns[at]
        for cost in uses:
            arc(0, node["p", at], size, cost)
        for source in members:
            kept[at, source] = arc(node["p", at], node["s", source], size * len(uses), 0)
    for source in sources:
        arc(node["s", source], 1, quotas[source], 0)
    count = 2 + len(node)
    height = [0] * count
    while True:
        far, via = [None] * count, [None] * count
        far[0] = 0
        heap = [(0, 0)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for number in out[a]:
                b, room, cost = arcs[number]
                if room and (far[b] is None or d + cost + height[a] - height[b] < far[b]):
                    far[b], via[b] = d + cost + height[a] - height[b], number
                    heapq.heappush(heap, (far[b], b))
        if far[1] is None:
            break
        height = [h + (f if f is not None else 0) for h, f in zip(height, far, strict=True)]
        path, b = [], 1
        while b:
            path.append(via[b])
            b = arcs[via[b] ^ 1][0]
        flow = min(arcs[number][1] for number in path)
        for number in path:
            arcs[number][1] -= flow
            arcs[number ^ 1][1] += flow
    for (at, source), number in kept.items():
        given[at][source] = arcs[number ^ 1][1]


def pattern_of(members: Column) -> Column:
    """The set of sources a document belongs to, sorted, as JSON."""
    return F.to_json(F.array_sort(F.array_distinct(members)))


def sized(documents: DataFrame, members: Column, text: str = "text", doc_id: str = "doc_id", seed: int = SEED) -> DataFrame:
    """``doc_id, size, pattern, hash`` of every document; ``pattern`` is the sorted set of sources as JSON."""
    return documents.select(
        F.col(doc_id).alias("doc_id"), word_count(F.col(text)).alias("size"), pattern_of(members).alias("pattern"),
        F.xxhash64(doc_id, F.lit(seed)).alias("hash"),
    )


def plan(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> tuple[Cuts, DataFrame]:
    """Per pattern: whole uses and the seeded cut; per source: its words and its target."""
    spark = sizes.sparkSession
    rows = sizes.groupBy("pattern").agg(F.sum("size").alias("size")).collect()  # one row per pattern
    rows.sort(key=lambda row: row["pattern"])
    patterns = [(tuple(json.loads(row["pattern"])), row["size"], row["pattern"]) for row in rows]
    words: dict[str | None, int] = defaultdict(int)
    for members, size, _ in patterns:
        for source in members:
            words[source] += size
    wanted = targets(words, sum(size for _, size, _ in patterns), weights, most)
    quotas = {source: round(value) for source, value in wanted.items()}
    flow = min_cost_flow([(members, size) for members, size, _ in patterns], quotas, USES[:most])
    needed = []
    for (_, size, name), given in zip(patterns, flow, strict=True):
        whole, rest = divmod(sum(given.values()), size) if size else (0, 0)
        needed.append((name, whole, rest))
    uses = spark.createDataFrame(needed, "pattern string, whole long, rest long")
    facts = spark.createDataFrame(
        [(source, words[source], float(wanted[source])) for source in words], "source string, source_size long, target double"
    )
    return _cuts(sizes, uses), facts


def bucket(hashed: Column) -> Column:
    """The bucket of a hash; rises with it."""
    return F.shiftright(hashed, 52) + F.lit(BUCKETS // 2)


class Cuts(NamedTuple):
    """Which documents are used once more: those up to their pattern's cut, and ``extras`` (``pattern, doc_id``)."""

    cuts: DataFrame
    extras: DataFrame


def _cut(at: DataFrame, uses: DataFrame) -> DataFrame:
    """``pattern, rest, got, cut_hash, cut_id, inclusive`` of the patterns with more than ``rest`` words in ``at``."""
    at = at.withColumn("bucket", bucket(F.col("hash")))
    histogram = at.groupBy("pattern", "bucket").agg(F.sum("size").alias("n"))
    upto = F.expr("sum(n) over (partition by pattern order by bucket)")
    crossing = histogram.withColumn("upto", upto).join(uses.filter("rest > 0"), "pattern").filter("upto > rest")
    crossing = crossing.groupBy("pattern", "rest").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("n")).alias("before"))).alias("c"))
    crossing = crossing.select("pattern", "rest", "c.bucket", "c.before")
    # Only the one bucket of each pattern in which the cut lies is summed row by row; equal ids are peers.
    inside = at.join(crossing, ["pattern", "bucket"]).withColumn(
        "upto", F.col("before") + F.expr("sum(size) over (partition by pattern order by hash, doc_id nulls first)")
    )
    last = inside.filter("upto <= rest").groupBy("pattern").agg(F.max(F.struct("upto", "hash", F.struct("doc_id").alias("id"))).alias("l"))
    cuts = crossing.join(last, "pattern", "left").select(
        "pattern", "rest", F.coalesce("l.upto", "before").alias("got"),
        # Without a document of the bucket before the cut, the cut is the end of the bucket before.
        F.coalesce("l.hash", F.shiftleft(F.col("bucket").cast("long") - BUCKETS // 2, 52)).alias("cut_hash"),
        F.col("l.id").alias("cut_id"), F.col("l").isNotNull().alias("inclusive"),
    )
    return materialise(cuts)


def _filled(others: DataFrame) -> DataFrame:
    """Of the first ``OFFERED`` documents of each pattern, the largest that fit its ``gap``: ``pattern, ids, left, n, last``."""
    nth = F.row_number().over(Window.partitionBy("pattern").orderBy("hash", "doc_id"))
    offered = others.withColumn("nth", nth).filter(F.col("nth") <= OFFERED).groupBy("pattern").agg(
        F.sort_array(F.collect_list(F.struct("size", "hash", F.struct("doc_id").alias("id"))), asc=False).alias("offers"),
        F.first("gap").alias("gap"), F.count("*").alias("n"), F.max(F.struct("hash", "doc_id")).alias("last"),
    )
    filled = F.expr(
        """aggregate(offers, named_struct('left', gap, 'ids', transform(slice(offers, 1, 0), x -> x.id)),
           (a, x) -> if(x.size <= a.left, named_struct('left', a.left - x.size, 'ids', concat(a.ids, array(x.id))), a))"""
    )
    return materialise(offered.withColumn("f", filled).select("pattern", "f.ids", "f.left", "n", "last"))


def _cuts(sizes: DataFrame, uses: DataFrame) -> Cuts:
    """The seeded cut, and the documents after it that fill what is still missing, until none fits.

    The cut stops before the first document that would pass it.  Of those after it that fit the gap the first ``OFFERED``
    are tried; where more than they are needed, the cut is repeated over the others that fit, and so on.
    """
    cuts = _cut(sizes, uses)
    others = sizes.groupBy("pattern", "hash", "doc_id").agg(F.sum("size").alias("size")).join(cuts, "pattern")
    gap = F.col("rest") - F.col("got")
    fits = ~before_cut() & (F.col("size") > 0) & (F.col("size") <= F.col("gap"))
    names = ("pattern", "hash", "doc_id", "size", "gap")
    others = materialise(others.withColumn("gap", gap).filter(fits).select(*names))
    extras = []
    while True:
        filled = _filled(others)
        extras.append(filled.select("pattern", F.explode("ids").alias("id")).select("pattern", "id.doc_id"))
        # All that were offered have been taken or do not fit any more.
        state = filled.filter((F.col("n") == OFFERED) & (F.col("left") > 0)).select("pattern", "left", "last")
        after = others.drop("gap").join(F.broadcast(state), "pattern").filter("struct(hash, doc_id) > last and size <= left")
        after = materialise(after.select("pattern", "hash", "doc_id", "size", F.col("left").alias("gap")))
        if after.isEmpty():
            break
        wanted = after.groupBy("pattern").agg(F.first("gap").alias("rest"))
        marked = after.join(F.broadcast(_cut(after, wanted)), "pattern", "left")
        # A pattern without a cut has no more than is wanted: all are taken.
        extras.append(marked.filter(F.col("rest").isNull() | before_cut()).select("pattern", "doc_id"))
        others = materialise(marked.filter("rest is not null").withColumn("gap", gap).filter(fits).select(*names))
        if others.isEmpty():
            break
    table = materialise(uses.join(cuts.drop("rest", "got"), "pattern", "left"))
    return Cuts(table, materialise(reduce(DataFrame.unionAll, extras)))


def before_cut() -> Column:
    """Whether a row's ``(hash, doc_id)`` lies at or before its pattern's cut."""
    same = (F.col("hash") == F.col("cut_hash")) & F.col("inclusive")
    upto = F.col("doc_id").isNull() | (F.col("doc_id") <= F.col("cut_id.doc_id"))
    return F.coalesce((F.col("hash") < F.col("cut_hash")) | (same & F.coalesce(upto, F.lit(False))), F.lit(False))


def copies(sizes: DataFrame, cuts: Cuts) -> DataFrame:
    """``sizes`` with ``copies``: how often the mix uses each document."""
    extras = cuts.extras.select(F.col("pattern").alias("_pattern"), F.col("doc_id").alias("_id"), F.lit(True).alias("_extra"))
    used = sizes.join(cuts.cuts, "pattern")
    used = used.join(extras, (F.col("pattern") == F.col("_pattern")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    once_more = F.when(before_cut() | F.col("_extra").isNotNull(), 1).otherwise(0)
    used = used.withColumn("copies", (F.col("whole") + once_more).cast("long"))
    return used.drop("whole", "rest", "cut_hash", "cut_id", "inclusive", "_pattern", "_id", "_extra")


def mixing(documents: DataFrame) -> DataFrame:
    """Per document: its size, its source's words and target, and the words the mix takes of it."""
    sizes = materialise(sized(documents, F.array("source")).withColumn("source", F.get(F.from_json("pattern", "array<string>"), F.lit(0))))
    cuts, facts = plan(sizes)
    used = copies(sizes, cuts).alias("u").join(facts.alias("f"), F.col("u.source").eqNullSafe(F.col("f.source")))
    return used.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
