"""Flow inside one file, with calls of its own functions matched to their returns.

No edge leaves a file, so a file's graph is solved where its rows meet: one shuffle by file, no rounds.  Rows arrive in order
of their file, and a task holds those of one file at a time; a file is at most what was parsed at once.

Inside a function its parameters are names for whatever a caller may give.  Where such a name reaches a return, every call gets
a summary edge from that argument to its own result, for the kinds of use that got through; where it reaches a sink, an edge from the
argument to the sink.  A value that enters by one call can therefore not leave by another.  Functions that call each other,
or themselves, settle together, since a summary only ever adds edges.  What a function makes of its own goes to the result of all
its calls.  A sink that only an unknown caller's value reaches is unknown.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave import dims

LEVELS = "id string, kind string, level string, source bigint"
LEVELS_SCHEMA = pa.schema([("id", pa.string()), ("kind", pa.string()), ("level", pa.string()), ("source", pa.int64())])
RANDOM_KIND = "random"
#: Columns of a tagged row, after its file.
TAGGED = ("tag", "a", "b", "name", "line", "safe_for")
#: Rows of a batch that is handed back.
BATCH = 8192


def levels_of(rows: Iterable[tuple]) -> list[tuple]:
    """Levels of the sinks of one file, from tagged rows (see ``solved``)."""
    steps: dict[str, list] = defaultdict(list)
    gates: dict[tuple[str, str], set[str]] = defaultdict(set)
    known: dict[str, dict] = defaultdict(dict)
    returns, results, arguments = {}, defaultdict(list), defaultdict(list)
    sinks: dict[str, set[str]] = defaultdict(set)
    waiting: deque = deque()

    def reach(node: str, kind: str, origin: object, source: int) -> None:
        old = known[node].get((kind, origin))
        if old is None or source < old:
            known[node][kind, origin] = source
            waiting.append((node, kind, origin))

    def opened(start: str, end: str, kind: str) -> None:
        if end not in gates[start, kind]:
            gates[start, kind].add(end)
            for (k, origin), source in list(known[start].items()):
                if k == kind:
                    reach(end, kind, origin, source)

    rows = list(rows)
    asked = {name for tag, _, _, name, _, _ in rows if tag == "sink"}
    if not asked:
        return []
    # Kinds never mix: only those that are asked for are followed.  A random value is one of any kind.
    followed = [kind for kind in dims.KINDS if kind in asked or RANDOM_KIND in asked]
    begins = []
    for tag, a, b, name, line, safe in rows:
        if tag == "edge":
            steps[a].append((b, frozenset(safe)))
        elif tag == "node":
            begins += [(a, kind, name, line) for kind in followed if kind not in safe]
        elif tag == "parameter":
            begins += [(a, kind, (b, name), line) for kind in followed]
        elif tag == "return":
            returns[a] = b
        elif tag == "call":
            results[b].append(a)
        elif tag == "argument":
            function, result = b.split("\x00")
            arguments[function, name].append((a, result))
        else:
            sinks[a].add(name)
    for begin in begins:
        reach(*begin)
    while waiting:
        node, kind, origin = waiting.popleft()
        source = known[node][kind, origin]
        for end, safe in steps[node]:
            if kind not in safe:
                reach(end, kind, origin, source)
        for end in list(gates[node, kind]):
            reach(end, kind, origin, source)
        given = isinstance(origin, tuple)
        function = returns.get(node)
        if function is not None:
            if given and origin[0] == function:
                for argument, result in arguments[origin]:
                    opened(argument, result, kind)
            elif not given:
                for result in results[function]:
                    reach(result, kind, origin, source)
        # What a helper returns is not what a browser receives: its return is no sink of what a caller gave.
        if given and function is None and (kind in sinks[node] or RANDOM_KIND in sinks[node]):
            for argument, _ in arguments[origin]:
                opened(argument, node, kind)
    out = []
    for node, kinds in sinks.items():
        for kind in kinds:
            reasons = {(k, o): s for (k, o), s in known[node].items() if k == kind}
            if kind == RANDOM_KIND:
                made = [s for (_, o), s in known[node].items() if o == dims.RANDOM]
                out += [(node, kind, dims.TAINTED, min(made))] if made else []
                continue
            # Nor is it a sink of what the helper reads itself: that goes to the calls of this file.
            inside = node in returns and bool(results[returns[node]])
            given = [s for (_, o), s in reasons.items() if o == dims.INPUT and not inside]
            unsure = any(inside or o == dims.OPAQUE or isinstance(o, tuple) for _, o in reasons)
            out.append((node, kind, dims.TAINTED if given else dims.UNKNOWN if unsure else dims.CLEAN, min(given, default=None)))
    return out


def _file_by_file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Levels of all files of a task, whose rows come in order of their file; a file may go on in the next batch."""

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else ((),) * len(LEVELS_SCHEMA)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, LEVELS_SCHEMA, strict=True)], schema=LEVELS_SCHEMA)

    current, held, out = None, [], []
    for batch in batches:
        for file, *row in zip(*[batch.column(name).to_pylist() for name in ("file", *TAGGED)], strict=True):
            if held and file != current:
                out += levels_of(held)
                held = []
                if len(out) >= BATCH:
                    yield made(out)
                    out = []
            current = file
            held.append(tuple(row))
    yield made(out + levels_of(held))


def solved(
    nodes: DataFrame, edges: DataFrame, sinks: DataFrame, parameters: DataFrame, returns: DataFrame, calls: DataFrame, arguments: DataFrame,
    file_of: Column,
) -> DataFrame:
    """``id, kind, level, source`` of all sinks.

    ``nodes (id, origin, line, safe_for)``, ``edges (src, dst, safe_for)``, ``sinks (id, kind)``, ``parameters (id, function, name,
    line)``, ``returns (id, function)``, ``calls (id, function)`` with the node of the result, ``arguments (id, function, name, result)``;
    ``file_of`` names the file of ``a``, the first node of a row.
    """
    none, line, nothing = F.lit(None).cast("string"), F.lit(0).cast("bigint"), F.array().cast("array<string>")

    def tagged(rows: DataFrame, tag: str, a: str, b: Column = none, name: Column = none, line: Column = line, safe: Column = nothing) -> DataFrame:
        own = (F.col(a).alias("a"), b.alias("b"), name.alias("name"), line.cast("bigint").alias("line"), safe.alias("safe_for"))
        return rows.select(F.lit(tag).alias("tag"), *own)

    every = (
        tagged(nodes, "node", "id", name=F.col("origin"), line=F.col("line"), safe=F.col("safe_for"))
        .unionByName(tagged(edges.filter("src is not null and dst is not null"), "edge", "src", F.col("dst"), safe=F.col("safe_for")))
        .unionByName(tagged(sinks, "sink", "id", name=F.col("kind")))
        .unionByName(tagged(parameters, "parameter", "id", F.col("function"), F.col("name"), F.col("line")))
        .unionByName(tagged(returns, "return", "id", F.col("function")))
        .unionByName(tagged(calls, "call", "id", F.col("function")))
        .unionByName(tagged(arguments, "argument", "id", F.concat("function", F.lit("\x00"), "result"), F.col("name")))
    )
    placed = every.select(file_of.alias("file"), *TAGGED)
    return placed.repartition("file").sortWithinPartitions("file").mapInArrow(_file_by_file, LEVELS)
