"""Repair of conversation structure with an audit of least cost.

Turns are kept (K), given another role (R), deleted (D) or inserted (I) so that the initials of the roles read
``(s?(ua)+)?``.  Costs are those of ``COSTS``; blank and duplicate turns must go, a truncated one that stays costs ``TRUNCATED`` more.  Of the
cheapest audits the one of least characters is chosen.

Dynamic programming over the turns with four states (nothing yet, after the system turn, after a user, after an
assistant).  The audit of a state is a node of a persistent ``Trail``: a letter, its prefix as a parent, ancestors at all
powers of two, and the rolling hash of the whole string; prefixes are shared and made once.  Two audits of equal cost are compared
by lifting both to one depth and searching the longest common prefix down the ancestors: different hashes differ, equal
ones are verified by the node itself, as equal strings are one node.  The least audit of a state is enough: what an audit
costs follows from its letters, so of two of equal cost neither is a beginning of the other.

A conversation may hold any share of all rows.  Rows are ordered by range partitions into chunks; a chunk gives, for
each of its conversations, the best audit from every state it can begin in to every state it can end in, a segment.
Segments of a conversation are joined by the same programme, a piece of audit for a letter.  Then every chunk renders its own
turns from its piece.  So turns of one conversation meet in no single task; what a task holds of it is four pieces of audit per segment.

Defined results: null role or text is one space; turns are ordered by number (null first), then role, then the SHA-256 of the text,
rows equal in all that are interchangeable; rows without a conversation id are one conversation of their own; a role that
begins with no s, u or a (an empty one too) can't be kept; an empty table gives no rows; texts are carried whole; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.text import CRC_SQL
from riskweave.session import materialise

COSTS = {"K": 0, "R": 3, "D": 4, "I": 3}
TRUNCATED = 3
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: Rows of a chunk, on average at most.
CHUNK_ROWS = 20_000
SPACE = " \t\n\x0b\x0c\r"
MODULUS, BASE = (1 << 61) - 1, 1_000_003


class Trail:
    """Strings as nodes that share their beginnings; node 0 is the empty string."""

    def __init__(self) -> None:
        self.parent, self.piece, self.hash = [0], [""], [0]
        #: Ancestors 1, 2, 4, .. steps up.
        self.ancestors: list[list[int]] = [[]]
        self.depth = [0]
        self.known: dict[tuple[int, str], int] = {}

    def extended(self, node: int, piece: str) -> int:
        """The node of ``node``'s string followed by ``piece``."""
        at = self.known.get((node, piece))
        if at is None:
            at = self.known[node, piece] = len(self.parent)
            ancestors, up = self.ancestors, [node]
            while len(ancestors[up[-1]]) >= len(up):
                up.append(ancestors[up[-1]][len(up) - 1])
            ancestors.append(up)
            value = self.hash[node]
            for letter in piece:
                value = (value * BASE + ord(letter)) % MODULUS
            self.hash.append(value)
            self.parent.append(node)
            self.piece.append(piece)
            self.depth.append(self.depth[node] + 1)
        return at

    def lifted(self, node: int, depth: int) -> int:
        """The ancestor of ``node`` at ``depth``."""
        steps = self.depth[node] - depth
        while steps:
            power = steps.bit_length() - 1
            node = self.ancestors[node][power]
            steps -= 1 << power
        return node

    def path(self, node: int, above: int = 0) -> list[str]:
        """Pieces from below ``above`` down to ``node``."""
        out = []
        while node != above:
            out.append(self.piece[node])
            node = self.parent[node]
        return out[::-1]

    def less(self, a: int, b: int) -> bool:
        """Whether the string of ``a`` comes before that of ``b``."""
        depth = min(self.depth[a], self.depth[b])
        x, y = self.lifted(a, depth), self.lifted(b, depth)
        if x == y:
            return self.depth[a] < self.depth[b]
        for power in range(len(self.ancestors[x]) - 1, -1, -1):
            if power < len(self.ancestors[x]):
                u, v = self.ancestors[x][power], self.ancestors[y][power]
                # An equal hash is no proof: equal strings are the same node.
                if self.hash[u] != self.hash[v] or u != v:
                    x, y = u, v
        one, two = self.piece[x], self.piece[y]
        if one.startswith(two) or two.startswith(one):
            above = self.parent[x]
            one, two = "".join(self.path(a, above)), "".join(self.path(b, above))
        return one < two


Best = list[tuple[int, int] | None]


def _offer(trail: Trail, best: Best, state: int, cost: int, node: int, piece: str) -> bool:
    now = best[state]
    if now is not None and now[0] < cost:
        return False
    at = trail.extended(node, piece)
    if now is None or cost < now[0] or (at != now[1] and trail.less(at, now[1])):
        best[state] = (cost, at)
        return True
    return False


def with_inserts(trail: Trail, best: Best) -> None:
    """Let every state be reached by inserted turns as well."""
    moved = True
    while moved:
        moved = False
        for state in range(4):
            if best[state] is not None:
                cost, node = best[state]
                moved |= _offer(trail, best, ASSISTANT if state == USER else USER, cost + COSTS["I"], node, "I")


def with_turn(trail: Trail, best: Best, initial: str, gone: bool, truncated: bool) -> Best:
    """The states after one more turn."""
    with_inserts(trail, best)
    after: Best = [None] * 4
    stays = TRUNCATED if truncated else 0
    for state in range(4):
        if best[state] is None:
            continue
        cost, node = best[state]
        _offer(trail, after, state, cost + COSTS["D"], node, "D")
        if gone:
            continue
        if initial == "s" and state == NOTHING:
            _offer(trail, after, SYSTEM, cost + stays + COSTS["K"], node, "K")
        to = ASSISTANT if state == USER else USER
        if initial == ("a" if to == ASSISTANT else "u"):
            _offer(trail, after, to, cost + stays + COSTS["K"], node, "K")
        else:
            _offer(trail, after, to, cost + stays + COSTS["R"], node, "R")
    return after


def best_end(trail: Trail, best: Best) -> tuple[int, int]:
    """Cost and audit of the best state a conversation may end in."""
    with_inserts(trail, best)
    ends: Best = [None]
    for state in (NOTHING, ASSISTANT):
        if best[state] is not None:
            cost, node = best[state]
            if ends[0] is None or cost < ends[0][0] or (cost == ends[0][0] and trail.less(node, ends[0][1])):
                ends[0] = (cost, node)
    return ends[0]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _batched(rows: Iterator[dict], schema: pa.Schema, most: int = 1000, chars: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded number and text."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row.values() if isinstance(v, str))
        if len(held) >= most or size >= chars:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


PATHS = "paths array<struct<entry: int, exit: int, cost: long, audit: string>>"
_PATHS = pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
COUNTS = ("blank", "duplicate", "truncated", "illegal")


def ordered(turns: DataFrame) -> DataFrame:
    """The turns in order: ``conv_id, turn, role, text, text_hash, place, chunk``; written once."""
    space = F.lit(" ")
    rows = turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
    )
    # Equal rows may be parted anywhere, which the random key allows.
    rows = rows.withColumns({"text_hash": F.sha2("text", 256), "any": F.monotonically_increasing_id()})
    least = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["conv_id", "turn", "role", "text_hash", "any"]
    chunks = rows.repartitionByRange(max(least, 1 + rows.count() // CHUNK_ROWS), *keys).sortWithinPartitions(*keys)
    placed = chunks.drop("any").withColumn("place", F.monotonically_increasing_id())
    return materialise(placed.withColumn("chunk", F.shiftright("place", 33)))


def faults(rows: DataFrame) -> DataFrame:
    """``conv_id, place, chunk, initial, fault`` of ordered turns; fault is blank, duplicate, truncated or null."""
    firsts = rows.groupBy("conv_id", "role", "text_hash").agg(F.min("place").alias("place"))
    trimmed = F.rtrim("text", F.lit(SPACE))
    light = rows.select(
        "conv_id", "place", "chunk", F.left("role", F.lit(1)).alias("initial"), (trimmed == "").alias("blank"),
        (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("truncated"),
    )
    light = light.join(firsts.select("place", F.lit(True).alias("first")), "place", "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("truncated"), "truncated")
    return light.select("conv_id", "place", "chunk", "initial", fault.alias("fault"))


def _kind(rows: DataFrame) -> tuple[str, pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    kind = rows.schema["conv_id"].dataType
    return kind.simpleString(), to_arrow_type(kind)


def segments(rows: DataFrame) -> DataFrame:
    """Per conversation and chunk: first place, rows, counts of faults, outer initials, and the best audits through it."""
    kind, arrow = _kind(rows)
    names = [("place", pa.int64()), ("chunk", pa.int64()), *[(c, pa.int64()) for c in COUNTS], ("first", pa.string()), ("last", pa.string())]
    out = pa.schema([("conv_id", arrow), *names, ("paths", _PATHS)])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        chunk, own, trail, starts = None, None, Trail(), {}

        def closed() -> dict:
            paths = [
                {"entry": entry, "exit": state, "cost": end[0], "audit": "".join(trail.path(end[1]))}
                for entry, best in starts.items() for state, end in enumerate(best) if end is not None
            ]
            return own | {"paths": paths}

        for row in _rows(batches):
            if own is None or row["chunk"] != chunk or row["conv_id"] != own["conv_id"]:
                if own is not None:
                    yield closed()
                # Only the first conversation of a chunk can have begun before.
                entries = range(4) if row["chunk"] != chunk else [NOTHING]
                chunk, trail = row["chunk"], Trail()
                own = {k: row[k] for k in ("conv_id", "place", "chunk")} | dict.fromkeys(COUNTS, 0) | {"first": row["initial"], "last": None}
                starts = {entry: [(0, 0) if state == entry else None for state in range(4)] for entry in entries}
            fault = row["fault"]
            if fault:
                own[fault] += 1
            if own["last"] is not None and own["last"] + row["initial"] not in ("su", "ua", "au"):
                own["illegal"] += 1
            own["last"] = row["initial"]
            for entry, best in starts.items():
                starts[entry] = with_turn(trail, best, row["initial"], fault in ("blank", "duplicate"), fault == "truncated")
        if own is not None:
            yield closed()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batched(walk(batches), out)

    schema = f"conv_id {kind}, place long, chunk long, {', '.join(f'{c} long' for c in COUNTS)}, first string, last string, {PATHS}"
    return rows.repartition("chunk").sortWithinPartitions("place").mapInArrow(work, schema)


def edits(parts: DataFrame) -> DataFrame:
    """Per segment: entry state and piece of the audit; the last one of a conversation also has its counts, cost and whole audit.

    ``whole`` tells that the segment is the conversation.
    """
    kind, arrow = _kind(parts)
    out = pa.schema([
        ("conv_id", arrow), ("place", pa.int64()), ("chunk", pa.int64()), ("entry", pa.int32()), ("piece", pa.string()), ("whole", pa.bool_()),
        *[(c, pa.int64()) for c in COUNTS], ("cost", pa.int64()), ("audit", pa.string()),
    ])

    def closed(trail: Trail, best: Best, own: list[dict], entries: dict[int, int]) -> Iterator[dict]:
        cost, node = best_end(trail, best)
        tail = ""
        while trail.depth[node] > len(own):
            tail, node = trail.piece[node] + tail, trail.parent[node]
        pieces, began, at = trail.path(node), [], node
        while at:
            began.append(entries[at])
            at = trail.parent[at]
        pieces[-1] += tail
        counts = {c: sum(part[c] for part in own) for c in COUNTS}
        counts["illegal"] += sum(a["last"] + b["first"] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        for number, (part, piece, entry) in enumerate(zip(own, pieces, began[::-1], strict=True), 1):
            row = {k: part[k] for k in ("conv_id", "place", "chunk")} | {"entry": entry, "piece": piece, "whole": len(own) == 1}
            yield row | (counts | {"cost": cost, "audit": "".join(pieces)} if number == len(own) else {})

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        own: list[dict] = []
        for part in _rows(batches):
            if own and own[0]["conv_id"] != part["conv_id"]:
                yield from closed(trail, best, own, entries)
                own = []
            if not own:
                trail, best, entries = Trail(), [(0, 0), None, None, None], {}
            after: Best = [None] * 4
            for path in part.pop("paths"):
                if best[path["entry"]] is not None:
                    cost, node = best[path["entry"]]
                    entries[trail.extended(node, path["audit"])] = path["entry"]
                    _offer(trail, after, path["exit"], cost + path["cost"], node, path["audit"])
            best = after
            own.append(part)
        if own:
            yield from closed(trail, best, own, entries)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batched(walk(batches), out)

    schema = (
        f"conv_id {kind}, place long, chunk long, entry int, piece string, whole boolean, {', '.join(f'{c} long' for c in COUNTS)}, "
        "cost long, audit string"
    )
    return materialise(parts.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(work, schema))


def rendered(rows: DataFrame, pieces: DataFrame) -> DataFrame:
    """The repaired turns ``conv_id, chunk, step, whole, edit, role, text``, each partition in order."""
    kind, arrow = _kind(rows)
    out = pa.schema([
        ("conv_id", arrow), ("chunk", pa.int64()), ("step", pa.int64()), ("whole", pa.bool_()), ("edit", pa.string()), ("role", pa.string()),
        ("text", pa.string()),
    ])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        own, piece, at, state, step = {}, "", 0, NOTHING, 0

        def inserted() -> Iterator[dict]:
            nonlocal at, state, step
            while at < len(piece) and piece[at] == "I":
                state = ASSISTANT if state == USER else USER
                yield own | {"step": step, "edit": "I", "role": "assistant" if state == ASSISTANT else "user", "text": ""}
                at, step = at + 1, step + 1

        for row in _rows(batches):
            if row["piece"] is not None:
                own, piece, at, state, step = {k: row[k] for k in ("conv_id", "chunk", "whole")}, row["piece"], 0, row["entry"], 0
                yield from inserted()
                continue
            edit, at = piece[at], at + 1
            if edit != "D":
                role = row["role"]
                if edit == "K" and role.startswith("s"):
                    state = SYSTEM
                else:
                    state = ASSISTANT if state == USER else USER
                if edit == "R":
                    role = "assistant" if state == ASSISTANT else "user"
                yield own | {"step": step, "edit": edit, "role": role, "text": row["text"]}
                step += 1
            yield from inserted()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batched(walk(batches), out)

    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    turns = rows.select("conv_id", "chunk", "place", none("piece", "string"), none("entry", "int"), none("whole", "boolean"), "role", "text")
    marks = pieces.select("conv_id", "chunk", "place", "piece", "entry", "whole", none("role", "string"), none("text", "string"))
    # The piece of a segment stands before the turn of the same place.
    both = turns.unionByName(marks).repartition("chunk").sortWithinPartitions("place", F.col("piece").isNull())
    schema = f"conv_id {kind}, chunk long, step long, whole boolean, edit string, role string, text string"
    return both.mapInArrow(work, schema)


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(repaired turns, audits): see ``rendered``, and per conversation ``conv_id``, counts of faults, ``cost`` and ``audit``."""
    rows = ordered(turns)
    pieces = edits(segments(faults(rows)))
    return rendered(rows, pieces), pieces.filter("audit is not null").select("conv_id", *COUNTS, "cost", "audit")


def digests(turns: DataFrame) -> DataFrame:
    """``conv_id, sha256`` of repaired turns as ``role:text`` lines joined by newlines; only conversations with turns.

    A conversation within a chunk is hashed where it is; of others every chunk gives its lines as parts, and the
    parts go through one hash in order, never held together.
    """
    kind, arrow = _kind(turns)
    names = [("conv_id", arrow), ("chunk", pa.int64()), ("part", pa.int64()), ("lines", pa.string()), ("sha256", pa.string())]
    out = pa.schema(names)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        own, held, size, part = None, [], 0, 0

        def closed() -> dict:
            if own["whole"]:
                return own | {"part": part, "lines": None, "sha256": digest.hexdigest()}
            return own | {"part": part, "lines": "".join(held), "sha256": None}

        for row in _rows(batches):
            if own is None or any(own[k] != row[k] for k in ("conv_id", "chunk")):
                if own is not None:
                    yield closed()
                own, held, size, part, digest = {k: row[k] for k in ("conv_id", "chunk", "whole")}, [], 0, 0, hashlib.sha256()
            line = f"{row['role']}:{row['text']}"
            if own["whole"]:
                digest.update(("\n" if row["step"] else "").encode() + line.encode("utf-8", "surrogatepass"))
                continue
            held.append(line + "\n")
            size += len(line)
            if size >= 1_000_000:
                yield closed()
                held, size, part = [], 0, part + 1
        if own is not None:
            yield closed()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batched(({k: row[k] for k in out.names} for row in lines(batches)), out)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        conversation, digest, open_ = None, None, False
        for row in _rows(batches):
            if digest is not None and row["conv_id"] != conversation:
                yield {"conv_id": conversation, "sha256": digest.hexdigest()}
                digest = None
            if digest is None:
                conversation, digest, open_ = row["conv_id"], hashlib.sha256(), False
            data = row["lines"].encode("utf-8", "surrogatepass")
            if data:
                digest.update((b"\n" if open_ else b"") + data[:-1])
                open_ = True
        if digest is not None:
            yield {"conv_id": conversation, "sha256": digest.hexdigest()}

    last = pa.schema([names[0], names[4]])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batched(fold(batches), last)

    made = materialise(turns.mapInArrow(first, f"conv_id {kind}, chunk long, part long, lines string, sha256 string"))
    parts = made.filter("lines is not null").repartition("conv_id").sortWithinPartitions("conv_id", "chunk", "part")
    folded = parts.mapInArrow(second, f"conv_id {kind}, sha256 string")
    return made.filter("sha256 is not null").select("conv_id", "sha256").unionByName(folded)


def damaged(turns: DataFrame) -> DataFrame:
    """The turns with the contract's faults: dropped, emptied, without marks of an end, repeated, or of another role."""
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
        (F.crc32(name.cast("binary")) % 20).alias("k"),
    ).filter("k <> 0")
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("k") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies).drop("copy")


def gaps(turns: DataFrame) -> DataFrame:
    """``conv_id, gaps``: turn numbers that are missing between the least and the greatest (at most what a long holds)."""
    numbers = turns.select("conv_id", F.col("turn").cast("decimal(38,0)").alias("turn")).distinct()
    missing = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    fits = F.least(F.coalesce(missing, F.lit(0)), F.lit(2**63 - 1).cast("decimal(38,0)"))
    return numbers.groupBy("conv_id").agg(fits.cast("long").alias("gaps"))


def _with(left: DataFrame, right: DataFrame) -> DataFrame:
    """``left`` with the columns of ``right`` by conversation; the null conversation is one as well."""
    other = right.withColumnRenamed("conv_id", "_conv_id")
    return left.join(other, F.col("conv_id").eqNullSafe(F.col("_conv_id")), "left").drop("_conv_id")


def structure_repair(turns: DataFrame) -> DataFrame:
    """Per original conversation: gaps, faults, cost, audit and the digest of the repaired turns, after the contract's damage."""
    hurt = damaged(turns)
    repaired, audits = repair(hurt)
    rows = _with(_with(_with(turns.select("conv_id").distinct(), gaps(hurt)), audits), digests(repaired))
    zero: list[Column] = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", *COUNTS, "cost")]
    empty = F.sha2(F.lit(""), 256)
    return rows.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", empty).alias("repaired_sha256"))


KEY_SQL = "(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))"
SQL = f"""
WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {CRC_SQL.format(KEY_SQL)} % 20 AS k FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy FROM o WHERE k <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
    regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS t FROM d),
f AS (SELECT *, left(role, 1) AS x, CASE WHEN t = '' THEN 'b'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
    WHEN right(t, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM n),
l AS (SELECT *, lag(x) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM f),
r AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS s, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS body FROM f
  UNION ALL
  (SELECT conv_id, i, s, cost, audit, body FROM (
    SELECT y.conv_id, f.i, CASE e.e WHEN 'D' THEN y.s WHEN 'K' THEN CASE f.x WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END
        ELSE CASE WHEN y.s = 2 THEN 3 ELSE 2 END END AS s,
      y.cost + CASE e.e WHEN 'D' THEN 4 WHEN 'K' THEN 0 ELSE 3 END + CASE WHEN e.e <> 'D' AND f.fault = 't' THEN 3 ELSE 0 END AS cost,
      y.audit || e.e AS audit,
      CASE e.e WHEN 'D' THEN y.body WHEN 'K' THEN list_append(y.body, f.role || ':' || f.text)
        ELSE list_append(y.body, CASE WHEN y.s = 2 THEN 'assistant:' ELSE 'user:' END || f.text) END AS body
    FROM (SELECT conv_id, i, CASE WHEN j = 0 THEN s ELSE CASE WHEN s = 2 THEN 3 ELSE 2 END END AS s, cost + 3 * j AS cost, audit || repeat('I', j) AS audit,
        CASE WHEN j = 0 THEN body ELSE list_append(body, CASE WHEN s = 2 THEN 'assistant:' ELSE 'user:' END) END AS body
      FROM r, (VALUES (0), (1)) AS j(j)) y
    JOIN f ON f.conv_id = y.conv_id AND f.i = y.i + 1, (VALUES ('D'), ('K'), ('R')) AS e(e)
    WHERE e.e = 'D' OR (f.fault NOT IN ('b', 'd') AND (e.e = 'R' OR (f.x = 's' AND y.s = 0) OR (f.x = 'u' AND y.s <> 2) OR (f.x = 'a' AND y.s = 2)))
  ) QUALIFY row_number() OVER (PARTITION BY conv_id, s ORDER BY cost, audit) = 1)),
m AS (SELECT conv_id, max(i) AS i FROM f GROUP BY conv_id),
z AS (SELECT r.conv_id, cost + 3 * j AS cost, audit || repeat('I', j) AS audit,
    CASE WHEN j = 0 THEN body ELSE list_append(body, CASE WHEN s = 2 THEN 'assistant:' ELSE 'user:' END) END AS body
  FROM r JOIN m USING (conv_id, i), (VALUES (0), (1)) AS j(j) WHERE CASE WHEN j = 0 THEN s ELSE CASE WHEN s = 2 THEN 3 ELSE 2 END END IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY r.conv_id ORDER BY r.cost + 3 * j, r.audit || repeat('I', j)) = 1),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
    count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || x NOT IN ('su', 'ua', 'au')) AS illegal FROM l GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
  sha256(coalesce(array_to_string(body, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN c USING (conv_id) LEFT JOIN z USING (conv_id)
"""
