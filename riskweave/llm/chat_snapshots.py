"""Chat formatting with cumulative snapshots collapsed.

A chat is often logged again after every turn, so one conversation is a prefix of another.  Every turn has a
128-bit hash of its position, role and text; the running sums over a conversation are the hashes of its turn
prefixes, the last one that of the whole.  A conversation whose whole hash is the hash of a strictly shorter prefix
of another one is a snapshot: an anti-join of the whole hashes against the distinct strict-prefix hashes keeps
the maximal conversations.  Of equal conversations the one of least id stays, and is counted with its copies.

Kept conversations are rendered turn by turn into segments of at most ``SEGMENT`` turns, so no row grows without
bound; a conversation's segments in order are its text.

Running sums are taken within blocks of turn numbers, totals of blocks before them added, so a conversation with
a third of all turns is spread; common prefixes and conversations are made distinct before they are joined.

Defined results: turns are ordered by number (null first), then role, then text; a turn logged twice with equal role
and text counts once; null role is ``unknown``, null text is empty; turns without a conversation id belong to no
conversation; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.session import materialise

BLOCK = 512
SEGMENT = 512
ROLE_OPEN, ROLE_CLOSE, TURN_CLOSE = "<|", "|>\n", "\n<|end|>\n"


def rendered(role: Column, text: Column) -> Column:
    """One turn in the chat template."""
    return F.concat(F.lit(ROLE_OPEN), role, F.lit(ROLE_CLOSE), text, F.lit(TURN_CLOSE))


def _before(rows: DataFrame, names: list[str]) -> DataFrame:
    """Sums of ``names`` over a conversation up to and with each row, block by block."""
    blocks = rows.groupBy("conv_id", "block").agg(*[F.sum(n).alias(f"{n}_b") for n in names])
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("decimal(38,0)")
    starts = blocks.select("conv_id", "block", *[F.coalesce(F.sum(f"{n}_b").over(earlier), zero).alias(f"{n}_b") for n in names])
    joined = rows.join(starts, ["conv_id", "block"])
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text_hash").rowsBetween(Window.unboundedPreceding, 0)
    sums = {n: (F.sum(n).over(inside) + F.col(f"{n}_b")).cast("decimal(38,0)") for n in names}
    return joined.withColumns({f"{n}_sum": c for n, c in sums.items()}).drop(*[f"{n}_b" for n in names])


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """``conv_id, position, h1, h2, last`` per turn, without texts: hashes of the turn prefixes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"),
        F.sha2(text, 256).alias("text_hash"), text.alias("text"),
    ).filter("conv_id is not null")
    rows = rows.select("conv_id", "turn", "role", "text_hash").distinct()
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-1 << 40)))
    one = F.lit(1).cast("decimal(38,0)")
    placed = _before(rows.withColumn("one", one), ["one"]).withColumnRenamed("one_sum", "position").drop("one")
    for name, seed in (("h1", 101), ("h2", 202)):
        hashed = F.xxhash64(F.col("position").cast("long"), "role", "text_hash", F.lit(seed))
        placed = placed.withColumn(name, hashed.cast("decimal(38,0)"))
    summed = _before(placed, ["h1", "h2"])
    return summed.select(
        "conv_id", "turn", "role", "text_hash", F.col("position").cast("long").alias("position"),
        F.col("h1_sum").alias("h1"), F.col("h2_sum").alias("h2"),
    )


def maximal(hashes: DataFrame) -> DataFrame:
    """``conv_id, n_turns, copies`` of the conversations that are no prefix of another one."""
    # The last prefix of a conversation is the whole: the one of greatest position.
    whole = hashes.groupBy("conv_id").agg(F.max(F.struct("position", "h1", "h2")).alias("w")).select("conv_id", "w.*")
    classes = whole.groupBy("position", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    # Strict prefixes: every prefix of a conversation but the whole, once each.
    ends = whole.select("conv_id", F.col("position").alias("n_turns"))
    inner = hashes.join(ends, "conv_id").filter("position < n_turns").select("position", "h1", "h2").distinct()
    kept = classes.join(inner, ["position", "h1", "h2"], "left_anti")
    return kept.select("conv_id", F.col("position").alias("n_turns"), "copies")


def chat_documents(turns: DataFrame) -> DataFrame:
    """``conv_id, segment, n_turns, copies, text``: maximal conversations in the chat template."""
    hashes = materialise(prefix_hashes(turns))
    kept = materialise(maximal(hashes))
    places = hashes.join(kept, "conv_id").select("conv_id", "turn", "role", "text_hash", "position", "n_turns", "copies")
    text = F.coalesce(F.col("text"), F.lit(""))
    bodies = turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"),
        F.sha2(text, 256).alias("text_hash"), text.alias("text"),
    ).filter("conv_id is not null")
    p, b = places.alias("p"), bodies.alias("b")
    same = (
        (F.col("p.conv_id") == F.col("b.conv_id")) & F.col("p.turn").eqNullSafe(F.col("b.turn"))
        & (F.col("p.role") == F.col("b.role")) & (F.col("p.text_hash") == F.col("b.text_hash"))
    )
    joined = b.join(p, same).select(
        "p.conv_id", "p.position", "p.n_turns", "p.copies", rendered(F.col("p.role"), F.col("b.text")).alias("turn_text")
    )
    segment = F.floor((F.col("position") - 1) / SEGMENT).alias("segment")
    # A turn logged twice renders alike: the set of (position, text) holds it once.
    parts = joined.groupBy("conv_id", segment, "n_turns", "copies").agg(F.array_sort(F.collect_set(F.struct("position", "turn_text"))).alias("parts"))
    return parts.select(
        "conv_id", "segment", "n_turns", "copies", F.array_join(F.transform("parts", lambda x: x["turn_text"]), "").alias("text")
    )


SQL = f"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS position FROM t),
h AS (SELECT *, list({{'r': role, 't': text}}) OVER (PARTITION BY conv_id ORDER BY position) AS prefix FROM n),
w AS (SELECT conv_id, max(position) AS n_turns, arg_max(prefix, position) AS whole FROM h GROUP BY conv_id),
c AS (SELECT n_turns, whole, min(conv_id) AS conv_id, count(*) AS copies FROM w GROUP BY n_turns, whole),
i AS (SELECT DISTINCT h.position, h.prefix FROM h JOIN w USING (conv_id) WHERE h.position < w.n_turns),
k AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.position = c.n_turns AND i.prefix = c.whole))
SELECT k.conv_id, (n.position - 1) // {SEGMENT} AS segment, k.n_turns::BIGINT AS n_turns, k.copies::BIGINT AS copies,
  string_agg('<|' || n.role || '|>' || chr(10) || n.text || chr(10) || '<|end|>' || chr(10), '' ORDER BY n.position) AS text
FROM k JOIN n USING (conv_id) GROUP BY ALL
"""
