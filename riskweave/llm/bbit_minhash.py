"""Near duplicates by b-bit MinHash with exact confirmation.

A document's set is its distinct word shingles.  One pass over the texts leaves, per document, the digest of the
set, band keys from the full minima of ``HASHES`` hash functions, and a signature of only the low ``BITS`` bits of
each minimum, packed into 64-bit words.  Documents of equal set are one class, represented by its least id.

Candidates come from equal band keys.  The similarity of a candidate pair is estimated from the signatures by
counting equal groups of bits (xor, fold, population count) and correcting for chance agreement
(``(share - 2^-b) / (1 - 2^-b)``); pairs that are more than ``SIGMAS`` standard errors below the threshold are
dropped, the others confirmed on full sets, rebuilt from the whole texts: rows come in order of the id that is met, its own text first,
and a worker turns few texts at a time into strings.

A bucket's pairs are never all made.  First every member meets the bucket's least id, which is linear in the
bucket, and links so found give components.  In buckets that still span several components, only the members
outside the largest one (movers) have to meet the others.  They do so in cells of at most ``CHUNK`` movers and
``CHUNK`` members: signatures are compared as a matrix, and only members with a near enough partner go on, with
their texts, to the same cell, where full sets are compared as a matrix.  A cell returns at most one link for two
components.  So rows are linear in a bucket (times its chunks), yet every candidate pair between components has
been compared, and the components are those of all candidate pairs.  A task holds one group of cells at a time; groups
are counted on the copied rows and on the characters of their texts, so a group has a few cells whatever the bucket.
Texts of documents that are in no pair stay where they are: a Bloom filter over the ids picks rows while texts are scanned.

Bands and rows are chosen so that a pair at the threshold misses every band with probability at most ``MISS``
(4e-7 at 0.85 with 25 bands of 5; 5e-8 at 0.80 with 32 of 4).

Defined results: null texts and texts without words have an empty set, are linked with nothing and are kept; fewer
words than a shingle make one shingle; equal rows are one class; rows that share an id are one node; rows without
an id are linked with nothing and kept; an empty table gives no rows; long texts are read whole (shingles in pieces);
other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.components import components, relabelled
from riskweave.llm.id_filter import may_be_one_of
from riskweave.llm.text import WORDS_HELD, Hashes, encoded, mixed, window_hashes
from riskweave.session import materialise

HASHES = 128
BITS = 4
SIGMAS = 6.0
MISS = 1e-6
#: Movers and members of a cell, on average at most, and rows and characters of text of the groups that cells are put together in.
CHUNK, GROUP_ROWS, GROUP_CHARS = 512, 4000, 32_000_000
#: Rows whose texts are Python strings at once.
SLICE = 256
PER_LONG = 64 // BITS
LOW = (1 << BITS) - 1


def bands_for(threshold: float, hashes: int = HASHES, miss: float = MISS) -> tuple[int, int]:
    """Bands and rows per band: the most selective choice that loses a pair at the threshold with chance <= ``miss``."""
    fit = [(hashes // rows, rows) for rows in range(1, hashes + 1) if (1 - threshold**rows) ** (hashes // rows) <= miss]
    return max(fit, key=lambda choice: choice[1])


def _functions() -> tuple[np.ndarray, np.ndarray]:
    values = mixed(np.arange(1, 2 * HASHES + 1, dtype=np.uint64))
    return (values[:HASHES] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (values[HASHES:] >> np.uint64(32)).astype(np.uint32)


TIMES, PLUS = _functions()


def shingles(text: str | None, width: int, hashes: Hashes) -> np.ndarray:
    """The set of a text: sorted distinct 64-bit shingle hashes."""
    words = encoded(text).lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    numbers = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    ordered = np.sort(window_hashes(numbers, min(width, len(numbers))))
    return ordered[np.concatenate([[True], ordered[1:] != ordered[:-1]])]


def minima(members: np.ndarray) -> np.ndarray:
    """Least value of every hash function over a set that isn't empty."""
    small = (mixed(members) >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(small), 512):
        values = small[at : at + 512, None] * TIMES[None]
        values += PLUS[None]
        np.minimum(least, values.min(axis=0), out=least)
    return least


def packed(least: np.ndarray) -> np.ndarray:
    """Low bits of the minima, ``PER_LONG`` to a 64-bit word."""
    low = (least & np.uint32(LOW)).astype(np.uint64).reshape(-1, PER_LONG)
    shifts = np.arange(PER_LONG, dtype=np.uint64) * np.uint64(BITS)
    return np.bitwise_or.reduce(low << shifts, axis=1).view(np.int64)


def band_keys(least: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band, from the full minima of its rows."""
    grid = least[: bands * rows].reshape(bands, rows).astype(np.uint64)
    key = mixed(np.arange(bands, dtype=np.uint64) + np.uint64(1))
    with np.errstate(over="ignore"):
        for row in range(rows):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + grid[:, row])
    return key.view(np.int64)


def signatures(documents: DataFrame, width: int, threshold: float) -> DataFrame:
    """``doc_id, n_shingles, chars, digest, bands, signature`` per row; the last three null for an empty set."""
    bands, rows = bands_for(threshold)

    kind = pa.schema([
        ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("chars", pa.int64()), ("digest", pa.binary()),
        ("bands", pa.list_(pa.int64())), ("signature", pa.list_(pa.int64())),
    ])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        hashes.limit = WORDS_HELD
        for batch in slices(batches):
            out = []
            for text in batch.column("text").to_pylist():
                members = shingles(text, width, hashes)
                if not len(members):
                    out.append((0, len(text or ""), None, None, None))
                    continue
                least = minima(members)
                digest = hashlib.blake2b(members.tobytes(), digest_size=16).digest()
                out.append((len(members), len(text), digest, band_keys(least, bands, rows), packed(least)))
            made = [pa.array(column, field.type) for column, field in zip(zip(*out, strict=True), list(kind)[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], schema=kind)

    schema = "doc_id long, n_shingles long, chars long, digest binary, bands array<long>, signature array<long>"
    return materialise(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sign, schema))


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, ``SLICE`` at a time: so many texts are Python strings at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def estimated(left: Column, right: Column) -> Column:
    """Similarity from two signatures, corrected for agreement by chance."""
    ones = F.lit(int("1" * PER_LONG, 16)).cast("long")  # the lowest bit of every group
    differ = F.zip_with(left, right, lambda a, b: a.bitwiseXOR(b))

    def folded(x: Column) -> Column:
        y = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        y = y.bitwiseOR(F.shiftrightunsigned(y, 2))
        return F.bit_count(y.bitwiseAND(ones))

    unequal = F.aggregate(F.transform(differ, folded), F.lit(0), lambda a, b: a + b)
    chance = 2.0**-BITS
    return ((1 - unequal / HASHES) - chance) / (1 - chance)


def floor_of(threshold: float) -> float:
    """Estimates below this are further than ``SIGMAS`` standard errors from the threshold."""
    chance = 2.0**-BITS
    share = chance + (1 - chance) * threshold
    return threshold - SIGMAS * math.sqrt(share * (1 - share) / HASHES) / (1 - chance)


def met(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    """``a, b`` of the linked pairs, from rows ``b, part, of, a, text`` in that order.

    Of a key (``b, part, of``) the text of ``b`` itself comes first, without ``a``; one set is held, and the next is made beside it.
    """
    hashes, current, leads = Hashes(), None, []
    hashes.limit = WORDS_HELD
    for batch in slices(batches):
        out = []
        for b, part, of, a, text in zip(*[batch.column(name).to_pylist() for name in ("b", "part", "of", "a", "text")], strict=True):
            if (b, part, of) != current:
                current, leads, seen = (b, part, of), [], set()
            if a is None:
                # Rows of one id and one text are one; other texts of an id have keys of their own.
                if text not in seen:
                    seen.add(text)
                    leads.append(shingles(text, width, hashes))
                continue
            own = shingles(text, width, hashes)
            for lead in leads:
                both = len(np.intersect1d(lead, own, assume_unique=True))
                if 100 * both >= percent * (len(lead) + len(own) - both):
                    out.append((a, b))
                    break
        yield pa.RecordBatch.from_arrays([pa.array([pair[i] for pair in out], pa.int64()) for i in (0, 1)], names=["a", "b"])


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """``a, b`` of the pairs whose full sets have ``100 * intersection >= percent * union``."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return met(batches, width, percent)

    needed = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id")))
    chosen = materialise(texts.filter(may_be_one_of(needed)(F.col("id"))).withColumn("of", F.xxhash64("text")))
    # An id that many meet comes in as many parts as it takes, each with its own copy of the text.
    crowds = materialise(pairs.groupBy("b").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("parts")))
    placed = pairs.join(crowds, "b").withColumn("part", F.pmod(F.xxhash64("a", F.lit(5)), F.col("parts")).cast("int"))
    # Each text of an id is met by itself, so that no row carries two texts and no key has more than one.
    texts_of = chosen.select(F.col("id").alias("b"), "of").distinct()
    placed = placed.select("a", "b", "part").hint("merge").join(texts_of.hint("merge"), "b")
    leads = crowds.select("b", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"))
    # Both sides of these joins grow with the input: merged at every size, never broadcast where still small.
    left = placed.hint("merge").join(chosen.select(F.col("id").alias("a"), "text").hint("merge"), "a")
    right = leads.hint("merge").join(chosen.select(F.col("id").alias("b"), "of", "text").hint("merge"), "b")
    names = ["b", "part", "of", "a", "text"]
    both = left.select(*names).unionByName(right.withColumn("a", F.lit(None).cast("long")).select(*names))
    ordered = both.repartition("b", "part", "of").sortWithinPartitions("b", "part", "of", F.col("a").asc_nulls_first())
    return ordered.mapInArrow(linked, "a long, b long")


def _cells(group: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, pd.DataFrame]]:
    """Movers and members of every cell of a group."""
    for _, cell in group.groupby(["key", "i", "j"], sort=False):
        side = cell["mover"].to_numpy()
        yield cell[side], cell[~side]


def _apart(left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray:
    return left["component"].to_numpy()[:, None] != right["component"].to_numpy()[None]


def near_in_cells(group: pd.DataFrame, least: float) -> pd.DataFrame:
    """Rows of cells whose estimate with some row of another component on the other side is at least ``least``.

    A pair that shares an earlier band is looked at there.
    """
    chance, kept = 2.0**-BITS, []
    ones = np.uint64(int("1" * PER_LONG, 16))
    for left, right in _cells(group):
        if left.empty or right.empty:
            continue
        near = _apart(left, right)
        a, b = (np.stack(x["signature"].to_numpy()).view(np.uint64) for x in (left, right))
        unequal = np.zeros(near.shape, np.int32)
        for word in range(a.shape[1]):
            x = a[:, word][:, None] ^ b[:, word][None]
            x |= x >> np.uint64(1)
            x |= x >> np.uint64(2)
            unequal += np.bitwise_count(x & ones)
        near &= ((1 - unequal / HASHES) - chance) / (1 - chance) >= least
        if not near.any():
            continue
        a, b = (np.stack(x["bands"].to_numpy()) for x in (left, right))
        for band in range(int(left["band"].iloc[0])):
            near &= a[:, band][:, None] != b[:, band][None]
        kept += [left[near.any(axis=1)], right[near.any(axis=0)]]
    columns = ["key", "i", "j", "mover", "id", "component", "chars"]
    return pd.concat(kept)[columns] if kept else group.iloc[:0][columns]


def links_in_cells(group: pd.DataFrame, width: int, percent: int) -> pd.DataFrame:
    """Pairs of components (greater first) with a link between their rows in a cell, from full sets."""
    hashes, found = Hashes(), set()
    hashes.limit = WORDS_HELD
    known: dict[int, np.ndarray] = {}
    for i, text in zip(group["id"], group["text"], strict=True):
        if i not in known:
            known[i] = shingles(text, width, hashes)
    for left, right in _cells(group):
        if left.empty or right.empty:
            continue
        sides = [[known[i] for i in x["id"]] for x in (left, right)]
        both = np.intersect1d(*[np.unique(np.concatenate(side)) for side in sides], assume_unique=True)
        # Overlaps as a product of incidence matrices over the shingles that stand on both sides, part by part.
        overlap = np.zeros((len(left), len(right)), np.float32)
        for at in range(0, len(both), 4096):
            part = both[at : at + 4096]
            grids = []
            for side in sides:
                grid = np.zeros((len(side), len(part)), np.float32)
                for row, own in enumerate(side):
                    grid[row, np.searchsorted(part, np.intersect1d(own, part, assume_unique=True))] = 1
                grids.append(grid)
            overlap += grids[0] @ grids[1].T
        sizes = [np.array([len(own) for own in side], float) for side in sides]
        linked = 100 * overlap.astype(float) >= percent * (sizes[0][:, None] + sizes[1][None] - overlap)
        rows, columns = np.nonzero(linked & _apart(left, right))
        for x, y in zip(left["component"].to_numpy()[rows], right["component"].to_numpy()[columns], strict=True):
            found.add((max(x, y), min(x, y)))
    return pd.DataFrame(sorted(found), columns=["a", "b"], dtype="int64")


def groups_for(rows: int, chars: int = 0) -> int:
    """So many groups that one has about ``GROUP_ROWS`` rows and ``GROUP_CHARS`` characters at most, or one cell."""
    return 1 + max(rows // GROUP_ROWS, chars // GROUP_CHARS)


def _group(groups: int) -> Column:
    return F.pmod(F.xxhash64("key", "i", "j"), F.lit(groups)).alias("g")


def between_components(members: DataFrame, marks: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """``a, b``: components with a link between them, from buckets ``(key, band, id, component)``."""
    sizes = members.groupBy("key", "component").agg(F.count("*").alias("n"))
    spans = sizes.groupBy("key").agg(
        F.max(F.struct("n", "component")).alias("top"), F.count("*").alias("parts"), F.sum("n").alias("m")
    )
    spans = spans.filter("parts > 1").select(
        "key", F.col("top.component").alias("top"), "m", (F.col("m") - F.col("top.n")).alias("moving"), F.ceil(F.col("m") / CHUNK).cast("int").alias("right"),
        F.ceil((F.col("m") - F.col("top.n")) / CHUNK).cast("int").alias("left"),
    )
    spans = materialise(spans)
    rows = materialise(members.join(spans.drop("m", "moving"), "key"))
    place = F.xxhash64("id", F.lit(3))
    every = lambda n: F.explode(F.expr(f"sequence(0, {n} - 1)"))
    movers = rows.filter("component <> top").withColumn("i", F.pmod(place, F.col("left")).cast("int")).withColumn("j", every("right"))
    others = rows.withColumn("j", F.pmod(place, F.col("right")).cast("int")).withColumn("i", every("left"))
    names = ["key", "band", "i", "j", "id", "component"]
    sides = movers.select(*names, F.lit(True).alias("mover")).unionByName(others.select(*names, F.lit(False).alias("mover")))
    # Groups follow the rows after they have been copied to their cells.
    copied = spans.agg(F.sum(F.expr("moving * right + m * left"))).first()[0] or 0
    least = floor_of(percent / 100)

    def near(group: pd.DataFrame) -> pd.DataFrame:
        return near_in_cells(group, least)

    def linked(group: pd.DataFrame) -> pd.DataFrame:
        return links_in_cells(group, width, percent)

    schema = "key long, i int, j int, mover boolean, id long, component long, chars long"
    left = sides.join(marks, "id").select(_group(groups_for(copied)), *names, "mover", "signature", "bands", "chars")
    kept = materialise(left.groupBy("g").applyInPandas(near, schema))
    wanted = texts.filter(may_be_one_of(kept.select("id"))(F.col("id")))
    met = kept.agg(F.count("*"), F.coalesce(F.sum("chars"), F.lit(0))).first()
    into = _group(groups_for(*met))
    right = kept.join(wanted.hint("merge"), "id").select(into, "key", "i", "j", "mover", "id", "component", "text")
    return materialise(right.groupBy("g").applyInPandas(linked, "a long, b long").distinct())


def near_duplicates(documents: DataFrame, width: int = 3, percent: int = 85) -> DataFrame:
    """Per row: ``doc_id, n_shingles, component_id, kept``."""
    threshold = percent / 100
    signed = signatures(documents, width, threshold)
    full = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy("digest", "n_shingles").agg(
        F.min("doc_id").alias("id"), F.first("bands").alias("bands"), F.first("signature").alias("signature"),
        F.max("chars").alias("chars"),
    )
    classes = materialise(classes)
    texts = documents.select(F.col("doc_id").cast("long").alias("id"), "text")
    entries = classes.select("id", F.posexplode("bands").alias("band", "key"))
    buckets = entries.groupBy("key").agg(F.min("id").alias("lead"), F.count("*").alias("n")).filter("n > 1")
    shared = materialise(entries.join(buckets, "key").select("key", "band", "id", "lead", "n"))

    # Every member and the least id of its bucket.
    pairs = _pairs(shared.select(F.col("id").alias("a"), F.col("lead").alias("b")))
    left = classes.select(F.col("id").alias("a"), F.col("signature").alias("sa"))
    right = classes.select(F.col("id").alias("b"), F.col("signature").alias("sb"))
    near = pairs.join(left, "a").join(right, "b").filter(estimated(F.col("sa"), F.col("sb")) >= floor_of(threshold))
    # No grouping by these keys: a bucket's least id is met by many, and only a plain join is split.
    near = materialise(near.select("a", "b"))
    labels = components(confirmed(near, texts, width, percent))

    # Buckets that still span several components; in a bucket of two the pair has been compared.
    members = shared.filter("n > 2").join(labels, "id", "left")
    members = members.select("key", "band", "id", F.coalesce("component", "id").alias("component"))
    marks = classes.select("id", "signature", "bands", "chars")
    between = between_components(members, marks, texts, width, percent)
    merged = components(between).select(F.col("id").alias("component"), F.col("component").alias("p"))
    labels = _extended(labels, between, merged)

    of_class = classes.select("digest", "id").join(labels, "id", "left")
    of_class = of_class.select("digest", F.coalesce("component", "id").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", "digest").join(of_class, "digest", "left")
    known = F.col("doc_id").isNotNull()
    component = F.when(known, F.coalesce("component_id", "doc_id"))
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def _pairs(pairs: DataFrame) -> DataFrame:
    """Distinct pairs of different ids, the greater first."""
    return pairs.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _extended(labels: DataFrame, between: DataFrame, merged: DataFrame) -> DataFrame:
    """Labels after components were merged; ids that had no link so far come in as their own component."""
    ids = between.select(F.col("a").alias("id")).union(between.select(F.col("b").alias("id"))).distinct()
    fresh = ids.join(labels, "id", "left_anti").select("id", F.col("id").alias("component"))
    return materialise(relabelled(labels.unionByName(fresh), merged))


def near_dedup(documents: DataFrame) -> DataFrame:
    """Per document: the size of its set, its component, and whether it is the one kept."""
    return near_duplicates(documents)


SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(list_slice(w, i, i + 2), ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
r AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.d WHERE r.c < l.b)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, doc_id = m.c AS kept
FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT d, min(c) AS c FROM r GROUP BY d) m ON m.d = doc_id
"""
