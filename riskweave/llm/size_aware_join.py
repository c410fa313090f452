"""Exact Jaccard self-join of word shingle sets by size: subsets for small sets, inverted lists for large ones.

A document's set is its distinct word shingles; documents of equal set are one class, known by its least id.  Two sets of
sizes n and m link when they share at least ``needed(n, m)`` members.

* **Small sets** (below the boundary) are joined by enumeration: a set emits all its subsets of every size that a
  partner of some small size may need.  Two sets that emit one subset of c members share c at least; they link for certain if
  ``needed(n, m) <= c``, and every linking pair has such a subset.  The least set of a subset's bucket links with
  all members that link with any, so a bucket gives one link a member and no pair is ever checked.
* **Large sets** are joined by inverted lists.  Members are ordered by how often they occur, the rarest first; sets that link
  share one of their first ``n - ceil(n * percent / 100) + 1`` members, and only those are posted.  The frequencies come from
  a sketch of fixed size that counts the shingles of all texts; it only orders, so an error costs time and not results.
  Small sets near the boundary are posted as well, for their large partners.
* **The boundary** is the size at which subsets cost more rows than lists: per size the number of subsets is known, and the
  length of the lists is summed from the sketch (``boundary``).

Pairs of a list are never all made.  A posted set first meets one set of its list, the leader; confirmed links
give components.  Where a list still spans several components, only the sets outside the largest one (movers) have to
meet the others, in cells of at most ``CELL`` by ``CELL`` sets on average: first every mover and the nearest set of another component
in each of its cells, then, between the components that are left, all that may link.  A pair that may link has passed an exact bound: bit parities
of a set make a map of some bits a member, and two maps differ in no more bits than the sets differ in members.  Such pairs, each once however
many lists they share, are checked on full sets rebuilt from the whole texts.  Texts of documents that pass with no other are left where they are: a Bloom
filter of fixed size over the ids in question picks rows while the texts are scanned.

Defined results: null texts and texts without words have an empty set and are linked with nothing; fewer words than a shingle make
one; rows of equal set are one class, and classes known by one id are one node; rows without an id are linked with
nothing and their component is null; an empty table gives no rows; long texts are read whole; other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.bbit_minhash import shingles
from riskweave.llm.components import components, relabelled
from riskweave.llm.id_filter import may_be_one_of
from riskweave.llm.text import Hashes, encoded, mixed, window_hashes
from riskweave.session import materialise

WIDTH, PERCENT = 3, 90
#: Sets of this size or more are never enumerated.
SMALLEST_LARGE = 30
#: Counters of the frequency sketch, in blocks that are summed apart.
COUNTERS, BLOCKS = 1 << 20, 64
#: 64-bit words of a parity map, at least and at most; a map has four bits a member or more up to that.
LEAST_WORDS, MOST_WORDS = 4, 1024
#: Words at most of the brief map that travels with every pair and cell; the whole map is asked of what passes it.
BRIEF_WORDS = 8
#: Sets on a side of a cell on average, and rows and characters of the groups that cells are put together in.
CELL, GROUP_ROWS, GROUP_CHARS = 512, 4000, 24_000_000


def needed(n: int, m: int, percent: int = PERCENT) -> int:
    """Members that sets of sizes n and m must share to link."""
    return -(-percent * (n + m) // (100 + percent))


def subset_sizes(n: int, below: int, percent: int = PERCENT) -> list[int]:
    """Sizes of the subsets that a set of n members shares with partners smaller than ``below``."""
    partners = (m for m in range(1, below) if 100 * min(n, m) >= percent * max(n, m))
    return sorted({c for m in partners if (c := needed(n, m, percent)) <= min(n, m)})


def boundary(sizes: dict[int, tuple[int, int]], percent: int = PERCENT) -> int:
    """Least size that counts as large, from size -> (sets, length of all lists their members are posted in)."""

    def cost(below: int) -> int:
        subsets = sum(count * sum(math.comb(n, c) for c in subset_sizes(n, below, percent)) for n, (count, _) in sizes.items() if n < below)
        return subsets + sum(lists for n, (_, lists) in sizes.items() if 100 * n >= percent * below)

    return min(range(1, SMALLEST_LARGE + 1), key=lambda below: (cost(below), below))


def posted(n: int, percent: int = PERCENT) -> int:
    """Members of a set of n that are posted: one more than a link may leave out."""
    return n + percent * -n // 100 + 1


# ---- frequencies


def sketch(documents: DataFrame, width: int = WIDTH) -> np.ndarray:
    """Counters of the shingles of all texts, by the low bits of their hashes; ``COUNTERS`` numbers, whatever the input."""
    size = COUNTERS // BLOCKS

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, counters = Hashes(), np.zeros(COUNTERS, np.int64)
        for batch in batches:
            places, held = [], 0
            for text in batch["text"]:
                words = encoded(text).lower().split()
                if words:
                    numbers = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
                    places.append((window_hashes(numbers, min(width, len(words))) & np.uint64(COUNTERS - 1)).astype(np.int64))
                    held += len(words)
                if held > COUNTERS:
                    counters += np.bincount(np.concatenate(places), minlength=COUNTERS)
                    places, held = [], 0
            if places:
                counters += np.bincount(np.concatenate(places), minlength=COUNTERS)
        if counters.any():
            yield pd.DataFrame({"block": np.arange(BLOCKS), "counters": [part.astype("<i8").tobytes() for part in counters.reshape(BLOCKS, size)]})

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Rows of a block one after another: many tasks give many rows.
        totals: dict[int, np.ndarray] = {}
        for frame in frames:
            for block, data in zip(frame["block"], frame["counters"], strict=True):
                totals[block] = totals.get(block, 0) + np.frombuffer(data, "<i8")
        if totals:
            yield pd.DataFrame({"block": list(totals), "counters": [total.astype("<i8").tobytes() for total in totals.values()]})

    schema = "block int, counters binary"
    parts = documents.select("text").mapInPandas(count, schema)
    out = np.zeros((BLOCKS, size), np.int64)
    for row in parts.repartition("block").mapInPandas(add, schema).collect():
        out[row["block"]] = np.frombuffer(row["counters"], "<i8")
    return out.reshape(-1)


# ---- sets


def parity_map(members: np.ndarray, most: int = MOST_WORDS) -> np.ndarray:
    """Bit parities of a set, a power of two of words: two maps of one width differ in at most as many bits as the sets in members.

    A map is halved by joining its halves with exclusive or.
    """
    words = LEAST_WORDS
    while words < most and 16 * words < len(members):
        words *= 2
    bits = np.bincount((mixed(members) >> np.uint64(40)).astype(np.int64) % (64 * words), minlength=64 * words) & 1
    return np.packbits(bits.astype(np.uint8)).view("<i8")


def signed(documents: DataFrame, frequency: np.ndarray, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Per row: id, hash of the text, size, characters, digest, parity map, posted members, length of their lists, and all members of a small set."""

    # What other shingles leave in a counter on average is not counted.
    others = int(frequency.sum()) // COUNTERS

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = Hashes()
        for batch in batches:
            out = []
            for text in batch["text"]:
                members = shingles(text, width, hashes)
                if not len(members):
                    out.append((0, len(text or ""), None, None, None, None, 0, None))
                    continue
                often = frequency[(members & np.uint64(COUNTERS - 1)).astype(np.int64)]
                first = np.argsort(often, kind="stable")[: posted(len(members), percent)]
                digest = hashlib.blake2b(members.tobytes(), digest_size=16).digest()
                small = members.view(np.int64) if len(members) < SMALLEST_LARGE else None
                out.append((len(members), len(text), digest, parity_map(members), parity_map(members, BRIEF_WORDS), members[first].view(np.int64), int(np.maximum(often[first] - others, 1).sum()), small))
            made = pd.DataFrame(out, columns=["n", "chars", "digest", "map", "brief", "posted", "lists", "members"])
            made.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy())
            made.insert(1, "text_hash", batch["text_hash"].to_numpy())
            yield made

    schema = "doc_id long, text_hash long, n long, chars long, digest binary, map array<long>, brief array<long>, posted array<long>, lists long, members array<long>"
    return materialise(_texts(documents).mapInPandas(sign, schema))


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")


def subsets(members: np.ndarray, size: int) -> np.ndarray:
    """Two 64-bit sums per subset of ``size`` members, which name it: of the whole less every choice of the others."""
    marks = np.stack([mixed(members), mixed(members ^ np.uint64(0x9E3779B97F4A7C15))])
    gone = len(members) - size
    with np.errstate(over="ignore"):
        whole = marks.sum(axis=1, dtype=np.uint64)
        if not gone:
            return whole[:, None]
        choices = np.array(list(itertools.combinations(range(len(members)), gone)))
        return whole[:, None] - marks[:, choices].sum(axis=2, dtype=np.uint64)


def small_links(classes: DataFrame, below: int, percent: int = PERCENT) -> DataFrame:
    """``a, b``: links among the sets below the boundary, one a member of every subset's bucket."""

    def enumerate_(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for id_, n, members in zip(batch["id"], batch["n"], batch["members"], strict=True):
                for size in subset_sizes(int(n), below, percent):
                    keys = subsets(np.asarray(members, np.int64).view(np.uint64), size).view(np.int64)
                    rows.append(pd.DataFrame({"c": size, "k1": keys[0], "k2": keys[1], "id": id_, "n": n}))
                    if sum(map(len, rows)) > 50_000:
                        yield pd.concat(rows)
                        rows = []
            if rows:
                yield pd.concat(rows)

    keys = ["c", "k1", "k2"]
    entries = classes.filter(F.col("n") < below).select("id", "n", "members").mapInPandas(enumerate_, "c int, k1 long, k2 long, id long, n long")
    entries = materialise(entries)
    least = entries.groupBy(*keys).agg(F.min(F.struct("n", "id")).alias("least"), F.count("*").alias("sets")).filter("sets > 1")
    met = entries.join(least.select(*keys, "least"), keys).filter(
        (F.col("id") != F.col("least.id")) & (F.col("c") >= _needed(F.col("n"), F.col("least.n"), percent))
    )
    return materialise(met.select(F.col("id").alias("a"), F.col("least.id").alias("b")))


def _needed(n: Column, m: Column, percent: int) -> Column:
    return F.ceil((n + m) * percent / F.lit(100 + percent))


# ---- lists


def _near(n: Column, m: Column, left: Column, right: Column, percent: int) -> Column:
    """Whether sizes and parity maps allow a link."""

    def halved(wide: Column, narrow: Column) -> Column:
        half = F.floor(F.size(wide) / 2).cast("int")
        joined = F.zip_with(F.slice(wide, 1, half), F.slice(wide, half + 1, half), lambda a, b: a.bitwiseXOR(b))
        return F.when(F.size(wide) > F.size(narrow), joined).otherwise(wide)

    # Sizes that allow a link give widths that are equal or the double.
    sizes = 100 * F.least(n, m) >= percent * F.greatest(n, m)
    bits = F.zip_with(halved(left, right), halved(right, left), lambda a, b: F.bit_count(a.bitwiseXOR(b)))
    return sizes & (F.aggregate(bits, F.lit(0), lambda a, b: a + b) <= n + m - 2 * _needed(n, m, percent))


def _differing(maps: list[np.ndarray], width: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits in which the maps of the pairs differ, at the width of the narrower one."""
    out, common = np.zeros(len(x), np.int64), np.minimum(width[x], width[y])
    for words in np.unique(common):
        at = np.flatnonzero(common == words)
        rows, place = np.unique(np.concatenate([x[at], y[at]]), return_inverse=True)
        grid = np.stack([m if len(m) == words else m[:words] ^ m[words:] for m in (maps[r] for r in rows)])
        out[at] = np.bitwise_count(grid[place[: len(at)]] ^ grid[place[len(at) :]]).sum(axis=1, dtype=np.int64)
    return out


def allowed(group: pd.DataFrame, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mover, other (places in the group) and differing bits of the pairs of a cell that differ in component and may link."""
    cell, mover = group.groupby(["key", "i", "j"], sort=False).ngroup().to_numpy(), group["mover"].to_numpy()
    n, component = group["n"].to_numpy(), group["component"].to_numpy()
    maps = [np.asarray(m, np.int64).view(np.uint64) for m in group["map"]]
    width = np.array([len(m) for m in maps], np.int64)
    left, right = np.flatnonzero(mover), np.flatnonzero(~mover)
    right = right[np.argsort(cell[right], kind="stable")]
    start, stop = (np.searchsorted(cell[right], cell[left], side) for side in ("left", "right"))
    out, ends = [], np.cumsum(stop - start)
    at = 0
    while at < len(left):
        # As many movers as have some 20,000 pairs; at least one.
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 20_000, "right")))
        counts = (stop - start)[at:to]
        x = np.repeat(left[at:to], counts)
        y = right[np.arange(len(x)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(start[at:to], counts)]
        small, large = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
        may = (component[x] != component[y]) & (100 * small >= percent * large)
        x, y = x[may], y[may]
        differ = _differing(maps, width, x, y)
        may = differ <= n[x] + n[y] - 2 * -(-percent * (n[x] + n[y]) // (100 + percent))
        out.append((x[may], y[may], differ[may]))
        at = to
    return tuple(map(np.concatenate, zip(*out, strict=True))) if out else (np.zeros(0, np.int64),) * 3


def nearest(group: pd.DataFrame, percent: int) -> pd.DataFrame:
    """``a, b``: every mover and the set of another component in its cell that differs from it in the fewest bits."""
    x, y, differ = allowed(group, percent)
    ids, order = group["id"].to_numpy(), np.lexsort((group["id"].to_numpy()[y], differ, x))
    first = order[np.flatnonzero(np.diff(x[order], prepend=-1))]
    return pd.DataFrame({"a": ids[x[first]], "b": ids[y[first]]})


def every_near(group: pd.DataFrame, percent: int) -> pd.DataFrame:
    """``a, b``: every mover and every set of another component in its cell that it may link with."""
    x, y, _ = allowed(group, percent)
    ids = group["id"].to_numpy()
    return pd.DataFrame({"a": ids[x], "b": ids[y]}).drop_duplicates()


def _chosen(choose: Callable, percent: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda group: choose(group, percent)


def links_of(group: pd.DataFrame, width: int, percent: int) -> pd.DataFrame:
    """``a, b``: components with a confirmed link in a cell.  A pair whose components are joined already is not looked at."""
    hashes, known, found = Hashes(), {}, set()
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    names, texts = list(zip(group["id"], group["text_hash"], strict=True)), group["text"].to_numpy()

    def members(at: int) -> np.ndarray:
        if names[at] not in known:
            known[names[at]] = shingles(texts[at], width, hashes)
        return known[names[at]]

    component = group["component"].tolist()
    x, y, differ = allowed(group, percent)
    for place in np.argsort(differ, kind="stable"):
        one, two = int(x[place]), int(y[place])
        ours, theirs = component[one], component[two]
        if (r := root(ours)) == (q := root(theirs)):
            continue
        a, b = members(one), members(two)
        both = len(np.intersect1d(a, b, assume_unique=True))
        if 100 * both >= percent * (len(a) + len(b) - both):
            parent[max(r, q)] = min(r, q)
            found.add((max(ours, theirs), min(ours, theirs)))
    return pd.DataFrame(sorted(found), columns=["a", "b"], dtype="int64")


def _grouped(rows: DataFrame, count: int) -> DataFrame:
    return rows.withColumn("g", F.pmod(F.xxhash64("key", "i", "j"), F.lit(count))).groupBy("g")


def confirmed(cells: DataFrame, documents: DataFrame, width: int, percent: int) -> DataFrame:
    """``a, b`` of components that link in a cell ``(key, i, j, mover, id, text_hash, component, n, map, chars)``."""
    texts = in_question(documents, cells.select("id").distinct())
    rows, chars = cells.agg(F.count("*"), F.coalesce(F.sum("chars"), F.lit(0))).first()

    def check(group: pd.DataFrame) -> pd.DataFrame:
        return links_of(group, width, percent)

    # Both sides grow with the input: merged at every size.
    joined = cells.join(texts.hint("merge"), ["id", "text_hash"]).select("key", "i", "j", "mover", "id", "text_hash", "component", "n", "map", "text")
    groups = 1 + max(rows // GROUP_ROWS, chars // GROUP_CHARS)
    return materialise(_grouped(joined, groups).applyInPandas(check, "a long, b long").distinct())


def in_question(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """``id, text_hash, text`` of the rows whose id may be one of ``ids (id)``, each once."""
    known = _texts(documents).withColumnRenamed("doc_id", "id")
    asked = known.filter(may_be_one_of(ids)(F.col("id")))
    return materialise(asked.groupBy("id", "text_hash").agg(F.first("text").alias("text")))


def stars(pairs: DataFrame) -> DataFrame:
    """Cells of one leader and at most about ``CELL`` of its sets, from ``a, b`` (b the leader): ``key, i, j, mover, id``."""
    # Written first: a join that groups by the same key could not be split.
    crowds = materialise(pairs.groupBy("b").agg(F.ceil(F.count("*") / CELL).cast("int").alias("parts")))
    part = F.pmod(F.xxhash64("a", F.lit(5)), F.col("parts")).cast("int").alias("i")
    rows = pairs.join(crowds, "b").select(F.col("b").alias("key"), part, F.lit(0).alias("j"), F.lit(True).alias("mover"), F.col("a").alias("id"))
    leads = crowds.select(F.col("b").alias("key"), F.explode(F.expr("sequence(0, parts - 1)")).alias("i"), F.lit(0).alias("j"), F.lit(False).alias("mover"), F.col("b").alias("id"))
    return rows.unionByName(leads)


def met_in_stars(pairs: DataFrame, marks: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """The cells of ``stars`` with what a check needs; a set is its own component where there are no labels."""
    cells = stars(pairs).hint("merge").join(marks.hint("merge"), "id")
    if labels is None:
        return materialise(cells.withColumn("component", F.col("id")))
    return materialise(cells.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id")))


def passing(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` that sizes and maps of ``marks (id, n, map)`` allow to link."""
    one, two = (marks.select(F.col("id").alias(s), F.col("n").alias(f"n{s}"), F.col("map").alias(f"map{s}")) for s in "ab")
    # Both sides grow with the input: merged at every size.  No grouping by these keys, so that hot ones can be split.
    joined = pairs.hint("merge").join(one.hint("merge"), "a").join(two.hint("merge"), "b")
    return materialise(joined.filter(_near(F.col("na"), F.col("nb"), F.col("mapa"), F.col("mapb"), percent)).select("a", "b"))


def between(members: DataFrame, marks: DataFrame) -> tuple[DataFrame, int]:
    """Cells between the sets outside the largest component of a list and all others, and how many rows they have."""
    sizes = members.groupBy("key", "component").agg(F.count("*").alias("sets"))
    spans = sizes.groupBy("key").agg(F.max(F.struct("sets", "component")).alias("top"), F.count("*").alias("parts"), F.sum("sets").alias("m"))
    spans = materialise(spans.filter("parts > 1").select(
        "key", F.col("top.component").alias("top"), "m", (F.col("m") - F.col("top.sets")).alias("moving"),
        F.ceil(F.col("m") / CELL).cast("int").alias("right"), F.ceil((F.col("m") - F.col("top.sets")) / CELL).cast("int").alias("left"),
    ))
    rows = materialise(members.join(spans.drop("m", "moving"), "key"))
    place = F.xxhash64("id", F.lit(3))
    every = lambda n: F.explode(F.expr(f"sequence(0, {n} - 1)"))
    movers = rows.filter("component <> top").withColumn("i", F.pmod(place, F.col("left")).cast("int")).withColumn("j", every("right"))
    others = rows.withColumn("j", F.pmod(place, F.col("right")).cast("int")).withColumn("i", every("left"))
    names = ["key", "i", "j", "id", "component"]
    sides = movers.select(*names, F.lit(True).alias("mover")).unionByName(others.select(*names, F.lit(False).alias("mover")))
    copied = spans.agg(F.sum(F.expr("moving * right + m * left"))).first()[0] or 0
    return sides.hint("merge").join(marks.hint("merge"), "id"), copied


def _labelled(shared: DataFrame, labels: DataFrame) -> DataFrame:
    members = shared.hint("merge").join(labels.hint("merge"), "id", "left")
    return members.select("key", "id", F.coalesce("component", "id").alias("component"))


def joined_by(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after links between components; ids that had no label so far are their own component."""
    merged = components(links).select(F.col("id").alias("component"), F.col("component").alias("p"))
    ends = links.select(F.col("a").alias("id")).union(links.select(F.col("b").alias("id"))).distinct()
    fresh = ends.join(labels, "id", "left_anti").select("id", F.col("id").alias("component"))
    return materialise(relabelled(labels.unionByName(fresh), merged))


def linked_sets(documents: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Per row: ``doc_id, n_shingles, component_id``."""
    rows = signed(documents, sketch(documents, width), width, percent)
    full = rows.filter("n > 0 and doc_id is not null")
    first = [F.first(c).alias(c) for c in ("n", "chars", "map", "brief", "posted", "lists", "members")]
    classes = full.groupBy("digest").agg(F.min(F.struct("doc_id", "text_hash")).alias("least"), *first)
    classes = materialise(classes.select("digest", F.col("least.doc_id").alias("id"), F.col("least.text_hash").alias("text_hash"), *[c for c in classes.columns[2:]]))
    sizes = classes.filter(F.col("n") < SMALLEST_LARGE).groupBy("n").agg(F.count("*").alias("sets"), F.sum("lists").alias("lists"))
    below = boundary({r["n"]: (r["sets"], r["lists"]) for r in sizes.collect()}, percent)
    small = small_links(classes, below, percent)

    # Lists with more than one set, and their leaders.
    large = classes.filter(100 * F.col("n") >= percent * below)
    entries = large.select("id", F.explode("posted").alias("key"))
    lists = entries.groupBy("key").agg(F.count("*").alias("sets"), F.min("id").alias("lead")).filter("sets > 1")
    # Both sides of such joins grow with the input: merged at every size, never broadcast where still small.
    shared = materialise(entries.hint("merge").join(lists.hint("merge"), "key"))
    marks = classes.select("id", "text_hash", "n", "map", "chars")
    briefs = classes.select("id", "n", F.col("brief").alias("map"))
    met = materialise(shared.filter("id <> lead").select(F.col("id").alias("a"), F.col("lead").alias("b")).distinct())
    pairs = passing(passing(met, briefs, percent), marks, percent)
    labels = components(small.unionByName(confirmed(met_in_stars(pairs, marks), documents, width, percent)))

    # In a list of two the pair has met.
    shared = shared.filter("sets > 2").select("key", "id")

    for choose in (nearest, every_near):
        cells, count = between(_labelled(shared, labels), briefs)
        pairs = materialise(_grouped(cells, 1 + count // GROUP_ROWS).applyInPandas(_chosen(choose, percent), "a long, b long"))
        pairs = passing(materialise(pairs.distinct()), marks, percent)
        labels = joined_by(labels, confirmed(met_in_stars(pairs, marks, labels), documents, width, percent))

    of_class = classes.select("digest", F.col("id").alias("least"))
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), "digest").join(of_class, "digest", "left")
    out = out.join(labels.select(F.col("id").alias("least"), "component"), "least", "left")
    known = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "least", "doc_id"))
    return out.select("doc_id", "n_shingles", known.alias("component_id"))


def jaccard_join(documents: DataFrame) -> DataFrame:
    """Per document: the size of its set and its component, with the contract's shingles and share."""
    return linked_sets(documents)


SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(list_slice(w, i, i + 2), ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
r AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.d WHERE r.c < l.b)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id
FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT d, min(c) AS c FROM r GROUP BY d) m ON m.d = doc_id
"""
