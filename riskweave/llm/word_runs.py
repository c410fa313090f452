"""Periodic runs of words, found by a suffix automaton with link-cut access.

A run is a stretch of consecutive words with smallest period q and a length of at least ``max(least, times * q)`` that no
neighbouring word extends keeping period q.

The suffix automaton of a text gives a tree of suffix links: the path from the state of a prefix to the root stands for
all suffixes of that prefix, the longest first.  Every state on it has a *last occurrence*, the end of its latest
occurrence so far.  Appending word i is one link-cut access of the state of prefix i: the preferred paths it
meets are the segments of equal last occurrence, and all of them are recoloured to i.  A segment with last occurrence e whose deepest
state on the path has length L says that the suffix of length L ends at i and, latest, at e: with d = i - e it has period d, and if
``L >= (times - 1) * d`` that is a power of at least ``times``, which is extended to both sides to the run it lies in.
Every run is met so: at its last word the suffix without the first q words ended latest q words before (an occurrence
between would give the run a smaller period, by Fine and Wilf).  Of equal stretches the smallest period counts.

Before that a text is cut where no run can pass.  A pair of neighbouring words in a run occurs at least
``times - 1`` times in it, so a rarer pair lies in no run; pairs are counted again in the pieces that
are left until none falls away.  Only such pieces are appended to an automaton; the cut never loses a run.

A text is one row and one call: the automaton holds one piece (some 500 bytes a word), nothing is kept between texts.

Defined results: null and empty texts have no words, no runs and an empty collapsed text; a text of any length is read
whole; repeated rows give repeated rows; an empty table gives no rows; other columns are not read or are passed on.
Words are runs of characters other than space and ``\\t \\n \\v \\f \\r``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.text import CRC_SQL, WORD, words_of

#: Powers that count as a run, and the least number of words.
TIMES, LEAST = 4, 6
FOUND = "runs array<struct<start: long, length: long, period: long>>, collapsed string"


def suffix_links(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffix automaton: link and greatest length of every state, and the state of every prefix.  State 0 is the root."""
    steps: list[dict[int, int]] = [{}]
    link, length, prefix = [-1], [0], []
    last = 0
    for word in words:
        state = len(link)
        steps.append({})
        length.append(length[last] + 1)
        at = last
        while at >= 0 and word not in steps[at]:
            steps[at][word] = state
            at = link[at]
        if at < 0:
            link.append(0)
        else:
            there = steps[at][word]
            if length[there] == length[at] + 1:
                link.append(there)
            else:
                copy = state + 1
                link.append(copy)
                steps.append(steps[there].copy())
                length.append(length[at] + 1)
                link.append(link[there])
                link[there] = copy
                while at >= 0 and steps[at].get(word) == there:
                    steps[at][word] = copy
                    at = link[at]
        prefix.append(state)
        last = state
    return link, length, prefix


class LastOccurrences:
    """Link-cut access over the tree of suffix links.

    A preferred path is a splay tree ordered by depth; it holds the states of one last occurrence, which is kept at the tree's
    root.  Nodes are states plus one, 0 is none.
    """

    def __init__(self, link: list[int], length: list[int]) -> None:
        self.up = [0] + [at + 1 for at in link]
        self.shallow = [0] * len(self.up)
        self.deep = [0] * len(self.up)
        self.last = [-1] * len(self.up)
        self.length = [0, *length]

    def _splay(self, x: int) -> None:
        up, shallow, deep = self.up, self.shallow, self.deep
        while (y := up[x]) and (shallow[y] == x or deep[y] == x):
            z = up[y]
            inner = z and (shallow[z] == y or deep[z] == y)
            # A straight line turns the parent first, a bend the node twice.
            turns = ((y, x) if (shallow[z] == y) == (shallow[y] == x) else (x, x)) if inner else (x,)
            if not inner:
                self.last[x] = self.last[y]
            else:
                w = up[z]
                if not w or (shallow[w] != z and deep[w] != z):
                    self.last[x] = self.last[z]
            for a in turns:
                b = up[a]
                c = up[b]
                if shallow[b] == a:
                    inside = shallow[b] = deep[a]
                    deep[a] = b
                else:
                    inside = deep[b] = shallow[a]
                    shallow[a] = b
                if inside:
                    up[inside] = b
                up[b] = a
                up[a] = c
                if c:
                    if shallow[c] == b:
                        shallow[c] = a
                    elif deep[c] == b:
                        deep[c] = a

    def access(self, state: int, end: int) -> list[tuple[int, int]]:
        """(last occurrence, length) of the segments from the state up to the root, which all get ``end``."""
        met, below, x = [], 0, state + 1
        while x:
            self._splay(x)
            last = self.last[x]
            if self.deep[x]:
                self.last[self.deep[x]] = last
            if last >= 0:
                met.append((last, self.length[x]))
            self.deep[x] = below
            below = x
            x = self.up[x]
        self.last[below] = end
        return met


def runs_of(words: list[int], times: int = TIMES, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence, by start and period."""
    link, length, prefix = suffix_links(words)
    paths, count = LastOccurrences(link, length), len(words)
    found: dict[tuple[int, int], int] = {}
    reach: dict[int, int] = {}
    for end, state in enumerate(prefix):
        for last, size in paths.access(state, end):
            period = end - last
            # A run is entered once: two runs of one period share fewer words than the period.
            if size < (times - 1) * period or end <= reach.get(period, -1):
                continue
            start, stop = last - size + 1, end + 1
            while start and words[start - 1] == words[start - 1 + period]:
                start -= 1
            while stop < count and words[stop] == words[stop - period]:
                stop += 1
            reach[period] = stop - 1
            found[start, stop] = min(period, found.get((start, stop), period))
    chosen = [(a, b - a, q) for (a, b), q in found.items() if b - a >= max(least, times * q)]
    return sorted(chosen, key=lambda run: (run[0], run[2]))


def pieces(words: np.ndarray, times: int = TIMES, least: int = LEAST) -> list[tuple[int, int]]:
    """(start, stop) of the stretches a run can lie in: no pair of neighbours rarer than ``times - 1`` in its stretch."""
    if len(words) < least:
        return []
    pairs = np.unique(words[:-1] * (int(words.max()) + 1) + words[1:], return_inverse=True)[1]
    at = np.arange(len(pairs))
    while len(at):
        piece = np.cumsum(np.diff(at, prepend=at[0]) > 1)
        _, which, counts = np.unique(piece * len(pairs) + pairs[at], return_inverse=True, return_counts=True)
        stays = (counts[which] >= times - 1) & (np.bincount(piece)[piece] >= least - 1)
        if stays.all():
            starts = np.flatnonzero(np.diff(piece, prepend=-1))
            return [(int(at[a]), int(at[b - 1]) + 2) for a, b in zip(starts, [*starts[1:], len(at)], strict=True)]
        at = at[stays]
    return []


def collapsed(text: str | None, times: int = TIMES, least: int = LEAST) -> tuple[list[tuple[int, int, int]], str]:
    """Runs of a text, and its words joined by one space without what any run repeats after its first period."""
    words = words_of(text)
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    runs = []
    for start, stop in pieces(ids, times, least):
        runs += [(start + a, n, q) for a, n, q in runs_of(ids[start:stop].tolist(), times, least)]
    runs.sort(key=lambda run: (run[0], run[2]))
    if runs:
        stays = np.ones(len(words), bool)
        for start, length, period in runs:
            stays[start + period : start + length] = False
        words = [words[i] for i in np.flatnonzero(stays)]
    return runs, b" ".join(words).decode("utf-8", "surrogatepass")


def found_in(text: Column, times: int = TIMES, least: int = LEAST) -> Column:
    """Struct of ``runs`` (start, length, period; by start and period) and ``collapsed`` of a text."""
    if times < 2:
        raise ValueError("a run repeats at least twice")

    @F.pandas_udf(FOUND)
    def each(texts: pd.Series) -> pd.DataFrame:
        rows = [collapsed(text, times, least) for text in texts]
        runs = [[{"start": a, "length": n, "period": q} for a, n, q in own] for own, _ in rows]
        return pd.DataFrame({"runs": runs, "collapsed": [text for _, text in rows]})

    return each(text)


def collapse_runs(documents: DataFrame, times: int = TIMES, least: int = LEAST) -> DataFrame:
    """``doc_id, runs, collapsed`` per row of ``documents (doc_id, text)``."""
    out = documents.select("doc_id", found_in(F.col("text"), times, least).alias("found"))
    return out.select("doc_id", "found.runs", "found.collapsed")


def with_repeats(documents: DataFrame) -> DataFrame:
    """``doc_id, text`` where a tenth of the texts, chosen by id, repeat one stretch up to their end (a null id: never)."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = documents.select("doc_id", "text", h.alias("h")).withColumn(
        "w", F.when(F.col("h") % 10 == 0, F.expr(rf"regexp_extract_all(text, '{WORD}', 0)".replace("\\", "\\\\")))
    )
    rows = rows.withColumn("n", F.coalesce(F.size("w"), F.lit(0))).withColumn("g", F.expr("h div 10"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.expr("cast(g % n as int)")))
    rows = rows.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    tail = F.expr("transform(sequence(a, n - 1), i -> element_at(w, a + (i - a) % p + 1))")
    text = F.when(F.col("n") > 0, F.array_join(F.concat(F.expr("slice(w, 1, a)"), tail), " ")).otherwise(F.col("text"))
    return rows.select("doc_id", text.alias("text"))


def greatest(runs: Column) -> Column:
    """The run of greatest length by period, exactly; of equal ones the first."""

    def order(a: Column, b: Column) -> Column:
        left, right = a["length"] * b["period"], b["length"] * a["period"]
        first = F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1))
        first = first.when(a["period"] < b["period"], -1).when(a["period"] > b["period"], 1).otherwise(0)
        return F.when(left > right, -1).when(left < right, 1).otherwise(first)

    return F.get(F.array_sort(runs, order), F.lit(0))


def period_runs(documents: DataFrame) -> DataFrame:
    """Per row of the texts with repeats: number of runs, the greatest, and digests of all runs and of the collapsed text."""
    rows = collapse_runs(with_repeats(documents))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    rows = rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), greatest(F.col("runs")).alias("best"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
    return rows.select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {CRC_SQL.format("doc_id::VARCHAR")} AS h,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
a AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d),
p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM a),
x AS (SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_concat(w[1:a],
    list_transform(range(a, n), lambda i: w[a + (i - a) % p + 1])) END AS w FROM p),
u AS (SELECT r, n, unnest(w) AS v, unnest(range(n)) AS i FROM x),
e AS (SELECT s.r, s.i, t.i - s.i AS q FROM u s JOIN u t ON s.r = t.r AND s.v = t.v AND t.i > s.i AND 4 * (t.i - s.i) <= s.n),
k AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS o FROM e),
g AS (SELECT r, q, min(i) AS s, count(*) + q AS l FROM k GROUP BY r, q, o HAVING count(*) + q >= greatest(6, 4 * q)),
f AS (SELECT r, s, l, min(q) AS q FROM g GROUP BY r, s, l),
b AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY l::DOUBLE / q DESC, s, q) AS best FROM f),
m AS (SELECT r, count(*) AS n_runs, max(s) FILTER (best = 1) AS s, max(l) FILTER (best = 1) AS l, max(q) FILTER (best = 1) AS q,
    string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM b GROUP BY r),
z AS (SELECT DISTINCT r, unnest(range(s + q, s + l)) AS i FROM f),
c AS (SELECT u.r, string_agg(u.v, ' ' ORDER BY u.i) AS t FROM u ANTI JOIN z ON u.r = z.r AND u.i = z.i GROUP BY u.r)
SELECT x.doc_id, coalesce(m.n_runs, 0)::BIGINT AS n_runs, m.s AS start, m.l AS length, m.q AS period,
  1000 * m.l // m.q AS exponent_milli, sha256(coalesce(m.lines, '')) AS runs_sha256, sha256(coalesce(c.t, '')) AS collapsed_sha256
FROM x LEFT JOIN m ON m.r = x.r LEFT JOIN c ON c.r = x.r
"""
