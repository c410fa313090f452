"""Nearest neighbours by a block matrix join: int8 tiles with error bounds, then exact scores.

Queries and candidates are dealt by a hash of their id into groups of bounded size; every (query group, candidate
group) is one cell of a grid, joined by cogroup.  A cell multiplies int8 tiles.  With ``v = s (q + e)``, ``q`` the
int8 vector, ``s`` its scale and ``|e_i| <= 1/2``, the product of two vectors differs from ``s_u s_v <q_u, q_v>`` by at
most ``s_u s_v (|q_u|_1 / 2 + |q_v|_1 / 2 + d / 4)``.  Pairs whose upper bound is below the k-th best lower bound
seen by the query are dropped; the others are computed in double precision on the original vectors, in the order
of the components.  Each cell keeps the best ``k`` of every query in heaps; a top-k window merges the cells.

Neither side is broadcast and no cell grows with the input: more rows are more cells.  Work is queries times
candidates, as a search of a stated query set against all rows is.

Defined results: vectors that are null, empty, zero, or hold a null or a non-finite component take no part, as
query or candidate; only vectors of equal length are compared; equal scores are ordered by the smaller id; rows that
repeat an id count once (the least vector by component order, should they differ); null ids take no part; a query
with fewer than ``k`` candidates gets all of them; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.session import materialise

K = 20
QUERY_ROWS = 1024
CANDIDATE_ROWS = 8192
#: Candidates per tile within a cell.
TILE = 2048


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = F.forall(vector, lambda x: x == 0)
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~odd & ~zero, F.lit(False))


def quantised(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values (held as floats for the matrix product), scales, and sums of absolute values."""
    scale = np.abs(vectors).max(axis=1) / 127
    scale = np.where(scale > 0, scale, 1.0)
    whole = np.rint(vectors / scale[:, None]).clip(-127, 127).astype(np.int8)
    return whole, scale, np.abs(whole.astype(np.int32)).sum(axis=1).astype(float)


def exact(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products row by row in double precision, added up in component order."""
    total = np.zeros(len(queries))
    for at in range(queries.shape[1]):
        total += queries[:, at] * candidates[:, at]
    return total


def best_of_cell(query_ids, queries, candidate_ids, candidates, k: int = K) -> list[tuple[int, float, int]]:
    """``(query, score, candidate)``: the best ``k`` of every query among the candidates of one cell."""
    heaps: list[list[tuple[float, int]]] = [[] for _ in query_ids]
    floor = np.full(len(query_ids), -np.inf)  # the k-th best lower bound so far
    lows = np.full((len(query_ids), 0), -np.inf)
    q8, q_scale, q_sum = quantised(queries)
    q_wide = q8.astype(np.float64 if queries.shape[1] > 1000 else np.float32)  # whole numbers stay exact
    for at in range(0, len(candidate_ids), TILE):
        ids, vectors = candidate_ids[at : at + TILE], candidates[at : at + TILE]
        c8, c_scale, c_sum = quantised(vectors)
        scale = q_scale[:, None] * c_scale[None]
        product = (q_wide @ c8.T.astype(q_wide.dtype)).astype(np.float64) * scale
        slack = scale * (0.5 * q_sum[:, None] + 0.5 * c_sum[None] + queries.shape[1] / 4) * (1 + 1e-9) + 1e-300
        own = query_ids[:, None] == ids[None]
        low = np.where(own, -np.inf, product - slack)
        lows = np.concatenate([lows, low], axis=1)
        if lows.shape[1] > k:
            lows = np.partition(lows, lows.shape[1] - k, axis=1)[:, -k:]
        if lows.shape[1] == k:
            floor = lows.min(axis=1)
        row, column = np.nonzero((product + slack >= floor[:, None]) & ~own)
        if not len(row):
            continue
        scores = exact(queries[row], vectors[column])
        order = np.lexsort((ids[column], -scores, row))
        row, scores, found = row[order], scores[order], ids[column[order]]
        ends = np.searchsorted(row, np.arange(len(query_ids) + 1))
        for q in np.unique(row):
            span = slice(ends[q], min(ends[q] + k, ends[q + 1]))
            for score, candidate in zip(scores[span].tolist(), found[span].tolist(), strict=True):
                entry = (score, -candidate)
                if len(heaps[q]) < k:
                    heapq.heappush(heaps[q], entry)
                elif entry > heaps[q][0]:
                    heapq.heapreplace(heaps[q], entry)
                else:
                    break  # the rest of the tile is no better
    return [(int(query_ids[q]), score, -negative) for q, heap in enumerate(heaps) for score, negative in heap]


def search(
    rows: DataFrame, is_query: Column, k: int = K, id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """``query_id, rank, vec_id, score``: nearest ``k`` candidates of every query row."""
    plain = rows.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"), is_query.alias("q"))
    plain = materialise(plain.filter(F.col("id").isNotNull() & usable(F.col("v"))))
    sizes = plain.agg(F.count("*").alias("n"), F.sum(F.col("q").cast("long")).alias("q")).first()
    query_groups = 1 + (sizes["q"] or 0) // QUERY_ROWS
    candidate_groups = 1 + sizes["n"] // CANDIDATE_ROWS
    # A repeated id always falls in the same group, so it is made one there.
    by_query = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(query_groups)).cast("int")
    by_candidate = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(candidate_groups)).cast("int")
    dims = F.size("v").alias("d")
    every = F.explode(F.sequence(F.lit(0), F.lit(candidate_groups - 1))).alias("c")
    queries = plain.filter("q").select("id", "v", dims, by_query.alias("g"), every)
    every = F.explode(F.sequence(F.lit(0), F.lit(query_groups - 1))).alias("g")
    candidates = plain.select("id", "v", dims, every, by_candidate.alias("c"))

    def matrix(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        ids, vectors = group["id"].to_numpy(np.int64), np.stack(group["v"].to_numpy()).astype(np.float64)
        order = np.lexsort((*vectors.T[::-1], ids))
        ids, vectors = ids[order], vectors[order]
        first = np.concatenate([[True], ids[1:] != ids[:-1]])
        return ids[first], vectors[first]

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "score", "vec_id"]
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "score": [], "vec_id": []})
        return pd.DataFrame(best_of_cell(*matrix(left), *matrix(right), k), columns=names)

    keys = ["g", "c", "d"]
    found = queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInPandas(cell, "query_id long, score double, vec_id long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(embeddings: DataFrame) -> DataFrame:
    return search(embeddings, F.coalesce(F.col("vec_id") % 20 == 0, F.lit(False)))


SQL = f"""
WITH e AS (
  SELECT vec_id, min(embedding::DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))
    AND NOT list_bool_and(list_transform(embedding, lambda x: x = 0))
  GROUP BY vec_id),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v) AS score
  FROM e q JOIN e c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM p QUALIFY rank <= {K}
"""
