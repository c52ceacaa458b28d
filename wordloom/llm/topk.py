"""Exact top-k inner products without random access (NRA) over sorted lists.

Per block of candidates and dimension there is one list of the components in
descending order; a query reads it from the top where its own component is
positive and from the bottom where it is negative, deeper round by round.  What
has been read of a candidate and the list's frontier give bounds of its score:

* upper: an unread component counts as the frontier, the best that can follow;
* lower: an unread component counts as the far end of the list.

For a whole block of queries the bounds are matrix products: at depth t the upper
bound of dimension d is q⁺·max(v, frontier) + q⁻·min(v, frontier), because a
component has been read exactly when it lies beyond the frontier.  A candidate is
out for a query when its upper bound is below the k-th best lower bound; a
candidate that is out for all queries is read no further.  Reading stops when
no more than a few times k candidates are left for each query (or the lists are
read through), and their scores are then resolved exactly.  Ties are never cut:
a candidate goes only if its bound is strictly below.

Vectors are dealt by hash to blocks of bounded mean size; a block of queries and a
block of candidates meet as the rows of one group, keyed by the pair of blocks.
Each group returns k rows a query, and a window keeps the k best of all.

Defined results: vectors that are null or hold null or non-finite components take no
part; vectors of different lengths have no score; repeated rows are candidates, and queries, of
their own; rows with the query's own id are never its answers; ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ship, stored
from .vectors import matrix, usable

QUERIES = 2048  # of a pair of blocks
CANDIDATES = 4096
AT_ONCE = 256  # queries whose bounds are held at a time
DEPTHS = (0.12, 0.25, 0.45, 0.7)  # shares of the lists read by the end of each round
EXACT = 2.0 ** 53  # sums of integers below are exact in doubles


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer inner products of each query and candidate."""
    bound = np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * q.shape[1]
    if bound < EXACT:
        return (q @ v.T).astype(np.int64)
    exact = [[int(x) for x in row] for row in v.tolist()]
    return np.array([[sum(int(a) * b for a, b in zip(row, other, strict=True)) for other in exact]
                     for row in q.tolist()], dtype=np.int64).reshape(len(q), len(v))


def top_of_block(q_ids: np.ndarray, q: np.ndarray, v_ids: np.ndarray, v: np.ndarray,
                 k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, candidate index, score) of each query's ``k`` best candidates of a block, ties included
    by the smaller id; a candidate with the query's own id is left out."""
    own = q_ids[:, None] == v_ids[None, :]
    bound = np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * q.shape[1]
    kind = np.float32 if bound < 2.0 ** 24 else np.float64  # whichever holds the sums exactly
    plus, minus = np.maximum(q, 0).astype(kind), np.minimum(q, 0).astype(kind)
    v = v.astype(kind) if bound < EXACT else v
    ordered = np.sort(v, axis=0)  # the lists, from their bottom to their top
    n = len(v)
    left = np.arange(n)  # candidates that some query still needs
    alive = ~own
    for share in DEPTHS if bound < EXACT and n > 8 * k else ():
        depth = int(share * n)
        top, bottom = ordered[n - 1 - depth], ordered[depth]  # frontiers: the last entries read
        x = v[left]
        down, up = x >= top, x <= bottom  # read from the top, from the bottom
        lower = plus @ np.where(down, x, ordered[0]).T + minus @ np.where(up, x, ordered[-1]).T
        upper = plus @ np.where(down, x, top).T + minus @ np.where(up, x, bottom).T
        lower[~alive] = -np.inf
        if len(left) > k:
            kth = np.partition(lower, len(left) - k, axis=1)[:, len(left) - k]
            alive &= upper >= kth[:, None]
        needed = alive.any(axis=0)
        left, alive = left[needed], alive[:, needed]
        if alive.sum(axis=1).max(initial=0) <= 4 * k:
            break
    score = _products(q, v[left])
    low = np.iinfo(np.int64).min
    rows, cols = [], []
    for i in range(len(q)):
        c = np.flatnonzero(alive[i])
        if len(c) > k:  # the k-th best score, then ties by id
            s = score[i, c]
            c = c[s >= np.partition(s, len(c) - k)[len(c) - k]]
        best = c[np.lexsort((v_ids[left[c]], -np.maximum(score[i, c], low + 1)))][:k]
        rows.append(np.full(len(best), i))
        cols.append(best)
    r, c = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (rows, cols))
    return r, left[c], score[r, c]


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of ``vectors`` (vec_id, embedding) with ``is_query``."""
    whole = usable(vectors).select(
        "vec_id", F.transform("x", lambda c: F.floor(c * F.lit(scale)).cast("double")).alias("x"),
        is_query.alias("q"))
    # rows are numbered, so that repeated rows, each a candidate of its own, spread over the blocks
    whole = stored(whole.withColumn("dim", F.size("x")).withColumn("row", F.monotonically_increasing_id()), "whole-vectors")
    n, n_queries = whole.agg(F.count(F.lit(1)), F.count(F.when(F.col("q"), 1))).first()
    c_groups, q_groups = -(-n // CANDIDATES) or 1, -(-n_queries // QUERIES) or 1
    place = F.xxhash64("row")
    candidates = whole.select("dim", F.pmod(place, F.lit(c_groups)).alias("cg"), F.explode(
        F.sequence(F.lit(0), F.lit(q_groups - 1))).alias("qg"), F.lit(False).alias("q"), "vec_id", "x")
    queries = whole.where("q").select("dim", F.explode(F.sequence(F.lit(0), F.lit(c_groups - 1))).alias("cg"), F.pmod(
        place, F.lit(q_groups)).alias("qg"), F.lit(True).alias("q"), "vec_id", "x")

    def run(group: pa.Table) -> pa.Table:
        asked = group.column("q").to_numpy()
        ids, x = group.column("vec_id").to_numpy(), matrix(group.column("x"))
        v_ids, v = ids[~asked], x[~asked]
        q_ids, q = ids[asked], x[asked]
        out = [top_of_block(q_ids[i:i + AT_ONCE], q[i:i + AT_ONCE], v_ids, v, k) for i in range(0, len(q), AT_ONCE)]
        rows = [np.concatenate(c) if c else np.zeros(0, dtype=np.int64) for c in zip(*(
            (q_ids[i * AT_ONCE + r], v_ids[c], s) for i, (r, c, s) in enumerate(out)), strict=True)] or [
            np.zeros(0, dtype=np.int64)] * 3
        return pa.table({"query_id": rows[0], "vec_id": rows[1], "score": rows[2]})

    ship(vectors.sparkSession)
    found = candidates.unionByName(queries.select(candidates.columns)).groupBy("dim", "qg", "cg").applyInArrow(
        run, "query_id long, vec_id long, score long")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
