"""Embedding near-dedup on a robust-pruned flat graph.

1. Equal vectors become one point with a weight, before anything else is shuffled.
2. Points are dealt to overlapping cluster shards: each goes to its ``OVERLAP`` nearest
   centroids (vectors sampled by hash), shard by shard again while a shard is large and not
   dense.  A dense shard, one group of near copies, is not cut by closeness but into blocks
   by hash, and its blocks are compared pair by pair.
3. In each block a flat graph is built by robust pruning: a point links to its nearest
   point, drops all points that are nearer to that one by ``ALPHA``, and so on up to
   ``DEGREE`` links; links are made mutual and the block's medoid reaches every point.
4. The adjacency lists of a point from all its shards are united.
5. Every point searches each block that it meets, from the block's medoid, over the united
   lists: a greedy search with a beam of ``BEAM`` that goes on expanding as long as
   points within the range turn up.
6. Each hit is verified with the cosine of the original vectors in double precision.

A pair that meets in several shards counts in the least of them.  Tasks return link
counts and one row per point and block (its smallest linked id), never pairs, so a group
of copies costs as many rows as it has members.  ``audit`` measures recall against
brute force after every search, point by point for a sample of points, so that a dense group weighs no more than any
other; below the target the search is repeated with a wider beam and more overlap, and after ``ATTEMPTS`` searches
below it all pairs of blocks of all points are compared, which finds every link.

Defined results: vectors null, empty, zero or with null or non-finite components link with
nothing and are kept; vectors of different lengths do not link; equal repeated rows are
one vector; rows without an id are left out; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import connected_components, map_arrow, ship, stored
from .vectors import matrix, usable

SHARD = 320  # points a shard aims at
LARGE = 1024  # a larger shard is split again
BLOCK = 512  # points of a block of a dense shard
CENTROIDS = 512  # of a split
APART = 0.8  # cosine from which a centroid stands for another
SALT = 8192  # points of a shard that a task assigns at a time
LEVELS = 6
DENSE = 0.6  # mean cosine to the centroid from which a shard counts as dense
OVERLAP = 3
DEGREE = 20
ALPHA = 1.2
BEAM = 24
EXPAND = 4  # points expanded by a query in one step
RECALL = 0.95
AUDIT = 256  # points whose links are counted exactly
ATTEMPTS = 3


def prune_graph(sims: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Mutual adjacency matrix of the robust-pruned graph over all points, reachable from the medoid."""
    n = len(sims)
    dist = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * sims)).astype(np.float32)
    rest = dist.copy()
    np.fill_diagonal(rest, np.inf)
    linked = np.zeros((n, n), dtype=bool)
    rows = np.arange(n)
    for _ in range(min(degree, n - 1)):
        near = rest.argmin(axis=1)
        some = np.isfinite(rest[rows, near])
        if not some.any():
            break
        linked[rows[some], near[some]] = True
        rest[alpha * dist[near] <= dist] = np.inf
        rest[rows, near] = np.inf
    linked |= linked.T
    reached = np.zeros(n, dtype=bool)
    front = np.array([medoid(sims)])
    while len(front):
        reached[front] = True
        front = np.flatnonzero(linked[front].any(axis=0) & ~reached)
    if not reached.all():  # each point left out gets a link to the nearest point reached
        out, inner = np.flatnonzero(~reached), np.flatnonzero(reached)
        to = inner[dist[np.ix_(out, inner)].argmin(axis=1)]
        linked[out, to] = linked[to, out] = True
    return linked


def medoid(sims: np.ndarray) -> int:
    return int(sims.sum(axis=1).argmax())


def range_search(queries: np.ndarray, points: np.ndarray, linked: np.ndarray, start: int, within: float,
                 beam: int = BEAM) -> np.ndarray:
    """(query, point) mask of the points found at ``within`` cosine: greedy search from ``start``."""
    n_q, n = len(queries), len(points)
    queries, points = queries.astype(np.float32), points.astype(np.float32)
    links = linked.astype(np.float32)
    sim = np.full((n_q, n), -np.inf, dtype=np.float32)
    sim[:, start] = queries @ points[start]
    open_ = np.zeros((n_q, n), dtype=bool)  # seen and not expanded
    open_[:, start] = True
    going = np.arange(n_q)
    while len(going):
        ahead = np.where(open_[going], sim[going], np.float32(-np.inf))
        best = np.argpartition(-ahead, min(EXPAND, n) - 1, axis=1)[:, :EXPAND]
        value = np.take_along_axis(ahead, best, axis=1)
        seen = sim[going]
        worst = -np.partition(-seen, min(beam, n) - 1, axis=1)[:, min(beam, n) - 1]
        use = np.isfinite(value) & (value >= worst[:, None])
        expand = ahead >= within  # all of the range at once
        q, k = np.nonzero(use)
        expand[q, best[q, k]] = True
        active = expand.any(axis=1)
        going, expand, seen = going[active], expand[active], seen[active]
        if not len(going):
            break
        open_[going] &= ~expand
        few = np.flatnonzero(expand.any(axis=0))  # points that some query expands
        fresh = (expand[:, few].astype(np.float32) @ links[few] > 0) & np.isneginf(seen)
        q, k = np.nonzero(fresh)
        if 4 * len(q) > fresh.size:
            sim[going[q], k] = (queries[going] @ points.T)[q, k]
        else:
            sim[going[q], k] = np.einsum("ij,ij->i", queries[going[q]], points[k])
        open_[going[q], k] = True
    return sim >= within


def shards(points: DataFrame, overlap: int = OVERLAP) -> DataFrame:
    """(vec_id, dim, n, x, shard): each point in the shards of its nearest centroids."""
    members = points.withColumn("shard", F.xxhash64("dim")).withColumn("sim", F.lit(0.0))
    for level in range(LEVELS):
        sizes = members.groupBy("shard").agg(F.count(F.lit(1)).alias("m"), F.avg("sim").alias("s"))
        large = stored(sizes.where((F.col("m") > LARGE) & (F.col("s") < DENSE)).select(
            "shard", F.least(F.lit(CENTROIDS), F.ceil(F.col("m") * overlap / SHARD)).alias("c"),
            F.ceil(F.col("m") / SALT).cast("int").alias("salts")), "large-shards")
        if large.isEmpty():
            break
        split = members.join(large, "shard")
        by_hash = W.partitionBy("shard").orderBy(F.xxhash64(F.lit(level), "vec_id"), "vec_id")
        first = split.withColumn("r", F.row_number().over(by_hash)).where((F.col("r") <= CENTROIDS))
        centroids = first.where("r <= c").withColumn(
            "salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).withColumn("centroid", F.lit(True))
        rows = split.withColumn("salt", F.pmod(F.xxhash64("vec_id", F.lit(5)), "salts").cast("int")).withColumn(
            "r", F.lit(0)).withColumn("centroid", F.lit(False))
        cols = ["shard", "salt", "centroid", "r", "vec_id", "dim", "n", "x"]
        dealt = _nearest(rows.select(cols).unionByName(centroids.select(cols)), overlap)
        stay = members.join(large, "shard", "left_anti").select(dealt.columns)
        # a point may come to one shard by two ways
        members = stored(dealt.unionByName(stay).dropDuplicates(["vec_id", "shard"]), "shards")
        overlap = 2
    return members.select("vec_id", "dim", "n", "x", "shard")


def _nearest(rows: DataFrame, overlap: int) -> DataFrame:
    """Points of a shard, with its centroids in every salt of it, to the shards of their nearest centroids.

    Centroids closer than ``APART`` to an earlier one are left out, so that a dense group has one."""
    def run(group: pa.Table) -> pa.Table:
        is_centroid = group.column("centroid").to_numpy()
        x = _unit(matrix(group.column("x")))
        chosen = np.flatnonzero(is_centroid)
        c = x[chosen[np.argsort(group.column("r").to_numpy()[chosen], kind="stable")]]
        near = c @ c.T >= APART
        use: list[int] = []
        for i in range(len(c)):
            if not near[i, use].any():
                use.append(i)
        points = np.flatnonzero(~is_centroid)
        sims = x[points] @ c[use].T
        best = np.argsort(-sims, axis=1, kind="stable")[:, :overlap]
        times = best.shape[1]
        kept = group.select(["vec_id", "dim", "n", "x"]).take(pa.array(np.repeat(points, times)))
        return kept.append_column("old", pa.array(np.full(len(points) * times, group.column("shard")[0].as_py()))
                                  ).append_column("c", pa.array(np.array(use)[best].ravel().astype(np.int32))
                                                  ).append_column("sim", pa.array(np.take_along_axis(sims, best, 1).ravel()))

    dealt = rows.groupBy("shard", "salt").applyInArrow(
        run, "vec_id long, dim int, n long, x array<double>, old long, c int, sim double")
    return dealt.select("vec_id", "dim", "n", "x", F.xxhash64("old", "c").alias("shard"), "sim")


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _blocks(members: DataFrame) -> DataFrame:
    """Members with the block of their shard and the shard's number of blocks."""
    sizes = members.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    return members.join(sizes, "shard").withColumn(
        "block", F.when(F.col("blocks") <= 2, 0).otherwise(F.pmod(F.xxhash64("vec_id", F.lit(7)), "blocks")).cast("int")
    ).withColumn("blocks", F.when(F.col("blocks") <= 2, 1).otherwise(F.col("blocks")))


def _build(members: DataFrame) -> DataFrame:
    """(vec_id, near): adjacency lists of the points, united over their shards."""
    def run(group: pa.Table) -> pa.Table:
        ids, x = group.column("vec_id").to_numpy(), _unit(matrix(group.column("x")))
        a, b = np.nonzero(prune_graph(x @ x.T))
        cuts = np.searchsorted(a, np.arange(len(ids) + 1))
        near = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids[b]))
        return pa.table({"vec_id": ids, "near": near})

    lists = members.groupBy("shard", "block").applyInArrow(run, "vec_id long, near array<long>")
    return lists.groupBy("vec_id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))


def _search(members: DataFrame, within: float, beam: int | None) -> DataFrame:
    """(vec_id, n, root): per point and pair of blocks its links and the smallest id of its links there.

    Without a ``beam`` every point of a block is compared with every one of the other.
    """
    i = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pairs = members.withColumn("other", i)
    pairs = pairs.withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other"))

    def run(group: pa.Table) -> pa.Table:
        ids, weight = group.column("vec_id").to_numpy(), group.column("n").to_numpy()
        raw = matrix(group.column("x"))
        x = _unit(raw)
        block = group.column("block").to_numpy()
        in_node = block == int(group.column("bj")[0].as_py())
        nodes = np.flatnonzero(in_node)
        asks = nodes if in_node.all() else np.flatnonzero(~in_node)
        none = pa.table({"vec_id": np.zeros(0, np.int64), "n": np.zeros(0, np.int64), "root": np.zeros(0, np.int64)})
        if not len(nodes) or not len(asks):
            return none
        if beam is None:
            found = x[asks] @ x[nodes].T >= within - 1e-6
        else:
            place = {v: k for k, v in enumerate(ids[nodes].tolist())}
            linked = np.zeros((len(nodes), len(nodes)), dtype=bool)
            near = group.column("near").combine_chunks()
            near = near.chunk(0) if isinstance(near, pa.ChunkedArray) else near
            for k, row in enumerate(nodes.tolist()):
                at = [place[v] for v in near[row].as_py() if v in place]
                linked[k, at] = True
            sims = x[nodes] @ x[nodes].T
            found = range_search(x[asks], x[nodes], linked, medoid(sims), within - 1e-6, beam)
        a, b = np.nonzero(found)
        a, b = asks[a], nodes[b]
        ordered = a < b if asks is nodes else np.ones(len(a), dtype=bool)
        if asks is nodes:  # either point of a pair may have found the other
            a, b = np.minimum(a, b), np.maximum(a, b)
            first = np.unique(a * len(ids) + b, return_index=True)[1]
            a, b = a[first], b[first]
            ordered = a < b
        a, b = a[ordered], b[ordered]
        # a pair belongs to the least shard that its points share
        own = group.column("shard")[0].as_py()
        shard_lists = group.column("all_shards").combine_chunks()
        shard_lists = shard_lists.chunk(0) if isinstance(shard_lists, pa.ChunkedArray) else shard_lists
        width = int(shard_lists.value_lengths().to_numpy().max())
        table = np.full((len(ids), width), np.iinfo(np.int64).max)
        for k in range(len(ids)):
            s = shard_lists[k].as_py()
            table[k, :len(s)] = s
        shared = table[a][:, :, None] == table[b][:, None, :]
        low = np.where(shared.any(axis=2), table[a], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max)
        mine = low == own
        a, b = a[mine], b[mine]
        norm = np.linalg.norm(raw, axis=1)
        real = np.einsum("ij,ij->i", raw[a], raw[b]) / (norm[a] * norm[b]) >= within
        a, b = a[real], b[real]
        n = np.bincount(a, weight[b], len(ids)) + np.bincount(b, weight[a], len(ids))
        root = ids.copy()
        while True:  # the smallest id spreads over the links of this group
            low = root.copy()
            np.minimum.at(low, a, root[b])
            np.minimum.at(low, b, root[a])
            if (low == root).all():
                break
            root = low
        hit = n > 0
        return pa.table({"vec_id": ids[hit], "n": n[hit].astype(np.int64), "root": root[hit]})

    return pairs.groupBy("shard", "bi", "bj").applyInArrow(run, "vec_id long, n long, root long")


def _points(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points (vec_id, dim, n, x) of different vectors, and (vec_id, point) of every usable vector."""
    ok = usable(vectors).where(F.exists("x", lambda c: c != 0)).dropDuplicates(["vec_id", "x"])
    firsts = stored(ok.groupBy("x").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("n"))
                    .withColumn("dim", F.size("x")), "points")
    return firsts, ok.join(firsts.where("n > 1").select("x", F.col("vec_id").alias("point")), "x").select(
        "vec_id", "point")


def _links(points: DataFrame, within: float, overlap: int, beam: int) -> DataFrame:
    members = _blocks(shards(points, overlap))
    everywhere = members.groupBy("vec_id").agg(F.sort_array(F.collect_list("shard")).alias("all_shards"))
    members = stored(members.join(everywhere, "vec_id"), "members")
    near = _build(members)
    return stored(_search(members.join(near, "vec_id"), within, beam), "links")


def _exact_links(points: DataFrame, within: float) -> DataFrame:
    """All links, by all pairs of blocks of points of one length."""
    members = _blocks(points.withColumn("shard", F.col("dim").cast("long"))).withColumn("all_shards", F.array("shard"))
    return stored(_search(stored(members, "members"), within, None), "links")


def audit(points: DataFrame, counts: DataFrame, within: float, sample: int = AUDIT) -> float:
    """Mean share of their true links that ``counts`` (vec_id, n_links) has of ``sample`` points (chosen by hash) with links."""
    asked = points.orderBy(F.xxhash64(F.lit(11), "vec_id"), "vec_id").limit(sample).collect()
    if not asked:
        return 1.0
    by_dim: dict[int, list] = {}
    for r in asked:
        by_dim.setdefault(r["dim"], []).append(r)
    sent = points.sparkSession.sparkContext.broadcast(
        {d: (np.array([r["vec_id"] for r in rs]), np.array([r["x"] for r in rs])) for d, rs in by_dim.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for d, (ids, q) in sent.value.items():
                rows = pa.array(np.flatnonzero(dims == d))
                if len(rows):
                    v, w = batch.column("vec_id").take(rows).to_numpy(), batch.column("n").take(rows).to_numpy()
                    hit = (_unit(q) @ _unit(matrix(batch.column("x").take(rows))).T >= within) & (ids[:, None] != v)
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(hit @ w)], ["vec_id", "n"])

    true = map_arrow(points.select("vec_id", "dim", "n", "x"), run, "vec_id long, n long").groupBy("vec_id").agg(
        F.sum("n").alias("n"))
    share = F.least(F.coalesce("n_links", F.lit(0)) / F.col("n"), F.lit(1.0))
    mean = true.where("n > 0").join(counts, "vec_id", "left").agg(F.avg(share)).first()[0]
    return 1.0 if mean is None else mean


def near_duplicates(vectors: DataFrame, within: float = 0.95, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding) with an id."""
    ship(vectors.sparkSession)
    points, copies = _points(vectors)
    overlap, beam = OVERLAP, BEAM
    for _ in range(ATTEMPTS):
        links = _links(points, within, overlap, beam)
        counts = links.groupBy("vec_id").agg(F.sum("n").alias("n_links"))
        if audit(points, counts, within) >= recall:
            break
        overlap, beam = 2 * overlap, 2 * beam
    else:
        links = _exact_links(points, within)
        counts = links.groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    ids = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id")).distinct()
    roots = connected_components(points.select(F.col("vec_id").alias("id")),
                                 links.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    per_point = points.select("vec_id", "n").join(counts, "vec_id", "left").join(
        roots, F.col("vec_id") == F.col("id")).select(
        F.col("vec_id").alias("point"), (F.coalesce("n_links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component")
    of = ids.join(copies, "vec_id", "left").withColumn("point", F.coalesce("point", "vec_id"))
    return of.join(per_point, "point", "left").groupBy("vec_id").agg(
        F.max(F.coalesce("n_links", F.lit(0))).alias("n_links"),
        F.min(F.coalesce("component", "vec_id")).alias("component_id")).withColumn(
        "kept", F.col("vec_id") == F.col("component_id"))
