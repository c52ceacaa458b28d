"""Exact top-k search and embedding near-dedup against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.llm import common, neardup_graph, topk

SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("rank", T.StringType()), T.StructField("x", T.StringType()), T.StructField("score", T.StringType())])


def edge_vectors(n=160, dim=8):
    r = np.random.default_rng(11)
    base = r.normal(size=(n // 4, dim))
    x = np.concatenate([base, base + 0.05 * r.normal(size=base.shape), base * 3, r.normal(size=(n // 4, dim))])
    rows = [(k, [float(np.float32(c)) for c in v], "a", "b", "c") for k, v in enumerate(x)]
    odd = [None, [], [0.0] * dim, [None] + [1.0] * (dim - 1), [float("nan")] * dim, [math.inf] + [0.0] * (dim - 1)]
    rows += [(1000 + k, v, None, None, None) for k, v in enumerate(odd)]
    rows += [rows[0], rows[0], (None, [1.0] * dim, "a", None, None), (1050, [1.0, 2.0], None, None, None),
             (1051, [1.0, 2.0], None, None, None)]
    return rows


def usable(rows):
    seen = {}
    for i, v, *_ in rows:
        if i is not None and v and all(c is not None and math.isfinite(c) for c in v):
            seen[i] = np.array(v, dtype=np.float32).astype(float)
    return seen


@pytest.mark.parametrize("sizes", [(2048, 4096), (3, 40)])
def test_top_k_edge_rows(spark, monkeypatch, sizes):
    monkeypatch.setattr(topk, "QUERIES", sizes[0])
    monkeypatch.setattr(topk, "CANDIDATES", sizes[1])
    rows = edge_vectors()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(map(tuple, topk.exact_top_k(df, F.col("vec_id") % 50 == 0).collect()))
    whole = [(i, np.floor(256 * np.array(v, dtype=np.float32).astype(float)).astype(np.int64)) for i, v, *_ in rows
             if i is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    want = []
    for q in {i for i, _ in whole if i % 50 == 0}:  # repeated rows count as often as they are there
        best = sorted((-int(qv @ v), i) for j, qv in whole if j == q for i, v in whole if i != q and len(v) == len(qv))[:5]
        want += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    assert got == sorted(want)


def test_top_of_block_keeps_ties_and_large_values():
    ids = np.arange(60)
    v = np.ones((60, 4)) * 3
    r, c, s = topk.top_of_block(np.array([100]), np.ones((1, 4)), ids, v, 5)
    assert c.tolist() == [0, 1, 2, 3, 4] and set(s.tolist()) == {12}
    big = np.array([[2.0**30, 1.0], [2.0**30, 2.0], [2.0**30, 3.0]])
    r, c, s = topk.top_of_block(np.array([9]), np.array([[2.0**30, 1.0]]), np.arange(3), big, 2)
    assert c.tolist() == [2, 1] and s.tolist() == [2**60 + 3, 2**60 + 2]


def test_top_k_empty_table(spark):
    assert topk.exact_top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 50 == 0).count() == 0


def brute_links(rows, within):
    vectors = {i: v for i, v in usable(rows).items() if np.any(v != 0)}
    ids = sorted({i for i, *_ in rows if i is not None})
    links, root = dict.fromkeys(ids, 0), {i: i for i in ids}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, x in vectors.items():
        for b, y in vectors.items():
            if a != b and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= within:
                links[a] += 1
                u, v = find(a), find(b)
                root[max(u, v)] = min(u, v)
    return sorted((i, links[i], find(i), find(i) == i) for i in ids)


@pytest.mark.parametrize("small", [False, True])
def test_near_duplicates_edge_rows(spark, monkeypatch, small):
    if small:  # shards, splits and pairs of blocks at test size
        for name, value in {"SHARD": 20, "LARGE": 40, "BLOCK": 8, "CENTROIDS": 6, "SALT": 30}.items():
            monkeypatch.setattr(neardup_graph, name, value)
    rows = edge_vectors()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(map(tuple, neardup_graph.near_duplicates(df).collect()))
    want = brute_links(rows, 0.95)
    if not small:
        assert got == want
    else:  # recall of an approximate index; no link below the limit
        assert [g[0] for g in got] == [w[0] for w in want]
        assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
        assert sum(g[1] for g in got) >= 0.9 * sum(w[1] for w in want)


def test_near_duplicates_dense_group_and_copies(spark):
    r = np.random.default_rng(5)
    one = r.normal(size=16)
    rows = [(k, [float(np.float32(c)) for c in one + 0.03 * r.normal(size=16)], None, None, None) for k in range(80)]
    rows += [(500 + k, rows[0][1], None, None, None) for k in range(40)]
    rows += [(900 + k, [float(np.float32(c)) for c in r.normal(size=16)], None, None, None) for k in range(50)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, neardup_graph.near_duplicates(df).collect())) == brute_links(rows, 0.95)


def test_near_duplicates_end_in_the_exact_pass_when_recall_stays_low(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(neardup_graph, "audit", lambda *a, **k: asked.append(1) or 0.0)
    monkeypatch.setattr(neardup_graph, "_links", lambda points, *_: points.select("vec_id", "n", F.col("vec_id").alias("root")).limit(0))
    monkeypatch.setattr(neardup_graph, "BLOCK", 30)
    rows = edge_vectors()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert sorted(map(tuple, neardup_graph.near_duplicates(df).collect())) == brute_links(rows, 0.95)
    assert len(asked) == neardup_graph.ATTEMPTS  # every search is audited


def test_audit_weighs_points_and_not_links(spark):
    """A dense group that is found does not hide that the links of a small one are lost."""
    r = np.random.default_rng(6)
    one, two = r.normal(size=16), r.normal(size=16)
    rows = [(k, [float(c) for c in one + 0.01 * r.normal(size=16)], None, None, None) for k in range(60)]
    rows += [(100 + k, [float(c) for c in two + 0.01 * r.normal(size=16)], None, None, None) for k in range(20)]
    points = neardup_graph._points(spark.createDataFrame(rows, SCHEMA))[0]
    counts = spark.createDataFrame([(k, 59) for k in range(60)], "vec_id long, n_links long")
    assert neardup_graph.audit(points, counts, 0.95) == pytest.approx(0.75)


def test_near_duplicates_of_the_given_vectors(spark):
    from wordloom.llm import catalog

    from .conftest import SF

    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = sorted(map(tuple, catalog.queries()["op10_embedding_neardup"](spark, SF).select(
        "vec_id", "n_links", "component_id", "kept").collect()))
    want = brute_links(rows, 0.95)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert sum(g[1:] == w[1:] for g, w in zip(got, want, strict=True)) >= 0.98 * len(want)


def test_near_duplicates_empty_table(spark):
    assert neardup_graph.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_graph_search_finds_the_whole_range():
    r = np.random.default_rng(2)
    x = r.normal(size=(300, 32))
    x[:120] = x[0] + 0.05 * x[:120]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sims = x @ x.T
    linked = neardup_graph.prune_graph(sims)
    assert (linked == linked.T).all()
    found = neardup_graph.range_search(x, x, linked, neardup_graph.medoid(sims), 0.9)
    true = sims >= 0.9 + 1e-6
    assert (found & true).sum() >= 0.99 * true.sum()


def test_connected_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + k) for k in range(30)] + [(7, 7), (200, 100)]
    nodes = [*range(42), 100, *range(200, 230), 999]
    df = common.connected_components(spark.createDataFrame([(n,) for n in nodes], "id long"),
                                     spark.createDataFrame(edges, "a long, b long"))
    got = {r["id"]: r["component"] for r in df.collect()}
    assert got == {n: 0 if n <= 40 else 41 if n == 41 else 999 if n == 999 else 100 for n in nodes}
