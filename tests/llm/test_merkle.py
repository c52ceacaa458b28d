"""The Merkle manifest against a tree built by its definition."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from wordloom.llm import merkle, q_merkle

FIELDS = q_merkle.FIELDS


def sha(s):
    return hashlib.sha256(s.encode("utf-8")).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode('utf-8'))}:{v}" for v in row))


def climb(nodes):
    """Root of ``nodes``, and for each one its (left, right) digests level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = nodes[k // 8 * 8:k // 8 * 8 + 8]
            paths[i].append(("".join(run[:k % 8]), "".join(run[k % 8 + 1:])))
        at = [k // 8 for k in at]
        nodes = [sha("".join(nodes[i:i + 8])) for i in range(0, len(nodes), 8)]
    return nodes[0], paths


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    order = sorted(trees, key=lambda k: (k is not None, (k or "").encode("utf-8")))
    built = {}
    for k in order:
        trees[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        built[k] = climb([leaf(r) for r in trees[k]])
    root, above = climb([built[k][0] for k in order]) if order else (None, [])
    out = []
    for k, up in zip(order, above):
        for r, path in zip(trees[k], built[k][1]):
            whole = path + up
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            text = None if r[4] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])
            h = leaf((*r[:4], text)) if tampered else leaf(r)
            for left, right in whole:
                h = sha(left + h + right)
            out.append((r[0], leaf(r), built[k][0], root, sha("".join(a + b for a, b in whole)), h, h == root))
    return sorted(out, key=repr)


def query(spark, df, tmp_path):
    df.write.parquet(str(tmp_path / "documents.parquet"))
    out = q_merkle.op12_merkle_manifest(spark, str(tmp_path))
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, out.collect()), key=repr)


def fields_of(rows):
    return [(i, s, g, n, t) for i, t, g, s, n in rows]


def test_edge_rows(spark, edge_docs, edge_rows, tmp_path):
    got = query(spark, edge_docs, tmp_path)
    assert got == brute(fields_of(edge_rows))
    assert {r[6] for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 8, 9, 65, 700])
def test_sizes_around_the_powers_of_eight(spark, monkeypatch, tmp_path, n):
    monkeypatch.setattr(merkle, "DIGITS", 1 if n < 100 else 2)  # several rollups on few rows
    rows = [(7 * i % 1009, f"Text {i}", "de" if n == 700 and i % 10 == 0 else "en", "s", i) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    assert query(spark, df, tmp_path) == brute(fields_of(rows))


def test_many_trees_and_repeated_ids(spark, tmp_path):
    rows = [(i % 3, f"T{i % 5}", f"l{i % 70}é" if i % 71 else None, None, None) for i in range(400)] + [(1, "same", "x", "", 0)] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    assert query(spark, df, tmp_path) == brute(fields_of(rows))


def test_empty_table_and_clashing_columns(spark, empty_docs, edge_docs, edge_rows, tmp_path):
    assert query(spark, empty_docs, tmp_path) == []
    clash = edge_docs
    for name in ["tree", "rank", "id", "h", "kids", "path", "leaf", "root", "levels", "block", "d0", "x", "e", "size"]:
        clash = clash.withColumn(name, F.lit("x"))
    out = merkle.merkle_manifest(clash, FIELDS)
    assert sorted(r["leaf"] for r in out.collect()) == sorted(leaf(r) for r in fields_of(edge_rows))
    assert {r["x"] for r in out.select((merkle.folded(F.col("leaf"), F.col("path")) == F.col("root")).alias("x")).collect()} == {True}
