"""Ranked lexical search against scoring every document for every item."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.llm import lexical, q_lexical

from .conftest import words

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    """docs, items: (id, text)."""
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, wanted in asked.items():
        scored = []
        for d, c in counted:
            m = 10 + 90 * sum(c.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                    for t in wanted if t in c)
            if s > 0:
                scored.append((-s, d is not None, d or 0, d))
        out += [(i, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def ranked(df):
    return sorted(map(tuple, df.collect()), key=repr)


ITEM = "item_id long, text string"
SIZES = {"SHARD": 7, "CLUSTER": 2, "READ": 1, "VOCABULARY": 60}


def test_terms_are_the_matches_of_the_pattern():
    for text in ("", "a", "Ab-9 É日本 x_y\x00z\x7f", " two  words ", "ÀÉ Σ İ"):
        assert [t for t in lexical.terms_of(text) if t] == [t.encode() for t in terms(text)]


@pytest.mark.parametrize("small", [False, True])
def test_edge_rows(spark, monkeypatch, edge_docs, edge_rows, small):
    if small:  # many shards, blocks and blocks of items
        for name, value in SIZES.items():
            monkeypatch.setattr(lexical, name, value)
    items = [(k, " ".join(words(7, 200).split(" ")[k:k + 20])) for k in range(6)]
    items += [(20, "ONE two two"), (21, None), (22, "..."), (23, "nowhere"), (24, "site"), (24, "shared line"), (None, "own words"),
              (25, words(99, 120)), (26, "Σ İ é")]
    df = spark.createDataFrame(items, ITEM).repartition(2)
    got = ranked(lexical.lexical_search(edge_docs, df))
    assert got == brute([r[:2] for r in edge_rows], items)


def test_many_equal_documents_and_hot_words(spark, monkeypatch):
    for name, value in {"SHARD": 40, "CLUSTER": 4, "READ": 2}.items():
        monkeypatch.setattr(lexical, name, value)
    docs = [(i, "the the common passage of words") for i in range(120)] + [(500 + i, f"the {words(i, 30, 40)}") for i in range(200)]
    items = [(0, "the common passage"), (1, "the"), (2, words(3, 12, 40) + " the"), (3, words(5, 30, 40))]
    src = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    got = ranked(lexical.lexical_search(src, spark.createDataFrame(items, ITEM)))
    assert got == brute(docs, items)


def test_empty_tables_and_clashing_columns(spark, empty_docs, edge_docs, edge_rows):
    items = [(1, "one two"), (2, "line")]
    df = spark.createDataFrame(items, ITEM)
    assert lexical.lexical_search(empty_docs, df).count() == 0
    assert lexical.lexical_search(edge_docs, df.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
    clash, asked = edge_docs, df
    for name in ["doc", "t", "n", "terms", "tfs", "heavy", "impacts", "shard", "item", "score", "rank", "item_id"]:
        clash = clash.withColumn(name, F.lit("x"))
        if name != "item_id":
            asked = asked.withColumn(name, F.lit("x"))
    assert ranked(lexical.lexical_search(clash, asked)) == brute([r[:2] for r in edge_rows], items)


def test_blocks_are_skipped_and_the_best_stay():
    r = np.random.default_rng(3)
    n, width = 600, 40
    dense = np.where(r.random((n, width)) < 0.15, r.integers(1, 1000, (n, width)), 0)
    dense[:, 0] = 1
    rows, cols = np.nonzero(dense)
    shard = lexical.Shard(np.arange(n), lexical.Vectors(np.bincount(rows, minlength=n), cols, dense[rows, cols]), 8)
    for asked in ([0, 3, 7], [1, 2, 5, 9, 11], [0], [39, 45]):
        held = [c for c in asked if c < width]
        score = dense[:, held].sum(axis=1)
        want = sorted((-s, d) for d, s in enumerate(score.tolist()) if s)[:10]
        docs, got = shard.search(np.array(asked), 0, 10)
        assert [(-s, d) for d, s in zip(docs.tolist(), got.tolist())] == want
        docs, got = shard.search(np.array(asked), -want[4][0], 10)
        assert set(docs.tolist()) >= {d for _, d in want[:5]} and got.min() >= -want[4][0]


def test_whole_table_with_small_shards(spark, monkeypatch):
    from .conftest import SF

    monkeypatch.setattr(lexical, "SHARD", 50)
    monkeypatch.setattr(lexical, "CLUSTER", 5)
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{SF}/{t}.parquet").select(i, "text").collect()]
                   for t, i in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert ranked(q_lexical.op13_lexical_search(spark, SF)) == brute(docs, items)
