"""Line dedup, language identification, n-gram join and suffix dedup against brute force."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wordloom.llm import catalog, langid, line_dedup, ngram_join, suffix_dedup, suffix_sort

from .conftest import DOC_SCHEMA, SF, words


# line dedup ---------------------------------------------------------------------------------------------------

def brute_lines(rows, ratio, least):
    pages, holds = Counter(), Counter()
    for _, text, _, source, _ in rows:
        if source is not None:
            pages[source] += 1
            for line in {x.strip(" ") for x in (text or "").split("\n")} - {""}:
                holds[source, line] += 1
    out = []
    for doc, text, _, source, _ in rows:
        if text is None:
            out.append((doc, None))
            continue
        gone = {x for (s, x), n in holds.items() if s == source and n >= least and n > ratio * pages[source]}
        out.append((doc, "\n".join(x for x in text.split("\n") if x.strip(" ") == "" or x.strip(" ") not in gone)))
    return sorted(out, key=repr)


def test_line_dedup_edge_rows(clashing, empty_docs, edge_rows):
    for ratio, least in ((0.1, 3), (0.3, 2)):
        got = line_dedup.line_dedup(clashing, ratio=ratio, min_pages=least).select("doc_id", "text").collect()
        assert sorted(map(tuple, got), key=repr) == brute_lines(edge_rows, ratio, least)
    assert line_dedup.line_dedup(empty_docs).count() == 0


# language identification ----------------------------------------------------------------------------------------

def test_bloom_slices_have_no_false_negatives():
    r = np.random.default_rng(1)
    entries = [r.integers(0, 2**63, n, dtype=np.int64).view(np.uint64) for n in (50, 500, 0, *[20] * 70)]
    f = langid.Filters.build([f"l{i:02d}" for i in range(len(entries))], entries, "l00")
    assert f.words.shape[0] == 2
    for k, e in enumerate(entries):
        for p in f.positions(e, f.words.shape[1]):
            assert ((f.words[k // 64][p] >> np.uint64(k % 64)) & np.uint64(1)).all()


def test_langid_edge_rows(spark, clashing, empty_docs, edge_rows):
    filters = langid.learn(clashing)
    out = langid.identify(clashing, filters).select("doc_id", "text", "lang_pred", "score", "coverage").collect()
    assert len(out) == len(edge_rows)
    for r in out:
        assert 0 <= r["score"] <= 1 and 0 <= r["coverage"] <= 1
        if r["text"] is None or not any(c.isalpha() for c in r["text"]):
            assert r["lang_pred"] == "und" and r["score"] == 0
        else:
            assert r["lang_pred"] in {"en", "de", "fr"}
    none = langid.learn(empty_docs)
    assert langid.identify(empty_docs, none).count() == 0
    assert {r["lang_pred"] for r in langid.identify(clashing, none).collect()} == {"und"}


def test_op6_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = catalog.queries()["op6_language_id"](spark, sf).collect()
    assert len(rows) == len(langs)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    held = [r["lang_pred"] == langs[r["doc_id"]] for r in rows if r["held_out"]]
    assert sum(held) / len(held) >= 0.97


# n-gram join ----------------------------------------------------------------------------------------------------

def brute_components(rows, n, percent):
    sets = defaultdict(list)
    for doc, text in rows:
        w = (text or "").encode().lower().split()
        sets[doc].append(frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset())
    root = {d: d for d in sets if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(root)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                u, v = find(a), find(b)
                root[max(u, v)] = min(u, v)
    return sorted(((d, len(s), None if d is None else find(d)) for d, all_of in sets.items() for s in all_of), key=repr)


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_ngram_join_edge_rows(clashing, edge_rows, n, percent):
    got = ngram_join.ngram_components(clashing, n=n, percent=percent).collect()
    assert sorted(map(tuple, got), key=repr) == brute_components([r[:2] for r in edge_rows], n, percent)


def test_ngram_join_empty_table(empty_docs):
    assert ngram_join.ngram_components(empty_docs).count() == 0


def test_shared_counts(monkeypatch):
    monkeypatch.setattr(ngram_join, "COLUMNS", 7)
    r = np.random.default_rng(4)
    sets = [np.unique(r.integers(0, 60, n)) for n in (40, 30, 20, 1, 50)]
    got = ngram_join.shared_counts(sets)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i != j:
                assert got[i, j] == len(np.intersect1d(a, b))


def test_candidates_of_a_cluster_are_filtered_and_lose_no_link():
    r = np.random.default_rng(5)
    percent, sets = 80, []
    for g in range(12):
        base = r.choice(5000, 60, replace=False)
        for k in range(6):
            s = base.copy()
            s[: (k * 3) % 14] = r.choice(10**6, (k * 3) % 14)
            sets.append(np.unique(s[: 60 - 2 * (k % 3)]).astype(np.uint64))
    prefixes = [s[:ngram_join.prefix_length(len(s), percent)] for s in sets]  # any fixed order is right
    n = np.array([len(s) for s in sets])
    sig = np.array([ngram_join._signature(s) for s in sets], dtype=np.uint64).view(np.int64)
    got = ngram_join.candidates(n, sig, [p.astype(np.int64) for p in prefixes], [np.arange(len(p)) for p in prefixes], percent)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i != j:
                common = len(np.intersect1d(a, b))
                assert got[i, j] or common * 100 < percent * (len(a) + len(b) - common)
                assert not got[i, j] or len(np.intersect1d(prefixes[i], prefixes[j]))
    assert got.sum() < 0.2 * len(sets) ** 2


@pytest.mark.parametrize(("few", "rounds"), [(32, 3), (2, 0), (2, 1)])
def test_ngram_join_dense_and_borderline_groups(spark, monkeypatch, few, rounds):
    """A chain of near copies, and groups whose members are near the limit of 85 percent; with few star rounds
    the rest is left to rows or to blocks of clusters."""
    monkeypatch.setattr(ngram_join, "FEW", few)
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "STAR_ROUNDS", rounds)
    rows, doc = [], 0
    for g in range(4):
        base = words(1000 + g, 120).split(" ")
        for k in range(25):
            w = list(base)
            for j in range(k % 5 + (3 if g % 2 else 0)):
                w[(17 * j + 13 * k * (g + 1)) % len(w)] = f"x{g}{k}{j}"
            rows.append((doc, " ".join(w)))
            doc += 1
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = ngram_join.ngram_components(df).collect()
    assert sorted(map(tuple, got), key=repr) == brute_components(rows, 4, 85)


def test_ngram_join_deals_postings_within_a_batch(spark, monkeypatch):
    """However many texts a batch has, a task holds some ``HELD`` postings, and the dealt blobs hold every one of them."""
    rows = [(k, words(2000 + k // 4, 100) + f" x{k}") for k in range(40)]
    dealt = {}

    def spy(df, run, schema, keep=ngram_join.map_arrow):
        dealt[schema] = run
        return keep(df, run, schema)

    monkeypatch.setattr(ngram_join, "map_arrow", spy)
    monkeypatch.setattr(ngram_join, "HELD", 50)
    got = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    assert sorted(map(tuple, got), key=repr) == brute_components(rows, 4, 85)
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows]), pa.array([t for _, t in rows])], ["doc", "text"])
    out = list(dealt["part long, blob binary"](iter([batch])))
    sizes = [sum(len(b.as_py()) for b in x.column("blob")) // ngram_join.POSTING.itemsize for x in out]
    assert sum(sizes) == sum(ngram_join.prefix_length(len(ngram_join.gram_set(t, 4)), 85) for _, t in rows)
    assert len(out) > 5 and max(sizes) < 100


def test_op4_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = catalog.queries()["op4_ngram_jaccard"](spark, SF).collect()
    assert sorted(map(tuple, got), key=repr) == brute_components(rows, 4, 85)


# suffix dedup ---------------------------------------------------------------------------------------------------

def brute_suffix(rows, length=100):
    """Rows in order: (id, n_bytes, n_removed, n_spans, sha256 of what is left)."""
    seen, out = set(), []
    for doc, text in rows:
        b = (text or "").encode()
        cover = bytearray(len(b))
        fresh = []
        for i in range(len(b) - length + 1):
            w = b[i:i + length]
            if w in seen:
                cover[i:i + length] = b"\1" * length
            else:
                seen.add(w)
                fresh.append(w)
        spans = sum(1 for i, c in enumerate(cover) if c and not (i and cover[i - 1]))
        kept = bytes(x for x, c in zip(b, cover, strict=True) if not c)
        out.append((doc, len(b), sum(cover), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def of_suffix(df):
    out = suffix_dedup.remove_repeats(df).withColumn("sha", F.sha2("kept", 256)).drop("kept")
    return sorted(map(tuple, out.collect()), key=repr)


def test_sort_strings_orders_and_measures():
    r = np.random.default_rng(3)
    rows = [bytes(r.integers(97, 99, 100, dtype=np.uint8)) for _ in range(50)]
    rows += [rows[0][:40] + bytes(r.integers(97, 100, 60, dtype=np.uint8)) for _ in range(60)] + rows[:20]
    matrix = np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(-1, 100)
    order, lcp = suffix_sort.sort_strings(matrix)
    ordered = [rows[i] for i in order]
    assert ordered == sorted(rows)
    for k in range(1, len(rows)):
        a, b = ordered[k - 1], ordered[k]
        assert lcp[k] == next((i for i in range(100) if a[i] != b[i]), 100)


def test_blind_trie_sorts_distinct_strings():
    strings = {bytes([a, b, c, 0]) for a in (1, 5) for b in (2, 3, 9) for c in range(4)}
    trie = suffix_sort.BlindTrie()
    for s in [*strings, *strings]:
        trie.insert(s)
    assert trie.ordered() == sorted(strings)
    assert suffix_sort.BlindTrie().ordered() == []


@pytest.mark.parametrize("hot_least", [400, 1])
def test_suffix_dedup_edge_rows(clashing, edge_rows, monkeypatch, hot_least):
    """With ``hot_least`` 1 every repeated anchor takes the way of hot ones."""
    monkeypatch.setattr(suffix_dedup, "HOT_LEAST", hot_least)
    monkeypatch.setattr(suffix_dedup, "HOT_LOCAL", min(3, hot_least))
    rows = sorted(((d, t) for d, t, *_ in edge_rows), key=lambda x: (x[0] is None, x[0] or 0))
    assert of_suffix(clashing) == brute_suffix(rows)


def test_suffix_dedup_overlaps_and_runs(spark, empty_docs):
    passage = words(5, 40)
    rows = [(1, "a" * 350), (2, passage + "b" * 150 + passage), (3, "x" + passage[3:] + "y"), (4, "é" * 120), (5, "b" * 99)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert of_suffix(df) == brute_suffix(rows)
    assert suffix_dedup.remove_repeats(empty_docs).count() == 0


def test_long_texts_are_scanned_in_pieces():
    text = (words(8, 3000) * 3).encode()
    whole = suffix_dedup.anchors_of([text])
    assert len(whole[0]) and (whole[3] >= whole[2]).all()
    windows = sum((whole[3] - whole[2] + 1).tolist())
    assert windows == len(text) - suffix_dedup.LENGTH + 1


def test_op7_against_brute_force(spark):
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = catalog.queries()["op7_suffix_dedup"](spark, SF).collect()
    assert sorted(map(tuple, got), key=repr) == brute_suffix(rows)


def test_schema_is_the_documents_one(edge_docs):
    assert edge_docs.schema == DOC_SCHEMA
