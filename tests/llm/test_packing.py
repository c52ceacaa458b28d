"""Packing: every id of the public library lies in exactly one piece, and windows need no padding."""

import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wordloom.llm import packing, q_packing, word_ids
from wordloom.llm.transducer import WordBpe

from .conftest import DOC_SCHEMA, words
from .test_tokenizers import some_texts

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, encoding="utf-8") as f:
        return word_ids.WordIds(f.read(), WordBpe.read(PATH))


def test_ids_equal_library(encoder, library):
    texts = some_texts(400) + ["", " ", "a", "x" * 300, "é" * 200, "日本語" * 90, "Σς İI ﬁ", "don't 'Sell ''s 12 3", "\x00\x01"]
    texts += [words(k, 200) for k in range(5)]
    assert [x.tolist() for x in encoder.encode_all(texts)] == [library(t) for t in texts]


def test_long_texts_are_cut_at_blanks_and_a_full_table_starts_anew(library, monkeypatch):
    monkeypatch.setattr(word_ids, "PIECE_CHARS", 50)
    monkeypatch.setattr(word_ids, "WORDS", 40)
    with open(PATH, encoding="utf-8") as f:
        e = word_ids.WordIds(f.read(), WordBpe.read(PATH))
    texts = [words(k, 60) for k in range(6)] + ["y" * 500, words(3, 30) + "<|endoftext|>" + words(4, 30), "é" * 120 + " z"]
    assert [x.tolist() for x in e.encode_all(texts)] == [library(t) for t in texts]


def check(rows, docs, library, window=2048):
    """rows: (doc, start, length, crc, doc_tokens, sequence, offset); docs: (id, text)."""
    want = defaultdict(list)
    for i, text in docs:
        want[i].append([*library(text), 1])
    windows = defaultdict(list)
    pieces = defaultdict(list)
    for doc, start, length, crc, tokens, seq, offset in rows:
        assert length > 0
        windows[seq].append((offset, length))
        pieces[doc].append((tokens, start, length, crc))
    assert set(pieces) == set(want)
    for doc, lists in want.items():
        # each id of a document once: its pieces follow one another; equal ids of several rows are told apart by crc
        expected = sum(map(len, lists))
        assert sum(p[2] for p in pieces[doc]) == expected
        for tokens, start, length, crc in pieces[doc]:
            assert any(len(ids) == tokens and zlib.crc32(struct.pack(f"<{length}I", *ids[start:start + length])) == crc
                       for ids in lists if start + length <= len(ids))
        if len(lists) == 1:
            at = 0
            for _, start, length, _ in sorted(pieces[doc], key=lambda p: p[1]):
                assert start == at
                at += length
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == window or (at < window and at & (at - 1) == 0)
    return windows


def query(spark, df, tmp_path):
    df.write.parquet(str(tmp_path / "documents.parquet"))
    out = q_packing.op11_packing(spark, str(tmp_path))
    assert [(f.name, f.dataType.simpleString()) for f in out.schema][:7] == [
        ("doc_id", "bigint"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint"), ("doc_tokens", "bigint"),
        ("sequence_id", "bigint"), ("offset", "bigint")]
    return list(map(tuple, out.collect()))


def test_edge_rows(spark, edge_docs, edge_rows, library, tmp_path):
    check(query(spark, edge_docs, tmp_path), [r[:2] for r in edge_rows], library)


def test_empty_table(spark, empty_docs, tmp_path):
    assert query(spark, empty_docs, tmp_path) == []


def test_clashing_columns(spark, clashing, edge_rows, library):
    out = packing.pack(clashing.withColumn("open", F.lit("x")).withColumn("start", F.lit(9)), PATH, 1)
    rows = [(r["doc_id"], r["start"], r["length"], zlib.crc32(bytes(r["ids"])), r["doc_tokens"], r["sequence_id"], r["offset"])
            for r in out.collect()]
    check(rows, [r[:2] for r in edge_rows], library)


def test_several_rounds_of_merging_and_small_windows(spark, monkeypatch, library):
    monkeypatch.setattr(packing, "FAN_IN", 2)
    docs = [(i, words(i, random.Random(i).randint(0, 90))) for i in range(300)]
    df = spark.createDataFrame([(*d, None, None, None) for d in docs], DOC_SCHEMA).repartition(7)
    out = packing.pack(df, PATH, 1, window=64, n_open=4)
    rows = [(r["doc_id"], r["start"], r["length"], zlib.crc32(bytes(r["ids"])), r["doc_tokens"], r["sequence_id"], r["offset"])
            for r in out.collect()]
    windows = check(rows, docs, library, 64)
    assert sum(sum(n for _, n in parts) < 64 for parts in windows.values()) <= 6


def test_packer_places_best_fit_and_tops_up_the_fullest():
    def piece(doc, n):
        return packing.Piece(doc, 0, np.full(n, doc, dtype=np.uint32), n)

    p = packing.Packer(0, window=10, n_open=2)
    for doc, n in ((1, 6), (2, 8), (3, 2)):  # the third fills the second window
        p.put(piece(doc, n))
    assert p.columns["doc"] == [2, 3] and p.filled == [6]
    p.put(piece(4, 7))
    p.put(piece(5, 5))  # no room: the fullest (7) takes three, the tail goes to the other
    assert p.columns["doc"][2:] == [4, 5] and p.columns["length"][2:] == [7, 3] and p.filled == [8]


def test_whole_table(spark, library):
    from .conftest import SF

    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    windows = check(list(map(tuple, q_packing.op11_packing(spark, SF).collect())), docs, library)
    total = sum(n for parts in windows.values() for _, n in parts)
    assert sum(sum(n for _, n in parts) == 2048 for parts in windows.values()) == total // 2048
