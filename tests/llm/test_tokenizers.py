"""Byte-level BPE and token counts against the public libraries, and their parts."""

import hashlib
import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from wordloom.llm import bpe, catalog, transducer

from .conftest import SF

ALPHABET = "aab 'thSrevelmds\n\t  1zß日🙂’\x1c　ÀÉΣİ"


@pytest.fixture(scope="module")
def vocab():
    return bpe.Vocabulary.read(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(vocab):
    ranks = {t: i for i, t in enumerate(vocab.tokens)}
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def word_bpe():
    return transducer.WordBpe.read(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def counts_of():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return lambda texts: [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


def some_texts(n, seed=1):
    r = random.Random(seed)
    out = ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 60))) for _ in range(n)]
    parts = ["the", "ing", "un", "re", "<|endoftext|>", "<|startoftext|>", " ", "tion", "123", "'s", "é", "''s"]
    return out + ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(n)]


def test_perfect_hash_is_minimal_and_finds_only_its_keys(vocab):
    h = vocab.hash
    assert sorted(h.item.tolist()) == list(range(len(vocab.tokens)))
    assert h.find(vocab.tokens) == list(range(len(vocab.tokens)))
    assert h.find([b"no such token at all", b""]) == [-1, -1]
    assert bpe.PerfectHash([]).find([b"a"]) == [-1]


def test_heap_merge_equals_library_on_single_pieces(vocab, library):
    ranks = {t: i for i, t in enumerate(vocab.tokens)}
    for piece in ("aaaaaaa", "thaaththth", "zzzzzz", "éééé", "x" * 3000):
        assert bpe.merge_bytes(piece.encode(), ranks) == library.encode_ordinary(piece)


def test_encoder_equals_library(vocab, library):
    texts = some_texts(2000)
    encoder = bpe.Encoder(vocab, memo=300)  # the memo is emptied many times
    for k in range(0, len(texts), 100):
        ids, cuts = encoder.encode_all(texts[k:k + 100])
        for i, t in enumerate(texts[k:k + 100]):
            assert ids[cuts[i]:cuts[i + 1]].tolist() == library.encode_ordinary(t)


def test_every_code_point_is_cut_as_by_the_library(vocab, library):
    texts = ["a" + chr(c) + chr(c) + "b 1" + chr(c) + " " + chr(c) + "  x"
             for c in range(0, 0x110000, 7) if not 0xD800 <= c < 0xE000]
    ids, cuts = bpe.Encoder(vocab).encode_all(texts)
    assert all(ids[cuts[i]:cuts[i + 1]].tolist() == library.encode_ordinary(t) for i, t in enumerate(texts))


def test_encode_decode_edge_rows(clashing, empty_docs, edge_rows, vocab, library):
    out = bpe.decode(bpe.encode(clashing, vocab), vocab).select("doc_id", "text", "ids", "decoded", "source").collect()
    assert len(out) == len(edge_rows)
    for r in out:
        assert r["ids"] == library.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
    assert bpe.decode(bpe.encode(empty_docs, vocab), vocab).count() == 0


def _held_and_peak(work):
    """Bytes that ``work()`` leaves allocated while its result lives, and holds at most."""
    tracemalloc.start()
    try:
        result = work()
        held, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    del result
    return held, peak


def test_memo_takes_few_bytes_an_entry(vocab):
    encoder = bpe.Encoder(vocab)
    pieces = [["".join(random.Random(i).choices("bcdfgh", k=12)) for i in range(k, k + 1000)] for k in range(0, 40_000, 1000)]
    held, _ = _held_and_peak(lambda: [encoder.encode_all([" ".join(p)]) and None for p in pieces])
    ids = sum(len(encoder.encode_all([" ".join(p)])[0]) for p in pieces)
    assert held < 40 * 40_000 + 4 * ids


def test_encoding_a_batch_takes_little_memory(spark, vocab, library, monkeypatch):
    monkeypatch.setattr(bpe, "map_arrow", lambda df, run, schema: run)
    run = bpe.encode_and_decode(spark.createDataFrame([(1, "a")], "doc_id long, text string"), vocab)
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma"]) + str(rng.randrange(50)) for _ in range(300)) for _ in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(texts)], ["doc_id", "text"])
    rows = []
    _, peak = _held_and_peak(lambda: rows.extend(x.column("ids").value_lengths().to_pylist() for x in run(iter([batch]))))
    assert peak < 24_000_000
    assert [n for x in rows for n in x] == [len(x) for x in library.encode_ordinary_batch(texts)]


def test_op2_digests(spark, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = catalog.queries()["op2_byte_bpe"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()


def test_transducer_counts_equal_library(word_bpe, counts_of):
    texts = some_texts(1500, seed=2) + ["a" * 3000 + " " + "thereing" * 1500 + "x", ""]
    assert transducer.Counter(word_bpe).count_all(texts).tolist() == counts_of(texts)


def test_chunk_maps_compose(word_bpe):
    symbols = np.frombuffer(b"thereing" * 400 + b"ab" * 10, dtype=np.uint8).astype(np.int64).copy()
    symbols[[5, 1999, len(symbols) - 1]] += transducer.ENDS
    t = transducer.Transducer(word_bpe)
    whole = t.run(symbols, chunk=10**6)
    for chunk in (3, 7, 64):
        assert (t.run(symbols, chunk=chunk) == whole).all()


def test_table_restart_changes_no_count(word_bpe, counts_of):
    counter = transducer.Counter(word_bpe)
    counter.transducer.cells = 64 * 50
    texts = some_texts(300, seed=3)
    got = [n for k in range(0, len(texts), 20) for n in counter.count_all(texts[k:k + 20]).tolist()]
    assert got == counts_of(texts)


def test_count_tokens_edge_rows(clashing, empty_docs, edge_rows, word_bpe, counts_of):
    out = transducer.count_tokens(clashing, word_bpe).select("text", "n_bytes", "n_tokens").collect()
    assert len(out) == len(edge_rows)
    assert [r["n_tokens"] for r in out] == counts_of([r["text"] or "" for r in out])
    assert [r["n_bytes"] for r in out] == [len((r["text"] or "").encode()) for r in out]
    assert transducer.count_tokens(empty_docs, word_bpe).count() == 0


def test_op5_counts(spark, counts_of):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = catalog.queries()["op5_token_counts"](spark, SF).collect()
    want = dict(zip(texts, counts_of(list(texts.values())), strict=True))
    assert {r["doc_id"]: (r["n_tokens"], r["over_limit"]) for r in rows} == {k: (n, n > 2048) for k, n in want.items()}


def test_blankless_words_are_scanned_in_few_rounds(word_bpe, counts_of, monkeypatch):
    rounds = []
    t = transducer.Counter(word_bpe)
    advance = t.transducer._advance
    monkeypatch.setattr(t.transducer, "_advance", lambda *a: rounds.append(1) or advance(*a))
    r = random.Random(4)
    texts = ["a" * 40000, "".join(r.choice("aeiostrn") for _ in range(30000)), "é" * 9000 + " word " + "the" * 9000, ".,;" * 8000]
    for text in texts:
        rounds.clear()
        assert t.count_all([text]).tolist() == counts_of([text])
        assert len(rounds) <= 8  # not one per chunk
