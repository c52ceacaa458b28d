"""Cleaning, CSV round trip and feature operators."""

import math

from pyspark.sql import functions as F

from wordloom.functions.constants import LEVELS
from wordloom.operators import features as ft
from wordloom.operators import prep
from wordloom.session import scratch_path
from wordloom.sources import csv as csv_src


def test_unknown_objective_gives_zeros_and_blank_label_is_zero(spark):
    df = spark.createDataFrame([(1, "Remembering"), (2, "Other"), (3, None)], "item_id long, objective string")
    out = {r.item_id: r for r in prep.one_hot(df, "objective", {"Remembering": "remember"}, LEVELS).collect()}
    assert out[1].remember == 1.0 and out[2].remember == 0.0 and out[3].remember == 0.0
    assert all(out[2][lv] == 0.0 for lv in LEVELS)
    lab = spark.createDataFrame([(1, None, 1.0)], "doc_id long, remember double, understand double")
    r = prep.fill_labels(lab, ["remember", "understand"]).first()
    assert (r.remember, r.understand) == (0.0, 1.0)


def test_csv_round_trip_with_quotes_commas_and_blanks(spark):
    rows = [
        (0, "Describe the cell, and its parts", 1.0, None, None, None, None, None),
        (1, " recall terms; apply \"rules\"", 1.0, None, 1.0, None, None, None),
        (2, "line one\nline two", None, None, None, None, None, 1.0),
    ]
    schema = csv_src.objectives_schema(LEVELS)
    df = spark.createDataFrame(rows, schema)
    path = scratch_path(spark, "test-csv")
    csv_src.write_csv(df, path)
    back = sorted(map(tuple, csv_src.read_csv(spark, path, schema).collect()))
    assert back == sorted(rows)


def test_unpivot_and_label_vector(spark):
    df = spark.createDataFrame([(7, 1.0, None)], "doc_id long, remember double, understand double")
    long = {(r.level, r.y) for r in prep.unpivot_levels(df, ["doc_id"], ["remember", "understand"]).collect()}
    assert long == {("remember", 1), ("understand", 0)}
    v = prep.label_vector(df, ["remember", "understand"]).first().label_vector
    assert v == [1.0, 0.0]


def _docs(spark):
    return spark.createDataFrame(
        [(0, "The cell divides; the cell grows."), (1, "Cells and tissues form organs"), (2, "the of and"), (3, None)],
        "doc_id long, text string",
    )


def test_bigrams_formed_after_stopword_removal(spark):
    t = ft.add_token_columns(_docs(spark)).orderBy("doc_id").collect()
    assert t[0][ft.UNI_COL] == ["cell", "divides", "cell", "grows"]
    assert t[0][ft.BI_COL] == ["cell divides", "divides cell", "cell grows"]
    assert t[2][ft.UNI_COL] == [] and t[3][ft.UNI_COL] == []


def test_vocabulary_ties_and_tfidf_norm(spark):
    d = _docs(spark)
    st = ft.fit_features(d, 3)
    assert st.uni.terms == sorted(st.uni.terms)
    assert "cell" in st.uni.terms
    tf = ft.tfidf_long(ft.vocab_counts(d, st.uni), st.tfidf, digits=None)
    norms = {r.doc_id: r.s for r in tf.groupBy("doc_id").agg(F.sum(F.col("tfidf") ** 2).alias("s")).collect()}
    assert all(abs(v - 1.0) < 1e-12 for v in norms.values())
    n = 4
    assert math.isclose(st.tfidf.weights[st.uni.terms.index("cell")], math.log((1 + n) / (1 + 1)) + 1)


def test_vector_features_agree_with_long_form(spark):
    from pyspark.ml.functions import vector_to_array

    d = _docs(spark)
    st = ft.fit_features(d, 5)
    vec = ft.vector_features(d, st).select("doc_id", vector_to_array("features").alias("a"))
    names = st.names()
    long = {(r.doc_id, r.feature): r.value for r in ft.feature_matrix_long(d, st, digits=None).collect()}
    for r in vec.collect():
        for i, v in enumerate(r.a):
            want = long.get((r.doc_id, names[i]), 0.0)
            assert abs(v - want) < 1e-9, (r.doc_id, names[i], v, want)


def test_readability_zero_without_words(spark):
    d = spark.createDataFrame([(0, "!!! ..."), (1, "One two three four. Five six.")], "doc_id long, text string")
    got = {r.doc_id: r.ari for r in ft.readability(d).collect()}
    assert got[0] == 0.0
    chars, words, sents = len("Onetwothreefour.Fivesix."), 6, 1
    per_word, per_sentence = round(chars / words, 2), round(words / sents, 2)
    assert got[1] == round(4.71 * per_word + 0.5 * per_sentence - 21.43, 1)


def test_sequence_chunks_cover_whole_text(spark):
    d = spark.createDataFrame([(0, " ".join(f"w{i % 7}" for i in range(130)))], "doc_id long, text string")
    vocab = ft.fit_sequence_vocab(d)
    enc = ft.encode_sequences(d, vocab, 55).orderBy("chunk").collect()
    assert [r.n_real for r in enc] == [55, 55, 20]
    assert all(len(r.input_ids) == 55 for r in enc)
    assert enc[2].input_ids[20:] == [0] * 35
    assert {i for r in enc for i in r.input_ids} == set(range(2, 9)) | {0}  # every word has an id of its own


def test_sequence_ids_follow_count_then_term_over_many_partitions(spark):
    words = [f"w{i:03d}" for i in range(200) for _ in range(1 + i % 7)]
    d = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "doc_id long, text string").repartition(7)
    got = {r.term: r.id for r in ft.fit_sequence_vocab(d).collect()}
    want = sorted(set(words), key=lambda w: (-words.count(w), w))
    assert got == {w: i + 2 for i, w in enumerate(want)}
