"""Steps that must not grow faster than the tables: what they shuffle, keep and run at once, and that results stay exact."""

import re
import threading
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wordloom.functions import text as tx
from wordloom.operators import features as ft
from wordloom.plans import q_ml
from wordloom.sources import persist

ODD = ["one two three. Four five six! a b, c d e", "", None, "x" * 3000, "... ?! .", "a b.c d e f", "é ü ñ 漢 字 語. 1 2 3",
       " lead\ttab\nline\x0bv  ", "- - word - - other - - third -", "a.b c?d e f!g", "w1 w2. w3\nw4 w5 . , ; w6"]


def _exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)


@pytest.fixture()
def docs(spark):
    words = ["cell", "wall", "grow", "divide", "root", "leaf", "stem", "seed"]
    rows = [(i, " ".join(words[(i * k + k * k) % (3 + k % 6)] for k in range(1, 30))) for i in range(40)]
    return spark.createDataFrame([*rows, (7, "cell cell wall"), (None, "cell leaf"), (41, None)], "doc_id long, text string")


@pytest.mark.parametrize("buckets, fullest", [(1 << 18, 4), (4, 1), (16, 1), (64, 2)])
def test_vocabularies_are_exact_whatever_the_buckets(docs, monkeypatch, buckets, fullest):
    monkeypatch.setattr(ft, "TERM_BUCKETS", buckets)
    monkeypatch.setattr(ft, "FULLEST", fullest)
    t = ft.add_token_columns(docs)
    rows = t.collect()
    for n, v in zip((1, 2), ft.fit_vocabularies(t, [1, 2], 6), strict=True):
        lists = [r[ft._tok_col(n)] for r in rows]
        total, df = Counter(x for ts in lists for x in ts), Counter(x for ts in lists for x in set(ts))
        want = sorted(sorted(total, key=lambda x: (-total[x], x))[:6])
        assert v.terms == want
        assert v.totals == {x: total[x] for x in want} and v.dfs == {x: df[x] for x in want}


def test_counts_are_dealt_by_id_before_texts_are_cut(docs):
    st = ft.fit_features(docs, 5)
    for df in (ft.tfidf_long(ft.vocab_counts(docs, st.uni), st.tfidf), ft.feature_matrix_long(docs, st)):
        assert _exchanges(df) and all(keys.startswith("doc_id") and "," not in re.sub(r", \d+.*", "", keys) for keys in _exchanges(df))


def test_readability_counts_by_one_pass_agree_with_splitting(spark):
    chars, words, sentences = tx.readability_parts("text")
    d = spark.createDataFrame(list(enumerate(ODD)), "i int, text string").select("text", chars.alias("c"), words.alias("w"), sentences.alias("s"))
    blank, has = r"[ \t\n\r\f\x0b]+", re.compile(r"[^\W_]")
    for r in d.collect():
        t = r.text or ""
        n_words = lambda s: sum(bool(has.search(x)) for x in re.split(blank, s))
        assert (r.c, r.w) == (len(re.sub(blank, "", t)), n_words(t)), t
        assert r.s == max(1, sum(n_words(p) > 2 for p in re.split(r"[.!?]+", t))), t


@pytest.mark.parametrize("n_rows, at_once", [(10, True), (30_000, False)])
def test_large_fits_run_one_after_another(spark, monkeypatch, n_rows, at_once):
    running, most, lock = 0, 0, threading.Lock()

    def fit(tr, level, kind, params, n):
        nonlocal running, most
        with lock:
            running += 1
            most = max(most, running)
        time.sleep(0.2)
        with lock:
            running -= 1
        return level

    monkeypatch.setattr(q_ml.md, "fit_level", fit)
    frame = spark.range(n_rows).withColumn("split", F.lit("train"))
    assert q_ml.fit_all_levels(frame, "svm", {}) == q_ml.LEVELS
    assert (most > 1) == at_once


@pytest.mark.parametrize("frequent", [0, 3, 200_000])
def test_sequences_with_frequent_and_rare_terms(docs, monkeypatch, frequent):
    monkeypatch.setattr(ft, "FREQUENT_TERMS", frequent)
    vocab = ft.fit_sequence_vocab(docs.where("doc_id <> 7 or doc_id is null"))
    ids = {r.term: r.id for r in vocab.collect()}
    texts = [r for r in docs.where("doc_id <> 7").collect() if r.text]
    one = docs.where("doc_id <> 7").unionByName(docs.sparkSession.createDataFrame([(99, "unseen cell")], "doc_id long, text string"))
    got = {(r.doc_id, r.chunk): (list(r.input_ids), r.n_real) for r in ft.encode_sequences(one, vocab, 10).collect()}
    want = {}
    for doc_id, text in [(r.doc_id, r.text) for r in texts] + [(99, "unseen cell")]:
        seq = [ids.get(w, 1) for w in text.split()]
        for k in range(0, len(seq), 10):
            part = seq[k:k + 10]
            want[doc_id, k // 10] = (part + [0] * (10 - len(part)), len(part))
    assert got == want


def test_features_written_by_split_without_a_sort(spark, tmp_path, monkeypatch):
    feats = spark.createDataFrame([(i, "train" if i % 3 else "test", f"f{i % 2}", 1.0) for i in range(20)],
                                  "doc_id long, split string, feature string, value double")
    targets = feats.select("doc_id", F.lit("remember").alias("level"), "split", F.lit(1).alias("y"))
    persist.save_feature_set(feats, targets, f"{tmp_path}/a")
    persist.save_feature_set(feats, targets, f"{tmp_path}/b", splits=("train", "test"))
    a, b = (sorted(map(tuple, persist.load_features(spark, f"{tmp_path}/{x}").select(*feats.columns).collect())) for x in "ab")
    assert a == b == sorted(map(tuple, feats.collect()))
    assert sorted(map(tuple, persist.summary(spark, f"{tmp_path}/a").collect())) == sorted(
        map(tuple, persist.summary(spark, f"{tmp_path}/b").collect()))


def test_feature_ranking_cuts_a_text_once(spark, tmp_path, monkeypatch):
    """Labels and terms of the ranking read the same word tokens; stop words and bigrams make no copies as Java strings."""
    from wordloom.functions.constants import LEVEL_TOKENS, LEVELS
    from wordloom.operators import features as ft
    from wordloom.operators import ranking as rk
    from wordloom.plans import q_models

    texts = [None, "", "a", "the of", *(f"The {LEVEL_TOKENS[LEVELS[k % 6]]} term{k % 5} term{k % 3} of word{k} word{k}" for k in range(60))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    seen = []

    def spy(tokens, *args, keep=rk.chi_square_by_level):
        seen.append(tokens)
        return keep(tokens, *args)

    monkeypatch.setattr(rk, "chi_square_by_level", spy)
    assert q_models.topk_features_per_level(spark, str(tmp_path)).count() > 0
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and "UDF(" not in plan
    both = ft.add_token_columns(docs)
    assert "UDF(" not in both._jdf.queryExecution().optimizedPlan().toString()
    got = {r["doc_id"]: r for r in both.collect()}
    assert [got[i][ft.UNI_COL] for i in range(4)] == [[]] * 4 and [got[i][ft.BI_COL] for i in range(4)] == [[]] * 4
    assert got[4][ft.BI_COL] == [f"{LEVEL_TOKENS[LEVELS[0]]} term0", "term0 term0", "term0 word0", "word0 word0"]
    assert ft.add_token_columns(docs, stopwords=[]).where("doc_id = 3").first()[ft.UNI_COL] == ["the", "of"]
