"""Chat formatting, mixing, oracles on sf0.001, and the pipeline against its stages by brute force."""

import hashlib
import importlib.util
import sys

import duckdb
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as entry
from wordloom.llm import catalog, chat_format, mixing

from .conftest import DOC_SCHEMA, SF, words

CHAT = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
    T.StructField("text", T.StringType()), T.StructField("pos", T.StringType()), T.StructField("hi", T.StringType())])


def test_chat_edge_rows(spark):
    talk = [("user", "a"), ("assistant", "b"), (None, None), ("user", "d")]

    def conv(i, n, start=0):
        return [(i, start + k, *talk[k], "x", "y") for k in range(n)]

    rows = conv(1, 2) + conv(2, 4) + conv(3, 4, start=2000) + conv(4, 1) + [(5, 0, "assistant", "a", None, None)]
    rows += [(6, k, "user", f"t{k}", None, None) for k in range(2500)]  # several blocks of turns
    rows += [(7, k, "user", f"t{k}", None, None) for k in range(2000)]
    rows += [(None, 0, "user", "a", None, None), (8, 0, "user", "a", None, None), (8, 0, "user", "a", None, None)]
    got = {r["conv_id"]: r for r in chat_format.chat_format(spark.createDataFrame(rows, CHAT).repartition(4)).collect()}
    assert set(got) == {2, 5, 6, 8}
    assert got[2]["n_copies"] == 2 and got[2]["n_turns"] == 4 and got[6]["n_turns"] == 2500 and got[8]["n_turns"] == 2
    assert got[2]["rendered"] == "".join(f"<|{r or 'user'}|>\n{x or ''}<|end|>\n" for r, x in talk)
    assert chat_format.chat_format(spark.createDataFrame([], CHAT)).count() == 0


def test_chat_null_turns_come_first(spark):
    rows = [(1, None, "user", "x", None, None), (1, -5000, "user", "y", None, None)]
    rows += [(2, None, "user", "x", None, None), (2, -5000, "user", "y", None, None), (2, 3, "user", "z", None, None)]
    got = chat_format.chat_format(spark.createDataFrame(rows, CHAT)).collect()
    assert [(r["conv_id"], r["n_turns"]) for r in got] == [(2, 3)]
    assert got[0]["rendered"].index("x") < got[0]["rendered"].index("y") < got[0]["rendered"].index("z")


def test_raking_reaches_the_margins(spark):
    cells = spark.createDataFrame([("a", "x", 10.0), ("a", "y", 30.0), ("b", "x", 50.0), ("b", "y", 10.0)],
                                  "m1 string, m2 string, w double")
    targets = {"m1": spark.createDataFrame([("a", 0.7), ("b", 0.3)], "m1 string, share double"),
               "m2": spark.createDataFrame([("x", 0.4), ("y", 0.6)], "m2 string, share double")}
    rows = mixing.rake(cells, targets, sweeps=12).collect()
    total = sum(r["fit"] for r in rows)
    assert abs(sum(r["fit"] for r in rows if r["m1"] == "a") / total - 0.7) < 1e-6
    assert abs(sum(r["fit"] for r in rows if r["m2"] == "x") / total - 0.4) < 1e-6


def test_mix_edge_rows(clashing, empty_docs, edge_rows):
    margins = {"source": F.col("source"), "lang": F.col("lang"), "topic": mixing.topic("text")}

    def run(df):
        return mixing.mix(df, margins, mixing.n_words("text"), mixing.TEMPERATURES, sweeps=2)

    out = run(clashing).collect()
    assert len(out) == len(edge_rows)
    assert all(0 <= r["_prob"] <= 1 and r["_kept"] is not None and r["topic"] == "x" for r in out)
    assert max(r["_prob"] for r in out) == 1
    assert len({r["_kept"] for r in out if r["doc_id"] == 9}) == 1  # repeated rows, one decision
    assert run(empty_docs).count() == 0


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_oracle(spark, name):
    def canon(columns, rows):
        order = sorted(range(len(columns)), key=lambda i: columns[i])
        return sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in rows), key=repr)

    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = catalog.queries()[name](spark, SF)
    res = con.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in res.description]
    assert sorted(columns) == sorted(df.columns)
    assert canon(df.columns, df.collect()) == canon(columns, res.fetchall())


def test_op9_runs_no_python(spark):
    plan = catalog.queries()["op9_mixing"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"))


def test_pipeline_stages_on_edge_rows(spark, edge_docs, empty_docs, edge_rows):
    import corpus_pipeline as cp

    docs, ids = edge_docs, [r[0] for r in edge_rows]
    for name, stage in cp.STAGES:
        out = stage(spark, docs, SF)
        if name != "byte_bpe":
            assert out.columns == docs.columns
            docs = out.cache()
            now = [r["doc_id"] for r in docs.collect()]
            if name == "language_id":  # nulls, empty texts and texts without a letter go, others stay
                assert set(ids) - set(now) == {4, 5, 6, 11}
            elif name == "ngram_jaccard_join":
                assert 1 in now and 2 not in now and 3 not in now and 8 not in now and now.count(9) == 1
        else:
            assert all(r["round_trip"] for r in out.collect())
    for name, stage in cp.STAGES:
        assert stage(spark, empty_docs, SF).count() == 0, name
    assert edge_docs.schema == DOC_SCHEMA


def test_pipeline_run(spark):
    import corpus_pipeline as cp

    ranks = {t: i for i, t in enumerate(
        cp.Vocabulary.read(public_tokenizers.path("byte_bpe_50k.tiktoken")).tokens)}
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = entry.queries()["pipeline"](spark, SF).collect()
    assert 0 < len(rows) <= len(texts)
    for r in rows:
        assert r["round_trip"]
        text = library.decode(r["ids"])
        # line dedup only takes whole lines out
        lines = iter(texts[r["doc_id"]].split("\n"))
        assert all(any(x == line for x in lines) for line in text.split("\n")) or text == ""
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert r["ids"] == library.encode_ordinary(text)


def test_pipeline_keeps_one_text_of_a_large_copy_group(spark):
    import corpus_pipeline as cp

    copied = "\n".join(words(1000 + k, 25) for k in range(6))
    nav = "Shared line of the site"
    rows = [(k, copied, "en", "a", len(copied)) for k in range(30)]
    for k in range(30, 90):
        text = "\n".join([nav, words(k, 30), words(500 + k, 30)])
        rows.append((k, text, "en", "ab"[k % 2], len(text)))
    rows += [(90 + k, "Only\nboilerplate", "en", "b", 16) for k in range(4)]
    rows += [(94 + k, f"Only\nboilerplate\n{words(94 + k, 20)}", "en", "b", 0) for k in range(4)]
    docs = cp.boilerplate(spark, spark.createDataFrame(rows, DOC_SCHEMA).repartition(4), SF)
    texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in docs.collect()}
    assert len(texts) == len(rows) and all(t.strip() for t, _ in texts.values())
    assert all(texts[k] == (copied, len(copied)) for k in range(30))
    assert all(nav not in texts[k][0] and texts[k][1] == len(texts[k][0]) for k in range(30, 90))
    kept = {r["doc_id"]: r["text"] for r in cp.near_copies(spark, docs, SF).collect()}
    assert [k for k, t in kept.items() if t == copied] == [0] and not set(range(1, 30)) & set(kept)
    assert set(range(30, 90)) <= set(kept)


def test_line_dedup_counts_equal_pages_once(spark):
    from wordloom.llm.line_dedup import boilerplate_lines

    rows = [(1, "x\ny", "en", "a", 3)] * 9 + [(9, "x\nz", "en", "a", 3), (9, "x\nz", "en", "a", 3)]
    rows += [(11, "x\nw", "en", "a", 3), (12, None, "en", "a", None), (13, "", "en", "a", 0)]
    df = spark.createDataFrame(rows, DOC_SCHEMA).repartition(4)
    got = boilerplate_lines(df, "source", "text", 0.1, 1, page="doc_id")
    assert sorted((r["_n"], r["_np"]) for r in got.collect()) == [(1, 5)] * 3 + [(3, 5)]


def test_pipeline_keeps_one_whole_text_of_a_mirror(spark):
    """30 pages of 100 that differ in one line: their common lines are theirs, not the site's."""
    import corpus_pipeline as cp

    common = [words(2000 + k, 40) for k in range(6)]
    rows = [(k, "\n".join([*common, f"visit {k}"]), "en", "a", 1) for k in range(30)]
    rows += [(k, "\n".join(["Shared line of the site", words(k, 60)]), "en", "a", 1) for k in range(30, 100)]
    docs = cp.boilerplate(spark, spark.createDataFrame(rows, DOC_SCHEMA).repartition(4), SF)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(texts[k] == rows[k][1] for k in range(30))
    assert all(texts[k] == words(k, 60) for k in range(30, 100))
    kept = {r["doc_id"]: r["text"] for r in cp.near_copies(spark, docs, SF).collect()}
    assert set(kept) == {0, *range(30, 100)} and kept[0] == rows[0][1]


def test_pipeline_judges_rows_by_their_own_text(spark):
    import corpus_pipeline as cp

    copy, own, other = words(1, 60), words(2, 60), words(3, 60)
    rows = [(1, copy), (2, copy), (2, own), (3, other), (3, words(4, 60)), (3, other), (4, words(5, 60)), (4, words(5, 60)),
            (None, words(6, 60)), (None, words(7, 60)), (None, copy), (5, ""), (5, None), (6, "")]
    df = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], DOC_SCHEMA).repartition(3)
    kept = sorted(((r["doc_id"], r["text"]) for r in cp.near_copies(spark, df, SF).collect()), key=repr)
    want = [(1, copy), (2, own), (3, other), (3, words(4, 60)), (4, words(5, 60)), (None, words(6, 60)), (None, words(7, 60)), (6, "")]
    assert kept == sorted([*want, (5, ""), (5, None)], key=repr)
    assert cp.boilerplate(spark, df, SF).count() == len(rows)


def test_pipeline_language_stage_rejects_gibberish_and_unlearned_languages(spark):
    import random

    import corpus_pipeline as cp

    r = random.Random(5)

    def letters(alphabet, n, least=2, most=9):
        return " ".join("".join(r.choice(alphabet) for _ in range(r.randint(least, most))) for _ in range(n))

    latin = "abcdefghijklmnopqrstuvwxyz"
    foreign = [
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i "
        "sumieniem i powinni postępować wobec innych w duchu braterstwa.",
        "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di "
        "coscienza e devono agire gli uni verso gli altri in spirito di fratellanza.",
        "Alle mensen worden vrij en gelijk in waardigheid en rechten geboren. Zij zijn begiftigd met verstand en "
        "geweten, en behoren zich jegens elkander in een geest van broederschap te gedragen."]
    bad = foreign + [letters(latin, 80), letters("0123456789abcdef", 20, 32, 32), letters(latin, 15)]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = docs.where("lang is not null and length(text) > 60").collect()
    short = [" ".join(x["text"].split()[:3]) for x in clean[::10]]
    extra = [(10**6 + k, t, "en" if k % 2 else None, "a", len(t)) for k, t in enumerate(bad)]
    extra += [(2 * 10**6 + k, t, None, "a", len(t)) for k, t in enumerate(short)]
    every = docs.unionByName(spark.createDataFrame(extra, DOC_SCHEMA).select(docs.columns))
    kept = {x["doc_id"] for x in cp.language_id(spark, every, SF).select("doc_id").collect()}
    assert not {k for k in kept if 10**6 <= k < 2 * 10**6}
    lost = [t for k, t in enumerate(short) if 2 * 10**6 + k not in kept and any(c.isalpha() for c in t)]
    assert not lost, lost
    gone = [(x["doc_id"], x["text"][:80]) for x in clean if x["doc_id"] not in kept and any(c.isalpha() for c in x["text"])]
    assert not gone, gone


def test_entry_lists_every_query():
    names = entry.queries()
    assert "pipeline" in names
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13


def test_entry_guard_hides_no_error_of_a_present_module():
    assert importlib.util.find_spec("wordloom.llm").origin and "corpus_pipeline" in sys.modules
