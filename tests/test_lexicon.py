"""Golden cases and properties of lexicon reading, matching and scoring."""

import random

import pytest

from wordloom.operators import lexicon as lx
from wordloom.operators.lexicon import Lexicon


def lex_text(categories, entries, header="%"):
    lines = [header] + [f"{i} {n}" for i, n in categories] + [header] + [" ".join([p, *ids]) for p, ids in entries]
    return "\n".join(lines) + "\n"


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def scores(spark, lex, texts):
    rows = lx.category_scores(docs(spark, texts), lex).collect()
    return {(r.doc_id, r.category): r.score for r in rows}


def test_shortest_wildcard_wins_over_longer_exact(spark):
    lex = Lexicon.from_text(spark, lex_text([("1", "X"), ("2", "Y")], [("ab*", ["1"]), ("abcd", ["2"])]))
    assert scores(spark, lex, ["abcd"]) == {(0, "X"): 100.0}


def test_wildcard_matches_its_own_stem(spark):
    lex = Lexicon.from_text(spark, lex_text([("1", "X")], [("ab*", ["1"])]))
    assert scores(spark, lex, ["ab"]) == {(0, "X"): 100.0}


def test_exact_does_not_match_longer_token(spark):
    lex = Lexicon.from_text(spark, lex_text([("1", "X")], [("ab", ["1"])]))
    assert scores(spark, lex, ["abc"]) == {}


def test_several_categories_per_entry(spark):
    lex = Lexicon.from_text(spark, lex_text([("1", "X"), ("2", "Y")], [("w", ["1", "2"])]))
    assert scores(spark, lex, ["w z"]) == {(0, "X"): 50.0, (0, "Y"): 50.0}


def test_empty_and_punctuation_only_and_null_texts_give_no_rows(spark):
    lex = Lexicon.from_text(spark, lex_text([("1", "X")], [("a*", ["1"])]))
    d = spark.createDataFrame([(0, ""), (1, "!!!"), (2, None)], "doc_id long, text string")
    assert lx.category_scores(d, lex).count() == 0
    counts = {r.doc_id: r.n_tokens for r in lx.token_counts(d).collect()}
    assert counts == {0: 0, 1: 0, 2: 0}


def test_repeated_pattern_last_entry_wins(spark):
    lex = Lexicon.from_text(spark, lex_text([("1", "X"), ("2", "Y")], [("a", ["1"]), ("a", ["2"])]))
    assert scores(spark, lex, ["a"]) == {(0, "Y"): 100.0}


def test_wildcards_with_same_stem_later_wins(spark):
    lex = Lexicon.from_text(spark, lex_text([("1", "X"), ("2", "Y")], [("ab*", ["1"]), ("ab*zz", ["2"])]))
    assert scores(spark, lex, ["abq"]) == {(0, "Y"): 100.0}


def test_lone_star_matches_every_token(spark):
    lex = Lexicon.from_text(spark, lex_text([("1", "X")], [("*", ["1"])]))
    assert scores(spark, lex, ["a bb ccc"]) == {(0, "X"): 100.0}


def test_entry_without_categories_still_shadows(spark):
    lex = Lexicon.from_text(spark, lex_text([("1", "X")], [("ab*", []), ("abc", ["1"])]))
    assert scores(spark, lex, ["abc"]) == {}
    cov = lx.coverage(docs(spark, ["abc"]), lex).first()
    assert (cov.n_tokens, cov.n_matched, cov.dic_pct) == (1, 1, 100.0)


def test_section_lines_with_titles_and_blank_separated_fields(spark):
    text = "% 1st section\n1 art\n2\trel\n\n% 2nd section\nthe 1\nof\t2\n"
    lex = Lexicon.from_text(spark, text)
    assert lex.category_names == ["art", "rel"]
    assert scores(spark, lex, ["The cat of the hat"]) == {(0, "art"): 40.0, (0, "rel"): 20.0}


def test_strict_mode_rejects_empty_lexicon_and_unknown_ids(spark):
    with pytest.raises(ValueError):
        Lexicon.from_text(spark, "% only a title\n1 art\n", strict=True)
    with pytest.raises(ValueError):
        Lexicon.from_text(spark, lex_text([("1", "X")], [("a", ["9"])]))
    loose = Lexicon.from_text(spark, lex_text([("1", "X")], [("a", ["9", "1"])]), strict=False)
    assert scores(spark, loose, ["a b"]) == {(0, "X"): 50.0}


def test_tab_fields_keep_names_and_phrases_whole(spark):
    text = "%\n1\tPos Emo\n2 Two words\n%\nkind of\t1\ncan't\t1\t2\nglad* 1\n"
    lex = Lexicon.from_text(spark, text)
    assert lex.category_names == ["Pos Emo", "Two words"]
    assert scores(spark, lex, ["kind of", "I can't", "gladly"]) == {
        (1, "Pos Emo"): 50.0, (1, "Two words"): 50.0, (2, "Pos Emo"): 100.0}


def test_lexicon_files_are_merged_in_the_order_of_their_names(spark):
    from wordloom.session import scratch_path

    path = scratch_path(spark, "lexicon-files")
    for name, text in (("a.dic", "%\n1 X\n2 Y\n%\nfoo 1\nbar 2\n"), ("b.dic", "%\n1 Z\n2 X\n%\nfoo 1\nbaz 2\n")):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.option("lineSep", "\x00").text(f"{path}/{name}")
    one = Lexicon.read(spark, f"{path}/a.dic")
    assert scores(spark, one, ["foo bar"]) == {(0, "X"): 50.0, (0, "Y"): 50.0}
    both = Lexicon.read(spark, f"{path}/*")
    assert both.category_names == ["X", "Y", "Z"]
    assert scores(spark, both, ["foo", "bar", "baz"]) == {(0, "Z"): 100.0, (1, "Y"): 100.0, (2, "X"): 100.0}


def test_patterns_are_lower_cased_and_punctuation_removed_from_text(spark):
    lex = Lexicon.from_text(spark, lex_text([("1", "X")], [("I", ["1"]), ("dont", ["1"])]))
    got = scores(spark, lex, ["I DON'T know…", "“Café” crème!"])
    assert got == {(0, "X"): round(200.0 / 3, 6)}
    assert lx.token_counts(docs(spark, ["“Café” crème!"])).first().n_tokens == 2


def _scores_by_rule(entries, text):
    """The match rule spelled out: of all entries that fit a token, wildcards come before exact entries,
    shorter stems before longer ones, later lines before earlier ones."""
    import string
    from collections import Counter

    tokens = "".join(c for c in text.lower() if c not in string.punctuation).split()
    hits = Counter()
    for token in tokens:
        fitting = []
        for line, (pattern, cats) in enumerate(entries):
            stem, star, _ = pattern.partition("*")
            if token.startswith(stem) if star else token == pattern:
                fitting.append((not star, len(stem), -line, cats))
        if fitting:
            hits.update(min(fitting)[3])
    return {c: round(100.0 * n / len(tokens), 6) for c, n in hits.items()}


def test_matches_the_rule_on_random_patterns(spark):
    rnd = random.Random(7)
    alphabet = "abc"
    cats = [("1", "X"), ("2", "Y"), ("3", "Z")]
    for trial in range(3):
        entries = []
        for _ in range(25):
            stem = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 4)))
            pat = stem + ("*" if rnd.random() < 0.4 else "")
            ids = rnd.sample(["1", "2", "3"], rnd.randint(1, 2))
            entries.append((pat, ids))
        texts = [" ".join("".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 5))) for _ in range(rnd.randint(1, 12)))
                 for _ in range(20)]
        lex = Lexicon.from_text(spark, lex_text(cats, entries))
        got = scores(spark, lex, texts)
        names = dict(cats)
        for i, t in enumerate(texts):
            want = _scores_by_rule([(p, [names[x] for x in ids]) for p, ids in entries], t)
            have = {c: s for (d, c), s in got.items() if d == i}
            assert have == want, (trial, t)


def test_scores_unchanged_under_repartitioning(spark):
    lex = Lexicon.builtin(spark)
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    a = sorted(map(tuple, lx.category_scores(d, lex).collect()))
    b = sorted(map(tuple, lx.category_scores(d.repartition(13, "lang"), lex).collect()))
    assert a == b


def test_match_plan_uses_broadcast_hash_joins_only(spark):
    lex = Lexicon.builtin(spark)
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    plan = lx.category_scores(d, lex)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    assert "SortMergeJoin" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan


def test_scores_by_label_matches_direct_mean(spark):
    lex = Lexicon.builtin(spark)
    d = docs(spark, ["the cat", "a dog and the", "nothing here", ""])
    labels = spark.createDataFrame([(0, 1), (1, 1), (2, 0), (3, 0)], "doc_id long, quality int")
    got = {(r.quality, r.category): (r.n_docs, r.mean_score) for r in lx.scores_by_label(d, labels, lex, "quality").collect()}
    assert got[(1, "art")] == (2, round((50.0 + 50.0) / 2, 6))
    assert got[(1, "link")] == (1, round(50.0 / 2, 6))
    assert not any(k[0] == 0 for k in got)


def test_treebank_tokenizer_option(spark):
    lex = Lexicon.from_text(spark, lex_text([("1", "X")], [("not", ["1"]), ("``", ["1"])]))
    d = docs(spark, ["I cannot go, gonna stay", "“quoted”"])
    plain = {r.doc_id: r.n_tokens for r in lx.token_counts(d).collect()}
    tb = {r.doc_id: r.n_tokens for r in lx.token_counts(d, treebank=True).collect()}
    assert plain == {0: 5, 1: 1} and tb == {0: 7, 1: 3}
    got = scores(spark, lex.with_treebank_tokens(), ["I cannot go", "“quoted”"])
    assert got == {(0, "X"): 25.0, (1, "X"): round(100.0 / 3, 6)}
    assert scores(spark, lex, ["I cannot go"]) == {}


def test_shuffle_join_path_equals_broadcast_path(spark):
    from dataclasses import replace

    lex = Lexicon.builtin(spark)
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    big = replace(lex, broadcast_ok=False)
    a = sorted(map(tuple, lx.category_scores(d, lex).collect()))
    b = sorted(map(tuple, lx.category_scores(d, big).collect()))
    assert a == b and len(a) > 0
    assert sorted(map(tuple, lx.coverage(d, lex).collect())) == sorted(map(tuple, lx.coverage(d, big).collect()))
