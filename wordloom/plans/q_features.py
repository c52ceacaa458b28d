"""Feature queries (F1-F12, S6): vocabularies, counts, TF-IDF, readability, feature matrix, sequences."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import functions as F

from ..functions.constants import (
    MAX_FEATURES,
    SEQ_MAX_LENGTH,
    SPLIT_SEED,
    TEST_SHARE,
)
from ..functions.stopwords import ENGLISH_STOPWORDS
from ..functions.text import BLANK_RUN, explode_rows, word_tokens
from ..operators import features as ft
from ..operators.sampling import random_split
from ..session import read_table, session_key
from . import views
from .q_prep import sql_split_r1
from .registry import builtin_lexicon, register
from .sql_common import q, sql_lex_match, sql_word_tokens

TEST_FRACTION = Fraction(TEST_SHARE).limit_denominator(1000)

# ------------------------------------------------------------ Spark side

_STATE: dict = {}


_SPLITS: dict = {}


def split_docs(spark, sf_dir):
    """R1 split of the documents, planned once per (session, scale factor) so its bucket table is reused."""
    key = (*session_key(spark), sf_dir)
    if key not in _SPLITS:
        docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
        _SPLITS[key] = random_split(docs, "doc_id", SPLIT_SEED, TEST_FRACTION)
    return _SPLITS[key]


def train_docs(spark, sf_dir):
    return split_docs(spark, sf_dir).filter(F.col("split") == "train").drop("split")


def test_docs(spark, sf_dir):
    return split_docs(spark, sf_dir).filter(F.col("split") == "test").drop("split")


def feature_state(spark, sf_dir, max_features: int = MAX_FEATURES) -> ft.FeatureState:
    """Fitted once per (session, scale factor, size) and reused by every feature query."""
    base_key = (*session_key(spark), sf_dir, MAX_FEATURES)
    if base_key not in _STATE:
        _STATE[base_key] = ft.fit_features(train_docs(spark, sf_dir), MAX_FEATURES, builtin_lexicon(spark))
    if max_features == MAX_FEATURES:
        return _STATE[base_key]
    key = base_key[:3] + (max_features,)
    if key not in _STATE:
        if max_features < MAX_FEATURES:
            _STATE[key] = ft.shrink_features(_STATE[base_key], max_features)
        else:
            _STATE[key] = ft.fit_features(train_docs(spark, sf_dir), max_features, builtin_lexicon(spark))
    return _STATE[key]


# -------------------------------------------------------------- SQL side

_STOP_SQL = "[" + ", ".join(q(w) for w in ENGLISH_STOPWORDS) + "]"


def sql_ftoks(expr: str = "text") -> str:
    return f"list_filter({sql_word_tokens(expr)}, lambda x: NOT list_contains({_STOP_SQL}, x))"


def _vocab_cte(name: str, counts: str, k: int) -> str:
    return f"""{name} AS (
  SELECT term, total, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS pos
  FROM (SELECT term, CAST(sum(n) AS BIGINT) AS total FROM {counts} GROUP BY term
        ORDER BY total DESC, term LIMIT {k}))"""


def sql_feature_ctes(k: int = MAX_FEATURES) -> str:
    """CTEs train_docs, test_docs, ftoks, uni_all, uni_vocab, bi_all, bi_vocab, ndocs, idf."""
    return f"""{sql_split_r1()},
train_docs AS (SELECT d.doc_id, d.text FROM documents d JOIN split_r1 s ON s.doc_id = d.doc_id WHERE s.split = 'train'),
test_docs AS (SELECT d.doc_id, d.text FROM documents d JOIN split_r1 s ON s.doc_id = d.doc_id WHERE s.split = 'test'),
ftoks AS (SELECT doc_id, {sql_ftoks()} AS t FROM train_docs),
uni_all AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(t) AS term FROM ftoks) GROUP BY doc_id, term),
{_vocab_cte('uni_vocab', 'uni_all', k)},
bi_all AS (
  SELECT doc_id, term, count(*) AS n
  FROM (SELECT doc_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS term FROM ftoks)
  GROUP BY doc_id, term),
{_vocab_cte('bi_vocab', 'bi_all', k)},
ndocs AS (SELECT count(*) AS n_docs FROM train_docs),
idf AS (
  SELECT v.term, ln(CAST(1 + n_docs AS DOUBLE) / CAST(1 + coalesce(d.df, 0) AS DOUBLE)) + 1.0 AS idf
  FROM uni_vocab v LEFT JOIN (SELECT term, count(*) AS df FROM uni_all GROUP BY term) d ON d.term = v.term, ndocs)"""


def sql_tfidf_apply(name: str, source: str, id_expr: str = "doc_id") -> str:
    """CTE ``name`` (id, term, tfidf) for the rows of ``source`` with the training state."""
    return f"""{name}_c AS (
  SELECT id, term, count(*) AS n
  FROM (SELECT {id_expr} AS id, unnest({sql_ftoks()}) AS term FROM {source}) x
  WHERE term IN (SELECT term FROM uni_vocab) GROUP BY id, term),
{name}_w AS (SELECT id, term, CAST(n AS DOUBLE) * idf AS w FROM {name}_c JOIN idf USING (term)),
{name} AS (SELECT id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 6) AS tfidf FROM {name}_w)"""


def sql_ari(expr: str = "text") -> str:
    has = "'[\\p{L}\\p{N}]'"
    words = f"len(list_filter(string_split_regex(coalesce({expr}, ''), {q(BLANK_RUN)}), lambda w: regexp_matches(w, {has})))"
    piece_words = f"len(list_filter(string_split_regex(p, {q(BLANK_RUN)}), lambda w: regexp_matches(w, {has})))"
    sents = f"greatest(1, len(list_filter(string_split_regex(coalesce({expr}, ''), '[.!?]+'), lambda p: {piece_words} > 2)))"
    chars = f"length(regexp_replace(coalesce({expr}, ''), {q(BLANK_RUN)}, '', 'g'))"
    def half_up(x: str, scale: float) -> str:
        return f"(CAST(floor(({x}) * CAST({scale} AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS DOUBLE) / CAST({scale} AS DOUBLE))"

    per_word = half_up(f"CAST({chars} AS DOUBLE) / CAST({words} AS DOUBLE)", 100.0)
    per_sentence = half_up(f"CAST({words} AS DOUBLE) / CAST({sents} AS DOUBLE)", 100.0)
    value = half_up(f"CAST(4.71 AS DOUBLE) * {per_word} + CAST(0.5 AS DOUBLE) * {per_sentence} - CAST(21.43 AS DOUBLE)", 10.0)
    return f"CASE WHEN {words} > 0 THEN {value} ELSE CAST(0.0 AS DOUBLE) END"


# ----------------------------------------------------------------- queries


@register("txt_tokens", f"SELECT token, count(*) AS n FROM (SELECT unnest({sql_word_tokens()}) AS token FROM documents) GROUP BY token")
def txt_tokens(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return explode_rows(docs, [], word_tokens("text"), "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@register(
    "txt_stopword_filter",
    f"SELECT doc_id, len({sql_word_tokens()}) AS n_before, len({sql_ftoks()}) AS n_after FROM documents",
)
def txt_stopword_filter(spark, sf_dir):
    docs = ft.add_token_columns(read_table(spark, sf_dir, "documents"), bigram=False)
    return docs.select(
        "doc_id",
        F.size(word_tokens("text")).cast("long").alias("n_before"),
        F.size(ft.UNI_COL).cast("long").alias("n_after"),
    )


@register("feat_unigram_vocab", f"WITH {sql_feature_ctes()} SELECT term, total, pos FROM uni_vocab")
def feat_unigram_vocab(spark, sf_dir):
    return feature_state(spark, sf_dir).uni.table


@register("feat_bigram_vocab", f"WITH {sql_feature_ctes()} SELECT term, total, pos FROM bi_vocab")
def feat_bigram_vocab(spark, sf_dir):
    return feature_state(spark, sf_dir).bi.table


@register("feat_unigram_counts",
          f"WITH {sql_feature_ctes()} SELECT doc_id, term, n FROM uni_all WHERE term IN (SELECT term FROM uni_vocab)")
def feat_unigram_counts(spark, sf_dir):
    return ft.vocab_counts(train_docs(spark, sf_dir), feature_state(spark, sf_dir).uni)


@register("feat_bigram_counts",
          f"WITH {sql_feature_ctes()} SELECT doc_id, term, n FROM bi_all WHERE term IN (SELECT term FROM bi_vocab)")
def feat_bigram_counts(spark, sf_dir):
    return ft.vocab_counts(train_docs(spark, sf_dir), feature_state(spark, sf_dir).bi)


@register("feat_tfidf",
          f"WITH {sql_feature_ctes()}, {sql_tfidf_apply('tt', 'train_docs')} SELECT id AS doc_id, term, tfidf FROM tt")
def feat_tfidf(spark, sf_dir):
    st = feature_state(spark, sf_dir)
    return ft.tfidf_long(ft.vocab_counts(train_docs(spark, sf_dir), st.uni), st.tfidf)


@register("feat_transform_test",
          f"WITH {sql_feature_ctes()}, {sql_tfidf_apply('te', 'test_docs')} SELECT id AS doc_id, term, tfidf FROM te")
def feat_transform_test(spark, sf_dir):
    st = feature_state(spark, sf_dir)
    return ft.tfidf_long(ft.vocab_counts(test_docs(spark, sf_dir), st.uni), st.tfidf)


@register(
    "feat_transform_second_set",
    f"""WITH {sql_feature_ctes()}, {views.sql_second()}, {sql_tfidf_apply('se', 'v_second', 'item_id')}
SELECT id AS item_id, term, tfidf FROM se""",
)
def feat_transform_second_set(spark, sf_dir):
    st = feature_state(spark, sf_dir)
    second = views.second_set(spark, sf_dir)
    return ft.tfidf_long(ft.vocab_counts(second, st.uni, id_col="item_id"), st.tfidf, id_col="item_id")


@register("feat_ari", f"SELECT doc_id, round({sql_ari()}, 6) AS ari FROM documents")
def feat_ari(spark, sf_dir):
    return ft.readability(read_table(spark, sf_dir, "documents"))


def _matrix_parts(docs: str, id_col: str, lex_match: str) -> str:
    """CTE m (id, feature, value, block) of all five blocks for the rows of ``docs``."""
    return f"""{sql_tfidf_apply('tt', docs, id_col)},
{lex_match},
mt AS (SELECT {id_col}, {sql_ftoks()} AS t FROM {docs}),
m AS (
  SELECT {id_col}, 'uni_' || term AS feature, CAST(count(*) AS DOUBLE) AS value, 'uni' AS block
    FROM (SELECT {id_col}, unnest(t) AS term FROM mt) WHERE term IN (SELECT term FROM uni_vocab) GROUP BY {id_col}, term
  UNION ALL SELECT {id_col}, 'bi_' || term, CAST(count(*) AS DOUBLE), 'bi'
    FROM (SELECT {id_col}, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS term FROM mt)
    WHERE term IN (SELECT term FROM bi_vocab) GROUP BY {id_col}, term
  UNION ALL SELECT id, 'tfidf_' || term, tfidf, 'tfidf' FROM tt
  UNION ALL SELECT {id_col}, 'ari', round({sql_ari()}, 6), 'ari' FROM {docs}
  UNION ALL SELECT {id_col}, category, score, 'lex' FROM lex_scores)"""


def _matrix_sql() -> str:
    return f"{sql_feature_ctes()}, {_matrix_parts('train_docs', 'doc_id', sql_lex_match('train_docs'))}"


@register("feat_matrix_long", f"WITH {_matrix_sql()} SELECT doc_id, feature, value FROM m")
def feat_matrix_long(spark, sf_dir):
    st = feature_state(spark, sf_dir)
    return ft.feature_matrix_long(train_docs(spark, sf_dir), st).drop("block")


@register(
    "feat_matrix_second_set",
    f"""WITH {sql_feature_ctes()}, {views.sql_second()},
second_docs AS (SELECT item_id AS doc_id, text FROM v_second),
{_matrix_parts('second_docs', 'doc_id', sql_lex_match('second_docs'))}
SELECT doc_id AS item_id, feature, value, block FROM m""",
)
def feat_matrix_second_set(spark, sf_dir):
    """All five blocks of the second table, with the state fitted on the training rows."""
    return ft.feature_matrix_long(views.second_set(spark, sf_dir), feature_state(spark, sf_dir), id_col="item_id")


def _sum_block(b: str) -> str:
    return f"round(coalesce(sum(CASE WHEN block = '{b}' THEN value END), 0.0), 6) AS sum_{b}"


@register(
    "feat_row_summary",
    f"""WITH {_matrix_sql()}
SELECT doc_id, count(*) FILTER (WHERE value <> 0) AS n_nonzero, {_sum_block('uni')}, {_sum_block('bi')},
       {_sum_block('tfidf')}, max(CASE WHEN block = 'ari' THEN value END) AS ari, {_sum_block('lex')}
FROM m GROUP BY doc_id""",
)
def feat_row_summary(spark, sf_dir):
    st = feature_state(spark, sf_dir)
    m = ft.feature_matrix_long(train_docs(spark, sf_dir), st)

    def s(b):
        return F.round(F.coalesce(F.sum(F.when(F.col("block") == b, F.col("value"))), F.lit(0.0)), 6).alias(f"sum_{b}")

    return m.groupBy("doc_id").agg(
        F.count(F.when(F.col("value") != 0, 1)).alias("n_nonzero"),
        s("uni"), s("bi"), s("tfidf"),
        F.max(F.when(F.col("block") == "ari", F.col("value"))).alias("ari"),
        s("lex"),
    )


def _names_sql() -> str:
    return f"""WITH {sql_feature_ctes()}, {sql_lex_match()},
n AS (
  SELECT 0 AS blk, pos, 'uni_' || term AS feature FROM uni_vocab
  UNION ALL SELECT 1, pos, 'bi_' || term FROM bi_vocab
  UNION ALL SELECT 2, pos, 'tfidf_' || term FROM uni_vocab
  UNION ALL SELECT 3, 0, 'ari'
  UNION ALL SELECT 4, pos, category FROM lex_categories)
SELECT CAST(row_number() OVER (ORDER BY blk, pos) - 1 AS INTEGER) AS pos, feature FROM n"""


@register("feat_names", _names_sql())
def feat_names(spark, sf_dir):
    st = feature_state(spark, sf_dir)
    # At most 3 * max_features + 1 + categories names, all fitted state already on the driver.
    return spark.createDataFrame(list(enumerate(st.names())), "pos int, feature string")


@register(
    "seq_encode_pad",
    f"""WITH dt AS (SELECT doc_id, {sql_word_tokens()} AS toks FROM documents),
sv AS (
  SELECT term, CAST(row_number() OVER (ORDER BY total DESC, term) + 1 AS INTEGER) AS id
  FROM (SELECT term, count(*) AS total FROM (SELECT unnest(toks) AS term FROM dt) GROUP BY term)),
ps AS (SELECT doc_id, unnest(range(0, len(toks))) AS p, unnest(toks) AS term FROM dt),
ided AS (SELECT doc_id, p // {SEQ_MAX_LENGTH} AS chunk, p, coalesce(sv.id, 1) AS id FROM ps LEFT JOIN sv ON sv.term = ps.term)
SELECT doc_id, CAST(chunk AS INTEGER) AS chunk,
       array_to_string(list_concat(list(id ORDER BY p),
                                   list_transform(range({SEQ_MAX_LENGTH} - count(*)), lambda x: 0)), ' ') AS input_ids,
       CAST(count(*) AS INTEGER) AS n_real
FROM ided GROUP BY doc_id, chunk""",
)
def seq_encode_pad(spark, sf_dir):
    docs = views.objectives(spark, sf_dir).select("doc_id", "text")
    vocab = ft.fit_sequence_vocab(docs)
    enc = ft.encode_sequences(docs, vocab, SEQ_MAX_LENGTH)
    return enc.select("doc_id", "chunk", F.array_join("input_ids", " ").alias("input_ids"), "n_real")
