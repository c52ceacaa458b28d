"""Source, sink, persistence, inference and streaming queries (S1, S2, S5, S6, M15, streaming L6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.constants import LEVEL_TOKENS, LEVELS, MAX_FEATURES
from ..operators import features as ft
from ..operators import inference as inf
from ..operators import prep
from ..session import read_table, scratch_path
from ..sources import csv as csv_src
from ..sources import persist
from ..streaming import lexicon_stream
from . import views
from .q_features import feature_state, split_docs, sql_feature_ctes, sql_ftoks
from . import q_lexicon  # noqa: F401  (registers lex_category_scores, whose oracle is shared)
from .q_prep import ql
from .registry import ORACLES, builtin_lexicon, register
from .sql_common import sql_lex_match, sql_word_tokens


@register(
    "src_csv_roundtrip",
    f"WITH {views.sql_objectives()} SELECT doc_id, length(text) AS text_len, md5(text) AS text_md5, "
    + ", ".join(ql(lv) for lv in LEVELS) + " FROM v_objectives",
)
def src_csv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "objectives-csv")
    csv_src.write_csv(views.objectives(spark, sf_dir), path)
    back = csv_src.read_csv(spark, path, csv_src.objectives_schema(LEVELS))
    return back.select("doc_id", F.length("text").cast("long").alias("text_len"), F.md5("text").alias("text_md5"), *LEVELS)


@register("src_head_n", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 10")
def src_head_n(spark, sf_dir):
    return csv_src.head(read_table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 10)


def _persist_sql() -> str:
    unp = " UNION ALL ".join(f"SELECT doc_id, '{lv}' AS level FROM v_objectives" for lv in LEVELS)
    return f"""WITH {sql_feature_ctes()}, {views.sql_objectives()}, {sql_lex_match()},
alld AS (SELECT d.doc_id, d.text, s.split FROM documents d JOIN split_r1 s ON s.doc_id = d.doc_id),
adt AS (SELECT doc_id, split, {sql_ftoks()} AS t FROM alld),
uni_x AS (SELECT doc_id, split, term FROM (SELECT doc_id, split, unnest(t) AS term FROM adt)
          WHERE term IN (SELECT term FROM uni_vocab)),
bi_x AS (SELECT doc_id, split, term
         FROM (SELECT doc_id, split, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS term FROM adt)
         WHERE term IN (SELECT term FROM bi_vocab)),
feat AS (
  SELECT doc_id, split, 'uni_' || term AS feature FROM uni_x
  UNION ALL SELECT doc_id, split, 'tfidf_' || term FROM uni_x
  UNION ALL SELECT doc_id, split, 'bi_' || term FROM bi_x
  UNION ALL SELECT doc_id, split, 'ari' FROM alld
  UNION ALL SELECT l.doc_id, a.split, l.category FROM lex_scores l JOIN alld a ON a.doc_id = l.doc_id),
tg AS (SELECT u.doc_id, u.level, s.split FROM ({unp}) u JOIN split_r1 s ON s.doc_id = u.doc_id),
nr AS (SELECT level, split, count(DISTINCT doc_id) AS n_rows FROM tg GROUP BY level, split),
nf AS (SELECT split, count(DISTINCT feature) AS n_features FROM feat GROUP BY split)
SELECT nr.level, nr.split, nr.n_rows, nf.n_features, nn.n_names, CAST(0 AS BIGINT) AS n_unnamed
FROM nr JOIN nf ON nf.split = nr.split,
  (SELECT (SELECT count(*) FROM uni_vocab) * 2 + (SELECT count(*) FROM bi_vocab) + 1 + (SELECT count(*) FROM lex_categories) AS n_names) nn"""


@register("feat_persist_roundtrip", _persist_sql())
def feat_persist_roundtrip(spark, sf_dir):
    """Write features (by split), targets (by level, split), names and the second table's features, read them back, summarise."""
    st = feature_state(spark, sf_dir, MAX_FEATURES)
    docs = split_docs(spark, sf_dir)
    feats = ft.feature_matrix_long(docs, st, keep=["split"])
    targets = prep.unpivot_levels(views.with_level_labels(docs), ["doc_id", "split"], LEVELS)
    names = spark.createDataFrame(list(enumerate(st.names())), "pos int, feature string")
    second = ft.feature_matrix_long(views.second_set(spark, sf_dir), st, id_col="item_id")
    path = scratch_path(spark, "feature-set")
    persist.save_feature_set(feats, targets, path, names, second, splits=("train", "test"))
    t = persist.load_targets(spark, path)
    f = persist.load_features(spark, path)
    names = persist.load_names(spark, path)
    rows = t.groupBy("level", "split").agg(F.countDistinct("doc_id").alias("n_rows"))
    # rows and splits agree in both tables: every feature row has its document's split already
    nf = f.groupBy("split").agg(F.countDistinct("feature").alias("n_features"))
    used = f.select("feature").unionByName(persist.load_second(spark, path).select("feature")).distinct()
    n_unnamed = used.join(F.broadcast(names), "feature", "left_anti").count()
    return rows.join(F.broadcast(nf), "split").select(
        "level", "split", "n_rows", "n_features", F.lit(names.count()).cast("long").alias("n_names"),
        F.lit(n_unnamed).cast("long").alias("n_unnamed"))


@register(
    "batch_infer_udf",
    f"""WITH k AS (
  SELECT doc_id, len(list_filter({sql_word_tokens()}, lambda t: list_contains({list(LEVEL_TOKENS.values())}, t))) AS k
  FROM documents)
SELECT doc_id, round(1.0 / (1.0 + exp(1.0 - 0.5 * k)), 6) AS score FROM k""",
)
def batch_infer_udf(spark, sf_dir):
    weights = {tok: 0.5 for tok in LEVEL_TOKENS.values()}
    factory = inf.keyword_scorer_factory(weights, bias=-1.0)
    obj = views.objectives(spark, sf_dir)
    return inf.batch_score(obj, factory, "level-keywords", "doc_id", ["text"]).withColumn("score", F.round("score", 6))


@register("stream_lex_scores")
def stream_lex_scores(spark, sf_dir):
    """Lexicon percentages computed by a streaming query over the documents file, read back from its sink."""
    sink = scratch_path(spark, "stream-sink")
    ckpt = scratch_path(spark, "stream-checkpoint")
    q = lexicon_stream.start_scoring(spark, sf_dir, "documents.parquet", builtin_lexicon(spark), sink, ckpt)
    q.awaitTermination()
    return lexicon_stream.read_scores(spark, sink)


ORACLES["stream_lex_scores"] = ORACLES["lex_category_scores"]
