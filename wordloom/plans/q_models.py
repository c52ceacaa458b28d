"""Model queries: feature rankings (A6, A7) and relational naive Bayes (M1)."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import functions as F

from ..functions.constants import LEVELS, TOP_FEATURE_FREQUENCY, TOP_FEATURES_PER_LEVEL
from ..functions.text import word_tokens
from ..operators import features as ft
from ..operators import lexicon as lx
from ..operators import naive_bayes as nb
from ..operators import ranking as rk
from ..session import read_table, session_key
from . import views
from .q_features import feature_state, split_docs, sql_feature_ctes, sql_ftoks
from .q_prep import ql
from .registry import builtin_lexicon, register
from .sql_common import sql_lex_match
from .q_prep import sql_split_r1


# ------------------------------------------------------------- rankings


def _importance(spark, sf_dir):
    st = feature_state(spark, sf_dir)
    # labels and terms read the same word tokens, so that a text is cut once
    train = split_docs(spark, sf_dir).filter(F.col("split") == "train").select("doc_id", word_tokens("text").alias("_wt"))
    train = views.with_level_labels(train, tokens="_wt").select(
        "doc_id", "_wt", *[F.coalesce(F.col(lv), F.lit(0.0)).cast("long").alias(lv) for lv in LEVELS]
    )
    toks = ft.add_token_columns(train, bigram=False, tokens="_wt")
    imp = rk.chi_square_by_level(toks, ft.UNI_COL, LEVELS, st.uni.table)
    return imp.select("level", F.concat(F.lit("uni_"), "term").alias("feature"), "importance")


def _chi(o: str, e: str) -> str:
    return f"CASE WHEN {e} > 0 THEN ({o} - {e}) * ({o} - {e}) / {e} ELSE 0.0 END"


def _topk_sql() -> str:
    labs = ", ".join(f"CAST(coalesce(o.{ql(lv)}, 0) AS BIGINT) AS {ql(lv)}" for lv in LEVELS)
    obs = ", ".join(f"CAST(sum({ql(lv)}) AS DOUBLE) AS o1_{lv}" for lv in LEVELS)
    sz = ", ".join(f"CAST(sum({ql(lv)}) AS DOUBLE) AS n1_{lv}" for lv in LEVELS)
    parts = []
    for lv in LEVELS:
        e1 = f"(_t * n1_{lv} / _n)"
        e0 = f"(_t * (_n - n1_{lv}) / _n)"
        o1 = f"o1_{lv}"
        o0 = f"(_t - o1_{lv})"
        parts.append(f"SELECT '{lv}' AS level, term, {_chi(o1, e1)} + {_chi(o0, e0)} AS importance FROM obs, sz")
    return f"""{sql_feature_ctes()}, {views.sql_objectives()},
tr AS (SELECT o.doc_id, {labs}, {sql_ftoks('o.text')} AS t
       FROM v_objectives o JOIN split_r1 s ON s.doc_id = o.doc_id WHERE s.split = 'train'),
occ AS (SELECT unnest(t) AS term, {', '.join(ql(lv) for lv in LEVELS)} FROM tr),
obs AS (SELECT term, CAST(count(*) AS DOUBLE) AS _t, {obs} FROM occ
        WHERE term IN (SELECT term FROM uni_vocab) GROUP BY term),
sz AS (SELECT CAST(count(*) AS DOUBLE) AS _n, {sz} FROM tr),
imp AS ({' UNION ALL '.join(parts)}),
top AS (
  SELECT level, CAST(row_number() OVER (PARTITION BY level ORDER BY importance DESC, 'uni_' || term) AS INTEGER) AS rank,
         'uni_' || term AS feature, importance
  FROM imp)"""


@register(
    "topk_features_per_level",
    f"WITH {_topk_sql()} SELECT level, rank, feature, round(importance, 6) AS importance FROM top WHERE rank <= {TOP_FEATURES_PER_LEVEL}",
)
def topk_features_per_level(spark, sf_dir):
    return rk.top_k_per_group(_importance(spark, sf_dir), "level", TOP_FEATURES_PER_LEVEL)


@register(
    "topk_feature_frequency",
    f"""WITH {_topk_sql()}
SELECT feature, count(*) AS n_levels FROM top WHERE rank <= {TOP_FEATURES_PER_LEVEL}
GROUP BY feature ORDER BY n_levels DESC, feature LIMIT {TOP_FEATURE_FREQUENCY}""",
)
def topk_feature_frequency(spark, sf_dir):
    top = rk.top_k_per_group(_importance(spark, sf_dir), "level", TOP_FEATURES_PER_LEVEL)
    return rk.most_common(top, "feature", TOP_FEATURE_FREQUENCY)


# ---------------------------------------------------------- naive Bayes


def _nb_parts(spark, sf_dir):
    lex = builtin_lexicon(spark)
    docs = split_docs(spark, sf_dir)
    labels = read_table(spark, sf_dir, "labels")
    gold = labels.join(docs.select("doc_id", "split"), "doc_id").unpivot(
        ["doc_id", "split"], ["quality", "toxic"], "level", "y"
    )
    train = gold.filter(F.col("split") == "train").drop("split")
    test = gold.filter(F.col("split") == "test").drop("split")
    # per-document category scores (a few rows per document) are read by the ε pass, the fit and the
    # prediction: persisted once instead of tokenizing the texts three times
    feats = lx.category_scores(docs.select("doc_id", "text"), lex, digits=None).select(
        "doc_id", F.col("category").alias("feature"), F.col("score").alias("value")
    ).persist(StorageLevel.MEMORY_AND_DISK)
    return lex, train, test, feats


_NB_KEY: dict = {}


def nb_model(spark, sf_dir):
    key = (*session_key(spark), sf_dir)
    if key not in _NB_KEY:
        lex, train, test, feats = _nb_parts(spark, sf_dir)
        _NB_KEY[key] = (nb.fit(feats, train, lex.category_names), test, feats)
    return _NB_KEY[key]


def _nb_sql() -> str:
    return f"""{sql_split_r1()}, {sql_lex_match()},
lab AS (SELECT l.doc_id, l.quality, l.toxic, s.split FROM labels l JOIN split_r1 s ON s.doc_id = l.doc_id),
tg AS (SELECT doc_id, 'quality' AS level, quality AS y FROM lab WHERE split = 'train'
       UNION ALL SELECT doc_id, 'toxic', toxic FROM lab WHERE split = 'train'),
cats AS (SELECT category AS feature FROM lex_categories),
x AS (SELECT t.doc_id, c.feature, coalesce(s.score, 0.0) AS value
      FROM (SELECT DISTINCT doc_id FROM lab) t CROSS JOIN cats c
      LEFT JOIN (SELECT doc_id, category, 100.0 * CAST(cnt AS DOUBLE) / CAST(n_tokens AS DOUBLE) AS score FROM lex_counts) s
        ON s.doc_id = t.doc_id AND s.category = c.feature),
eps AS (SELECT 1e-9 * max(v) AS eps
        FROM (SELECT feature, var_pop(value) AS v FROM x WHERE doc_id IN (SELECT doc_id FROM tg) GROUP BY feature)),
st AS (SELECT tg.level, tg.y, x.feature, avg(x.value) AS mean, var_pop(x.value) + (SELECT eps FROM eps) AS var
       FROM tg JOIN x ON x.doc_id = tg.doc_id GROUP BY tg.level, tg.y, x.feature),
pri AS (SELECT level, y, count(*) AS n_c, sum(count(*)) OVER (PARTITION BY level) AS n_l FROM tg GROUP BY level, y),
trows AS (SELECT doc_id, 'quality' AS level FROM lab WHERE split = 'test'
          UNION ALL SELECT doc_id, 'toxic' FROM lab WHERE split = 'test'),
jll AS (
  SELECT r.doc_id, r.level, st.y,
         ln(CAST(p.n_c AS DOUBLE) / CAST(p.n_l AS DOUBLE)) - 0.5 * sum(ln(2 * pi() * st.var))
         - 0.5 * sum((x.value - st.mean) * (x.value - st.mean) / st.var) AS j
  FROM trows r JOIN x ON x.doc_id = r.doc_id JOIN st ON st.level = r.level AND st.feature = x.feature
  JOIN pri p ON p.level = r.level AND p.y = st.y
  GROUP BY r.doc_id, r.level, st.y, p.n_c, p.n_l)"""


@register(
    "nb_gaussian_stats",
    f"WITH {_nb_sql()} SELECT level, y, feature, round(mean, 6) AS mean, round(var, 6) AS var FROM st",
)
def nb_gaussian_stats(spark, sf_dir):
    model, _, _ = nb_model(spark, sf_dir)
    return nb.stats_table(model)


@register(
    "nb_gaussian_predict",
    f"""WITH {_nb_sql()}
SELECT doc_id, level,
       CAST(CASE WHEN max(CASE WHEN y = 1 THEN j END) > coalesce(max(CASE WHEN y = 0 THEN j END), '-inf'::DOUBLE)
                 THEN 1 ELSE 0 END AS INTEGER) AS yhat
FROM jll GROUP BY doc_id, level""",
)
def nb_gaussian_predict(spark, sf_dir):
    model, test, feats = nb_model(spark, sf_dir)
    return nb.predict(model, feats, test)
