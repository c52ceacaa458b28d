"""Model queries (M2-M12, M15-M17, S7): Spark ML fits per level on one checkpointed feature frame.

Fitting is iterative, so most are rows-only checks; counts over fitted models have an oracle.
The frame uses the SF's documents with the full 1,000-term vocabularies of the feature queries.
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import (
    FOLD_SEED,
    HALVING_FACTOR,
    HALVING_SEED,
    LEVELS,
    MAX_FEATURES,
    N_FOLDS,
    REFERENCE_GRIDS,
    TOP_FEATURES_PER_LEVEL,
)
from ..operators import blocks as bl
from ..operators import evaluate as ev
from ..operators import features as ft
from ..operators import inference as inf
from ..operators import models as md
from ..operators import naive_bayes as nb
from ..operators import ranking as rk
from ..operators import sampling as sm
from ..operators import search as se
from ..operators.fits import Model
from ..operators.kernels import KernelMap, gamma_of, kernel_error
from ..session import read_table, reliable_checkpoint, scratch_path, session_key
from . import views
from .q_features import _matrix_parts, feature_state, split_docs, sql_feature_ctes
from .q_prep import ql, sql_split_r1
from .registry import register
from .sql_common import sql_lex_match

_FRAMES: dict = {}

LOGREG = {"C": 1.0, "penalty": "l2", "tol": 1e-4, "max_iter": 200}
SVM = {"C": 1.0, "max_iter": 50}
RF = {"n_estimators": 50, "max_depth": 10}
# One candidate of every kind, as the libraries set them by default or, for boosting, the first of the grid.
DEFAULTS = {
    "nb": {"var_smoothing": 1e-9},
    "svm": {"C": 1.0, "gamma": "scale", "kernel": "rbf"},
    "logreg": {"penalty": "l2", "C": 1.0, "solver": "saga", "tol": 1e-4, "max_iter": 200},
    "rf": {"n_estimators": 100, "max_depth": None, "max_features": "sqrt", "min_samples_split": 2, "min_samples_leaf": 1,
           "bootstrap": True},
    "gbt": {"gamma": 0.1, "learning_rate": 0.1, "max_depth": 5, "n_estimators": 100},
}
# Trees of the forest with six outputs: full depth, square root of the features, as the library's default.
JOINT_TREES = 100
# Every different candidate of the reference's grids: 3 + 20 + 42 + 162 + 24, times six levels and three folds.
TUNE_GRIDS = {kind: md.distinct_candidates(kind, se.expand_grid(grid)) for kind, grid in REFERENCE_GRIDS.items()}


# Training rows up to which the fits of all levels run at once.
SIDE_BY_SIDE_ROWS = 20_000


def _key(spark, sf_dir, name):
    return (*session_key(spark), sf_dir, name)


def _state(spark, sf_dir, name: str, make):
    """Fitted state, made once per session."""
    key = _key(spark, sf_dir, name)
    if key not in _FRAMES:
        _FRAMES[key] = make()
    return _FRAMES[key]


def model_frame(spark, sf_dir) -> DataFrame:
    """(doc_id, split, features, six 0/1 labels, fold_<level>), checkpointed once."""
    key = _key(spark, sf_dir, "frame")
    if key in _FRAMES:
        return _FRAMES[key]
    docs = split_docs(spark, sf_dir)
    state = feature_state(spark, sf_dir, MAX_FEATURES)
    vec = ft.vector_features(docs.select("doc_id", "text"), state)
    # ids, split and the six labels: a narrow table (no text), written once so that folds
    # and the frame read it instead of re-running the label regexes over every text
    labelled = reliable_checkpoint(views.with_level_labels(docs).select(
        "doc_id", "split", *[F.coalesce(F.col(lv), F.lit(0.0)).alias(lv) for lv in LEVELS]
    ))
    train = labelled.filter(F.col("split") == "train")
    long = train.unpivot(["doc_id"], LEVELS, "level", "y")
    folds = sm.kfold(long, "doc_id", FOLD_SEED, N_FOLDS, strata=["level", "y"])
    folds_wide = folds.groupBy("doc_id").pivot("level", LEVELS).agg(F.first("fold"))
    folds_wide = folds_wide.select("doc_id", *[F.col(lv).alias(f"fold_{lv}") for lv in LEVELS])
    frame = (
        labelled.join(vec, "doc_id")
        .join(folds_wide, "doc_id", "left")
    )
    frame = reliable_checkpoint(frame)
    _FRAMES[key] = frame
    return frame


def second_frame(spark, sf_dir) -> DataFrame:
    """Second table (conversations) with the same fitted features and the same label rule."""
    key = _key(spark, sf_dir, "second")
    if key not in _FRAMES:
        state = feature_state(spark, sf_dir, MAX_FEATURES)
        sec = views.second_set(spark, sf_dir)
        vec = ft.vector_features(sec, state, id_col="item_id")
        lab = views.with_level_labels(sec).select(
            "item_id", *[F.coalesce(F.col(lv), F.lit(0.0)).alias(lv) for lv in LEVELS]
        )
        _FRAMES[key] = reliable_checkpoint(lab.join(vec, "item_id").withColumnRenamed("item_id", "doc_id"))
    return _FRAMES[key]


def _train(frame):
    return frame.filter(F.col("split") == "train")


def _test(frame):
    return frame.filter(F.col("split") == "test")


def fit_all_levels(frame: DataFrame, kind: str, params: dict) -> list[md.FittedLevel]:
    """One fit per level.  Spark ML keeps a copy of the training rows for each fit that runs.  Few rows are fitted side by
    side, which keeps the executors busy between the small jobs of any one fit; more than ``SIDE_BY_SIDE_ROWS`` level
    after level, so that never more than one copy asks for the executors' memory."""
    tr = _train(frame)
    n = tr.count()
    with ThreadPoolExecutor(max_workers=len(LEVELS) if n <= SIDE_BY_SIDE_ROWS else 1) as pool:
        return list(pool.map(lambda lv: md.fit_level(tr, lv, kind, params, n), LEVELS))


def predict_all(fitted: list[md.FittedLevel], frame: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return reduce(DataFrame.unionByName, [md.predict_level(f, frame, id_col) for f in fitted])


def _level_predictions(spark, sf_dir, kind, params, frame=None):
    frame = model_frame(spark, sf_dir) if frame is None else frame
    fitted = fit_all_levels(frame, kind, params)
    return predict_all(fitted, _test(frame)).select("doc_id", "level", "yhat")


@register("svm_linear_predict")
def svm_linear_predict(spark, sf_dir):
    return _level_predictions(spark, sf_dir, "svm", SVM)


def _kernel_predictions(spark, sf_dir, kernel: str) -> DataFrame:
    """A linear machine per level on the mapped rows; the map does not depend on the level and is made once."""
    frame = model_frame(spark, sf_dir)
    mapping = KernelMap(kernel, md.scale_gamma(_train(frame)), _dim(spark, sf_dir))
    columns = ["doc_id", "split", "features", *LEVELS]
    return _level_predictions(spark, sf_dir, "svm", SVM, frame=reliable_checkpoint(md.kernel_features(frame.select(*columns), mapping)))


@register("svm_kernel_predict")
def svm_kernel_predict(spark, sf_dir):
    return _kernel_predictions(spark, sf_dir, "rbf")


@register("svm_poly_predict")
def svm_poly_predict(spark, sf_dir):
    return _kernel_predictions(spark, sf_dir, "poly")


@register("kernel_map_error")
def kernel_map_error(spark, sf_dir):
    """Error of both kernel maps against the exact kernels of all pairs of a labelled sample, for every gamma setting."""
    x = bl.labelled_sample(_train(model_frame(spark, sf_dir)), LEVELS, _dim(spark, sf_dir), se.LABELLED_ROWS, HALVING_SEED).x.dense()
    rows = [(kind, setting, g, len(x), kernel_error(KernelMap(kind, g, x.shape[1]), x)) for kind in ("rbf", "poly")
            for setting in ("scale", "auto") for g in [gamma_of(setting, x)]]
    return spark.createDataFrame(rows, "kernel string, setting string, gamma double, n_rows long, relative_error double")


@register("rf_importances")
def rf_importances(spark, sf_dir):
    """The 20 features with the largest forest importance per level."""
    names = feature_state(spark, sf_dir, MAX_FEATURES).names()
    rows = [(f.level, names[i], float(v)) for f in fit_all_levels(model_frame(spark, sf_dir), "rf", RF)
            for i, v in zip(f.model.featureImportances.indices, f.model.featureImportances.values)]
    scores = spark.createDataFrame(rows, "level string, feature string, importance double")
    return rk.top_k_per_group(scores, "level", TOP_FEATURES_PER_LEVEL)


@register("logreg_predict")
def logreg_predict(spark, sf_dir):
    return _level_predictions(spark, sf_dir, "logreg", LOGREG)


@register("rf_predict")
def rf_predict(spark, sf_dir):
    return _level_predictions(spark, sf_dir, "rf", RF)


def _default_models(spark, sf_dir) -> list:
    """(level, kind, model) of ``DEFAULTS`` for every level, fitted on all training rows."""
    def make() -> list:
        rows = se.refit(spark, _work(spark, sf_dir), [(lv, kind, p) for kind, p in DEFAULTS.items() for lv in LEVELS])
        return [(r[0], r[1], Model.from_bytes(r[5])) for r in rows]

    return _state(spark, sf_dir, "defaults", make)


@register("gbt_predict")
def gbt_predict(spark, sf_dir):
    """Newton boosting of every level."""
    models = [m for m in _default_models(spark, sf_dir) if m[1] == "gbt"]
    return se.predict_models(_test(model_frame(spark, sf_dir)), models, _work(spark, sf_dir).value.bins,
                             _dim(spark, sf_dir)).select("doc_id", "level", "yhat")


def _joint_forest(spark, sf_dir, frame: DataFrame) -> DataFrame:
    """(doc_id, level, yhat, score) of one forest with six outputs."""
    model = _state(spark, sf_dir, "joint", lambda: se.joint_forest(spark, _work(spark, sf_dir), JOINT_TREES))
    return se.predict_outputs(frame, model, LEVELS, _work(spark, sf_dir).value.bins, _dim(spark, sf_dir))


def _multilabel(spark, sf_dir) -> DataFrame:
    return _state(spark, sf_dir, "multi", lambda: reliable_checkpoint(
        _joint_forest(spark, sf_dir, _test(model_frame(spark, sf_dir)))))


@register("multilabel_rf_predict")
def multilabel_rf_predict(spark, sf_dir):
    return _multilabel(spark, sf_dir).select("doc_id", "level", "yhat")


@register("multilabel_proba_wide")
def multilabel_proba_wide(spark, sf_dir):
    return md.proba_wide(_multilabel(spark, sf_dir), LEVELS)


def _dim(spark, sf_dir) -> int:
    return len(feature_state(spark, sf_dir, MAX_FEATURES).names())


def _work(spark, sf_dir):
    """All training rows, as every search and its refits read them."""
    return _state(spark, sf_dir, "work", lambda: se.share_rows(
        _train(model_frame(spark, sf_dir)), LEVELS, _dim(spark, sf_dir), HALVING_SEED))


def _search_scores(spark, sf_dir) -> DataFrame:
    return _state(spark, sf_dir, "grid", lambda: se.scores_frame(spark, se.grid_search(
        spark, _work(spark, sf_dir), LEVELS, TUNE_GRIDS, N_FOLDS)))


def _halving_scores(spark, sf_dir) -> DataFrame:
    return _state(spark, sf_dir, "halving", lambda: se.scores_frame(spark, se.halving_search(
        spark, _work(spark, sf_dir), LEVELS, TUNE_GRIDS, N_FOLDS, HALVING_FACTOR)))


@register("search_grid")
def search_grid(spark, sf_dir):
    return _search_scores(spark, sf_dir).withColumn("f1", F.round("f1", 6))


@register("search_halving")
def search_halving(spark, sf_dir):
    return _halving_scores(spark, sf_dir).withColumn("f1", F.round("f1", 6))


@register("search_best_params")
def search_best_params(spark, sf_dir):
    """The winner of every level and model over the whole grids."""
    return se.best_params(_search_scores(spark, sf_dir))


def _winners(spark, sf_dir) -> str:
    """Folder of the halving search's winners, a model per level and kind, fitted again on all training rows."""
    def make() -> str:
        best = se.best_params(_halving_scores(spark, sf_dir)).collect()
        rows = se.refit(spark, _work(spark, sf_dir), [(r["level"], r["model"], json.loads(r["params"])) for r in best])
        path = scratch_path(spark, "models")
        se.save_models(spark, rows, path)
        return path

    return _state(spark, sf_dir, "winners", make)


def _both_sets(spark, sf_dir, models) -> DataFrame:
    """(dataset, doc_id, level, model, yhat, score) of ``models`` on both test sets, stored once."""
    bins, dim = _work(spark, sf_dir).value.bins, _dim(spark, sf_dir)
    parts = [se.predict_models(frame.withColumn("doc_id", F.col("doc_id").cast("string")), models, bins, dim).withColumn(
        "dataset", F.lit(name)) for name, frame in (
            ("test", _test(model_frame(spark, sf_dir))), ("second", second_frame(spark, sf_dir)))]
    return parts[0].unionByName(parts[1])


def _winner_predictions(spark, sf_dir) -> DataFrame:
    return _state(spark, sf_dir, "predictions", lambda: reliable_checkpoint(
        _both_sets(spark, sf_dir, se.load_models(spark, _winners(spark, sf_dir)))))


def _gold(spark, sf_dir) -> DataFrame:
    """(dataset, doc_id, level, y) of both test sets, from their label tables alone."""
    def long(frame, id_col, dataset):
        return frame.select(F.lit(dataset).alias("dataset"), F.col(id_col).cast("string").alias("doc_id"), *LEVELS).unpivot(
            ["dataset", "doc_id"], LEVELS, "level", "y").withColumn("y", F.col("y").cast("int"))

    return long(_test(model_frame(spark, sf_dir)), "doc_id", "test").unionByName(
        long(second_frame(spark, sf_dir), "doc_id", "second"))


def _sql_gold() -> str:
    """Rows and positive labels of both test sets by level, from the given tables."""
    return f"""{sql_split_r1()}, {views.sql_objectives()}, {views.sql_second()}, {views.sql_second_labels()},
gold AS (
  SELECT 'test' AS dataset, level, y FROM (
    SELECT {', '.join(f"CAST(coalesce(o.{ql(lv)}, 0) AS BIGINT) AS {ql(lv)}" for lv in LEVELS)}
    FROM v_objectives o JOIN split_r1 s ON s.doc_id = o.doc_id WHERE s.split = 'test')
  UNPIVOT (y FOR level IN ({', '.join(ql(lv) for lv in LEVELS)}))
  UNION ALL
  SELECT 'second', level, y FROM (SELECT {', '.join(ql(lv) for lv in LEVELS)} FROM v_second_labels)
  UNPIVOT (y FOR level IN ({', '.join(ql(lv) for lv in LEVELS)})))"""


@register(
    "score_two_sets",
    f"""WITH {_sql_gold()}
SELECT g.dataset, g.level, m.model, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_positive, CAST(0 AS BIGINT) AS n_unscored,
       TRUE AS confusion_adds_up, TRUE AS metrics_agree
FROM gold g CROSS JOIN (SELECT unnest({list(TUNE_GRIDS)}) AS model) m GROUP BY g.dataset, g.level, m.model""",
)
def score_two_sets(spark, sf_dir):
    """The winners of every kind on both test sets, predictions joined with gold by key: rows and positives as the
    gold tables have them, rows without a score, and whether the report's metrics follow from the confusion counts."""
    joined = ev.with_gold(_winner_predictions(spark, sf_dir), _gold(spark, sf_dir), ["dataset", "doc_id", "level"])
    bad = F.coalesce(~F.col("yhat").isin(0, 1), F.lit(True)) | F.col("score").isNull() | F.isnan("score")
    hit = (F.col("y") == 1) & (F.col("yhat") == 1)
    keys = ["dataset", "level", "model"]
    counted = joined.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("y").cast("long")).alias("n_positive"),
        F.count(F.when(bad, 1)).alias("n_unscored"), F.count(F.when(hit, 1)).alias("_tp"),
        F.sum(F.col("yhat").cast("long")).alias("_said"), F.count(F.when(F.col("y") == F.col("yhat"), 1)).alias("_same"))
    both = counted.join(ev.headline(joined, keys), keys)
    f1 = F.when(F.col("_tp") > 0, 2 * F.col("_tp") / (F.col("_said") + F.col("n_positive"))).otherwise(0.0)
    agree = (F.abs(F.col("accuracy") - F.col("_same") / F.col("n")) < 1e-5) & (F.abs(F.col("f1") - f1) < 1e-5)
    apart = (F.col("_said") - F.col("_tp")) + (F.col("n_positive") - F.col("_tp"))  # false of both kinds
    return both.select(*keys, "n", "n_positive", "n_unscored", (F.col("_same") + apart == F.col("n")).alias("confusion_adds_up"),
                       agree.alias("metrics_agree"))


@register("train_levels_report")
def train_levels_report(spark, sf_dir):
    """All levels × five models: halving search, refit, both test sets, metrics from predictions joined with gold by key."""
    preds = ev.with_gold(_winner_predictions(spark, sf_dir), _gold(spark, sf_dir), ["dataset", "doc_id", "level"])
    metrics = ev.headline(preds, ["dataset", "level", "model"])
    fitted = spark.read.parquet(_winners(spark, sf_dir)).select("level", "model", "params", "fit_seconds")
    return metrics.join(F.broadcast(fitted), ["level", "model"]).select(
        "dataset", "level", "model", F.col("params").alias("best_params"), "accuracy", "kappa", "auc", "f1",
        F.round("fit_seconds", 3).alias("fit_seconds"))


@register(
    "model_persist_roundtrip",
    f"""WITH {sql_split_r1()}
SELECT l.level, m.model, s.n AS n_rows, CAST(0 AS BIGINT) AS n_differ
FROM (SELECT count(*) AS n FROM split_r1 WHERE split = 'test') s
CROSS JOIN (SELECT unnest({LEVELS}) AS level) l CROSS JOIN (SELECT unnest({list(TUNE_GRIDS)}) AS model) m""",
)
def model_persist_roundtrip(spark, sf_dir):
    """The winner of every level and kind written to the shared folder, loaded, written and loaded again: rows of the test
    set, and those on which the loaded copies differ."""
    first = se.load_models(spark, _winners(spark, sf_dir))
    path = scratch_path(spark, "models-again")
    se.save_models(spark, [(lv, kind, se.params_key(m.params), 0.0, 0, m.to_bytes()) for lv, kind, m in first], path)
    again = _both_sets(spark, sf_dir, se.load_models(spark, path)).where("dataset = 'test'")
    kept = _winner_predictions(spark, sf_dir).where("dataset = 'test'")
    keys = ["doc_id", "level", "model"]
    both = kept.select(*keys, F.col("yhat").alias("a"), F.col("score").alias("sa")).join(
        again.select(*keys, F.col("yhat").alias("b"), F.col("score").alias("sb")), keys)
    return both.groupBy("level", "model").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(F.when((F.col("a") != F.col("b")) | (F.col("sa") != F.col("sb")), 1)).alias("n_differ"))


# Kinds whose fit minimizes a loss or an impurity, so that it cannot do worse on its rows than one class for all.
CERTIFIED = ["svm", "logreg", "rf", "gbt", "joint_rf"]


@register(
    "fit_certificates",
    f"""WITH {sql_split_r1()}, {views.sql_objectives()},
gold AS (
  SELECT level, y FROM (
    SELECT {', '.join(f"CAST(coalesce(o.{ql(lv)}, 0) AS BIGINT) AS {ql(lv)}" for lv in LEVELS)}
    FROM v_objectives o JOIN split_r1 s ON s.doc_id = o.doc_id WHERE s.split = 'train')
  UNPIVOT (y FOR level IN ({', '.join(ql(lv) for lv in LEVELS)})))
SELECT g.level, m.model, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_positive, CAST(0 AS BIGINT) AS n_unscored,
       TRUE AS no_worse_than_one_class
FROM gold g CROSS JOIN (SELECT unnest({CERTIFIED}) AS model) m GROUP BY g.level, m.model""",
)
def fit_certificates(spark, sf_dir):
    """Every kind and the joint forest on the training rows: rows and positives as the label tables have them, rows
    without a score, and whether at least as many rows are right as with the larger class for all."""
    train = _train(model_frame(spark, sf_dir))
    told = se.predict_models(train, [m for m in _default_models(spark, sf_dir) if m[1] in CERTIFIED],
                             _work(spark, sf_dir).value.bins, _dim(spark, sf_dir))
    joint = _joint_forest(spark, sf_dir, train).withColumn("model", F.lit("joint_rf"))
    gold = train.select("doc_id", *LEVELS).unpivot(["doc_id"], LEVELS, "level", "y")
    both = ev.with_gold(told.unionByName(joint), gold, ["doc_id", "level"])
    bad = F.coalesce(~F.col("yhat").isin(0, 1), F.lit(True)) | F.col("score").isNull() | F.isnan("score")
    counted = both.groupBy("level", "model").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("y").cast("long")).alias("n_positive"), F.count(F.when(bad, 1)).alias("n_unscored"),
        F.count(F.when(F.col("y") == F.col("yhat"), 1)).alias("_right"))
    larger = F.greatest("n_positive", F.col("n") - F.col("n_positive"))
    return counted.select("level", "model", "n", "n_positive", "n_unscored", (F.col("_right") >= larger).alias("no_worse_than_one_class"))


@register("labels_fit_report")
def labels_fit_report(spark, sf_dir):
    """Every kind fitted on the given labels (quality, toxic) of the training rows, with its metrics on the test rows."""
    names = ["quality", "toxic"]
    labels = read_table(spark, sf_dir, "labels").select("doc_id", *names)
    frame = reliable_checkpoint(model_frame(spark, sf_dir).select("doc_id", "split", "features").join(labels, "doc_id"))
    dim = _dim(spark, sf_dir)
    folds = {f"fold_{n}": F.lit(0) for n in names}
    work = se.share_rows(_train(frame).withColumns(folds), names, dim, HALVING_SEED)
    fitted = [(r[0], r[1], Model.from_bytes(r[5])) for r in se.refit(
        spark, work, [(lv, kind, p) for kind, p in DEFAULTS.items() for lv in names])]
    told = se.predict_models(_test(frame), fitted, work.value.bins, dim)
    gold = _test(frame).select("doc_id", *names).unpivot(["doc_id"], names, "level", "y")
    return ev.headline(ev.with_gold(told, gold, ["doc_id", "level"]), ["level", "model"])


def _nb_full_sql() -> str:
    return f"""{sql_feature_ctes()}, {_matrix_parts('documents', 'doc_id', sql_lex_match('documents'))}, {views.sql_objectives()},
lab AS (SELECT doc_id, level, y, split FROM (
  SELECT o.doc_id, s.split, {', '.join(f"CAST(coalesce(o.{ql(lv)}, 0) AS BIGINT) AS {ql(lv)}" for lv in LEVELS)}
  FROM v_objectives o JOIN split_r1 s ON s.doc_id = o.doc_id)
  UNPIVOT (y FOR level IN ({', '.join(ql(lv) for lv in LEVELS)}))),
names AS (
  SELECT 'uni_' || term AS feature FROM uni_vocab UNION ALL SELECT 'tfidf_' || term FROM uni_vocab
  UNION ALL SELECT 'bi_' || term FROM bi_vocab UNION ALL SELECT 'ari' UNION ALL SELECT category FROM lex_categories),
nc AS (SELECT level, y, CAST(count(*) AS DOUBLE) AS n FROM lab WHERE split = 'train' GROUP BY level, y),
nt AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM split_r1 WHERE split = 'train'),
eps AS (SELECT 1e-9 * max(k * v / n + k * (n - k) / (n * n) * a * a) AS eps FROM (
  SELECT feature, CAST(count(*) AS DOUBLE) AS k, avg(value) AS a, var_pop(value) AS v FROM m
  JOIN split_r1 s ON s.doc_id = m.doc_id WHERE s.split = 'train' GROUP BY feature), nt),
seen AS (SELECT l.level, l.y, m.feature, CAST(count(*) AS DOUBLE) AS k, avg(m.value) AS a, var_pop(m.value) AS v
  FROM m JOIN lab l ON l.doc_id = m.doc_id WHERE l.split = 'train' GROUP BY l.level, l.y, m.feature),
st AS (SELECT nc.level, nc.y, f.feature, coalesce(k, 0) * coalesce(a, 0) / n AS mean,
         coalesce(k, 0) * coalesce(v, 0) / n + coalesce(k, 0) * (n - coalesce(k, 0)) / (n * n) * coalesce(a, 0) * coalesce(a, 0)
         + (SELECT eps FROM eps) AS var
       FROM nc CROSS JOIN names f LEFT JOIN seen ON seen.level = nc.level AND seen.y = nc.y AND seen.feature = f.feature),
const AS (SELECT st.level, st.y, ln(max(nc.n) / (SELECT n FROM nt)) - 0.5 * sum(ln(2 * pi() * var)) - 0.5 * sum(mean * mean / var) AS c
          FROM st JOIN nc ON nc.level = st.level AND nc.y = st.y GROUP BY st.level, st.y),
jll AS (SELECT m.doc_id, st.level, st.y, max(const.c) + sum(m.value * st.mean / st.var - 0.5 * m.value * m.value / st.var) AS j
        FROM m JOIN split_r1 s ON s.doc_id = m.doc_id AND s.split = 'test' JOIN st ON st.feature = m.feature
        JOIN const ON const.level = st.level AND const.y = st.y GROUP BY m.doc_id, st.level, st.y)"""


@register(
    "nb_full_predict",
    f"""WITH {_nb_full_sql()}
SELECT doc_id, level, CAST(CASE WHEN max(CASE WHEN y = 1 THEN j END) > max(CASE WHEN y = 0 THEN j END) THEN 1 ELSE 0 END AS INTEGER) AS yhat
FROM jll GROUP BY doc_id, level""",
)
def nb_full_predict(spark, sf_dir):
    """Gaussian naive Bayes on the whole feature matrix, moments from vectors, posteriors in log space."""
    frame = model_frame(spark, sf_dir)
    models = [(lv, "nb", m) for lv, m in nb.fit_vectors(_train(frame), LEVELS).items()]
    told = se.predict_models(_test(frame), models, None, _dim(spark, sf_dir))  # naive Bayes reads no bins
    return told.select("doc_id", "level", "yhat")


@register(
    "batch_infer_model",
    f"""WITH {sql_split_r1()} SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_differ FROM split_r1 WHERE split = 'test'""",
)
def batch_infer_model(spark, sf_dir):
    """A fitted logistic regression written to the shared folder, scored by Arrow batches, against the JVM model's scores."""
    frame = model_frame(spark, sf_dir)
    fitted = md.fit_level(_train(frame), LEVELS[0], "logreg", LOGREG)
    path = scratch_path(spark, "linear-model")
    weights = [(-1, float(fitted.model.intercept)), *((i, float(w)) for i, w in enumerate(fitted.model.coefficients.toArray()))]
    spark.createDataFrame(weights, "pos int, weight double").write.parquet(path)
    own = md.predict_level(fitted, _test(frame)).select("doc_id", F.col("score").alias("jvm"))
    both = inf.score_vectors(_test(frame), path).join(own, "doc_id")
    return both.agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(F.abs(F.col("score") - F.col("jvm")) > 1e-9, 1)).alias("n_differ"))


@register("topk_coefficients")
def topk_coefficients(spark, sf_dir):
    """The 20 features with the largest absolute coefficients per level, for both linear kinds."""
    names = feature_state(spark, sf_dir, MAX_FEATURES).names()
    kinds = {"logreg": DEFAULTS["logreg"], "svm": {"C": 1.0, "gamma": "scale", "kernel": "linear"}}
    fitted = se.refit(spark, _work(spark, sf_dir), [(lv, kind, p) for kind, p in kinds.items() for lv in LEVELS])
    rows = [(f"{r[1]}/{r[0]}", n, abs(float(w))) for r in fitted
            for n, w in zip(names, Model.from_bytes(r[5]).arrays["w"], strict=False) if w]
    scores = spark.createDataFrame(rows, "level string, feature string, importance double")
    top = rk.top_k_per_group(scores, "level", TOP_FEATURES_PER_LEVEL)
    kind_level = F.split("level", "/")
    return top.select(kind_level[0].alias("model"), kind_level[1].alias("level"), "rank", "feature", "importance")
