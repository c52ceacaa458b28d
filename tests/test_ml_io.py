"""Search loops, persistence and streaming on tiny inputs."""

import pytest
from pyspark.ml.linalg import Vectors

from wordloom.operators import lexicon as lx
from wordloom.operators import models as md
from wordloom.operators import search as se
from wordloom.operators.fits import Model
from wordloom.session import scratch_path
from wordloom.sources import persist
from wordloom.streaming import lexicon_stream


def _frame(spark):
    rows = []
    for i in range(60):
        y = float(i % 2)
        rows.append((i, Vectors.dense([y + 0.1 * (i % 5), 1.0 - y, float(i % 3)]), y, (i // 3) % 3))
    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql import types as T

    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("features", VectorUDT()),
        T.StructField("a", T.DoubleType()), T.StructField("fold_a", T.IntegerType()),
    ])
    return spark.createDataFrame(rows, schema)


def test_estimator_mapping(spark):
    lr = md.make_estimator("logreg", {"C": 2.0, "penalty": "l1"}, 100, "a")
    assert lr.getRegParam() == 1.0 / 200 and lr.getElasticNetParam() == 1.0 and not lr.getStandardization()
    rf = md.make_estimator("rf", {"n_estimators": 5, "max_depth": None, "max_features": "auto"}, 10, "a")
    assert rf.getMaxDepth() == md.MAX_TREE_DEPTH and rf.getFeatureSubsetStrategy() == "sqrt"


def test_feature_set_round_trip(spark):
    feats = spark.createDataFrame(
        [(1, "train", "uni_a", 1.0), (2, "train", "uni_b", 2.0), (3, "test", "uni_a", 1.0)],
        "doc_id long, split string, feature string, value double")
    targets = spark.createDataFrame(
        [(1, "remember", "train", 1), (2, "remember", "train", 0), (3, "remember", "test", 1)],
        "doc_id long, level string, split string, y long")
    path = scratch_path(spark, "test-persist")
    persist.save_feature_set(feats, targets, path)
    got = sorted(map(tuple, persist.load_level(spark, path, "remember", "train").select("doc_id", "y", "feature").collect()))
    assert got == [(1, 1, "uni_a"), (2, 0, "uni_b")]
    summ = {(r.level, r.split): (r.n_rows, r.n_features) for r in persist.summary(spark, path).collect()}
    assert summ == {("remember", "train"): (2, 2), ("remember", "test"): (1, 1)}


def test_streaming_scores_equal_batch_scores(spark):
    lex = lx.Lexicon.builtin(spark)
    src = scratch_path(spark, "stream-src")
    docs = spark.createDataFrame(
        [(0, "the cat and the hat", "en", "s", 19), (1, "un erstes tion", "en", "s", 14)],
        lexicon_stream.DOCUMENT_SCHEMA)
    docs.write.parquet(src)
    sink, ck = scratch_path(spark, "stream-sink"), scratch_path(spark, "stream-ck")
    q = lexicon_stream.start_scoring(spark, src, "*.parquet", lex, sink, ck)
    q.awaitTermination()
    got = sorted(map(tuple, lexicon_stream.read_scores(spark, sink).collect()))
    want = sorted(map(tuple, lx.category_scores(docs.select("doc_id", "text"), lex).collect()))
    assert got == want and len(got) > 0


@pytest.mark.parametrize("parts", [0, 3])
def test_stream_reads_a_table_of_one_file_or_of_parts(spark, tmp_path, parts):
    lex = lx.Lexicon.builtin(spark)
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(["the cat and the hat", "un erstes tion", None, "the the"])]
    docs = spark.createDataFrame(rows, lexicon_stream.DOCUMENT_SCHEMA)
    if parts:
        docs.repartition(parts).write.parquet(f"{tmp_path}/documents.parquet")
    else:
        docs.toPandas().to_parquet(f"{tmp_path}/documents.parquet")
    docs.limit(1).write.parquet(f"{tmp_path}/other.parquet")
    sink = scratch_path(spark, "stream-sink")
    lexicon_stream.start_scoring(spark, str(tmp_path), "documents.parquet", lex, sink,
                                 scratch_path(spark, "stream-ck")).awaitTermination()
    got = sorted(map(tuple, lexicon_stream.read_scores(spark, sink).collect()))
    assert got == sorted(map(tuple, lx.category_scores(docs.select("doc_id", "text"), lex).collect())) and got


def test_reference_grids_expand_and_build_spark_estimators(spark):
    from wordloom.functions.constants import REFERENCE_GRIDS
    from wordloom.operators.models import make_estimator
    from wordloom.operators.search import expand_grid

    sizes = {k: len(expand_grid(g)) for k, g in REFERENCE_GRIDS.items()}
    assert sizes == {"nb": 3, "svm": 24, "logreg": 54, "rf": 324, "gbt": 24}
    first = expand_grid(REFERENCE_GRIDS["logreg"])[0]
    assert first == {"penalty": "l1", "C": 0.1, "solver": "saga", "tol": 0.01, "max_iter": 200}
    for kind in ("logreg", "rf", "svm"):
        for p in expand_grid(REFERENCE_GRIDS[kind]):
            make_estimator(kind, p, 1000, "remember")


def test_queries_search_every_reference_candidate_of_every_kind(spark, monkeypatch):
    from types import SimpleNamespace

    from wordloom.functions.constants import REFERENCE_GRIDS
    from wordloom.plans import q_ml

    monkeypatch.setattr(q_ml, "_FRAMES", {})
    monkeypatch.setattr(q_ml, "_work", lambda *_: SimpleNamespace(value=SimpleNamespace(sample=SimpleNamespace(x=range(800)))))
    asked = []

    def run_jobs(spark, work, jobs, run, schema):  # naive Bayes' last value is best
        out = []
        for j in jobs:
            for place, params in zip(j["places"], j["params"]):
                asked.append((j["kind"], j["level"], md.params_key(params), j["fold"]))
                out.append({"kind": j["kind"], "level": j["level"], "place": place, "fold": j["fold"],
                            "f1": 0.9 if params.get("var_smoothing") == 1e-10 else 0.1})
        return out

    monkeypatch.setattr(se, "_run_jobs", run_jobs)
    best = q_ml.search_best_params(spark, "none").collect()
    assert len(best) == 30  # a row per level and model
    assert {(r["params"], r["mean_f1"]) for r in best if r["model"] == "nb"} == {('{"var_smoothing":1e-10}', 0.9)}
    want = {(kind, lv, md.params_key(p), f) for kind, grid in REFERENCE_GRIDS.items()
            for p in md.distinct_candidates(kind, se.expand_grid(grid)) for lv in q_ml.LEVELS for f in range(3)}
    assert set(asked) == want and len(asked) == len(want) == (3 + 20 + 42 + 162 + 24) * 18
    rows = q_ml.search_halving(spark, "none").collect()
    assert {(r["model"], r["params"]) for r in rows if r["rung"] == 0} == {(k, p) for k, _, p, _ in want}
    assert {k: max(r["rung"] for r in rows if r["model"] == k) + 1 for k in REFERENCE_GRIDS} == {
        "nb": 2, "svm": 3, "logreg": 4, "rf": 4, "gbt": 3}


@pytest.mark.parametrize("kind", ["rbf", "poly"])
def test_kernel_features_read_stored_vectors_and_equal_the_map(spark, kind):
    import numpy as np
    from pyspark.ml.linalg import Vectors, VectorUDT
    from pyspark.sql import types as T

    from wordloom.operators.kernels import KernelMap

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("features", VectorUDT()),
                           T.StructField("_z", T.StringType())])
    rows = [(1, Vectors.sparse(5, [1, 3], [1.0, 2.0]), "x"), (2, Vectors.dense([1.0, 2, 3, 4, 5]), None),
            (3, Vectors.sparse(5, [], []), "y")]
    mapping = KernelMap(kind, 0.5, 5, components=16)
    out = md.kernel_features(spark.createDataFrame(rows, schema).drop("_z"), mapping)
    got = {r.doc_id: r.features.toArray() for r in out.collect()}
    for i, v, _ in rows:
        assert np.allclose(got[i], mapping(v.toArray()[None])[0])


def test_csv_round_trip_keeps_empty_and_missing_texts_apart(spark):
    from wordloom.sources import csv as csv_src

    rows = [(1, "", 1.0), (2, None, None), (3, 'a, "b"\n c ', 0.0), (4, "  x", 1.0), (5, "\\N", 1.0)]
    path = scratch_path(spark, "test-csv")
    csv_src.write_csv(spark.createDataFrame(rows, "doc_id long, text string, remember double"), path)
    assert sorted(map(tuple, csv_src.read_csv(spark, path, csv_src.objectives_schema(["remember"])).collect())) == rows


def test_naive_bayes_variance_of_close_values(spark):
    import statistics

    from wordloom.operators import naive_bayes as nb

    values = [1e6, 1e6 + 1e-6, 1e6 + 2e-6, 1e6]
    feats = spark.createDataFrame([(i, "f", v) for i, v in enumerate(values)] + [(10, "g", 2.0), (0, "g", 4.0)],
                                  "doc_id long, feature string, value double")
    targets = spark.createDataFrame([(i, "a", 1) for i in range(4)] + [(10, "a", 0), (11, "a", 0)],
                                    "doc_id long, level string, y int")
    model = nb.fit(feats, targets, ["f", "g"], var_smoothing=0.0)
    got = {(r.y, r.feature): (r["mean"], r["var"]) for r in model.stats.collect()}
    assert abs(got[1, "f"][1] - statistics.pvariance(values)) < 1e-15
    assert got[0, "g"] == (1.0, 1.0) and got[1, "g"] == (1.0, 3.0)


def test_search_without_rows_gives_no_score(spark):
    from wordloom.operators import blocks as bl

    fr = _frame(spark).filter("fold_a <> 1")
    work = se.share(spark, bl.labelled_sample(fr, ["a"], 3, 100, "s"))
    rows = se.grid_search(spark, work, ["a"], {"nb": [{"var_smoothing": 1e-9}]}, 3)
    assert sorted((r[4], r[5] is None) for r in rows) == [(0, False), (1, True), (2, False)]
    best = se.best_params(se.scores_frame(spark, rows)).first()
    assert best.mean_f1 is not None


def test_checkpoint_folder_is_asked_for_on_a_cluster():
    from types import SimpleNamespace

    from wordloom.session import ensure_checkpoint_dir

    conf = SimpleNamespace(get=lambda key, default=None: default)
    for master in ("yarn", "local-cluster[2,1,1024]"):
        sc = SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: conf, master=master)
        with pytest.raises(RuntimeError):
            ensure_checkpoint_dir(SimpleNamespace(sparkContext=sc, conf=conf))


def test_unknown_parameters_are_an_error():
    with pytest.raises(ValueError):
        md.make_estimator("logreg", {"C": 1.0, "gama": 2}, 10, "a")


def test_search_kinds_fit_what_they_name(spark):
    """A ring is no halfplane: the rbf candidate separates it, the linear one does not; naive Bayes does too."""
    import math

    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql import types as T

    from wordloom.operators import blocks as bl

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("features", VectorUDT()),
                           T.StructField("a", T.DoubleType()), T.StructField("fold_a", T.IntegerType())])
    rows = []
    for i in range(90):
        r, t = (0.3, i * 0.7) if i % 2 else (2.0, i * 0.7)
        rows.append((i, Vectors.dense([r * math.cos(t), r * math.sin(t)]), float(i % 2), i % 3))
    fr = spark.createDataFrame(rows, schema)
    work = se.share(spark, bl.labelled_sample(fr, ["a"], 2, 100, "s"))
    grid = [{"C": 10.0, "kernel": "linear", "gamma": "scale"}, {"C": 10.0, "kernel": "rbf", "gamma": "scale"}]
    scores = {}
    for _, kind, params, _, _, f1 in se.grid_search(spark, work, ["a"], {"svm": grid}, 3):
        scores.setdefault("rbf" in params, []).append(f1)
    assert min(scores[True]) > 0.95 > max(scores[False])
    best = se.refit(spark, work, [("a", "nb", {"var_smoothing": 1e-9})])
    model = [(r[0], r[1], Model.from_bytes(r[5])) for r in best]
    out = {r["doc_id"]: r["yhat"] for r in se.predict_models(fr, model, work.value.bins, 2).collect()}
    assert sum(out[i] == i % 2 for i in range(90)) >= 85


def test_predictions_meet_gold_by_key(spark):
    from wordloom.operators import evaluate as ev

    preds = spark.createDataFrame([(1, "a", 1, 0), (2, "a", 0, 0), (3, "a", 1, 0)], "doc_id long, level string, yhat int, y int")
    gold = spark.createDataFrame([(2, "a", 0), (1, "a", 1), (9, "a", 1)], "doc_id long, level string, y int")
    got = ev.with_gold(preds, gold, ["doc_id", "level"])
    assert sorted((r.doc_id, r.yhat, r.y) for r in got.collect()) == [(1, 1, 1), (2, 0, 0)]
