"""Spark ML classifiers per level (M2-M8, M12, M16) and one fixed feature frame for all of them.

The frame ``(id, split, features, label…)`` is built once and checkpointed to
the shared checkpoint folder: the iterative fits then read a short lineage
that survives executor loss.  Every level is a different ``labelCol`` of the
same frame, so no per-level copy of the data exists.

Parameter names follow the reference's grids; the mapping is:
  C → regParam = 1 / (C · n) (sums versus means of the loss), standardization off;
  penalty l1/l2/none → elasticNetParam 1/0 and regParam 0 for none;
  n_estimators → numTrees; max_depth None → 30 (Spark's limit).
Boosting, kernel candidates and all searches are fitted by ``fits``, on all training rows too.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .blocks import Sparse
from .kernels import KernelMap

MAX_TREE_DEPTH = 30


_SVM_PARAMS = {"C", "gamma", "kernel", "max_iter", "tol"}
KNOWN_PARAMS = {
    "svm": _SVM_PARAMS, "svm_rbf": _SVM_PARAMS, "svm_poly": _SVM_PARAMS,
    "logreg": {"penalty", "C", "solver", "tol", "max_iter"},
    "rf": {"n_estimators", "max_depth", "max_features", "min_samples_split", "min_samples_leaf", "bootstrap"},
    "gbt": {"gamma", "learning_rate", "max_depth", "n_estimators"},
    "nb": {"var_smoothing"},
}
KERNEL_KINDS = {"linear": "svm", "rbf": "svm_rbf", "poly": "svm_poly"}


def kind_of(kind: str, params: dict) -> str:
    """The kind that a parameter map asks for: the SVM's kernel names a feature map."""
    return KERNEL_KINDS[params["kernel"]] if kind == "svm" and "kernel" in params else kind


def effective(kind: str, params: dict) -> tuple:
    """What of a candidate the fits tell apart; equal tuples fit equal models."""
    kind = kind_of(kind, params)
    p = dict(params)
    c = float(p.get("C", 1.0))
    if kind == "logreg":
        reg = None if p.get("penalty", "l2") in (None, "none") else (p.get("penalty", "l2"), c)
        return kind, reg, float(p.get("tol", 1e-6)), int(p.get("max_iter", 100))
    if kind == "rf":
        depth = p.get("max_depth")
        return (kind, int(p.get("n_estimators", 100)), MAX_TREE_DEPTH if depth is None else int(depth),
                str(p.get("max_features", "sqrt")).replace("auto", "sqrt"), int(p.get("min_samples_split", 2)),
                int(p.get("min_samples_leaf", 1)), bool(p.get("bootstrap", True)))
    if kind in ("svm_rbf", "svm_poly"):  # gamma scales both kernels
        return kind, c, p.get("gamma", "scale"), int(p.get("max_iter", 100))
    if kind == "svm":
        return kind, c, int(p.get("max_iter", 100))
    return (kind, *sorted(p.items()))


def distinct_candidates(kind: str, grid: list[dict]) -> list[dict]:
    """``grid`` without candidates that fit the same model as an earlier one."""
    first: dict[tuple, dict] = {}
    for p in grid:
        first.setdefault(effective(kind, p), p)
    return list(first.values())


def params_key(params: dict) -> str:
    """Stable text form of a parameter map (the ``params`` column of search tables)."""
    return json.dumps(params, sort_keys=True, separators=(",", ":"))


def make_estimator(kind: str, params: dict, n_train: int, label_col: str, features_col: str = "features",
                   seed: int = 666):
    from pyspark.ml.classification import (
        LinearSVC,
        LogisticRegression,
        RandomForestClassifier,
    )

    p = dict(params)
    if kind in KNOWN_PARAMS and (unknown := set(p) - KNOWN_PARAMS[kind]):
        raise ValueError(f"unknown parameters of {kind}: {sorted(unknown)}")
    if kind == "svm":
        c = float(p.get("C", 1.0))
        return LinearSVC(
            featuresCol=features_col, labelCol=label_col, regParam=1.0 / (c * max(n_train, 1)),
            maxIter=int(p.get("max_iter", 100)), tol=float(p.get("tol", 1e-6)), standardization=False,
        )
    if kind == "logreg":
        penalty = p.get("penalty", "l2")
        c = float(p.get("C", 1.0))
        reg = 0.0 if penalty in (None, "none") else 1.0 / (c * max(n_train, 1))
        return LogisticRegression(
            featuresCol=features_col, labelCol=label_col, regParam=reg,
            elasticNetParam=1.0 if penalty == "l1" else 0.0, maxIter=int(p.get("max_iter", 100)),
            tol=float(p.get("tol", 1e-6)), standardization=False, family="binomial",
        )
    if kind == "rf":
        depth = p.get("max_depth")
        return RandomForestClassifier(
            featuresCol=features_col, labelCol=label_col, numTrees=int(p.get("n_estimators", 100)),
            maxDepth=MAX_TREE_DEPTH if depth is None else int(depth),
            featureSubsetStrategy=str(p.get("max_features", "sqrt")).replace("auto", "sqrt"),
            minInstancesPerNode=int(p.get("min_samples_leaf", 1)), bootstrap=bool(p.get("bootstrap", True)),
            seed=seed,
        )
    raise ValueError(f"unknown model kind {kind!r}")


def positive_score(kind: str):
    """Column with the positive-class score of a fitted model's output."""
    from pyspark.ml.functions import vector_to_array

    if kind == "svm":
        return vector_to_array(F.col("rawPrediction"))[1]
    return vector_to_array(F.col("probability"))[1]


@dataclass
class FittedLevel:
    level: str
    kind: str
    params: dict
    model: object
    fit_seconds: float


def fit_level(frame: DataFrame, level: str, kind: str, params: dict, n_train: int | None = None,
              features_col: str = "features") -> FittedLevel:
    """Fit one level on ``frame`` (rows already restricted to training rows)."""
    n = frame.count() if n_train is None else n_train
    t0 = time.time()
    model = make_estimator(kind, params, n, level, features_col).fit(frame)
    return FittedLevel(level, kind, params, model, time.time() - t0)


def predict_level(fitted: FittedLevel, frame: DataFrame, id_col: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """(id, keep…, level, y?, yhat, score) for one fitted level."""
    out = fitted.model.transform(frame)
    cols = [F.col(id_col), *[F.col(k) for k in (keep or [])], F.lit(fitted.level).alias("level")]
    if fitted.level in frame.columns:
        cols.append(F.col(fitted.level).cast("int").alias("y"))
    cols += [F.col("prediction").cast("int").alias("yhat"), positive_score(fitted.kind).alias("score")]
    return out.select(*cols)


# ------------------------------------------------------------ kernels

def kernel_features(frame: DataFrame, mapping: KernelMap, id_col: str = "doc_id", input_col: str = "features",
                    output_col: str = "features") -> DataFrame:
    """``frame`` with the kernel map of its vectors, in one narrow pass over Arrow batches.

    Vectors cross Arrow in their stored form; a slice of rows at a time is mapped by matrix products.
    """
    from pyspark.ml.functions import array_to_vector

    ship(frame.sparkSession)
    others = [c for c in frame.columns if c != input_col]
    schema = T.StructType([frame.schema[c] for c in others] + [T.StructField("_z", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, x in Sparse.of_vectors(batch.column(input_col), mapping.dim).slices():
                z = mapping(x)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(z.ravel()), z.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(start, len(x)) for c in others), lists], [*others, "_z"])

    out = frame.select(*others, input_col).mapInArrow(run, schema)
    return out.withColumn(output_col, array_to_vector("_z")).drop("_z")


def scale_gamma(frame: DataFrame, input_col: str = "features") -> float:
    """gamma='scale': 1 / (n_features · variance of all entries), from one Summarizer pass."""
    from pyspark.ml.stat import Summarizer

    r = frame.select(Summarizer.metrics("mean", "variance", "count").summary(F.col(input_col)).alias("s")).first()["s"]
    mean = np.asarray(r["mean"].toArray())
    var = np.asarray(r["variance"].toArray())
    n = float(r["count"])
    ex2 = (var * (n - 1) / n + mean**2).mean() if n > 1 else 0.0
    total_var = ex2 - mean.mean() ** 2
    d = len(mean)
    return 1.0 / (d * total_var) if total_var > 0 else 1.0 / max(d, 1)


def proba_wide(preds: DataFrame, levels: list[str], id_col: str = "doc_id") -> DataFrame:
    """(id, p_<level>…) from long per-level scores; explicit pivot values."""
    wide = preds.groupBy(id_col).pivot("level", levels).agg(F.first("score"))
    return wide.select(id_col, *[F.round(F.col(lv), 6).alias(f"p_{lv}") for lv in levels])
