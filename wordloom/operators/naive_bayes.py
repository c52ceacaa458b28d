"""Gaussian naive Bayes as relational aggregates (M1).

Fit: per (level, y, feature) count k, mean m and population variance v of the *non-zero* entries
of a long feature table, plus the class sizes; zeros enter only through the counts, so
sparse features cost nothing: mean = m k / n and var = k v / n + k (n − k) m² / n² + ε, which
has no difference of large numbers, with
ε = var_smoothing × the largest feature variance over all training rows.

Predict: joint log-likelihood = log prior − ½ Σ_f log(2π var) − ½ Σ_f mean²/var
(a constant per class) + Σ over the row's non-zero features of
−½ [(x − mean)² − mean²] / var; the class with the larger value wins, the
first class on ties.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import ROUND_DIGITS


@dataclass
class GaussianNBModel:
    stats: DataFrame  # level, y, feature, mean, var
    consts: DataFrame  # level, y, const
    epsilon: float


def _moments() -> list[Column]:
    """Count, mean and population variance of the non-zero entries."""
    return [F.count("value").alias("k"), F.avg("value").alias("m"), F.var_pop("value").alias("v")]


def _with_zeros(n: Column) -> tuple[Column, Column]:
    """Mean and variance of ``n`` rows of which ``k`` have mean ``m`` and variance ``v``, the others 0."""
    k, m, v = (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("k", "m", "v"))
    return m * k / n, k * v / n + k * (n - k) / (n * n) * m * m


def fit(features: DataFrame, targets: DataFrame, feature_names: list[str], id_col: str = "doc_id",
        var_smoothing: float = 1e-9) -> GaussianNBModel:
    """``features`` (id, feature, value) non-zero entries; ``targets`` (id, level, y) training rows."""
    tgt = targets.select(id_col, "level", "y")
    ids = tgt.select(id_col).distinct()
    feats = features.join(ids, id_col, "left_semi")
    # ε from the variance of every feature over all training rows (zeros included)
    n_all = ids.count()
    fstats = feats.groupBy("feature").agg(*_moments())
    max_var = fstats.agg(F.max(_with_zeros(F.lit(float(n_all)))[1])).first()[0] or 0.0
    eps = var_smoothing * max_var

    sizes = tgt.groupBy("level", "y").agg(F.count(F.lit(1)).alias("n_c"))
    sums = feats.join(tgt, id_col).groupBy("level", "y", "feature").agg(*_moments())
    # (level, y) × feature grid without a join: the feature names are a literal array
    grid = sizes.withColumn("feature", F.explode(F.array(*[F.lit(f) for f in feature_names])))
    mean, var = _with_zeros(F.col("n_c").cast("double"))
    stats = grid.join(sums, ["level", "y", "feature"], "left").select(
        "level", "y", "feature", "n_c", mean.alias("mean"), (var + F.lit(eps)).alias("var"),
    ).cache()
    totals = sizes.groupBy("level").agg(F.sum("n_c").alias("n_l"))
    consts = stats.groupBy("level", "y", "n_c").agg(
        F.sum(F.log(F.lit(2.0 * math.pi) * F.col("var"))).alias("_lv"),
        F.sum(F.col("mean") * F.col("mean") / F.col("var")).alias("_mm"),
    ).join(totals, "level").select(
        "level", "y",
        (F.log(F.col("n_c") / F.col("n_l")) - F.lit(0.5) * F.col("_lv") - F.lit(0.5) * F.col("_mm")).alias("const"),
    ).cache()
    return GaussianNBModel(stats=stats.drop("n_c"), consts=consts, epsilon=eps)


def stats_table(model: GaussianNBModel, digits: int | None = ROUND_DIGITS) -> DataFrame:
    r = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    return model.stats.select("level", "y", "feature", r(F.col("mean")).alias("mean"), r(F.col("var")).alias("var"))


def predict(model: GaussianNBModel, features: DataFrame, rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, level, yhat) for every (id, level) of ``rows``; ``features`` holds non-zero entries only."""
    st = F.broadcast(model.stats)  # levels × classes × features rows
    corr = features.join(st, "feature").groupBy(id_col, "level", "y").agg(
        F.sum(
            F.lit(-0.5) * ((F.col("value") - F.col("mean")) * (F.col("value") - F.col("mean"))
                           - F.col("mean") * F.col("mean")) / F.col("var")
        ).alias("_corr")
    )
    base = rows.select(id_col, "level").join(F.broadcast(model.consts), "level")
    jll = base.join(corr, [id_col, "level", "y"], "left").select(
        id_col, "level", "y", (F.col("const") + F.coalesce(F.col("_corr"), F.lit(0.0))).alias("jll")
    )
    best = jll.groupBy(id_col, "level").agg(
        F.max(F.when(F.col("y") == 0, F.col("jll"))).alias("_j0"),
        F.max(F.when(F.col("y") == 1, F.col("jll"))).alias("_j1"),
    )
    return best.select(
        id_col, "level",
        F.when(F.col("_j1") > F.coalesce(F.col("_j0"), F.lit(float("-inf"))), 1).otherwise(0).cast("int").alias("yhat"),
    )


def fit_vectors(frame: DataFrame, levels: list[str], features_col: str = "features", var_smoothing: float = 1e-9) -> dict:
    """{level: Model} of Gaussian naive Bayes on whole feature vectors, zeros included.

    Moments of every (level, class) come from one aggregate of ``Summarizer`` over the vectors as they are stored: partial sums per
    partition, a row of moments per (level, class) to the driver.  ε = var_smoothing × the largest feature variance over all rows.
    """
    import numpy as np
    from pyspark.ml.stat import Summarizer

    from .fits import Model

    moments = Summarizer.metrics("mean", "variance", "count").summary(F.col(features_col)).alias("m")

    def parts(row) -> tuple[int, np.ndarray, np.ndarray]:
        n = int(row["count"])
        # the summarizer divides by n - 1
        return n, row["mean"].toArray(), row["variance"].toArray() * ((n - 1) / n if n else 0.0)

    long = frame.unpivot([features_col], levels, "level", "y")
    found = {(r["level"], int(r["y"])): parts(r["m"]) for r in long.groupBy("level", "y").agg(moments).collect()}
    _, _, all_var = parts(frame.select(moments).first()["m"])
    epsilon = var_smoothing * (float(all_var.max()) or 1.0)
    out = {}
    for lv in levels:
        empty = (0, np.zeros(len(all_var)), np.zeros(len(all_var)))
        n, mean, var = zip(*(found.get((lv, k), empty) for k in (0, 1)))
        out[lv] = Model("nb", {"var_smoothing": var_smoothing}, {
            "prior": np.array(n) / max(sum(n), 1), "mean": np.array(mean), "var": np.array(var) + epsilon})
    return out
