"""Batch inference with a caller-supplied scorer (M15) — the one deliberate Python path.

``batch_score`` runs ``mapInPandas``: Arrow batches of rows go to Python,
the scorer is built once per Python worker (cached by name), and returns one
score per row.  Nothing is bundled: the caller passes a factory, e.g. one
that loads an ONNX or pickled model from shared storage.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .blocks import Sparse

_WORKER_SCORERS: dict = {}


def batch_score(df: DataFrame, factory: Callable[[], Callable[[pd.DataFrame], np.ndarray]], name: str,
                id_col: str, input_cols: list[str], out_col: str = "score") -> DataFrame:
    """(id, score) for every row; ``factory()`` returns fn(batch pandas frame) → scores."""
    schema = f"{id_col} {dict(df.dtypes)[id_col]}, {out_col} double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = _WORKER_SCORERS.get(name)
        if scorer is None:
            scorer = _WORKER_SCORERS[name] = factory()
        for b in batches:
            yield pd.DataFrame({id_col: b[id_col], out_col: np.asarray(scorer(b[input_cols]), dtype="float64")})

    return df.select(id_col, *input_cols).mapInPandas(run, schema)


def linear_weights(path: str) -> tuple[np.ndarray, float]:
    """(weights, intercept) of a linear model stored as (pos, weight) rows, the intercept at position -1."""
    spark = SparkSession.getActiveSession()
    rows = spark.read.parquet(path).collect()  # a weight per feature
    weights = np.zeros(max(r["pos"] for r in rows) + 1)
    for r in rows:
        if r["pos"] >= 0:
            weights[r["pos"]] = r["weight"]
    return weights, next((r["weight"] for r in rows if r["pos"] < 0), 0.0)


def score_vectors(df: DataFrame, path: str, id_col: str = "doc_id", features_col: str = "features",
                  out_col: str = "score") -> DataFrame:
    """(id, score): the stored linear model on every row, one sparse product per Arrow batch."""
    weights, intercept = linear_weights(path)
    spark = df.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast((weights, intercept))
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = sent.value
        for batch in batches:
            x = Sparse.of_vectors(batch.column("_x"), len(w))
            row = np.repeat(np.arange(len(x)), np.diff(x.at))
            margin = np.bincount(row, weights=x.vals * w[x.cols], minlength=len(x)) + b
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(1.0 / (1.0 + np.exp(-margin)))], [id_col, out_col])

    return df.select(id_col, F.col(features_col).alias("_x")).mapInArrow(run, f"`{id_col}` {kind}, {out_col} double")


def keyword_scorer_factory(weights: dict[str, float], bias: float, text_col: str = "text"):
    """Toy scorer: logistic of weighted keyword counts (stands in for a loaded model)."""

    def factory():
        import regex

        from ..functions.text import WORD_TOKEN

        word = regex.compile(WORD_TOKEN)

        def score(frame: pd.DataFrame) -> np.ndarray:
            out = np.empty(len(frame))
            for i, t in enumerate(frame[text_col].fillna("").to_numpy()):
                z = bias
                for w in word.findall(t.lower()):
                    z += weights.get(w, 0.0)
                out[i] = 1.0 / (1.0 + np.exp(-z))
            return out

        return score

    return factory
