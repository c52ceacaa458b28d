"""Post-processing of raw scores (M13, M14) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def threshold(p: Column, cut: float = 0.5) -> Column:
    """0 below the cut, 1 otherwise (the cut itself gives 1)."""
    return F.when(p < F.lit(cut), 0).otherwise(1).cast("int")


def sigmoid_threshold_array(arr: Column, cut: float = 0.5) -> Column:
    """Array form: per element sigmoid then threshold."""
    return F.transform(arr, lambda x: threshold(sigmoid(x), cut))


def argmax(arr: Column) -> Column:
    """0-based position of the largest value; the first one on ties."""
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")
