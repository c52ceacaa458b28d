"""Distribution summaries (A1-A5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import ROUND_DIGITS


def label_counts(long_labels: DataFrame, group: list[str], y: str = "y") -> DataFrame:
    """Class counts per group (level, split …) on the unpivoted labels."""
    return long_labels.groupBy(*group, y).agg(F.count(F.lit(1)).alias("n"))


def label_cardinality(df: DataFrame, n_labels: Column) -> DataFrame:
    """Histogram of the number of labels per row."""
    return df.select(n_labels.cast("int").alias("n_labels")).groupBy("n_labels").agg(
        F.count(F.lit(1)).alias("n_docs")
    )


def length_profile(lengths: DataFrame, col: str, digits: int | None = ROUND_DIGITS) -> DataFrame:
    """min, max, mean and the exact 99.5th percentile (linear interpolation).

    ``percentile`` keeps a value → frequency map, and lengths are integers
    with few distinct values, so its buffer stays small at any row count.
    """
    c = F.col(col)
    mean, p = F.avg(c.cast("double")), F.percentile(c, F.lit(0.995))
    if digits is not None:
        mean, p = F.round(mean, digits), F.round(p, digits)
    return lengths.agg(
        F.min(c).cast("long").alias("min_len"),
        F.max(c).cast("long").alias("max_len"),
        mean.alias("mean_len"),
        p.alias("p995"),
    )


def multi_predicted(pred: DataFrame, id_cols: list[str], yhat: str = "yhat") -> DataFrame:
    """Number of rows predicted with more than one label."""
    per = pred.groupBy(*id_cols).agg(F.sum(F.col(yhat)).alias("_k"))
    return per.agg(F.count(F.when(F.col("_k") > 1, 1)).alias("n_multi"))
