"""Cleaning and reshaping of labelled text tables (P1-P12, J1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def one_hot(df: DataFrame, col: str, mapping: dict[str, str], levels: list[str], drop: bool = True) -> DataFrame:
    """One 0.0/1.0 column per level: exact, case-sensitive match; unknown or null value → all zeros."""
    inverse: dict[str, list[str]] = {lv: [] for lv in levels}
    for value, lv in mapping.items():
        inverse[lv].append(value)
    c = F.col(col)
    out = df.select(
        "*",
        *[
            (F.when(c.isin(*vals), F.lit(1.0)).otherwise(F.lit(0.0)) if vals else F.lit(0.0)).alias(lv)
            for lv, vals in inverse.items()
        ],
    )
    return out.drop(col) if drop else out


def fill_labels(df: DataFrame, levels: list[str], value: float = 0.0) -> DataFrame:
    """A blank label means 0."""
    return df.na.fill(value, subset=levels)


def label_vector(df: DataFrame, levels: list[str], name: str = "label_vector") -> DataFrame:
    """Pack the (filled) label columns into one array<double> column."""
    return df.withColumn(name, F.array(*[F.coalesce(F.col(lv).cast("double"), F.lit(0.0)) for lv in levels]))


def n_labels(vector: str = "label_vector"):
    return F.aggregate(F.col(vector), F.lit(0.0), lambda acc, x: acc + x)


def unpivot_levels(df: DataFrame, id_cols: list[str], levels: list[str]) -> DataFrame:
    """(ids…, level, y long): one row per level, so one job serves all levels."""
    filled = df.select(*id_cols, *[F.coalesce(F.col(lv), F.lit(0.0)).cast("long").alias(lv) for lv in levels])
    return filled.unpivot(id_cols, levels, "level", "y")


def join_fill(left: DataFrame, right: DataFrame, key: str, fill: float = 0.0) -> DataFrame:
    """Keyed left join (never by row position), then missing numbers → 0.0."""
    joined = left.join(right, key, "left")
    numeric = [f.name for f in joined.schema.fields
               if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.LongType, T.IntegerType)) and f.name != key]
    return joined.na.fill(fill, subset=numeric)


def profile_shape(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(n_rows, n_cols, n_null_text) in one pass."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(df.columns)).cast("int").alias("n_cols"),
        F.count(F.when(F.col(text_col).isNull(), 1)).alias("n_null_text"),
    )
