"""Feature-set persistence (S6): features once by split, targets by level and split.

The reference pickles x/y per level and part; here the feature rows are
written once (they do not depend on the level) partitioned by ``split`` and
the targets partitioned by ``level`` and ``split``; loading one (level,
split) is a partition-pruned read of both plus a join on the row id.  The names of
the features in vector order and the features of a second table stand beside them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_feature_set(features: DataFrame, targets: DataFrame, path: str, names: DataFrame | None = None,
                     second: DataFrame | None = None, splits: tuple[str, ...] | None = None) -> None:
    """features (id, split, feature, value, …); targets (id, level, split, y); names (pos, feature);
    second (id, feature, value, …) of another table.

    Where ``splits`` names all values of ``split``, the features of each are written by themselves: the filter reaches
    the input, so every row is made once, and the many feature rows need no sort by split before they are written."""
    if names is not None:
        names.write.mode("overwrite").parquet(f"{path}/names")
    if second is not None:
        second.write.mode("overwrite").parquet(f"{path}/second")
    if splits is None:
        features.write.mode("overwrite").partitionBy("split").parquet(f"{path}/features")
    else:
        for v in splits:
            features.where(F.col("split") == v).drop("split").write.mode("overwrite").parquet(f"{path}/features/split={v}")
    targets.write.mode("overwrite").partitionBy("level", "split").parquet(f"{path}/targets")


def load_targets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/targets")


def load_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/features")


def load_names(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/names")


def load_second(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/second")


def load_level(spark: SparkSession, path: str, level: str, split: str, id_col: str = "doc_id") -> DataFrame:
    """(id, y, feature, value) of one level and split; both reads prune to one partition."""
    t = load_targets(spark, path).filter((F.col("level") == level) & (F.col("split") == split))
    f = load_features(spark, path).filter(F.col("split") == split).drop("split")
    return t.select(id_col, "y").join(f, id_col)


def summary(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """(level, split, n_rows, n_features) from the stored tables."""
    t = load_targets(spark, path)
    f = load_features(spark, path)
    rows = t.groupBy("level", "split").agg(F.countDistinct(id_col).alias("n_rows"))
    feats = f.join(t.select(id_col, "level", "split"), [id_col, "split"]).groupBy("level", "split").agg(
        F.countDistinct("feature").alias("n_features")
    )
    return rows.join(feats, ["level", "split"], "left").select(
        "level", "split", "n_rows", F.coalesce(F.col("n_features"), F.lit(0)).cast("long").alias("n_features")
    )
