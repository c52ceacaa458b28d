"""Query of embedding near-dedup: all of ``embeddings`` at a cosine of 0.95."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import register, table
from .neardup_graph import near_duplicates

WITHIN = 0.95


@register("op10_embedding_neardup")
def op10_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"), WITHIN)
