"""Query of language identification: learned on three quarters of ``documents``, predicted for all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import register, table
from .langid import identify, learn


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


@register("op6_language_id")
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    filters = learn(docs.where(~held_out()))
    out = identify(docs.select("doc_id", held_out().alias("held_out"), "text"), filters)
    return out.select("doc_id", "held_out", "lang_pred", "score", "coverage")
