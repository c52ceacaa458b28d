"""Query of token counts: every text of ``documents``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .common import register, table
from .transducer import WordBpe, count_tokens

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048


@register("op5_token_counts")
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    bpe = WordBpe.read(public_tokenizers.path(TOKENIZER))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = count_tokens(docs, bpe).drop("text")
    return counted.withColumn("over_limit", counted["n_tokens"] > LIMIT)
