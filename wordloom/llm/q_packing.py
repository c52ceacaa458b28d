"""Query of packing: all ``documents`` into windows of 2,048 tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import register, table
from .packing import pack

TOKENIZER = "word_bpe_49k.json"
END_ID = 1


@register("op11_packing")
def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), END_ID)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
