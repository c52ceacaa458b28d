"""Query of byte-level BPE: every text of ``documents`` encoded and decoded."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Vocabulary, encode_and_decode, ids_digest
from .common import register, table

VOCABULARY = "byte_bpe_50k.tiktoken"


@register("op2_byte_bpe")
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = Vocabulary.read(public_tokenizers.path(VOCABULARY))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = encode_and_decode(docs, vocab)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids_digest().alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))
