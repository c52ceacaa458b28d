"""Lexicon scoring over a stream of new text files (Structured Streaming).

Each text is scored on its own, so a micro-batch needs no state: the stream
runs the batch plan of ``operators.lexicon.category_scores`` inside
``foreachBatch``.  Every batch is written to its own ``epoch=<id>`` folder
with mode overwrite, so a batch replayed after a failure replaces its own
output (exactly-once results with an at-least-once sink).  The checkpoint
location must be on shared storage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import lexicon as lx

DOCUMENT_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def start_scoring(spark: SparkSession, source_dir: str, file_glob: str, lex: lx.Lexicon, sink_path: str,
                  checkpoint_path: str, available_now: bool = True, max_files_per_trigger: int | None = None):
    """Start the streaming query; returns the ``StreamingQuery``.

    ``file_glob`` names files of ``source_dir`` or folders of part files: a table may be either.  The braces make any
    name a pattern, and Spark takes no single file as the base path of a pattern's files.
    """
    reader = spark.readStream.schema(DOCUMENT_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(f"{source_dir.rstrip('/')}/{{{file_glob}}}")

    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        scores = lx.category_scores(batch.select("doc_id", "text"), lex)
        scores.write.mode("overwrite").parquet(f"{sink_path}/epoch={epoch_id}")

    writer = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint_path)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def read_scores(spark: SparkSession, sink_path: str) -> DataFrame:
    return spark.read.parquet(sink_path).select("doc_id", "category", "score")
