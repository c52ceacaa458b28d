"""Delimited text in and out (S1-S3, S5) with explicit schemas.

Reading: comma, ``"`` quotes and escapes, header row, blanks after the
delimiter skipped, quoted fields may span lines.  Writing quotes every field
and keeps leading/trailing blanks, so a round trip returns the same text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


# A missing value in the file; an empty text is an empty field, so the two come back apart.
NULL_MARK = "\u001fnull\u001f"
# Multi-line files are read by one task each, so their size is bounded when they are written.
MAX_RECORDS_PER_FILE = 100_000


def objectives_schema(levels: list[str], id_col: str = "doc_id", text_col: str = "text") -> T.StructType:
    return T.StructType(
        [T.StructField(id_col, T.LongType()), T.StructField(text_col, T.StringType())]
        + [T.StructField(lv, T.DoubleType()) for lv in levels]
    )


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("sep", ",")
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", False)
        .option("multiLine", True)
        .option("nullValue", NULL_MARK)
        .option("emptyValue", "")
        .option("mode", "FAILFAST")
        .csv(path)
    )


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    (
        df.write.mode(mode)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("quoteAll", True)
        .option("nullValue", NULL_MARK)
        .option("emptyValue", "")
        .option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def head(df: DataFrame, key: str, n: int) -> DataFrame:
    """First n rows in an explicit key order (a top-n, never a full sort)."""
    return df.orderBy(key).limit(n)
