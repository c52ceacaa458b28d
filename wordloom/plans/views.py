"""Input views over the driver's tables, defined once for Spark and once as SQL CTEs.

``v_objectives``  documents + six labels: 1.0 if the word tokens of the text
                  contain the level's token, else null.
``v_bank``        events as a question bank: item_id, objective.
``v_second``      conversations as the second test set: item_id = ``conv_id:turn``, text.
``v_gold``        labels unpivoted to (doc_id, level, y).
``v_pred``        rule predictions per (doc_id, level) over the *whole* text:
                  k = word tokens that start with the level's token and are
                  longer than it; yhat = k > 0; score = k / (k + 1).
``v_logits``      embeddings: all elements as doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import LEVEL_TOKENS, LEVELS
from ..functions.text import WORD_TOKEN, explode_rows, word_tokens
from ..session import read_table


def count_longer_with_prefix(tokens: Column, tok: str) -> Column:
    """Number of word tokens that start with ``tok`` and are longer than it."""
    return F.size(F.filter(tokens, lambda t: t.startswith(tok) & (t != F.lit(tok))))


def _word_tokens(text_col: str) -> Column:
    # one regex pass per text; every level test below is an array operation on its result
    return word_tokens(F.col(text_col))


def with_level_labels(df: DataFrame, text_col: str = "text", tokens: str | None = None) -> DataFrame:
    """Add the six level labels: 1.0 if the text's word tokens contain the level token, else null.

    ``tokens``: a column that has the text's word tokens already.
    """
    toks = tokens or "_lvl_toks"
    out = df if tokens else df.withColumn(toks, _word_tokens(text_col))
    return out.select(
        *[F.col(c) for c in df.columns],
        *[F.when(F.array_contains(toks, LEVEL_TOKENS[lv]), F.lit(1.0)).alias(lv) for lv in LEVELS],
    )


def objectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_level_labels(docs)


def bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    return ev.select(F.col("event_id").alias("item_id"), F.col("event_type").alias("objective"))


def second_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = read_table(spark, sf_dir, "conversations")
    return conv.select(F.concat_ws(":", "conv_id", "turn").alias("item_id"), "text")


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = read_table(spark, sf_dir, "labels")
    return lab.unpivot("doc_id", ["quality", "toxic"], "level", "y")


def pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", _word_tokens("text").alias("_toks"))
    toks = F.col("_toks")
    cols = []
    for lv in LEVELS:
        tok = LEVEL_TOKENS[lv]
        cols.append(
            F.struct(
                F.lit(lv).alias("level"),
                F.when(F.array_contains(toks, tok), 1).otherwise(0).alias("y"),
                count_longer_with_prefix(toks, tok).alias("k"),
            )
        )
    rows = explode_rows(docs, ["doc_id"], F.array(*cols), "r").select("doc_id", "r.*")
    return rows.select(
        "doc_id",
        "level",
        F.col("y").cast("int").alias("y"),
        F.when(F.col("k") > 0, 1).otherwise(0).cast("int").alias("yhat"),
        (F.col("k") / (F.col("k") + F.lit(1.0))).alias("score"),
        F.lit("test").alias("dataset"),
    )


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = read_table(spark, sf_dir, "embeddings")
    return emb.select(
        "vec_id",
        F.transform("embedding", lambda x: x.cast("double")).alias("logits"),
    )


# ----------------------------------------------------------------- SQL side

_SQL_TOK = "regexp_extract_all(lower(coalesce(text, '')), '" + WORD_TOKEN + "')"


def sql_objectives() -> str:
    labels = ",\n    ".join(
        f"CASE WHEN list_contains(toks, '{LEVEL_TOKENS[lv]}') THEN CAST(1.0 AS DOUBLE) END AS {lv}" for lv in LEVELS
    )
    return f"""v_objectives AS (
  SELECT doc_id, text,
    {labels}
  FROM (SELECT doc_id, text, {_SQL_TOK} AS toks FROM documents)
)"""


def sql_bank() -> str:
    return "v_bank AS (SELECT event_id AS item_id, event_type AS objective FROM events)"


def sql_second() -> str:
    return "v_second AS (SELECT conv_id || ':' || turn AS item_id, text FROM conversations)"


def sql_second_labels() -> str:
    """The level labels of ``v_second``, 0 or 1."""
    labels = ", ".join(f"CAST(coalesce(list_contains(toks, '{LEVEL_TOKENS[lv]}'), FALSE) AS BIGINT) AS {lv}" for lv in LEVELS)
    return f"v_second_labels AS (SELECT item_id, {labels} FROM (SELECT item_id, {_SQL_TOK} AS toks FROM v_second))"


def sql_gold() -> str:
    return """v_gold AS (
  SELECT doc_id, 'quality' AS level, quality AS y FROM labels
  UNION ALL SELECT doc_id, 'toxic' AS level, toxic AS y FROM labels
)"""


def sql_pred() -> str:
    parts = []
    for lv in LEVELS:
        tok = LEVEL_TOKENS[lv]
        parts.append(
            f"SELECT doc_id, '{lv}' AS level, CAST(CASE WHEN list_contains(toks, '{tok}') THEN 1 ELSE 0 END AS INTEGER) AS y, "
            f"len(list_filter(toks, lambda t: starts_with(t, '{tok}') AND t <> '{tok}')) AS k FROM pt"
        )
    union = "\n  UNION ALL ".join(parts)
    return f"""pt AS (SELECT doc_id, {_SQL_TOK} AS toks FROM documents),
v_pred_k AS (
  {union}
),
v_pred AS (
  SELECT doc_id, level, y, CAST(CASE WHEN k > 0 THEN 1 ELSE 0 END AS INTEGER) AS yhat,
         k / (k + CAST(1.0 AS DOUBLE)) AS score, 'test' AS dataset
  FROM v_pred_k
)"""


def sql_logits() -> str:
    return "v_logits AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS logits FROM embeddings)"
