"""Query of exact top-k search: every fiftieth vector of ``embeddings`` against all others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import register, table
from .topk import exact_top_k

_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda c: floor(256 * c::double)::bigint) as x from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
q as (select vec_id as query_id, x as qx from v where vec_id % 50 = 0),
s as (
  select query_id, vec_id, list_sum(list_transform(list_zip(qx, x), lambda p: p[1] * p[2]))::bigint as score
  from q join v on vec_id <> query_id and len(qx) = len(x))
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score
from s qualify rank <= 5
"""


@register("op8_exact_top_k", _SQL)
def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
