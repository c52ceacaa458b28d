"""Query of chat formatting: all of ``conversations``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .chat_format import chat_format
from .common import register, table

_SQL = """
with t as (
  select conv_id, turn, coalesce(role, 'user') as role, coalesce(text, '') as text from conversations
  where conv_id is not null),
c as (
  select conv_id, list({'r': role, 'x': text} order by turn nulls first, md5(role || chr(1) || text)) as l from t
  group by 1),
g as (select l, min(conv_id) as conv_id, count(*) as n_copies from c group by 1),
p as (select distinct unnest(list_transform(range(1, len(l)), lambda k: l[1:k])) as pre from g)
select g.conv_id, len(g.l)::bigint as n_turns, g.n_copies,
       array_to_string(list_transform(g.l, lambda z: '<|' || z.r || '|>' || chr(10) || z.x || '<|end|>' || chr(10)), '')
         as rendered
from g where not exists (select 1 from p where p.pre = g.l)
"""


@register("op3_chat_format", _SQL)
def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format(table(spark, sf_dir, "conversations"))
