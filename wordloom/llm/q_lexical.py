"""Query of ranked lexical search: every item of ``benchmark`` against all ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import register, table
from .lexical import lexical_search

TOP = 10
_TERMS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), " \
         r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

_SQL = f"""
with d as (
  select row_number() over () as r, doc_id, {_TERMS.format('text')} as terms from documents),
held as (select r, doc_id, len(terms) as n, terms from d where len(terms) > 0),
total as (select count(*)::bigint as n_docs, sum(n)::bigint as n_terms from held),
tf as (select r, term, count(*) as tf from (select r, unnest(terms) as term from held) group by 1, 2),
weights as (
  select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w
  from tf, total group by term, n_docs),
asked as (select distinct item_id, unnest({_TERMS.format('text')}) as term from benchmark),
scored as (
  select item_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::bigint as score
  from asked join tf using (term) join weights using (term) join (select r, n from held) using (r), total
  group by 1, 2)
select item_id, (row_number() over (partition by item_id order by score desc, doc_id nulls first))::int as rank, doc_id, score
from scored join (select r, doc_id from held) using (r) where score > 0 qualify rank <= {TOP}
"""


@register("op13_lexical_search", _SQL)
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=TOP)
