"""Query of line dedup: ``documents`` by their source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import register, table
from .line_dedup import MIN_PAGES, RATIO, line_dedup

_SQL = f"""
with lines as (
  select doc_id, source, i, line from (
    select doc_id, source, unnest(range(1, len(l) + 1)) as i, unnest(l) as line
    from (select doc_id, source, string_split(text, chr(10)) as l from documents where text is not null))),
counts as (
  select source, trim(line, ' ') as k, count(distinct doc_id) as n from lines
  where source is not null and trim(line, ' ') <> '' group by 1, 2),
totals as (select source, count(*) as np from documents group by 1),
boiler as (
  select c.source, k from counts c join totals t on c.source = t.source
  where n >= {MIN_PAGES} and n > {RATIO}::double * np),
marked as (
  select l.*, b.k is not null as gone from lines l
  left join boiler b on l.source = b.source and trim(l.line, ' ') = b.k),
per_doc as (
  select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
         coalesce(string_agg(line, chr(10) order by i) filter (not gone), '') as text
  from marked group by 1)
select d.doc_id, d.source, coalesce(p.n_lines, 0)::bigint as n_lines, coalesce(p.n_dropped, 0)::bigint as n_dropped,
       p.text
from documents d left join per_doc p on d.doc_id = p.doc_id
"""


@register("op1_line_dedup", _SQL)
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"), host="source", text="text")
    return out.select("doc_id", "source", F.col("_n_lines").alias("n_lines"),
                      F.col("_n_dropped").alias("n_dropped"), "text")
