"""Query of source mixing: ``documents`` raked to tempered source, language and topic shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import register, table
from .mixing import SWEEPS, TEMPERATURES, mix, n_words, topic


def _sql() -> str:
    n = "len(regexp_extract_all(coalesce(text, ''), '[^ \\n]+'))"
    ctes = [f"""
d as (
  select doc_id, coalesce(source, '(none)') as source, coalesce(lang, '(none)') as lang, {n}::bigint as weight,
    case when (length(coalesce(text, '')) - length(replace(coalesce(text, ''), '|', ''))) * 5 >= {n} + 1 then 'table'
         when length(coalesce(text, '')) - length(replace(coalesce(text, ''), '!!', '')) >= {n} + 1 then 'shout'
         when {n} < 50 then 'note' else 'prose' end as topic
  from documents)""", """
c0 as (select source, lang, topic, sum(weight)::double as w, sum(weight)::double as fit from d group by 1, 2, 3)""", """
tot as (select sum(w) as total from c0)"""]
    for m in ("source", "lang", "topic"):
        ctes.append(f"""
t_{m} as (select {m}, s / sum(s) over () as share from (
  select {m}, pow(sum(w), {TEMPERATURES[m]}) as s from c0 group by 1 having sum(w) > 0))""")
    k = 0
    for _ in range(SWEEPS):
        for m in ("source", "lang", "topic"):
            ctes.append(f"""
c{k + 1} as (
  select c.source, c.lang, c.topic, c.w, c.fit * coalesce(f.f, 0.0) as fit from c{k} c left join (
    select x.{m}, case when x.s > 0 then t.share * (select total from tot) / x.s else 0.0 end as f
    from (select {m}, sum(fit) as s from c{k} group by 1) x join t_{m} t on x.{m} = t.{m}) f on c.{m} = f.{m})""")
            k += 1
    ctes.append(f"""
r as (select *, case when w > 0 then fit / w end as r from c{k})""")
    ctes.append("""
p as (select source, lang, topic, coalesce(r / (select max(r) from r), 1.0) as prob from r)""")
    return "with" + ",".join(ctes) + """
select d.doc_id, d.source, d.lang, d.topic, d.weight, round(p.prob, 6) as prob,
  ('0x' || substr(md5(coalesce(d.doc_id::varchar, '')), 1, 8))::bigint::double / 4294967296.0 < p.prob as kept
from d join p on d.source = p.source and d.lang = p.lang and d.topic = p.topic
"""


@register("op9_mixing", _sql())
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    docs = docs.withColumn("topic", topic("text"))
    margins = {m: F.col(m) for m in ("source", "lang", "topic")}
    out = mix(docs, margins, n_words("text"), TEMPERATURES)
    none = F.lit("(none)")
    return out.select("doc_id", F.coalesce("source", none).alias("source"), F.coalesce("lang", none).alias("lang"),
                      "topic", F.col("_weight").alias("weight"), F.round("_prob", 6).alias("prob"),
                      F.col("_kept").alias("kept"))
