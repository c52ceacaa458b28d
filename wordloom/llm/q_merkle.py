"""Query of the Merkle manifest: every row of ``documents``, a tree per language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import register, table
from .merkle import FAN, digest, folded, merkle_manifest, proof

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SQL_LEVELS = 10  # levels that the SQL has; a tree ends below the last one
POLYNOMIAL = 3988292384  # fixed value: the reversed polynomial of crc32


def _sql() -> str:
    def fields(text: str) -> str:
        return " || ".join(f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')"
                           for c in [*FIELDS[:-1], text])

    ones = 4294967295
    # unsigned crc32 of the decimal id: eight shifts after each byte
    crc = (f"xor({ones}::bigint, list_reduce(list_prepend({ones}::bigint, flatten(list_transform(string_split(doc_id::varchar, ''),"
           " lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, x: case when x >= 0 then xor(a, x)"
           f" when a & 1 = 1 then xor(a >> 1, {POLYNOMIAL}::bigint) else a >> 1 end))")
    ctes = [f"""
leaves as (
  select doc_id, lang, sha256({fields('text')}) as h,
    case when ({crc}) % 3 = 0 then sha256({fields(f"translate(text, '{UPPER}', '{LOWER}')")}) end as other
  from documents)""", """
t0 as (select lang as tree, row_number() over (partition by lang order by doc_id nulls first, h) - 1 as pos, h from leaves)""", """
own as (
  select doc_id, lang as tree, row_number() over (partition by lang order by doc_id nulls first, h) - 1 as pos, h as leaf,
    coalesce(other, h) as cur, '' as proof from leaves)"""]

    def climb(prefix: str, rows: str, keep: str) -> str:
        """Levels of the trees ``prefix``0, and ``rows`` carried up through them."""
        for k in range(SQL_LEVELS):
            ctes.append(f"""
{prefix}w{k} as (
  select tree, pos, h, count(*) over (partition by tree) as n,
    coalesce(string_agg(h, '') over (partition by tree, pos // {FAN} order by pos rows between unbounded preceding and 1 preceding), '') as l,
    coalesce(string_agg(h, '') over (partition by tree, pos // {FAN} order by pos rows between 1 following and unbounded following), '') as r
  from {prefix}{k})""")
            ctes.append(f"""
{prefix}{k + 1} as (
  select tree, pos // {FAN} as pos, case when max(n) = 1 then min(h) else sha256(string_agg(h, '' order by pos)) end as h
  from {prefix}w{k} group by tree, pos // {FAN})""")
            ctes.append(f"""
{rows}{k + 1} as (
  select {keep}, o.tree, o.pos // {FAN} as pos, case when w.n = 1 then o.cur else sha256(w.l || o.cur || w.r) end as cur,
    o.proof || case when w.n = 1 then '' else w.l || w.r end as proof
  from {rows + str(k) if k else rows} o join {prefix}w{k} w on o.tree is not distinct from w.tree and o.pos = w.pos)""")
        return f"{prefix}{SQL_LEVELS}"

    subroots = climb("t", "own", "o.doc_id, o.leaf")
    ctes.append(f"""
s0 as (select 0 as tree, row_number() over (order by tree nulls first) - 1 as pos, h from {subroots})""")
    ctes.append(f"""
up as (
  select o.doc_id, o.leaf, o.tree as lang, t.h as subroot, 0 as tree, t.pos, o.cur, o.proof
  from own{SQL_LEVELS} o join (select tree as lang, h, row_number() over (order by tree nulls first) - 1 as pos from {subroots}) t
    on o.tree is not distinct from t.lang)""")
    root = climb("s", "up", "o.doc_id, o.leaf, o.lang, o.subroot")
    return "with" + ",".join(ctes) + f"""
select u.doc_id, u.leaf, u.subroot, r.h as root, sha256(u.proof) as proof_sha256, u.cur as folded_root, u.cur = r.h as verified
from up{SQL_LEVELS} u cross join {root} r"""


@register("op12_merkle_manifest", _sql())
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    out = merkle_manifest(docs, FIELDS, altered={"text": F.translate("text", UPPER, LOWER)}, when=tampered)
    out = out.withColumn("folded_root", folded(F.coalesce("other_leaf", "leaf"), F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", digest(proof(F.col("path"))).alias("proof_sha256"), "folded_root",
                      (F.col("folded_root") == F.col("root")).alias("verified"))
