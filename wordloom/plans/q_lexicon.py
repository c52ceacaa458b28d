"""Lexicon queries (S8, J2-J5, L1-L10) and the flagship query."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lexicon as lx
from ..session import read_table, scratch_path
from ..sources.lexicon import builtin_lexicon_text, lexicon_text_frame, parse_lexicon
from .registry import ORACLES, builtin_lexicon, register
from .sql_common import q, sql_lex_match, sql_lex_tokens, sql_lexicon


def _docs(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", "text")


@register(
    "lex_read_categories",
    f"""WITH {sql_lex_match()}
SELECT c.cat_id, c.category, c.pos,
       coalesce(u.n_docs, 0) AS n_docs, coalesce(u.n_matched, 0) AS n_matched
FROM lex_categories c
LEFT JOIN (SELECT category, count(*) AS n_docs, sum(cnt) AS n_matched FROM lex_counts GROUP BY category) u
  USING (category)""",
)
def lex_read_categories(spark, sf_dir):
    """Categories as read from the file (id, name, file position) with their use over all documents:
    documents with at least one token of the category and matched tokens in total (0 if unused)."""
    t = parse_lexicon(lexicon_text_frame(spark, builtin_lexicon_text()))
    cats = t.categories.select("cat_id", "category", F.col("pos").cast("int").alias("pos"))
    use = lx.category_counts(_docs(spark, sf_dir), builtin_lexicon(spark)).groupBy("category").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("cnt").alias("n_matched")
    )
    return cats.join(use, "category", "left").select(
        "cat_id", "category", "pos",
        F.coalesce(F.col("n_docs"), F.lit(0)).cast("long").alias("n_docs"),
        F.coalesce(F.col("n_matched"), F.lit(0)).cast("long").alias("n_matched"),
    )


@register("lex_read_file", ORACLES["lex_read_categories"])
def lex_read_file(spark, sf_dir):
    """As ``lex_read_categories``, with the lexicon written to the shared folder and read from there as a file."""
    path = scratch_path(spark, "lexicon")
    spark.createDataFrame([(builtin_lexicon_text(),)], "value string").coalesce(1).write.text(path)
    lex = lx.Lexicon.read(spark, f"{path}/part-*")
    use = lx.category_counts(_docs(spark, sf_dir), lex).groupBy("category").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("cnt").alias("n_matched"))
    return lex.categories.join(use, "category", "left").select(
        "cat_id", "category", "pos",
        F.coalesce(F.col("n_docs"), F.lit(0)).cast("long").alias("n_docs"),
        F.coalesce(F.col("n_matched"), F.lit(0)).cast("long").alias("n_matched"))


@register(
    "lex_read_entries",
    f"""WITH {sql_lex_match()}
SELECT e.pattern, e.stem, e.is_prefix, e.category, coalesce(u.n_matches, 0) AS n_matches
FROM lex_entry_cats e
LEFT JOIN (SELECT m.entry_no, count(*) AS n_matches
           FROM lex_doc_tok d JOIN lex_tok_match m USING (token) GROUP BY m.entry_no) u
  USING (entry_no)""",
)
def lex_read_entries(spark, sf_dir):
    """Resolved entries (one row per category id) with the token occurrences each entry matches
    over all documents; an entry hidden by a shorter wildcard stem, or never seen, has 0."""
    lex = builtin_lexicon(spark)
    use = lx.entry_matches(_docs(spark, sf_dir), lex)
    return lex.entry_cats.select("pattern", "stem", "is_prefix", "category").join(use, "pattern", "left").select(
        "pattern", "stem", "is_prefix", "category",
        F.coalesce(F.col("n_matches"), F.lit(0)).cast("long").alias("n_matches"),
    )


@register(
    "lex_match_tokens",
    f"""WITH {sql_lex_match()}
SELECT m.token, m.pattern, c.category FROM lex_tok_match m JOIN lex_entry_cats c ON c.entry_no = m.entry_no""",
)
def lex_match_tokens(spark, sf_dir):
    return lx.distinct_token_matches(_docs(spark, sf_dir), builtin_lexicon(spark))


@register(
    "lex_unmatched_tokens",
    f"""WITH {sql_lex_match()}
SELECT token, count(DISTINCT doc_id) AS n_docs FROM lex_doc_tok d
WHERE NOT EXISTS (SELECT 1 FROM lex_tok_match m WHERE m.token = d.token)
GROUP BY token""",
)
def lex_unmatched_tokens(spark, sf_dir):
    return lx.unmatched_tokens(_docs(spark, sf_dir), builtin_lexicon(spark))


@register("lex_token_counts", f"SELECT doc_id, len({sql_lex_tokens('text')}) AS n_tokens FROM documents")
def lex_token_counts(spark, sf_dir):
    return lx.token_counts(_docs(spark, sf_dir))


@register("lex_category_counts", f"WITH {sql_lex_match()} SELECT doc_id, category, cnt FROM lex_counts")
def lex_category_counts(spark, sf_dir):
    return lx.category_counts(_docs(spark, sf_dir), builtin_lexicon(spark)).drop("n_tokens")


@register("lex_category_scores", f"WITH {sql_lex_match()} SELECT doc_id, category, score FROM lex_scores")
def lex_category_scores(spark, sf_dir):
    return lx.category_scores(_docs(spark, sf_dir), builtin_lexicon(spark))


_CATS = ["art", "rel", "aux", "link", "stem", "neg"]


def _sql_wide() -> str:
    cols = ", ".join(f"max(CASE WHEN s.category = {q(c)} THEN s.score END) AS {c}" for c in _CATS)
    return f"""WITH {sql_lex_match()}
SELECT d.doc_id, {cols} FROM documents d LEFT JOIN lex_scores s ON s.doc_id = d.doc_id GROUP BY d.doc_id"""


@register("lex_scores_wide", _sql_wide())
def lex_scores_wide(spark, sf_dir):
    return lx.scores_wide(_docs(spark, sf_dir), builtin_lexicon(spark))


@register(
    "lex_coverage",
    f"""WITH {sql_lex_match()},
base AS (SELECT doc_id, len({sql_lex_tokens('text')}) AS n_tokens FROM documents),
matched AS (SELECT doc_id, count(*) AS n_matched FROM lex_doc_tok JOIN lex_tok_match USING (token) GROUP BY doc_id)
SELECT b.doc_id, b.n_tokens, CAST(coalesce(m.n_matched, 0) AS BIGINT) AS n_matched,
       CASE WHEN b.n_tokens > 0
            THEN round(100.0 * CAST(coalesce(m.n_matched, 0) AS DOUBLE) / CAST(b.n_tokens AS DOUBLE), 6) END AS dic_pct
FROM base b LEFT JOIN matched m ON m.doc_id = b.doc_id""",
)
def lex_coverage(spark, sf_dir):
    return lx.coverage(_docs(spark, sf_dir), builtin_lexicon(spark))


def _sql_surface() -> str:
    from ..functions.text import ASCII_PUNCT_CLASS

    def cnt(cls: str) -> str:
        return f"(length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), {q(cls)}, '', 'g')))"

    def per100(expr: str) -> str:
        return f"CASE WHEN wc > 0 THEN round(100.0 * CAST({expr} AS DOUBLE) / CAST(wc AS DOUBLE), 6) END"

    cols = [
        "doc_id",
        "wc",
        "CASE WHEN wc > 0 THEN round(CAST(wc AS DOUBLE) / greatest(1, len(regexp_extract_all(coalesce(text, ''), '[.!?]+'))), 6) END AS wps",
        f"{per100('len(list_filter(toks, lambda t: length(t) > 6))')} AS sixltr",
        f"{per100(cnt(ASCII_PUNCT_CLASS))} AS allpunc",
    ]
    cols += [f"{per100(cnt(cls))} AS {name}" for name, cls in lx.SURFACE_PUNCT.items()]
    return f"""SELECT {', '.join(cols)} FROM (
  SELECT doc_id, text, toks, len(toks) AS wc FROM (SELECT doc_id, text, {sql_lex_tokens('text')} AS toks FROM documents))"""


@register("lex_surface_stats", _sql_surface())
def lex_surface_stats(spark, sf_dir):
    return lx.surface_stats(_docs(spark, sf_dir))


SQL_SCORES_BY_QUALITY = f"""WITH {sql_lex_match()},
labelled AS (SELECT l.doc_id, l.quality FROM labels l WHERE l.doc_id IN (SELECT doc_id FROM documents)),
sizes AS (SELECT quality, count(*) AS n FROM labelled GROUP BY quality),
per AS (
  SELECT quality, category, count(*) AS n_docs,
         sum(100.0 * CAST(cnt AS DOUBLE) / CAST(n_tokens AS DOUBLE)) AS s
  FROM lex_counts JOIN labelled USING (doc_id) GROUP BY quality, category)
SELECT per.quality, category, n_docs, round(s / n, 6) AS mean_score FROM per JOIN sizes USING (quality)"""


@register("lex_scores_by_quality", SQL_SCORES_BY_QUALITY)
def lex_scores_by_quality(spark, sf_dir):
    """Flagship: documents ⋈ labels → tokens → lexicon match → mean percentage per category and quality class."""
    labels = read_table(spark, sf_dir, "labels")
    return lx.scores_by_label(_docs(spark, sf_dir), labels, builtin_lexicon(spark), "quality")
