"""Preparation and aggregate queries (P*, J1, A1-A4)."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import functions as F

from ..functions.constants import BANK_OBJECTIVE_TO_LEVEL, LEVELS, SPLIT_SEED, TEST_SHARE
from ..functions.text import lexicon_tokens
from ..operators import aggregates as agg
from ..operators import lexicon as lx
from ..operators import prep
from ..operators.sampling import random_split
from ..session import read_table
from . import views
from .registry import builtin_lexicon, register
from .sql_common import q, sql_lex_match, sql_treebank_tokens

TEST_FRACTION = Fraction(TEST_SHARE).limit_denominator(1000)


def ql(name: str) -> str:
    """Quoted level identifier (some level names are SQL keywords)."""
    return f'"{name}"'


def sql_split_r1(source: str = "documents", id_col: str = "doc_id") -> str:
    """split_r1(doc_id, split): the first ceil(n/5) rows in md5 order are test."""
    num, den = TEST_FRACTION.numerator, TEST_FRACTION.denominator
    return f"""split_r1 AS (
  SELECT {id_col} AS doc_id,
         CASE WHEN row_number() OVER (ORDER BY md5('{SPLIT_SEED}:' || CAST({id_col} AS VARCHAR)), {id_col})
                   <= (count(*) OVER () * {num} + {den - 1}) // {den}
              THEN 'test' ELSE 'train' END AS split
  FROM {source})"""


# ------------------------------------------------------------------ prep


def _one_hot_sql() -> str:
    cols = []
    for lv in LEVELS:
        vals = [k for k, v in BANK_OBJECTIVE_TO_LEVEL.items() if v == lv]
        if vals:
            inl = ", ".join(q(v) for v in vals)
            cols.append(f"CAST(CASE WHEN objective IN ({inl}) THEN 1.0 ELSE 0.0 END AS DOUBLE) AS {ql(lv)}")
        else:
            cols.append(f"CAST(0.0 AS DOUBLE) AS {ql(lv)}")
    return f"WITH {views.sql_bank()} SELECT item_id, {', '.join(cols)} FROM v_bank"


@register("prep_one_hot", _one_hot_sql())
def prep_one_hot(spark, sf_dir):
    return prep.one_hot(views.bank(spark, sf_dir), "objective", BANK_OBJECTIVE_TO_LEVEL, LEVELS)


def _vec_sql() -> str:
    filled = [f"coalesce({ql(lv)}, 0)" for lv in LEVELS]
    n = " + ".join(filled)
    txt = ", ".join(f"CAST(CAST({f} AS INTEGER) AS VARCHAR)" for f in filled)
    return (f"WITH {views.sql_objectives()} SELECT doc_id, CAST({n} AS INTEGER) AS n_labels, "
            f"concat_ws(',', {txt}) AS label_vector FROM v_objectives")


@register("prep_label_vector", _vec_sql())
def prep_label_vector(spark, sf_dir):
    df = prep.label_vector(prep.fill_labels(views.objectives(spark, sf_dir), LEVELS), LEVELS)
    return df.select(
        "doc_id",
        prep.n_labels().cast("int").alias("n_labels"),
        F.array_join(F.transform("label_vector", lambda x: x.cast("int").cast("string")), ",").alias("label_vector"),
    )


@register(
    "prep_fill_labels",
    f"WITH {views.sql_objectives()} SELECT doc_id, "
    + ", ".join(f"CAST(coalesce({ql(lv)}, 0.0) AS DOUBLE) AS {ql(lv)}" for lv in LEVELS)
    + " FROM v_objectives",
)
def prep_fill_labels(spark, sf_dir):
    return prep.fill_labels(views.objectives(spark, sf_dir), LEVELS).drop("text")


_CATS = ["art", "rel", "aux", "link", "stem", "neg"]


def _join_fill_sql() -> str:
    lab = ", ".join(f"CAST(coalesce(o.{ql(lv)}, 0.0) AS DOUBLE) AS {ql(lv)}" for lv in LEVELS)
    cats = ", ".join(
        f"CAST(coalesce(max(CASE WHEN s.category = {q(c)} THEN s.score END), 0.0) AS DOUBLE) AS {c}" for c in _CATS
    )
    return f"""WITH {views.sql_objectives()}, {sql_lex_match()}
SELECT o.doc_id, {lab}, {cats}
FROM v_objectives o LEFT JOIN lex_scores s ON s.doc_id = o.doc_id
GROUP BY o.doc_id, {', '.join('o.' + ql(lv) for lv in LEVELS)}"""


@register("prep_join_fill", _join_fill_sql())
def prep_join_fill(spark, sf_dir):
    obj = views.objectives(spark, sf_dir)
    lex = builtin_lexicon(spark)
    wide = (
        lx.category_scores(obj, lex)
        .groupBy("doc_id")
        .pivot("category", lex.category_names)
        .agg(F.first("score"))
    )
    left = prep.fill_labels(obj.drop("text"), LEVELS)
    return prep.join_fill(left, wide, "doc_id")


@register(
    "prep_unpivot_levels",
    f"WITH {views.sql_objectives()} "
    + " UNION ALL ".join(
        f"SELECT doc_id, '{lv}' AS level, CAST(coalesce({ql(lv)}, 0) AS BIGINT) AS y FROM v_objectives" for lv in LEVELS
    ),
)
def prep_unpivot_levels(spark, sf_dir):
    return prep.unpivot_levels(views.objectives(spark, sf_dir), ["doc_id"], LEVELS)


@register(
    "prep_profile_shape",
    f"WITH {views.sql_objectives()} SELECT count(*) AS n_rows, CAST(8 AS INTEGER) AS n_cols, "
    "count(*) FILTER (WHERE text IS NULL) AS n_null_text FROM v_objectives",
)
def prep_profile_shape(spark, sf_dir):
    return prep.profile_shape(views.objectives(spark, sf_dir))


# ------------------------------------------------------------ aggregates


def _label_counts_sql() -> str:
    unp = " UNION ALL ".join(
        f"SELECT doc_id, '{lv}' AS level, CAST(coalesce({ql(lv)}, 0) AS BIGINT) AS y FROM v_objectives" for lv in LEVELS
    )
    return f"""WITH {views.sql_objectives()}, {sql_split_r1()}, u AS ({unp})
SELECT level, split, y, count(*) AS n FROM u JOIN split_r1 USING (doc_id) GROUP BY level, split, y"""


@register("agg_label_counts", _label_counts_sql())
def agg_label_counts(spark, sf_dir):
    obj = random_split(views.objectives(spark, sf_dir), "doc_id", SPLIT_SEED, TEST_FRACTION)
    long = prep.unpivot_levels(obj, ["doc_id", "split"], LEVELS)
    return agg.label_counts(long, ["level", "split"])


@register(
    "agg_label_cardinality",
    f"WITH {views.sql_objectives()} SELECT CAST("
    + " + ".join(f"coalesce({ql(lv)}, 0)" for lv in LEVELS)
    + " AS INTEGER) AS n_labels, count(*) AS n_docs FROM v_objectives GROUP BY 1",
)
def agg_label_cardinality(spark, sf_dir):
    df = prep.label_vector(views.objectives(spark, sf_dir), LEVELS)
    return agg.label_cardinality(df, prep.n_labels())


@register(
    "agg_length_profile",
    f"""SELECT min(len_) AS min_len, max(len_) AS max_len, round(avg(CAST(len_ AS DOUBLE)), 6) AS mean_len,
       round(quantile_cont(len_, 0.995), 6) AS p995
FROM (SELECT len({sql_treebank_tokens('text')}) AS len_ FROM documents)""",
)
def agg_length_profile(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return agg.length_profile(docs.select(F.size(lexicon_tokens("text", treebank=True)).alias("len_")), "len_")


@register(
    "agg_multi_predicted",
    f"WITH {views.sql_pred()} SELECT count(*) AS n_multi FROM (SELECT doc_id FROM v_pred GROUP BY doc_id HAVING sum(yhat) > 1)",
)
def agg_multi_predicted(spark, sf_dir):
    return agg.multi_predicted(views.pred(spark, sf_dir), ["doc_id"])
