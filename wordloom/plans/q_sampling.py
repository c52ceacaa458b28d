"""Split and sample queries (R1-R6)."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import functions as F

from ..functions.constants import (
    FOLD_SEED,
    HALVING_FACTOR,
    HALVING_RUNGS,
    HALVING_SEED,
    N_FOLDS,
    SECOND_SPLIT_SEED,
    SPLIT_SEED,
    TEST_SHARE,
    UNDERSAMPLE_SEED,
)
from ..operators import sampling as sm
from ..session import read_table
from . import views
from .registry import register

TEST_FRACTION = Fraction(TEST_SHARE).limit_denominator(1000)
_NUM, _DEN = TEST_FRACTION.numerator, TEST_FRACTION.denominator


def _rank(seed: str, id_col: str = "doc_id", strata: str = "") -> str:
    part = f"PARTITION BY {strata} " if strata else ""
    return f"row_number() OVER ({part}ORDER BY md5('{seed}:' || CAST({id_col} AS VARCHAR)), {id_col})"


def _count(strata: str = "") -> str:
    return f"count(*) OVER (PARTITION BY {strata})" if strata else "count(*) OVER ()"


def _cut(n: str, num: int = _NUM, den: int = _DEN) -> str:
    return f"(({n}) * {num} + {den - 1}) // {den}"


@register(
    "split_random_80_20",
    f"""SELECT doc_id, CASE WHEN rn <= {_cut('n')} THEN 'test' ELSE 'train' END AS split
FROM (SELECT doc_id, {_rank(SPLIT_SEED)} AS rn, {_count()} AS n FROM documents)""",
)
def split_random_80_20(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id")
    return sm.random_split(docs, "doc_id", SPLIT_SEED, TEST_FRACTION)


@register(
    "split_stratified",
    f"""WITH {views.sql_gold()}
SELECT doc_id, level, CASE WHEN rn <= {_cut('n')} THEN 'test' ELSE 'train' END AS split
FROM (SELECT doc_id, level, {_rank(SPLIT_SEED, strata='level, y')} AS rn, {_count('level, y')} AS n FROM v_gold)""",
)
def split_stratified(spark, sf_dir):
    g = views.gold(spark, sf_dir)
    return sm.random_split(g, "doc_id", SPLIT_SEED, TEST_FRACTION, strata=["level", "y"]).select(
        "doc_id", "level", "split"
    )


@register(
    "split_three_way",
    f"""WITH first AS (
  SELECT doc_id, CASE WHEN rn <= {_cut('n')} THEN 'test' ELSE 'train' END AS split
  FROM (SELECT doc_id, {_rank(SPLIT_SEED)} AS rn, {_count()} AS n FROM documents)),
rest AS (
  SELECT doc_id, CASE WHEN rn <= {_cut('n')} THEN 'val' ELSE 'train' END AS split
  FROM (SELECT doc_id, {_rank(SECOND_SPLIT_SEED)} AS rn, {_count()} AS n FROM first WHERE split = 'train'))
SELECT doc_id, split FROM first WHERE split = 'test' UNION ALL SELECT doc_id, split FROM rest""",
)
def split_three_way(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id")
    return sm.three_way_split(docs, "doc_id", SPLIT_SEED, SECOND_SPLIT_SEED, TEST_FRACTION, TEST_FRACTION)


@register(
    "sample_undersample",
    f"""WITH {views.sql_gold()},
r AS (SELECT doc_id, level, y, {_rank(UNDERSAMPLE_SEED, strata='level, y')} AS rn, {_count('level, y')} AS n FROM v_gold),
m AS (SELECT *, min(n) OVER (PARTITION BY level) AS m FROM r)
SELECT doc_id, level, y FROM m WHERE rn <= m""",
)
def sample_undersample(spark, sf_dir):
    g = views.gold(spark, sf_dir)
    return sm.undersample(g, "doc_id", UNDERSAMPLE_SEED, ["level"], "y").select("doc_id", "level", "y")


def _fold_sql() -> str:
    terms = " + ".join(
        f"CASE WHEN rn > {_cut('n', j, N_FOLDS)} THEN 1 ELSE 0 END" for j in range(1, N_FOLDS)
    )
    return f"""WITH {views.sql_gold()}
SELECT doc_id, level, CAST({terms} AS INTEGER) AS fold
FROM (SELECT doc_id, level, {_rank(FOLD_SEED, strata='level, y')} AS rn, {_count('level, y')} AS n FROM v_gold)"""


@register("split_kfold_stratified", _fold_sql())
def split_kfold_stratified(spark, sf_dir):
    g = views.gold(spark, sf_dir)
    return sm.kfold(g, "doc_id", FOLD_SEED, N_FOLDS, strata=["level", "y"]).select("doc_id", "level", "fold")


def _rungs_sql() -> str:
    terms = " + ".join(
        f"CASE WHEN rn > {_cut('n', 1, HALVING_FACTOR ** (HALVING_RUNGS - 1 - r))} THEN 1 ELSE 0 END"
        for r in range(HALVING_RUNGS - 1)
    )
    return f"""SELECT CAST(unnest(range(part, {HALVING_RUNGS})) AS INTEGER) AS rung, doc_id
FROM (SELECT doc_id, {terms} AS part
      FROM (SELECT doc_id, {_rank(HALVING_SEED)} AS rn, {_count()} AS n FROM documents))"""


@register("split_halving_rungs", _rungs_sql())
def split_halving_rungs(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id")
    return sm.halving_rungs(docs, "doc_id", HALVING_SEED, HALVING_FACTOR, HALVING_RUNGS).select(
        F.col("rung").cast("int").alias("rung"), "doc_id"
    )
