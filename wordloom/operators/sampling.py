"""Reproducible splits and samples (R1-R6) by md5 order, without a one-partition window.

Every row gets the key ``md5(seed || ':' || id)``; the row's rank is its
position in key order within its stratum.  A rank is never computed by a
global ``row_number``: the first three hex digits of the key give 4,096
buckets; a small ``(stratum, bucket) → count`` table (partial aggregation)
gives each bucket's rank range.  Buckets whose range lies inside one part are
assigned wholesale; only the few buckets that straddle a cut are ranked, each
by its own window partition.  The result equals the global order exactly,
so the oracle may use a plain ``row_number``.

Cuts are given as integer thresholds per stratum (computed from the stratum
size ``_n``), so no floating rounding differs between engines.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checked_broadcast

BUCKET_HEX_DIGITS = 3
MAX_BUCKET_HEX_DIGITS = 6
# Largest bucket whose rows are ranked by one window partition when it straddles a cut.
EDGE_BUCKET_ROWS = 200_000


def hash_key(id_col: str, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))


def ceil_share(n: Column, share: Fraction) -> Column:
    """ceil(share * n) in integer arithmetic."""
    num, den = share.numerator, share.denominator
    return F.floor((n * F.lit(num) + F.lit(den - 1)) / F.lit(den)).cast("long")


def _bucket_of(h: Column, digits: int) -> Column:
    return F.substring(h, 1, digits)


def _with_prefix(counts: DataFrame, strata: list[str]) -> DataFrame:
    """``counts`` (strata…, _b, _cnt) with ``_before`` (rows of the stratum in the buckets before) and ``_n`` (all of them).

    Two levels: buckets with the same first digits are summed up by a window of their own, and the sums of these
    ranges by a second one over a row per range, so no task sees all buckets of a stratum.  Without strata the ranges (at most
    16 to the power of half the digits) come to the driver, where their running sum is taken.
    """
    half = F.greatest(F.lit(1), F.floor(F.length("_b") / 2)).cast("int")
    counts = counts.withColumn("_range", F.substring(F.col("_b"), F.lit(1), half))
    inside = Window.partitionBy(*strata, "_range").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_inside", F.coalesce(F.sum("_cnt").over(inside), F.lit(0)))
    ranges = counts.groupBy(*strata, "_range").agg(F.sum("_cnt").alias("_rows"))
    if strata:
        whole = Window.partitionBy(*strata)
        earlier = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        ranges = ranges.select(*strata, "_range", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_first"),
                               F.sum("_rows").over(whole).alias("_n"))
    else:
        found = sorted(ranges.collect())
        total, first, rows = sum(r["_rows"] for r in found), 0, []
        for r in found:
            rows.append((r["_range"], first, total))
            first += r["_rows"]
        ranges = F.broadcast(counts.sparkSession.createDataFrame(rows, "_range string, _first long, _n long"))
    left, right, cond = _join_on_stratum(counts, ranges, strata, ["_range"])
    return left.join(right, cond).select(*strata, "_b", "_cnt", (F.col("_first") + F.col("_inside")).alias("_before"), "_n")


def _bucket_table(keyed: DataFrame, strata: list[str], thresholds, stratum_extra) -> tuple[DataFrame, int]:
    """(strata…, _b, _before, _lo, _hi, _t…) per bucket; returns the table and the number of thresholds."""
    counts = _with_prefix(keyed.groupBy(*strata, "_b").agg(F.count(F.lit(1)).alias("_cnt")), strata)
    if stratum_extra is not None:
        counts = stratum_extra(counts)
    ts = thresholds(F.col("_n"))

    def part_of(rank: Column) -> Column:
        p = F.lit(0)
        for t in ts:
            p = p + F.when(rank > t, 1).otherwise(0)
        return p.cast("int")

    table = counts.select(
        *strata,
        "_b",
        "_cnt",
        "_before",
        part_of(F.col("_before") + 1).alias("_lo"),
        part_of(F.col("_before") + F.col("_cnt")).alias("_hi"),
        *[t.alias(f"_t{i}") for i, t in enumerate(ts)],
    )
    return table, len(ts)


def _join_on_stratum(left: DataFrame, right: DataFrame, strata: list[str], keys: list[str]):
    """(left, renamed right, condition) for a join on ``keys`` and, null-safe, on the strata, so a
    null stratum value keeps its own stratum; the right side's strata and keys are renamed apart."""
    renamed = right.select(*[F.col(c).alias(f"_s{i}") for i, c in enumerate(strata)],
                           *[F.col(c).alias(f"_r{c}") for c in keys],
                           *[c for c in right.columns if c not in strata and c not in keys])
    cond = None
    for c in keys:
        e = left[c].eqNullSafe(F.col(f"_r{c}"))
        cond = e if cond is None else cond & e
    for i, c in enumerate(strata):
        cond = cond & left[c].eqNullSafe(F.col(f"_s{i}"))
    return left, renamed, cond


def hash_parts(
    df: DataFrame,
    id_col: str,
    seed: str,
    thresholds: Callable[[Column], list[Column]],
    strata: list[str] | None = None,
    stratum_extra: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Add ``part`` (int): the number of thresholds the row's rank exceeds.

    ``thresholds(n)`` returns non-decreasing integer rank thresholds for a
    stratum of ``n`` rows.  ``stratum_extra`` may add per-stratum columns to
    the bucket table before thresholds are taken (e.g. a minority count).

    Plan: two small tables are computed from an id-only projection of ``df``
    — the bucket table, and the exact parts of the rows in the few buckets
    that straddle a cut (ranked by a window per bucket) — and both are
    broadcast after a row-count check.  The rows of ``df`` then get their part
    by two broadcast joins in one narrow pass: wide rows (texts) are read once
    and never shuffled.  If a bucket would hold more than
    ``EDGE_BUCKET_ROWS`` rows, the bucket key takes another hex digit.
    """
    strata = list(strata or [])
    ids = df.select(id_col, *strata).withColumn("_h", hash_key(id_col, seed))
    digits = BUCKET_HEX_DIGITS
    while True:
        keyed_ids = ids.withColumn("_b", _bucket_of(F.col("_h"), digits))
        table, n_ts = _bucket_table(keyed_ids, strata, thresholds, stratum_extra)
        # At most 16^digits rows per stratum: checked, then broadcast.
        table = checked_broadcast(table)
        biggest = table.agg(F.max("_cnt")).first()[0] or 0
        if biggest <= EDGE_BUCKET_ROWS or digits >= MAX_BUCKET_HEX_DIGITS:
            break
        table.unpersist()
        digits += 1
    bucket = _bucket_of(hash_key(id_col, seed), digits)

    # exact parts of the rows in straddling buckets only
    edge_buckets = table.filter(F.col("_lo") != F.col("_hi"))
    left, right, cond = _join_on_stratum(keyed_ids, edge_buckets, strata, ["_b"])
    edge = left.join(F.broadcast(right), cond)
    rn = F.row_number().over(Window.partitionBy(*strata, "_b").orderBy("_h", id_col))
    edge = edge.withColumn("_r", F.col("_before") + rn)
    p = F.lit(0)
    for i in range(n_ts):
        p = p + F.when(F.col("_r") > F.col(f"_t{i}"), 1).otherwise(0)
    # rows that share an id share the part of the first of them
    edge_parts = edge.select(id_col, *strata, p.cast("int").alias("_ep")).groupBy(id_col, *strata).agg(
        F.min("_ep").alias("_ep"))
    edge_parts = checked_broadcast(edge_parts)

    # every row: bucket table (wholesale part) then the edge table (exact part where the bucket straddles)
    keyed = df.withColumn("_b", bucket)
    left, right, cond = _join_on_stratum(keyed, table.select(*strata, "_b", "_lo"), strata, ["_b"])
    with_lo = left.join(right, cond).drop(*[c for c in right.columns if c != "_lo"])
    left, right, cond = _join_on_stratum(with_lo, edge_parts, strata, [id_col])
    out = left.join(right, cond, "left")
    return out.withColumn("part", F.coalesce(F.col("_ep"), F.col("_lo"))).drop(
        "_b", "_lo", *[c for c in right.columns]
    )


def random_split(df: DataFrame, id_col: str, seed: str, test_share: Fraction,
                 strata: list[str] | None = None) -> DataFrame:
    """Add ``split``: the first ceil(test_share * n) rows in key order are 'test', the rest 'train'."""
    out = hash_parts(df, id_col, seed, lambda n: [ceil_share(n, test_share)], strata)
    return out.withColumn("split", F.when(F.col("part") == 0, "test").otherwise("train")).drop("part")


def three_way_split(df: DataFrame, id_col: str, seed: str, second_seed: str, test_share: Fraction,
                    val_share: Fraction) -> DataFrame:
    """Two successive two-way cuts: test from all rows, then val from the remaining train rows."""
    first = random_split(df, id_col, seed, test_share)
    rest = random_split(first.filter(F.col("split") == "train").drop("split"), id_col, second_seed, val_share)
    rest = rest.withColumn("split", F.when(F.col("split") == "test", "val").otherwise("train"))
    return first.filter(F.col("split") == "test").unionByName(rest)


def kfold(df: DataFrame, id_col: str, seed: str, k: int, strata: list[str] | None = None) -> DataFrame:
    """Add ``fold`` in 0..k-1: contiguous key-order chunks of each stratum (stratified folds)."""
    out = hash_parts(df, id_col, seed, lambda n: [ceil_share(n, Fraction(j, k)) for j in range(1, k)], strata)
    return out.withColumnRenamed("part", "fold")


def undersample(df: DataFrame, id_col: str, seed: str, group: list[str], label: str) -> DataFrame:
    """Keep, per group, the first m rows of every class in key order, m = size of the smallest class."""

    def add_min(counts: DataFrame) -> DataFrame:
        return counts.withColumn("_m", F.min("_n").over(Window.partitionBy(*group)))

    out = hash_parts(df, id_col, seed, lambda n: [F.col("_m")], [*group, label], stratum_extra=add_min)
    return out.filter(F.col("part") == 0).drop("part")


def halving_rungs(df: DataFrame, id_col: str, seed: str, factor: int, rungs: int) -> DataFrame:
    """Nested growing subsets: rung r holds the first ceil(n / factor^(rungs-1-r)) rows in key order.

    Output (rung, id…) — a row of part p belongs to rungs p .. rungs-1.
    """
    ts = lambda n: [ceil_share(n, Fraction(1, factor ** (rungs - 1 - r))) for r in range(rungs - 1)]
    out = hash_parts(df, id_col, seed, ts)
    return out.withColumn("rung", F.explode(F.sequence(F.col("part"), F.lit(rungs - 1)))).drop("part")
