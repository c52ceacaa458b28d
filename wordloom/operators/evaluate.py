"""Agreement metrics (E1-E11) from confusion counts, all levels in one job.

Every metric is a formula over the four counts of a ``groupBy`` with
conditional sums, so the data is read once for any number of levels and
metrics.  Undefined ratios follow the usual report convention: precision,
recall and F1 are 0 when their denominator is 0; kappa and AUC are null
when only one class is present.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import ROUND_DIGITS
from ..session import checked_broadcast, reliable_checkpoint


# Distinct scores that one window of the score AUC ranks.


def _r(c: Column, digits: int | None = ROUND_DIGITS) -> Column:
    return F.round(c, digits) if digits is not None else c


def confusion(df: DataFrame, group: list[str], y: str = "y", yhat: str = "yhat") -> DataFrame:
    """(group…, tp, fp, fn, tn, n) as longs."""
    yc, pc = F.col(y), F.col(yhat)

    def c(cond: Column) -> Column:
        return F.sum(F.when(cond, 1).otherwise(0)).cast("long")

    return df.groupBy(*group).agg(
        c((yc == 1) & (pc == 1)).alias("tp"),
        c((yc == 0) & (pc == 1)).alias("fp"),
        c((yc == 1) & (pc == 0)).alias("fn"),
        c((yc == 0) & (pc == 0)).alias("tn"),
        F.count(F.lit(1)).alias("n"),
    )


def _div0(num: Column, den: Column) -> Column:
    """num / den, 0.0 when den is 0."""
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


def accuracy() -> Column:
    return (F.col("tp") + F.col("tn")).cast("double") / F.col("n").cast("double")


def kappa() -> Column:
    # products of counts leave the range of long from some 3e9 rows on
    tp, fp, fn, tn, n = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn", "n"))
    expected_off = (tn + fp) * (fp + tp) + (fn + tp) * (tn + fn)
    return F.when(expected_off > 0, F.lit(1.0) - (fp + fn) * n / expected_off)


def auc_hard() -> Column:
    """AUC of 0/1 predictions = mean of the two recalls; null with one class."""
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return F.when(
        ((tp + fn) > 0) & ((tn + fp) > 0),
        (tp.cast("double") / (tp + fn).cast("double") + tn.cast("double") / (tn + fp).cast("double")) / F.lit(2.0),
    )


def f1_pos() -> Column:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return _div0(F.lit(2) * tp, F.lit(2) * tp + fp + fn)


def f1_neg() -> Column:
    tn, fp, fn = F.col("tn"), F.col("fp"), F.col("fn")
    return _div0(F.lit(2) * tn, F.lit(2) * tn + fp + fn)


def with_gold(predictions: DataFrame, gold: DataFrame, keys: list[str], y: str = "y") -> DataFrame:
    """Predictions joined with the gold labels by key; a prediction without a label has no part."""
    return predictions.drop(y).join(gold.select(*keys, y), keys)


def headline(df: DataFrame, group: list[str], y: str = "y", yhat: str = "yhat",
             digits: int | None = ROUND_DIGITS) -> DataFrame:
    """Accuracy, kappa, hard AUC and F1 per group — the shape of the published table."""
    c = confusion(df, group, y, yhat)
    return c.select(
        *group,
        _r(accuracy(), digits).alias("accuracy"),
        _r(kappa(), digits).alias("kappa"),
        _r(auc_hard(), digits).alias("auc"),
        _r(f1_pos(), digits).alias("f1"),
    )


def single_metric(df: DataFrame, group: list[str], metric: str, digits: int | None = ROUND_DIGITS) -> DataFrame:
    c = confusion(df, group)
    expr = {"accuracy": accuracy(), "kappa": kappa(), "auc_hard": auc_hard(), "f1": f1_pos(),
            "f1_macro": (f1_pos() + f1_neg()) / F.lit(2.0)}[metric]
    return c.select(*group, _r(expr, digits).alias("value"))


def f1_micro(df: DataFrame, digits: int | None = ROUND_DIGITS) -> DataFrame:
    """Micro F1: counts summed over all labels first."""
    c = confusion(df, [])
    return c.select(_r(f1_pos(), digits).alias("value"))


def subset_accuracy(df: DataFrame, id_cols: list[str], digits: int | None = ROUND_DIGITS) -> DataFrame:
    """Exact-match accuracy of label vectors: a row counts only if every label agrees."""
    per = df.groupBy(*id_cols).agg(F.min(F.when(F.col("y") == F.col("yhat"), 1).otherwise(0)).alias("_ok"))
    return per.agg(_r(F.avg(F.col("_ok").cast("double")), digits).alias("value"))


def report_binary(df: DataFrame, group: list[str], digits: int | None = ROUND_DIGITS) -> DataFrame:
    """Per class 0/1: precision, recall, F1, support; plus accuracy, macro and weighted average rows."""
    c = confusion(df, group)
    p1, r1, f1 = _div0(F.col("tp"), F.col("tp") + F.col("fp")), _div0(F.col("tp"), F.col("tp") + F.col("fn")), f1_pos()
    p0, r0, f0 = _div0(F.col("tn"), F.col("tn") + F.col("fn")), _div0(F.col("tn"), F.col("tn") + F.col("fp")), f1_neg()
    s1 = (F.col("tp") + F.col("fn")).cast("long")
    s0 = (F.col("tn") + F.col("fp")).cast("long")
    n = F.col("n")

    def row(name: str, p: Column | None, r: Column | None, f: Column, s: Column) -> Column:
        none = F.lit(None).cast("double")
        return F.struct(
            F.lit(name).alias("row_name"),
            _r(p, digits).alias("precision") if p is not None else none.alias("precision"),
            _r(r, digits).alias("recall") if r is not None else none.alias("recall"),
            _r(f, digits).alias("f1"),
            s.alias("support"),
        )

    def wavg(a: Column, b: Column) -> Column:
        return (a * s0 + b * s1) / n

    rows = F.array(
        row("0", p0, r0, f0, s0),
        row("1", p1, r1, f1, s1),
        row("accuracy", None, None, accuracy(), n),
        row("macro avg", (p0 + p1) / F.lit(2.0), (r0 + r1) / F.lit(2.0), (f0 + f1) / F.lit(2.0), n),
        row("weighted avg", wavg(p0, p1), wavg(r0, r1), wavg(f0, f1), n),
    )
    return c.select(*group, F.explode(rows).alias("r")).select(*group, "r.*")


def report_multilabel(df: DataFrame, id_cols: list[str], level_col: str = "level",
                      levels: list[str] | None = None, digits: int | None = ROUND_DIGITS) -> DataFrame:
    """Per-label rows plus micro, macro, weighted and samples averages."""
    per = confusion(df, [level_col]).select(
        F.col(level_col).alias("row_name"),
        _div0(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        _div0(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
        f1_pos().alias("f1"),
        (F.col("tp") + F.col("fn")).cast("long").alias("support"),
        "tp", "fp", "fn",
    ).cache()
    micro = per.agg(
        F.lit("micro avg").alias("row_name"),
        _div0(F.sum("tp"), F.sum("tp") + F.sum("fp")).alias("precision"),
        _div0(F.sum("tp"), F.sum("tp") + F.sum("fn")).alias("recall"),
        _div0(F.lit(2) * F.sum("tp"), F.lit(2) * F.sum("tp") + F.sum("fp") + F.sum("fn")).alias("f1"),
        F.sum("support").cast("long").alias("support"),
    )
    macro = per.agg(
        F.lit("macro avg").alias("row_name"),
        F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"),
        F.sum("support").cast("long").alias("support"),
    )
    tot = F.sum("support").cast("double")
    weighted = per.agg(
        F.lit("weighted avg").alias("row_name"),
        _div0(F.sum(F.col("precision") * F.col("support")), tot).alias("precision"),
        _div0(F.sum(F.col("recall") * F.col("support")), tot).alias("recall"),
        _div0(F.sum(F.col("f1") * F.col("support")), tot).alias("f1"),
        F.sum("support").cast("long").alias("support"),
    )
    per_row = df.groupBy(*id_cols).agg(
        F.sum(F.when((F.col("y") == 1) & (F.col("yhat") == 1), 1).otherwise(0)).alias("_both"),
        F.sum(F.col("y")).alias("_ny"),
        F.sum(F.col("yhat")).alias("_np"),
    )
    samples = per_row.agg(
        F.lit("samples avg").alias("row_name"),
        F.avg(_div0(F.col("_both"), F.col("_np"))).alias("precision"),
        F.avg(_div0(F.col("_both"), F.col("_ny"))).alias("recall"),
        F.avg(_div0(F.lit(2) * F.col("_both"), F.col("_ny") + F.col("_np"))).alias("f1"),
        F.sum("_ny").cast("long").alias("support"),
    )
    out = per.drop("tp", "fp", "fn").unionByName(micro).unionByName(macro).unionByName(weighted).unionByName(samples)
    return out.select(
        "row_name",
        *[_r(F.col(c), digits).alias(c) for c in ("precision", "recall", "f1")],
        "support",
    )


def auc_scores(df: DataFrame, group: list[str], y: str = "y", score: str = "score", n_buckets: int | None = None,
               digits: int | None = ROUND_DIGITS) -> DataFrame:
    """ROC AUC of scores per group; tied scores count one half.

    AUC = Σ_s pos_s · (2·neg_below_s + neg_s) / (2·P·N) over distinct scores s.
    Distinct scores are collapsed first (partial aggregation) and dealt by ranges of (group, score) to ``n_buckets``
    partitions (the session's number by default), whose rows are written once.  A partition's negatives of a group
    are counted, the counts of the partitions before are a row's offset, and each partition adds its own running sum:
    no window spans a group, and nothing that grows with the scores reaches the driver.
    """
    per = df.groupBy(*group, score).agg(
        F.sum(F.col(y).cast("long")).alias("_pos"),
        (F.count(F.lit(1)) - F.sum(F.col(y).cast("long"))).alias("_neg"),
    )
    order = [*group, score]
    ranged = per.repartitionByRange(*([n_buckets] if n_buckets else []), *order).sortWithinPartitions(*order)
    # the high bits of the id are the partition
    ranged = reliable_checkpoint(ranged.withColumn("_part", F.shiftright(F.monotonically_increasing_id(), 33)))
    totals = ranged.groupBy(*group, "_part").agg(F.sum("_neg").alias("_pneg"))
    if group:  # at most a row per partition and group that meets it
        before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        offsets = totals.select(*group, "_part", F.coalesce(F.sum("_pneg").over(before), F.lit(0)).alias("_off"))
    else:
        rows, below = [], 0
        for r in sorted(totals.collect()):
            rows.append((r["_part"], below))
            below += r["_pneg"]
        offsets = df.sparkSession.createDataFrame(rows, "_part long, _off long")
    offsets = checked_small(offsets.select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)),
                                           F.col("_part").alias("_p"), "_off"))
    same = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    within = Window.partitionBy(*group, "_part").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranged.withColumn("_own", F.coalesce(F.sum("_neg").over(within), F.lit(0))).join(offsets, same).withColumn(
        "_below", F.col("_off") + F.col("_own"))
    agg = ranked.groupBy(*group).agg(
        F.sum(F.col("_pos").cast("double") * (F.lit(2.0) * F.col("_below") + F.col("_neg"))).alias("_num"),
        F.sum("_pos").alias("_p"),
        F.sum("_neg").alias("_n"),
    )
    auc = F.when(
        (F.col("_p") > 0) & (F.col("_n") > 0),
        F.col("_num").cast("double") / (F.lit(2.0) * F.col("_p").cast("double") * F.col("_n").cast("double")),
    )
    return agg.select(*group, _r(auc, digits).alias("auc"))


def checked_small(df: DataFrame) -> DataFrame:
    return checked_broadcast(df)
