"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells (source, language, topic).  The token weights of the
cells are raked in turn to the target shares of each margin, and a document is
then kept with the probability by which its cell was scaled (the largest scale
is 1), decided by a hash of its id.  Only DataFrame functions are used:

* one map-side combined aggregate gives the cells; hot sources shrink to cells there;
* each raking step is an aggregate and a join of the cell table, which is stored
  after each step; texts are not touched by the iterations;
* the scaled cells are joined back to the documents with a size-checked broadcast.

Defined results: a null margin value is a category of its own; a null text has
weight 0 and is kept by its cell's probability; a margin whose categories hold no tokens is left
as it is; a document whose id is null is decided by the hash of the empty
string; repeated rows get the same decision; further columns are carried through, whatever their names (columns
called ``_weight``, ``_prob`` and ``_kept`` are replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, small_side, stored

NONE = "(none)"
SWEEPS = 8
# target share of a category = its observed share to this power, over their sum
TEMPERATURES = {"source": 0.9, "lang": 0.9, "topic": 1.0}


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^ \n]+")), F.lit(0)).cast("long")


def topic(text: str = "text") -> Column:
    """Kind of text by its marks: table rows, shouting, short notes or prose."""
    t = F.coalesce(F.col(text), F.lit(""))
    bars = F.length(t) - F.length(F.replace(t, F.lit("|"), F.lit("")))
    bangs = F.length(t) - F.length(F.replace(t, F.lit("!!"), F.lit("")))
    n = n_words(text)
    return (F.when(bars * 5 >= n + 1, "table").when(bangs >= n + 1, "shout")
            .when(n < 50, "note").otherwise("prose"))


def tempered_targets(cells: DataFrame, margin: str, power: float) -> DataFrame:
    """(margin, share): observed token shares to ``power``, normalised; categories without tokens get none."""
    seen = cells.groupBy(margin).agg(F.sum("w").alias("s")).where("s > 0")
    seen = seen.withColumn("s", F.pow(F.col("s").cast("double"), F.lit(power)))
    total = seen.agg(F.sum("s")).first()[0] or 1.0
    return seen.select(margin, (F.col("s") / F.lit(total)).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = SWEEPS) -> DataFrame:
    """``cells`` (margins, w) with ``fit``: weights whose margins follow the targets, in ``sweeps`` sweeps."""
    total = cells.agg(F.sum("w").cast("double")).first()[0] or 0.0
    fitted = cells.withColumn("fit", F.col("w").cast("double"))
    for _ in range(sweeps):
        for margin, target in targets.items():
            scale = fitted.groupBy(margin).agg(F.sum("fit").alias("s")).join(target, margin).select(
                margin, F.when(F.col("s") > 0, F.col("share") * F.lit(total) / F.col("s")).otherwise(0.0).alias("f"))
            fitted = stored(
                fitted.join(scale, margin, "left").withColumn("fit", F.col("fit") * F.coalesce("f", F.lit(0.0)))
                .drop("f"), "raked")
    return fitted


def mix(docs: DataFrame, margins: dict[str, Column], weight: Column, powers: dict[str, float],
        targets: dict[str, DataFrame] | None = None, sweeps: int = SWEEPS, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with ``_weight``, ``_prob`` and ``_kept``.

    ``margins``: column by margin name; ``targets``: (margin, share) tables for margins that have
    explicit ones, else tempered observed shares by ``powers``.
    """
    keyed = docs.drop("_weight", "_prob", "_kept")
    names = dict(zip(margins, fresh(keyed, *(f"m_{m}" for m in margins)), strict=True))
    for m, col in margins.items():
        keyed = keyed.withColumn(names[m], F.coalesce(col.cast("string"), F.lit(NONE)))
    keyed = keyed.withColumn("_weight", weight)
    cells = stored(keyed.groupBy(*names.values()).agg(F.sum("_weight").alias("w")), "cells")
    wanted = {}
    for m, c in names.items():
        given = (targets or {}).get(m)
        wanted[c] = stored(given.select(F.col(m).alias(c), "share") if given is not None
                           else tempered_targets(cells, c, powers[m]), "targets")
    fitted = rake(cells, wanted, sweeps).withColumn("r", F.when(F.col("w") > 0, F.col("fit") / F.col("w")))
    top = fitted.agg(F.max("r")).first()[0] or 1.0
    # cells without tokens have nothing to weigh: their documents stay
    probs = fitted.select(*names.values(), F.coalesce(F.col("r") / F.lit(top), F.lit(1.0)).alias("_prob"))
    out = keyed.join(small_side(probs), list(names.values()), "left")
    u = F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, 8), 16, 10).cast(
        "double") / F.lit(4294967296.0)
    return out.withColumn("_kept", u < F.col("_prob")).drop(*names.values())
