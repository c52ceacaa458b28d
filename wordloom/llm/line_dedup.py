"""Line dedup by site-relative frequency.

A line is boilerplate of a host when the pages of that host that hold it are
more than ``ratio`` of all its pages.  Pages are counted once per line however
often it repeats in a page.  Everything is a DataFrame expression:

* (host, md5 of the trimmed line) counts: one shuffle of 16-byte keys, combined
  map-side, so neither a hot host nor a hot line meets in one task;
* the boilerplate lines per host: fewer than (mean lines a page) / ratio of them
  can exceed the ratio, whatever the host's size, so a list per host is bounded;
* a page's own lines are intersected with its host's list by hash, and its lines are filtered by the few that are
  left; texts are shuffled only when the lists of all hosts together pass the broadcast bound.

``page`` names what counts as one page: before a stage that removes copies, pages with the same value (the
group of near copies that they belong to) are one page of their host, or a group of copies would make its own lines boilerplate
and lose them; a page whose every line is boilerplate then stays as it is, for that stage to judge.

Defined results: a null text stays null and counts as a page; blank lines are
never boilerplate; a page whose every line is boilerplate keeps an empty text, without ``page``;
pages with a null host have no site and stay as they are; repeated rows are
pages of their own without ``page``; rows whose ``page`` is null are one page of their host; further columns are carried
through, whatever their names (columns called ``_n_lines`` and ``_n_dropped`` are replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, small_side, stored

RATIO = 0.1
MIN_PAGES = 3


def _key(line: Column) -> Column:
    return F.md5(F.trim(line))


def _keys(text: Column) -> Column:
    """Different keys of a text's lines that are not blank."""
    return F.array_distinct(F.transform(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), _key))


def boilerplate_lines(pages: DataFrame, host: str, text: str, ratio: float = RATIO,
                      min_pages: int = MIN_PAGES, page: str | None = None) -> DataFrame:
    """(_h, _k, _n, _np): host, 16-byte key, pages with the line and pages of the host, of the lines above the
    ratio and on ``min_pages`` pages at least."""
    src = pages.select(F.col(host).alias("_h"), F.col(text).alias("_t"),
                       (F.lit(None) if page is None else F.col(page)).alias("_p")).where("_h is not null")
    lines = src.select("_h", "_p", F.explode_outer(_keys(F.col("_t"))).alias("_k")).where("_k is not null")
    lines = lines.select("_h", "_p", F.unhex("_k").alias("_k"))
    if page is not None:
        lines, src = lines.distinct(), src.select("_h", "_p").distinct()
    totals = src.groupBy("_h").agg(F.count(F.lit(1)).alias("_np"))
    counts = lines.groupBy("_h", "_k").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_pages)
    return counts.join(totals, "_h").where(F.col("_n") > F.lit(ratio) * F.col("_np"))


def line_dedup(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO,
               min_pages: int = MIN_PAGES, page: str | None = None) -> DataFrame:
    """``pages`` with boilerplate lines removed from ``text``, plus ``_n_lines`` and ``_n_dropped`` (long).

    ``page``: a column whose equal values are one page, and pages of boilerplate only stay whole.
    """
    site, drop, hits, kept = fresh(pages, "site", "drop", "hits", "kept")
    lists = boilerplate_lines(pages, host, text, ratio, min_pages, page).groupBy(F.col("_h").alias(site)).agg(
        F.collect_list(F.lower(F.hex("_k"))).alias(drop))
    lists = small_side(stored(lists, "boilerplate"))
    joined = pages.join(lists, F.col(host) == F.col(site), "left")
    lines = F.split(F.col(text), "\n")
    joined = joined.withColumn(hits, F.when(F.col(drop).isNotNull(), F.array_intersect(_keys(F.col(text)), F.col(drop))))
    # a page without a hit is not looked at line by line
    hit = F.coalesce(F.size(hits) > 0, F.lit(False))
    left = F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col(hits), _key(x)))
    if page is not None:
        left = F.when(F.exists(left, lambda x: F.trim(x) != ""), left).otherwise(lines)
    joined = joined.withColumn(kept, F.when(hit, left).otherwise(lines))
    n_lines = F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long")
    n_kept = F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(kept)).cast("long")
    return (joined.withColumn("_n_lines", n_lines).withColumn("_n_dropped", n_lines - n_kept)
            .withColumn(text, F.when(hit, F.array_join(kept, "\n")).otherwise(F.col(text)))
            .drop(site, drop, hits, kept))
