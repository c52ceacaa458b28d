"""Lexicon reader: a category section and an entry section, each opened by a ``%`` line.

Layout::

    %  (any line starting with %)
    <id> <name>           one category per line, file order = category order
    %
    <pattern> <id> <id>…  one entry per line; ``stem*`` matches every token starting with stem

A line with a tab is split on tabs, so names and patterns may hold blanks; other lines are split on
blanks, and the name is the rest of the line.  Patterns lose the punctuation that texts lose
(``can't`` becomes ``cant``), but for ``*``.  Several files are read in the order of their names:
categories of one name are one, and of entries with one stem the last wins.  Parsing is a Spark plan over the file
text: ``wholetext`` read → array of lines → section number from the positions
of the ``%`` lines → ``posexplode``.  A lexicon is a hand-written word list
(kilobytes), so both result tables are small and later broadcast after a
row-count check.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
BUILTIN_LEXICON = os.path.join(_HERE, "resources", "levels.dic")

_FIELD_SEP = "[ \\t]+"
# ASCII punctuation without the star.
PATTERN_PUNCT_CLASS = "[!-)+-/:-@\\[-`{-~]"
_EDGE_BLANKS = "^[ \\t\\r\\n\\f]+|[ \\t\\r\\n\\f]+$"


def builtin_lexicon_text() -> str:
    with open(BUILTIN_LEXICON, encoding="utf-8") as fh:
        return fh.read()


def lexicon_text_frame(spark: SparkSession, text: str, source: str = "builtin") -> DataFrame:
    """One row (source, value) holding a whole lexicon file, for lexicons kept on the driver."""
    return spark.createDataFrame([(source, text)], "source string, value string")


def read_lexicon_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per lexicon file on shared storage: (source, value)."""
    return (
        spark.read.text(path, wholetext=True)
        .select(F.input_file_name().alias("source"), F.col("value"))
    )


@dataclass
class LexiconTables:
    categories: DataFrame  # source, cat_id, category, pos
    entries: DataFrame  # source, entry_no, pattern, stem, is_prefix, ids (array<string>)


def parse_lexicon(files: DataFrame, lowercase_patterns: bool = True) -> LexiconTables:
    """Parse (source, value) rows into category and entry tables.

    Any line starting with ``%`` switches section; blank lines are skipped.
    """
    lines = F.filter(
        F.transform(F.split(F.col("value"), "\n"), lambda l: F.regexp_replace(l, _EDGE_BLANKS, "")),
        lambda l: l != F.lit(""),
    )
    base = files.select("source", lines.alias("lines"))
    # 0-based positions of the section marks
    marks = F.filter(
        F.transform(F.col("lines"), lambda l, i: F.when(F.startswith(l, F.lit("%")), i).otherwise(F.lit(-1))),
        lambda i: i >= 0,
    )
    base = base.select("source", "lines", marks.alias("marks"))
    exploded = base.select(
        "source",
        "marks",
        F.posexplode("lines").alias("line_pos", "line"),
    ).select(
        "source",
        "marks",
        "line_pos",
        "line",
        F.size(F.filter(F.col("marks"), lambda m: m <= F.col("line_pos"))).alias("section"),
        F.when(F.col("line").contains("\t"), F.transform(
            F.split(F.col("line"), "\t"), lambda x: F.regexp_replace(x, _EDGE_BLANKS, "")))
        .otherwise(F.split(F.col("line"), _FIELD_SEP)).alias("parts"),
    ).filter(~F.startswith(F.col("line"), F.lit("%")))

    # Blank lines were removed before numbering, so the category lines directly follow the first
    # section mark of their file: position = line number - first mark - 1 (dense, no aggregate).
    categories = exploded.filter(F.col("section") == 1).select(
        "source",
        F.col("parts")[0].alias("cat_id"),
        F.array_join(F.filter(F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0))), lambda x: x != ""), " ")
        .alias("category"),
        (F.col("line_pos") - F.element_at("marks", 1) - 1).alias("pos"),
    )

    bare = F.regexp_replace(F.col("parts")[0], PATTERN_PUNCT_CLASS, "")
    # a pattern of nothing but punctuation is a mark of the tokenizer's own, as its quote tokens
    pattern = F.when(bare == "", F.col("parts")[0]).otherwise(bare)
    if lowercase_patterns:
        pattern = F.lower(pattern)
    entries = exploded.filter(F.col("section") == 2).select(
        "source",
        F.col("line_pos").alias("entry_no"),
        pattern.alias("pattern"),
        # ids of a tab-separated line may be set apart by blanks as well
        F.filter(F.flatten(F.transform(
            F.slice(F.col("parts"), 2, F.greatest(F.size("parts") - 1, F.lit(0))), lambda x: F.split(x, _FIELD_SEP))),
            lambda x: x != "").alias("ids"),
    ).select(
        "source",
        "entry_no",
        "pattern",
        F.substring_index(F.col("pattern"), "*", 1).alias("stem"),
        F.col("pattern").contains("*").alias("is_prefix"),
        "ids",
    )
    return LexiconTables(categories=categories, entries=entries)


def resolved_entries(tables: LexiconTables) -> DataFrame:
    """Entries after the overwrite rule: one per (is_prefix, stem), the last line of the last file wins.

    Two wildcard patterns with the same stem collide (text after the first ``*`` is ignored), as do repeated
    exact patterns.
    """
    e = tables.entries
    last = e.groupBy("is_prefix", "stem").agg(F.max(F.struct("source", "entry_no")).alias("last"))
    return e.join(last.select("is_prefix", "stem", "last.source", "last.entry_no"),
                  ["source", "is_prefix", "stem", "entry_no"])


def entry_categories(tables: LexiconTables, strict: bool = True) -> DataFrame:
    """(source, entry_no, pattern, stem, is_prefix, category, cat_pos) for the resolved entries.

    An id without a category is an error; with ``strict=False`` it is dropped.
    """
    e = resolved_entries(tables).select(
        "source", "entry_no", "pattern", "stem", "is_prefix", F.posexplode("ids").alias("id_pos", "cat_id")
    )
    joined = e.join(tables.categories.withColumnRenamed("pos", "cat_pos"), ["source", "cat_id"], "left")
    if strict:
        bad = joined.filter(F.col("category").isNull()).limit(1).collect()
        if bad:
            raise ValueError(f"lexicon entry {bad[0]['pattern']!r} names unknown category id {bad[0]['cat_id']!r}")
    return joined.filter(F.col("category").isNotNull()).drop("cat_id")


def check_not_empty(tables: LexiconTables) -> None:
    """Strict mode: an empty lexicon is an error rather than a silent no-op."""
    if not tables.entries.limit(1).collect():
        raise ValueError("lexicon has no entries")
