"""Lexicon scoring: token → entry match, category counts and percentages.

Match rule (one entry per token):
  1. the wildcard entry with the *shortest* stem that is a prefix of the token
     (a stem matches itself), even if a longer exact entry exists;
  2. otherwise the exact entry equal to the token;
  3. otherwise no match.

Plan shape.  The reference walks a character trie per token.  Here the trie
becomes a chain of broadcast hash joins, one per distinct wildcard stem length
``L`` (key ``substring(token, 1, L)``), plus one exact join, then
``coalesce`` in the order of rule 1-2.  The joins are narrow, so matching
every token occurrence costs hash probes inside one codegen stage and the
only shuffle is the final ``(doc_id, category)`` count, which is partially
aggregated map-side (a document lives in one partition).  Frequent words do
not skew anything: no exchange is keyed by token.

If a lexicon ever exceeds the broadcast bound, matching switches to the
distinct-token path: resolve the distinct tokens with shuffle joins, then join
back by token (AQE splits hot tokens).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import ROUND_DIGITS
from ..functions.text import explode_rows, lexicon_tokens
from ..session import BROADCAST_ROW_LIMIT, within_broadcast_bounds
from ..sources.lexicon import (
    LexiconTables,
    builtin_lexicon_text,
    check_not_empty,
    entry_categories,
    lexicon_text_frame,
    parse_lexicon,
    read_lexicon_files,
)


@dataclass
class Lexicon:
    """Parsed lexicon: small tables plus the driver-side facts needed to build match plans."""

    categories: DataFrame  # cat_id, category, pos
    entry_cats: DataFrame  # entry_no, pattern, stem, is_prefix, category, cat_pos
    entries: DataFrame  # entry_no, pattern, stem, is_prefix, cats array<string>
    stem_lengths: list[int]
    category_names: list[str]
    n_entries: int
    broadcast_ok: bool = True
    treebank: bool = False  # tokenizer option: split fused words and pad typographic quotes

    def with_treebank_tokens(self) -> "Lexicon":
        return replace(self, treebank=True)

    @classmethod
    def from_tables(cls, tables: LexiconTables, strict: bool = True) -> "Lexicon":
        """Resolve entries with Spark, then keep the (checked, small) result as local relations.

        One job parses and resolves the file; if the entry count is within the
        broadcast bound the rows are brought to the driver once and re-created
        as local relations, so every later match plan broadcasts a literal
        table instead of re-running the parse.  Beyond the bound the tables
        stay distributed and matching uses shuffle joins.
        """
        from ..sources.lexicon import resolved_entries

        if strict:
            check_not_empty(tables)
        # categories in the order of their files and lines; one name is one category
        places = {n: i for i, n in enumerate(dict.fromkeys(
            r["category"] for r in tables.categories.orderBy("source", "pos").select("category").collect()))}
        spark = tables.entries.sparkSession
        categories = spark.createDataFrame(list(places.items()), "category string, pos int")
        named = LexiconTables(tables.categories.drop("pos").join(categories, "category"), tables.entries)
        ec = entry_categories(named, strict=strict)
        res = resolved_entries(tables).drop("ids")
        cats_per_entry = ec.groupBy("source", "entry_no").agg(
            F.sort_array(F.collect_list(F.struct("id_pos", "category", "cat_pos"))).alias("c")
        ).select("source", "entry_no", F.col("c.category").alias("cats"), F.col("c.cat_pos").alias("cat_poss"))
        entries = res.join(cats_per_entry, ["source", "entry_no"], "left").select(
            "entry_no", "pattern", "stem", "is_prefix",
            F.coalesce(F.col("cats"), F.array().cast("array<string>")).alias("cats"),
            F.coalesce(F.col("cat_poss"), F.array().cast("array<int>")).alias("cat_poss"),
        )
        ids = tables.categories.groupBy("category").agg(F.min("cat_id").alias("cat_id"))
        categories = categories.join(ids, "category").select("cat_id", "category", "pos")
        # the resolved entries are computed once: counted, then (within the bound) read from the cache
        entries = entries.cache()
        categories = categories.cache()
        n_entries = entries.count()
        small = within_broadcast_bounds(entries, n_entries)
        if small:
            entry_rows = entries.collect()
            cat_rows = categories.collect()
            entries.unpersist()
            categories.unpersist()
            entries = spark.createDataFrame(entry_rows, entries.schema)
            categories = spark.createDataFrame(cat_rows, categories.schema)
            lengths = sorted({len(r["stem"]) for r in entry_rows if r["is_prefix"]})
            names = [r["category"] for r in sorted(cat_rows, key=lambda r: r["pos"])]
        else:
            lengths = sorted(
                r[0] for r in entries.filter("is_prefix").select(F.length("stem")).distinct().collect()
            )
            names = [r["category"] for r in categories.orderBy("pos").select("category").collect()]
        entry_cats = entries.select(
            "entry_no", "pattern", "stem", "is_prefix",
            F.explode(F.arrays_zip(F.col("cats").alias("category"), F.col("cat_poss").alias("cat_pos"))).alias("z"),
        ).select("entry_no", "pattern", "stem", "is_prefix", "z.category", "z.cat_pos")
        return cls(
            categories=categories,
            entry_cats=entry_cats,
            entries=entries.drop("cat_poss"),
            stem_lengths=lengths,
            category_names=names,
            n_entries=n_entries,
            broadcast_ok=small,
        )

    @classmethod
    def builtin(cls, spark: SparkSession) -> "Lexicon":
        return cls.from_tables(parse_lexicon(lexicon_text_frame(spark, builtin_lexicon_text())))

    @classmethod
    def from_text(cls, spark: SparkSession, text: str, strict: bool = True, lowercase_patterns: bool = True) -> "Lexicon":
        return cls.from_tables(parse_lexicon(lexicon_text_frame(spark, text), lowercase_patterns), strict=strict)

    @classmethod
    def read(cls, spark: SparkSession, path: str, strict: bool = True, lowercase_patterns: bool = True) -> "Lexicon":
        return cls.from_tables(parse_lexicon(read_lexicon_files(spark, path), lowercase_patterns), strict=strict)

    def _side(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self.broadcast_ok else df


def match_column(df: DataFrame, token_col: str, lex: Lexicon) -> DataFrame:
    """Add ``match_pattern`` (null = no match) and ``match_cats`` (array of categories) to every row."""
    out = df
    pattern_cols: list[Column] = []
    cats_cols: list[Column] = []
    tok = F.col(token_col)
    for i, length in enumerate(lex.stem_lengths):
        side = lex._side(
            lex.entries.filter(F.col("is_prefix") & (F.length("stem") == length)).select(
                F.col("stem").alias(f"_k{i}"), F.col("pattern").alias(f"_p{i}"), F.col("cats").alias(f"_c{i}")
            )
        )
        out = out.join(side, F.substring(tok, 1, length) == F.col(f"_k{i}"), "left")
        pattern_cols.append(F.col(f"_p{i}"))
        cats_cols.append(F.col(f"_c{i}"))
    exact = lex._side(
        lex.entries.filter(~F.col("is_prefix")).select(
            F.col("stem").alias("_kx"), F.col("pattern").alias("_px"), F.col("cats").alias("_cx")
        )
    )
    out = out.join(exact, tok == F.col("_kx"), "left")
    pattern_cols.append(F.col("_px"))
    cats_cols.append(F.col("_cx"))
    drop = [c for i in range(len(lex.stem_lengths)) for c in (f"_k{i}", f"_p{i}", f"_c{i}")] + ["_kx", "_px", "_cx"]
    return out.withColumn("match_pattern", F.coalesce(*pattern_cols)).withColumn(
        "match_cats", F.coalesce(*cats_cols)
    ).drop(*drop)


def match_tokens(df: DataFrame, token_col: str, lex: Lexicon) -> DataFrame:
    """Match rule applied to a token column; picks the plan by lexicon size."""
    if lex.broadcast_ok:
        return match_column(df, token_col, lex)
    distinct = df.select(F.col(token_col)).distinct()
    resolved = match_column(distinct, token_col, lex)
    return df.join(resolved, token_col, "left")


def doc_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", outer: bool = False,
               treebank: bool = False) -> DataFrame:
    """(id, n_tokens, token) — one row per token occurrence.

    Texts without tokens give no rows, or with ``outer`` one row with a null
    token, so per-document results need no join back to the document ids.
    """
    t = docs.select(F.col(id_col), lexicon_tokens(text_col, treebank).alias("_toks"))
    keep = [F.col(id_col), F.size("_toks").cast("long").alias("n_tokens")]
    if outer:
        return t.select(*keep, F.explode_outer("_toks").alias("token"))
    return explode_rows(t, keep, F.col("_toks"), "token")


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", treebank: bool = False) -> DataFrame:
    """(id, n_tokens) for every input row, 0 for empty or missing text."""
    return docs.select(F.col(id_col), F.size(lexicon_tokens(text_col, treebank)).cast("long").alias("n_tokens"))


def category_counts(docs: DataFrame, lex: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, category, cnt): each matched token adds 1 to each category of its entry."""
    m = match_tokens(doc_tokens(docs, id_col, text_col, treebank=lex.treebank), "token", lex)
    return (
        m.filter(F.col("match_pattern").isNotNull())
        .select(F.col(id_col), "n_tokens", F.explode("match_cats").alias("category"))
        .groupBy(id_col, "n_tokens", "category")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def entry_matches(docs: DataFrame, lex: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(pattern, n_matches): token occurrences each resolved entry matches; the aggregate is keyed by
    entry (bounded by the lexicon) and combined map-side, so frequent words do not skew it."""
    m = match_tokens(doc_tokens(docs, id_col, text_col, treebank=lex.treebank), "token", lex)
    return (
        m.filter(F.col("match_pattern").isNotNull())
        .groupBy(F.col("match_pattern").alias("pattern"))
        .agg(F.count(F.lit(1)).alias("n_matches"))
    )


def category_scores(docs: DataFrame, lex: Lexicon, id_col: str = "doc_id", text_col: str = "text",
                    digits: int | None = ROUND_DIGITS) -> DataFrame:
    """(id, category, score) with score = 100 * cnt / all tokens of the text (unmatched included)."""
    c = category_counts(docs, lex, id_col, text_col)
    score = F.lit(100.0) * F.col("cnt").cast("double") / F.col("n_tokens").cast("double")
    if digits is not None:
        score = F.round(score, digits)
    return c.select(F.col(id_col), "category", score.alias("score"))


def scores_wide(docs: DataFrame, lex: Lexicon, id_col: str = "doc_id", text_col: str = "text",
                digits: int | None = ROUND_DIGITS) -> DataFrame:
    """One row per input row, one column per lexicon category (file order), null where absent.

    Every document keeps at least one token row (``explode_outer``), so one
    aggregate per document yields all rows; the pivot uses the explicit
    category list (conditional sums, no job to discover values).
    """
    m = match_tokens(doc_tokens(docs, id_col, text_col, outer=True, treebank=lex.treebank), "token", lex)
    cats = m.select(F.col(id_col), "n_tokens", F.explode_outer("match_cats").alias("category"))
    wide = cats.groupBy(id_col, "n_tokens").pivot("category", lex.category_names).agg(F.sum(F.lit(1)))

    def score(c: str) -> Column:
        v = F.lit(100.0) * F.col(f"`{c}`").cast("double") / F.col("n_tokens").cast("double")
        return (F.round(v, digits) if digits is not None else v).alias(c)

    return wide.select(id_col, *[score(c) for c in lex.category_names])


def coverage(docs: DataFrame, lex: Lexicon, id_col: str = "doc_id", text_col: str = "text",
             digits: int | None = ROUND_DIGITS) -> DataFrame:
    """(id, n_tokens, n_matched, dic_pct): share of tokens matched by any entry (null for empty texts)."""
    m = match_tokens(doc_tokens(docs, id_col, text_col, outer=True, treebank=lex.treebank), "token", lex)
    out = m.groupBy(id_col, "n_tokens").agg(F.count("match_pattern").cast("long").alias("n_matched"))
    pct = F.when(F.col("n_tokens") > 0, F.lit(100.0) * F.col("n_matched") / F.col("n_tokens"))
    if digits is not None:
        pct = F.round(pct, digits)
    return out.select(id_col, "n_tokens", "n_matched", pct.alias("dic_pct"))


def distinct_token_matches(docs: DataFrame, lex: Lexicon, text_col: str = "text") -> DataFrame:
    """(token, pattern, category) for every distinct corpus token that has a matching entry."""
    toks = explode_rows(docs, [], lexicon_tokens(text_col, lex.treebank), "token").distinct()
    m = match_column(toks, "token", lex) if lex.broadcast_ok else match_tokens(toks, "token", lex)
    return m.filter(F.col("match_pattern").isNotNull()).select(
        "token", F.col("match_pattern").alias("pattern"), F.explode("match_cats").alias("category")
    )


def unmatched_tokens(docs: DataFrame, lex: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(token, n_docs) for tokens no entry matches (anti join against the matched set)."""
    per_doc = explode_rows(docs, [F.col(id_col)], F.array_distinct(lexicon_tokens(text_col, lex.treebank)), "token")
    m = match_tokens(per_doc, "token", lex)
    return (
        m.filter(F.col("match_pattern").isNull())
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n_docs"))
    )


# Punctuation columns of the surface statistics and their characters.
SURFACE_PUNCT = {
    "period": "[.]",
    "comma": "[,]",
    "colon": "[:]",
    "semic": "[;]",
    "qmark": "[?]",
    "exclam": "[!]",
    "dash": "[-]",
    "quote": "[\"]",
    "apostro": "[']",
    "parenth": "[()]",
    "otherp": "[#$%&*+/<=>@\\[\\\\\\]^_`{|}~]",
}


def surface_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  digits: int | None = ROUND_DIGITS, treebank: bool = False) -> DataFrame:
    """Word count, words per sentence, share of long words and punctuation per 100 words."""
    from ..functions.text import ASCII_PUNCT_CLASS, count_matches, sentence_marks

    toks = lexicon_tokens(text_col, treebank)
    base = docs.select(
        F.col(id_col),
        F.col(text_col),
        F.size(toks).cast("long").alias("wc"),
        F.size(F.filter(toks, lambda t: F.length(t) > 6)).alias("_six"),
        F.greatest(F.lit(1).cast("long"), sentence_marks(text_col)).alias("_sent"),
    )

    def per100(c: Column) -> Column:
        v = F.when(F.col("wc") > 0, F.lit(100.0) * c.cast("double") / F.col("wc"))
        return F.round(v, digits) if digits is not None else v

    wps = F.when(F.col("wc") > 0, F.col("wc").cast("double") / F.col("_sent"))
    if digits is not None:
        wps = F.round(wps, digits)
    cols = [
        F.col(id_col),
        "wc",
        wps.alias("wps"),
        per100(F.col("_six")).alias("sixltr"),
        per100(count_matches(text_col, ASCII_PUNCT_CLASS)).alias("allpunc"),
    ]
    cols += [per100(count_matches(text_col, cls)).alias(name) for name, cls in SURFACE_PUNCT.items()]
    return base.select(*cols)


def scores_by_label(docs: DataFrame, labels: DataFrame, lex: Lexicon, label_col: str,
                    id_col: str = "doc_id", digits: int | None = ROUND_DIGITS) -> DataFrame:
    """Mean category percentage per label class (absent category = 0) and documents with the category.

    Texts are scored where they lie (narrow); only the small per-document
    counts and the id/label pairs are shuffled for the join, never the text.  Texts without a label
    are left out before they are cut into tokens, where the labelled ids can be broadcast.
    """
    known = labels.select(id_col).where(F.col(id_col).isNotNull()).distinct()
    if known.limit(BROADCAST_ROW_LIMIT + 1).count() <= BROADCAST_ROW_LIMIT:
        docs = docs.join(F.broadcast(known), id_col, "left_semi")
    labelled = labels.select(id_col, label_col).join(docs.select(id_col), id_col)
    class_sizes = labelled.groupBy(label_col).agg(F.count(F.lit(1)).alias("_n"))
    counts = category_counts(docs, lex, id_col)
    score = F.lit(100.0) * F.col("cnt").cast("double") / F.col("n_tokens").cast("double")
    per = counts.join(labelled, id_col).groupBy(label_col, "category").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(score).alias("_sum")
    )
    mean = F.col("_sum") / F.col("_n")
    if digits is not None:
        mean = F.round(mean, digits)
    # class_sizes has one row per label value; AQE's runtime size check decides whether to broadcast it
    return per.join(class_sizes, label_col).select(label_col, "category", "n_docs", mean.alias("mean_score"))
