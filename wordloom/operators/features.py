"""Text features (F1-F12): n-gram counts, TF-IDF, readability, feature matrix, sequences.

Fitted state is always a small table: a vocabulary of at most
``max_features`` terms (brought to the driver once, its size bounded by
construction), idf weights and the training-set size.  Transforming other
rows (test part, second table) joins with that state and never refits.

Two equivalent output forms:

* long rows ``(doc_id, term, value)`` — the exchange format and the oracle's;
* ML vectors — ``CountVectorizerModel`` from the fitted vocabulary,
  ``ElementwiseProduct`` by the idf weights and ``Normalizer(p=2)`` give the
  smoothed TF-IDF exactly, all JVM-side, then ``VectorAssembler``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import ROUND_DIGITS
from ..functions.stopwords import ENGLISH_STOPWORDS
from ..functions.text import explode_rows, with_readability, word_tokens
from ..session import reliable_checkpoint


def _r(c: Column, digits: int | None) -> Column:
    return F.round(c, digits) if digits is not None else c


UNI_COL = "_uni_toks"
BI_COL = "_bi_toks"


def add_token_columns(docs: DataFrame, text_col: str = "text", stopwords: list[str] | None = None,
                      bigram: bool = True, tokens: str | None = None) -> DataFrame:
    """Add ``_uni_toks`` (word tokens without stop words, order and duplicates kept) and ``_bi_toks``
    (adjacent pairs of the filtered tokens, so neighbours may not be adjacent in the text).

    Both are array functions on Spark's own strings: a hash-set lookup per token, and one string per pair.
    ``tokens``: a column that has the text's word tokens already; it is dropped.
    """
    words = ENGLISH_STOPWORDS if stopwords is None else stopwords
    wt = tokens or "_wt"
    df = docs if tokens else docs.withColumn(wt, word_tokens(text_col))
    df = df.withColumn(UNI_COL, F.filter(wt, lambda w: ~w.isin(list(words))) if words else F.col(wt)).drop(wt)
    if bigram:
        pairs = F.greatest(F.size(UNI_COL) - 1, F.lit(0))
        df = df.withColumn(BI_COL, F.zip_with(F.slice(UNI_COL, 1, pairs), F.slice(UNI_COL, 2, pairs),
                                              lambda a, b: F.concat(a, F.lit(" "), b)))
    return df


def _tok_col(n: int) -> str:
    if n not in (1, 2):
        raise ValueError("n must be 1 or 2")
    return UNI_COL if n == 1 else BI_COL


def term_counts(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text",
                stopwords: list[str] | None = None) -> DataFrame:
    """(id, term, n): occurrences of each n-gram per row (partial aggregation per partition)."""
    t = add_token_columns(docs, text_col, stopwords, bigram=n == 2)
    return (
        explode_rows(t, [F.col(id_col)], F.col(_tok_col(n)), "term")
        .groupBy(id_col, "term")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@dataclass
class Vocabulary:
    """Top terms by total count (ties: term ascending); positions in alphabetical order."""

    n: int  # n-gram order
    terms: list[str]  # alphabetical = vector positions
    table: DataFrame  # term, total, pos
    dfs: dict  # term -> training rows containing it
    totals: dict  # term -> total count

    @property
    def size(self) -> int:
        return len(self.terms)

    def top(self, k: int) -> "Vocabulary":
        """The vocabulary a fit with ``max_features = k`` would give: a prefix of the same ranking."""
        ranked = sorted(self.terms, key=lambda t: (-self.totals[t], t))[:k]
        rows = sorted((t, self.totals[t], self.dfs[t]) for t in ranked)
        return _vocabulary(self.table.sparkSession, self.n, rows)


def _vocabulary(spark, n: int, rows: list[tuple[str, int, int]]) -> Vocabulary:
    table = spark.createDataFrame(
        [(t, tot, i) for i, (t, tot, _) in enumerate(rows)], "term string, total long, pos int"
    )
    return Vocabulary(n=n, terms=[t for t, _, _ in rows], table=table, dfs={t: d for t, _, d in rows},
                      totals={t: tot for t, tot, _ in rows})


# Hash buckets per n-gram order, and how many of the fullest are counted by term, as a multiple of the terms asked for.
TERM_BUCKETS = 1 << 18
FULLEST = 4


def _ends(orders: list[int]) -> list[Column]:
    """Where the terms of each order end in the concatenation of the orders' arrays."""
    ends, end = [], F.lit(0)
    for n in orders:
        end = end + F.size(_tok_col(n))
        ends.append(end.alias(f"_e{len(ends)}"))
    return ends


def _order_at(place: Column, orders: list[int]) -> Column:
    out = F.lit(orders[-1])
    for i in range(len(orders) - 2, -1, -1):
        out = F.when(place < F.col(f"_e{i}"), orders[i]).otherwise(out)
    return out


def _bucket() -> Column:
    """Bucket of a term: the order times the number of buckets, plus a hash."""
    return (F.col("_g") * F.lit(TERM_BUCKETS) + F.pmod(F.xxhash64("term"), F.lit(TERM_BUCKETS))).cast("long")


def _candidate_stats(tokens: DataFrame, orders: list[int], buckets: DataFrame | None) -> DataFrame:
    """(_g, term, total, df) of the terms in ``buckets``, or of all: occurrences, and rows that hold the term."""
    cols = [F.col(_tok_col(n)) for n in orders]
    t = tokens.select(*_ends(orders), F.concat(*cols, *[F.array_distinct(c) for c in cols]).alias("_terms"))
    end = F.col(f"_e{len(orders) - 1}")
    rows = explode_rows(t, [F.col(f"_e{i}") for i in range(len(orders))], F.col("_terms"), ("_p", "term"))
    # after the occurrences come the distinct terms of each order; a bigram holds a blank, a word does not
    order = _order_at(F.col("_p"), orders) if len(orders) == 1 else F.when(
        F.col("_p") < end, _order_at(F.col("_p"), orders)).otherwise(F.when(F.instr("term", " ") > 0, 2).otherwise(1))
    rows = rows.select(order.alias("_g"), "term", (F.col("_p") < end).alias("_o"))
    if buckets is not None:
        rows = rows.withColumn("_b", _bucket()).join(F.broadcast(buckets.select("_b")), "_b", "left_semi")
    return rows.groupBy("_g", "term").agg(
        F.count(F.when(F.col("_o"), 1)).alias("total"), F.count(F.when(~F.col("_o"), 1)).alias("df"))


def fit_vocabularies(tokens: DataFrame, orders: list[int], max_features: int) -> list[Vocabulary]:
    """Fit several n-gram vocabularies on a frame from ``add_token_columns``, exactly, in two passes.

    Most n-grams are rare and nearly all bigrams differ, so a table of all terms grows beyond the texts.  The first pass
    counts occurrences by hash bucket, a table of bounded size.  The second counts terms, but only those in the fullest
    buckets: a term occurs at most as often as its bucket, so where the last term kept occurs at least as often as the
    least of these buckets no other term can displace it.  Where it occurs less often, its count is a bound that holds,
    and the pass is done once more with all buckets that reach it.  Only the kept terms reach the driver.
    """
    from pyspark import StorageLevel

    t = tokens.select(*_ends(orders), F.concat(*[F.col(_tok_col(n)) for n in orders]).alias("_terms"))
    rows = explode_rows(t, [F.col(f"_e{i}") for i in range(len(orders))], F.col("_terms"), ("_p", "term"))
    rows = rows.select(_order_at(F.col("_p"), orders).alias("_g"), "term")
    buckets = rows.groupBy(_bucket().alias("_b")).agg(F.count(F.lit(1)).alias("_cnt")).withColumn(
        "_g", F.floor(F.col("_b") / TERM_BUCKETS).cast("int")).persist(StorageLevel.MEMORY_AND_DISK)
    least = {}
    for n in orders:
        fullest = buckets.filter(F.col("_g") == n).orderBy(F.desc("_cnt")).select("_cnt").limit(FULLEST * max_features).collect()
        least[n] = fullest[-1]["_cnt"] if len(fullest) == FULLEST * max_features else 0
    found: dict[int, list] = {}
    left = list(orders)
    while left:
        full = F.lit(False)
        for n in left:
            full = full | ((F.col("_g") == n) & (F.col("_cnt") >= least[n]))
        # with a bound of one occurrence every bucket stays
        kept = None if all(least[n] <= 1 for n in left) else buckets.filter(full)
        stats = _candidate_stats(tokens, left, kept).persist(StorageLevel.MEMORY_AND_DISK)
        again = []
        for n in left:
            top = stats.filter(F.col("_g") == n).orderBy(F.desc("total"), F.asc("term")).limit(max_features).collect()
            last = top[-1]["total"] if len(top) == max_features else 0
            if last >= least[n]:
                found[n] = sorted((r["term"], int(r["total"]), int(r["df"])) for r in top)
            else:
                least[n] = last
                again.append(n)
        stats.unpersist()
        left = again
    buckets.unpersist()
    return [_vocabulary(tokens.sparkSession, n, found[n]) for n in orders]


def fit_vocabulary(tokens: DataFrame, n: int, max_features: int) -> Vocabulary:
    """One vocabulary (see ``fit_vocabularies``)."""
    return fit_vocabularies(tokens, [n], max_features)[0]


def vocab_counts(docs: DataFrame, vocab: Vocabulary, id_col: str = "doc_id", text_col: str = "text",
                 stopwords: list[str] | None = None) -> DataFrame:
    """(id, term, n) restricted to vocabulary terms; unseen terms are ignored.

    Tokens are filtered by a broadcast semi join with the (≤ max_features) vocabulary before the per-row aggregate.
    The texts are dealt by id before they are cut: they are smaller than the terms made from them, and neither the
    aggregate nor a window by id shuffles anything after that.
    """
    t = add_token_columns(docs.select(id_col, text_col).repartition(F.col(id_col)), text_col, stopwords, bigram=vocab.n == 2)
    toks = explode_rows(t, [F.col(id_col)], F.col(_tok_col(vocab.n)), "term")
    kept = toks.join(F.broadcast(vocab.table.select("term")), "term", "left_semi")
    return kept.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("n"))


def ngram_counts(docs: DataFrame, vocabs: dict, id_col: str = "doc_id", text_col: str = "text",
                 stopwords: list[str] | None = None) -> DataFrame:
    """(id, block, term, n) for several vocabularies (block name → Vocabulary) from one tokenization.

    Occurrences are tagged with their block, semi-joined with the union of the
    (bounded) vocabularies and counted by one aggregate; consumers that filter
    one block share its shuffle (the exchange is reused).
    """
    t = add_token_columns(docs, text_col, stopwords, bigram=any(v.n == 2 for v in vocabs.values()))
    parts = []
    for block, v in vocabs.items():
        col = F.col(_tok_col(v.n))
        parts.append(F.arrays_zip(F.array_repeat(F.lit(block), F.size(col)).alias("block"), col.alias("term")))
    toks = explode_rows(t, [F.col(id_col)], F.concat(*parts), "z").select(id_col, "z.block", "z.term")
    vt = None
    for block, v in vocabs.items():
        part = v.table.select(F.lit(block).alias("block"), "term")
        vt = part if vt is None else vt.unionByName(part)
    kept = toks.join(F.broadcast(vt), ["block", "term"], "left_semi")
    return kept.groupBy(id_col, "block", "term").agg(F.count(F.lit(1)).alias("n"))


@dataclass
class TfidfModel:
    vocab: Vocabulary
    n_docs: int
    idf: DataFrame  # term, pos, idf
    weights: list[float]  # idf by vocabulary position


def fit_tfidf(vocab: Vocabulary, n_docs: int, spark) -> TfidfModel:
    """Smoothed idf = ln((1 + n) / (1 + df)) + 1 over the ≤ max_features vocabulary terms."""
    weights = [math.log((1.0 + n_docs) / (1.0 + vocab.dfs.get(t, 0))) + 1.0 for t in vocab.terms]
    idf = spark.createDataFrame(
        [(t, i, w) for i, (t, w) in enumerate(zip(vocab.terms, weights))], "term string, pos int, idf double"
    )
    return TfidfModel(vocab=vocab, n_docs=n_docs, idf=idf, weights=weights)


def tfidf_long(counts: DataFrame, model: TfidfModel, id_col: str = "doc_id",
               digits: int | None = ROUND_DIGITS) -> DataFrame:
    """(id, term, tfidf): raw count × idf, each row scaled to unit L2 norm (window by id, no self-join)."""
    w = counts.join(F.broadcast(model.idf.select("term", "idf")), "term").select(
        F.col(id_col), "term", (F.col("n").cast("double") * F.col("idf")).alias("_w")
    )
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(id_col)))
    return w.select(F.col(id_col), "term", _r(F.col("_w") / norm, digits).alias("tfidf"))


def readability(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                digits: int | None = ROUND_DIGITS) -> DataFrame:
    scored = with_readability(docs.select(id_col, text_col), text_col, "_ari")
    return scored.select(F.col(id_col), _r(F.col("_ari"), digits).alias("ari"))


@dataclass
class FeatureState:
    """Everything fitted on the training part, applied unchanged to any other table."""

    uni: Vocabulary
    bi: Vocabulary
    tfidf: TfidfModel
    lexicon: object | None  # operators.lexicon.Lexicon

    def names(self) -> list[str]:
        names = [f"uni_{t}" for t in self.uni.terms] + [f"bi_{t}" for t in self.bi.terms]
        names += [f"tfidf_{t}" for t in self.tfidf.vocab.terms] + ["ari"]
        if self.lexicon is not None:
            names += list(self.lexicon.category_names)
        return names


def fit_features(train: DataFrame, max_features: int, lexicon=None, id_col: str = "doc_id",
                 text_col: str = "text", stopwords: list[str] | None = None) -> FeatureState:
    """One aggregate job (unigram and bigram statistics together) and one count; every result is small."""
    toks = add_token_columns(train.select(id_col, text_col), text_col, stopwords)
    uni, bi = fit_vocabularies(toks, [1, 2], max_features)
    tf = fit_tfidf(uni, train.count(), train.sparkSession)
    return FeatureState(uni=uni, bi=bi, tfidf=tf, lexicon=lexicon)


def shrink_features(state: FeatureState, max_features: int) -> FeatureState:
    """State of a smaller ``max_features`` fit, derived on the driver from the fitted rows."""
    uni = state.uni.top(max_features)
    tf = fit_tfidf(uni, state.tfidf.n_docs, uni.table.sparkSession)
    return FeatureState(uni=uni, bi=state.bi.top(max_features), tfidf=tf, lexicon=state.lexicon)


def feature_matrix_long(docs: DataFrame, state: FeatureState, id_col: str = "doc_id", text_col: str = "text",
                        digits: int | None = ROUND_DIGITS, keep: list[str] | None = None) -> DataFrame:
    """(id, keep…, feature, value, block): all five blocks; zeros are absent except ari.

    One scan of the texts and one explode: unigrams, bigrams and lexicon tokens leave a row together, told apart by their
    place, meet the vocabularies and the lexicon in broadcast joins, and are counted by one keyed aggregate.  Only the
    TF-IDF norm needs a window, by row, over the counts.  The texts are dealt by key first and nothing is shuffled after that.
    """
    from ..functions.text import lexicon_tokens
    from . import lexicon as lx

    spark = docs.sparkSession
    lexicon = state.lexicon
    keys = [id_col, *(keep or [])]
    t = add_token_columns(docs.select(*keys, text_col).repartition(*[F.col(c) for c in keys]), text_col)
    t = t.withColumn("_lex_toks", lexicon_tokens(text_col, lexicon.treebank) if lexicon is not None
                     else F.array().cast("array<string>"))
    # before the explode: expressions beside it are evaluated for every row that it makes
    t = with_readability(t, text_col, "_ari").select(
        *keys, "_ari", F.size("_lex_toks").alias("_n_lex"), *_ends([1, 2]),
        F.concat(UNI_COL, BI_COL, F.array(F.lit("ari")), "_lex_toks").alias("_terms"))
    rows = explode_rows(t, [F.col(c) for c in (*keys, "_ari", "_n_lex", "_e0", "_e1")], F.col("_terms"), ("_p", "_term"))
    block = F.when(F.col("_p") < F.col("_e0"), "uni").when(F.col("_p") < F.col("_e1"), "bi").when(
        F.col("_p") == F.col("_e1"), "ari").otherwise("lex")
    rows = rows.select(*keys, "_ari", "_n_lex", block.alias("block"), "_term")
    # the fitted vocabularies: at most 2 × max_features rows
    known = [("uni", w, f"uni_{w}", x) for w, x in zip(state.tfidf.vocab.terms, state.tfidf.weights, strict=True)]
    known += [("bi", w, f"bi_{w}", None) for w in state.bi.terms] + [("ari", "ari", "ari", None)]
    vocab = spark.createDataFrame(known, "block string, _term string, _name string, _idf double")
    rows = rows.join(F.broadcast(vocab), ["block", "_term"], "left")
    names = F.array("_name")
    if lexicon is not None:
        rows = rows.withColumn("_tok", F.when(F.col("block") == "lex", F.col("_term")))
        rows = lx.match_tokens(rows, "_tok", lexicon)
        names = F.when(F.col("block") == "lex", F.col("match_cats")).otherwise(names)
    rows = rows.select(*keys, "_ari", "_n_lex", "block", "_idf", F.explode_outer(names).alias("feature")).where("feature is not null")
    counts = rows.groupBy(*keys, "block", "feature").agg(
        F.count(F.lit(1)).alias("_n"), F.max("_ari").alias("_ari"), F.max("_n_lex").alias("_n_lex"), F.max("_idf").alias("_idf"))
    n = F.col("_n").cast("double")
    weight = F.when(F.col("block") == "uni", n * F.col("_idf"))
    norm = F.sqrt(F.sum(weight * weight).over(Window.partitionBy(*keys)))
    value = F.when(F.col("block") == "ari", _r(F.col("_ari"), digits)).when(
        F.col("block") == "lex", _r(F.lit(100.0) * n / F.col("_n_lex").cast("double"), digits)).otherwise(n)
    counts = counts.select(*keys, "block", "feature", value.alias("value"), _r(weight / norm, digits).alias("_tfidf"))
    own = F.struct("feature", "value", "block")
    scaled = F.struct(F.concat(F.lit("tfidf_"), F.substring("feature", 5, 1 << 30)).alias("feature"),
                      F.col("_tfidf").alias("value"), F.lit("tfidf").alias("block"))
    out = counts.select(*keys, F.explode(F.when(F.col("block") == "uni", F.array(own, scaled)).otherwise(F.array(own))).alias("_x"))
    return out.select(*keys, "_x.feature", "_x.value", "_x.block")


# ------------------------------------------------------------- ML vectors


def vector_features(docs: DataFrame, state: FeatureState, id_col: str = "doc_id", text_col: str = "text",
                    output_col: str = "features") -> DataFrame:
    """(id, features) sparse vectors in the order of ``state.names()``, built by JVM-side transformers."""
    from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, VectorAssembler
    from pyspark.ml.linalg import Vectors

    from . import lexicon as lx

    docs = docs.select(id_col, text_col)
    base = with_readability(add_token_columns(docs, text_col), text_col, "_ari")
    uni = CountVectorizerModel.from_vocabulary(state.uni.terms, inputCol="_uni_toks", outputCol="_uni")
    bi = CountVectorizerModel.from_vocabulary(state.bi.terms, inputCol="_bi_toks", outputCol="_bi")
    out = bi.transform(uni.transform(base))
    out = ElementwiseProduct(scalingVec=Vectors.dense(state.tfidf.weights), inputCol="_uni", outputCol="_tfw").transform(out)
    out = Normalizer(p=2.0, inputCol="_tfw", outputCol="_tfidf").transform(out)
    inputs = ["_uni", "_bi", "_tfidf", "_ari"]
    out = out.select(id_col, *inputs)
    if state.lexicon is not None:
        wide = lx.scores_wide(docs, state.lexicon, id_col, text_col, digits=None)
        cats = state.lexicon.category_names
        wide = wide.select(id_col, *[F.coalesce(F.col(f"`{c}`"), F.lit(0.0)).alias(f"_lex_{i}") for i, c in enumerate(cats)])
        out = out.join(wide, id_col, "left")
        inputs += [f"_lex_{i}" for i in range(len(cats))]
    out = VectorAssembler(inputCols=inputs, outputCol=output_col, handleInvalid="keep").transform(out)
    return out.select(id_col, output_col)


# ----------------------------------------------------------- sequences


def fit_sequence_vocab(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, id) of every term: ids 2.. by total count desc, term asc; 0 = padding, 1 = unknown.

    The terms are sorted by ranges; a term's id is the number of terms in the ranges before plus its place in
    its own, so only one count per range reaches the driver.
    """
    totals = explode_rows(docs, [], word_tokens(text_col), "term").groupBy("term").agg(
        F.count(F.lit(1)).alias("total")
    )
    ordered = totals.repartitionByRange(F.desc("total"), F.asc("term")).sortWithinPartitions(
        F.desc("total"), F.asc("term")).withColumn("_place", F.monotonically_increasing_id())
    ordered = reliable_checkpoint(ordered)
    part = F.shiftright("_place", 33)
    sizes = {r["p"]: r["n"] for r in ordered.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, first = 2, []
    for p in sorted(sizes):
        first.append((p, before))
        before += sizes[p]
    starts = docs.sparkSession.createDataFrame(first, "p long, first long")
    ids = ordered.join(F.broadcast(starts), part == F.col("p"))
    place = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return ids.select("term", (F.col("first") + place).cast("int").alias("id"))


# Terms, the most frequent first, whose ids are sent to every task.
FREQUENT_TERMS = 200_000


def encode_sequences(docs: DataFrame, vocab: DataFrame, max_length: int, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """(id, chunk, input_ids, n_real): the whole text as consecutive chunks of ``max_length`` ids,
    each padded with 0 to ``max_length``; ``n_real`` is the attention-mask length.

    Most occurrences are of few terms: these get their ids by a broadcast join, where the texts lie.  Only the occurrences
    of rarer terms are shuffled by term.  A place and its id travel as one number.
    """
    toks = explode_rows(docs, [F.col(id_col)], word_tokens(text_col), ("p", "term"))
    frequent = F.col("id") < FREQUENT_TERMS + 2
    known = toks.join(F.broadcast(vocab.where(frequent)), "term", "left")
    rare = known.where("id is null").select(id_col, "p", "term").join(vocab.where(~frequent), "term", "left")
    cells = known.where("id is not null").select(id_col, "p", "id").unionByName(rare.select(id_col, "p", "id")).select(
        F.col(id_col), (F.col("p") / max_length).cast("int").alias("chunk"),
        F.shiftleft(F.col("p").cast("long"), 32).bitwiseOR(F.coalesce(F.col("id"), F.lit(1)).cast("long")).alias("_c"),
    )
    grouped = cells.groupBy(id_col, "chunk").agg(F.sort_array(F.collect_list("_c")).alias("_s"))
    ids = F.transform("_s", lambda c: c.bitwiseAND(F.lit((1 << 32) - 1)).cast("int"))
    return grouped.select(
        F.col(id_col),
        "chunk",
        F.concat(ids, F.array_repeat(F.lit(0), F.lit(max_length) - F.size("_s"))).alias("input_ids"),
        F.size("_s").alias("n_real"),
    )
