"""Language identification by bit-sliced Bloom filters of n-grams.

Learning: for every language the n-grams (1 to 4 letters and blanks) found in at
least ``MIN_SHARE`` of its sampled documents, and in ``REL_SHARE`` of the share
of the language that has them most.  Every language has a Bloom filter of the
same size and hash functions; the filters are kept bit-sliced, that is, one word
per filter position whose bit l tells language l's bit.  Looking up an n-gram
takes ``HASHES`` words and their AND: the set of all languages that contain it.

Deciding: per document, the bits of its n-grams' words are counted per language
(popcounts), the count expected from false positives is taken out
(c - N f) / (1 - f) with f the language's fill to the power of ``HASHES``, and the
largest count wins; ties go to the smaller name.

Scale: learning reads a sample bounded in expectation by ``SAMPLE_DOCS`` documents a language,
n-grams are counted map-side before the one shuffle, and the filters hold at
most (mean n-grams a document) / MIN_SHARE entries a language, whatever the
table's size, which is what is collected and broadcast.  Prediction is a narrow
map over whole texts.

Defined results: text null or without a letter: ``und`` with score 0; a text with
letters but no known n-gram: the most frequent learned language with score 0; no
labelled document at all: ``und``.  Score: the winner's share of all corrected counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import slices
from .common import map_arrow
from .scan import LETTER, SEPARATOR, Joined, code_point_classes, mix64

ORDERS = (1, 2, 3, 4)
LONG_ORDERS = (3, 4)  # short n-grams are the script's, long ones the language's
SAMPLE_DOCS = 3000  # sampled documents a language, in expectation
MIN_SHARE = 0.004
REL_SHARE = 0.25
BITS_PER_ENTRY = 12
HASHES = 3
UNKNOWN = "und"
_SEEDS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]  # fixed values


def ngrams(joined: Joined, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the n-grams of one order that lie in one text and hold a letter."""
    n = len(joined.cp) - order + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    letter = joined.kind == LETTER
    value = np.where(letter, joined.cp, np.uint32(32)).astype(np.uint64)
    some, within = letter[:n].copy(), joined.kind[:n] != SEPARATOR
    h = np.full(n, order, dtype=np.uint64)
    for i in range(order):
        h = (h ^ value[i:n + i]) * np.uint64(0x9DDFEA08EB382D69)
        h ^= h >> np.uint64(29)
        some |= letter[i:n + i]
        within &= joined.kind[i:n + i] != SEPARATOR
    at = np.flatnonzero(some & within)
    return at, h[at]


@dataclass
class Filters:
    """Bit-sliced Bloom filters: ``words[w][p]`` has bit l of language 64 w + l at position p."""

    languages: list[str]
    words: np.ndarray  # (ceil(languages / 64), positions) uint64
    false_positive: np.ndarray  # per language
    default: str
    classes: np.ndarray

    @staticmethod
    def positions(h: np.ndarray, size: int) -> list[np.ndarray]:
        return [(mix64(h + s) % np.uint64(size)).astype(np.int64) for s in _SEEDS[:HASHES]]

    @classmethod
    def build(cls, languages: list[str], entries: list[np.ndarray], default: str) -> Filters:
        """``entries``: the n-gram hashes of each language."""
        size = max(64, BITS_PER_ENTRY * max((len(e) for e in entries), default=0))
        words = np.zeros((-(-max(1, len(languages)) // 64), size), dtype=np.uint64)
        fill = np.zeros(len(languages))
        for k, e in enumerate(entries):
            bit = np.zeros(size, dtype=bool)
            for p in cls.positions(e, size):
                bit[p] = True
            words[k // 64] |= bit.astype(np.uint64) << np.uint64(k % 64)
            fill[k] = bit.mean()
        return cls(languages, words, fill ** HASHES, default, code_point_classes())

    def counts(self, joined: Joined, orders: tuple[int, ...] = ORDERS) -> tuple[np.ndarray, np.ndarray]:
        """Per text: n-grams, and n-grams in each language's filter."""
        n_texts = len(joined.sep)
        total = np.zeros(n_texts)
        found = np.zeros((len(self.languages), n_texts))
        for order in orders:
            at, h = ngrams(joined, order)
            of = np.searchsorted(joined.sep, at)  # text of each n-gram
            cuts = np.searchsorted(of, np.arange(n_texts + 1))
            total += np.diff(cuts)
            places = self.positions(h, self.words.shape[1])
            for w, word in enumerate(self.words):
                mask = word[places[0]]
                for p in places[1:]:
                    mask &= word[p]
                for k in range(64 * w, min(64 * w + 64, len(self.languages))):
                    bits = (mask >> np.uint64(k - 64 * w)) & np.uint64(1)
                    found[k] += np.diff(np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])[cuts])
        return total, found

    def _right(self, total: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Counts per language without those expected from false positives."""
        f = self.false_positive[:, None]
        return np.maximum(0.0, (found - total * f) / np.maximum(1e-9, 1.0 - f))

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Per text: language, score, and coverage (the share of its n-grams that the language has)."""
        return self.evidence(texts)[:3]

    def evidence(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As ``predict``, and the number of n-grams of ``LONG_ORDERS`` and the coverage over these."""
        joined = Joined([t.lower() for t in texts], self.classes)
        letters = np.concatenate([[0], np.cumsum(joined.kind == LETTER, dtype=np.int64)])[np.append(0, joined.sep)]
        some = np.diff(letters) > 0
        if not self.languages:
            return [UNKNOWN] * len(texts), *(np.zeros(len(texts)) for _ in range(4))
        long, long_found = self.counts(joined, LONG_ORDERS)
        total, found = self.counts(joined, tuple(o for o in ORDERS if o not in LONG_ORDERS))
        total, found = total + long, found + long_found
        right = self._right(total, found)
        best, mass = right.argmax(axis=0), right.sum(axis=0)
        top = right[best, np.arange(len(texts))]
        score = np.where(some & (mass > 0), top / np.maximum(mass, 1e-300), 0.0)
        names = [UNKNOWN if not s else self.languages[b] if m > 0 else self.default
                 for s, b, m in zip(some.tolist(), best.tolist(), mass.tolist(), strict=True)]
        coverage = np.where(some, top / np.maximum(total, 1.0), 0.0)
        long_cover = self._right(long, long_found)[best, np.arange(len(texts))] / np.maximum(long, 1.0)
        return names, np.clip(score, 0.0, 1.0), np.clip(coverage, 0.0, 1.0), long, np.clip(long_cover, 0.0, 1.0)


def _count_ngrams(docs: DataFrame) -> DataFrame:
    """(h, lang, n): documents of each language that hold an n-gram, summed up inside each slice."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = code_point_classes()
        for whole in batches:
            for batch, texts in slices(whole, "text"):
                names, lang = np.unique(batch.column("lang").to_pylist(), return_inverse=True)
                joined = Joined([t.lower() for t in texts], classes)
                for order in ORDERS:
                    at, h = ngrams(joined, order)
                    of = np.searchsorted(joined.sep, at)
                    _, first = np.unique(mix64(h + of.astype(np.uint64) * _SEEDS[1]), return_index=True)
                    pairs = np.rec.fromarrays([h[first].view(np.int64), lang[of[first]]])
                    kinds, n = np.unique(pairs, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.ascontiguousarray(kinds.f0)), pa.array(names[kinds.f1].tolist(), pa.string()),
                         pa.array(n.astype(np.int64))], ["h", "lang", "n"])

    return map_arrow(docs, run, "h long, lang string, n long")


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, least_docs: int = 1) -> Filters:
    """Filters from the ``text`` and non-null ``lang`` of ``docs`` (with ``doc_id``, used for sampling only).

    ``least_docs``: documents that hold an n-gram, at most a twentieth of the language's sample; with 1 a
    small table's every document vouches for itself.
    """
    docs = docs.select("doc_id", "text", "lang").where("lang is not null")
    sizes = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Filters.build([], [], UNKNOWN)
    rate = F.lit(0.0)
    for lang, n in sizes.items():
        rate = F.when(F.col("lang") == lang, min(1.0, sample_docs / n)).otherwise(rate)
    u = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 8), 16, 10)
    sample = docs.where(u.cast("double") / 4294967296.0 < rate).where("text is not null").select("text", "lang").cache()
    n_docs = {r["lang"]: r["n"] for r in sample.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(n_docs)
    counted = _count_ngrams(sample).groupBy("h", "lang").agg(F.sum("n").alias("n"))
    share = F.lit(0.0)
    for lang in languages:
        share = F.when(F.col("lang") == lang, F.col("n") / n_docs[lang]).otherwise(share)
    least = F.lit(1.0)
    for lang in languages:
        least = F.when(F.col("lang") == lang, min(least_docs, max(1.0, n_docs[lang] / 20))).otherwise(least)
    kept = (counted.withColumn("share", share).where((F.col("share") >= MIN_SHARE) & (F.col("n") >= least))
            .groupBy("h").agg(F.collect_list(F.struct("lang", "share")).alias("l"), F.max("share").alias("m"))
            .select("h", F.filter("l", lambda x: x["share"] >= F.col("m") * REL_SHARE)["lang"].alias("l")))
    rows = kept.toPandas()
    sample.unpersist()
    entries: dict[str, list[int]] = {lang: [] for lang in languages}
    for h, names in zip(rows["h"].tolist(), rows["l"].tolist(), strict=True):
        for name in names:
            entries[name].append(h)
    default = max(languages, key=lambda x: (sizes[x], x)) if languages else UNKNOWN
    return Filters.build(languages, [np.array(entries[x], dtype=np.int64).view(np.uint64) for x in languages], default)


def identify(docs: DataFrame, filters: Filters, text: str = "text", lang: str = "lang_pred",
             score: str = "score", coverage: str = "coverage", long: tuple[str, str] | None = None) -> DataFrame:
    """``docs`` with the predicted language, its score and its coverage for every whole ``text``.

    ``long``: names of two more columns, the number of n-grams of ``LONG_ORDERS`` and the coverage over these.
    """
    sent = docs.sparkSession.sparkContext.broadcast(filters)
    names = [lang, score, coverage, *(long or ())]
    kept = [c for c in docs.columns if c not in names]
    schema = T.StructType([docs.schema[c] for c in kept] + [
        T.StructField(c, T.DoubleType() if c != lang else T.StringType()) for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, texts in slices(whole, text):
                told, *numbers = sent.value.evidence(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c) for c in kept] + [pa.array(told, pa.string())]
                    + [pa.array(x) for x in numbers[:len(names) - 1]], [*kept, *names])

    return map_arrow(docs, run, schema)
