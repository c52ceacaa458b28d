"""Ranked lexical search with per-term geometric blocking; exact.

A document's score for an item is the sum of its impacts over the item's terms; an impact is a term's weight times
a saturated frequency, in 64-bit integers (``impacts``).

1. Forward vectors.  One pass over the texts counts every term of a document (its length) and keeps the frequencies of
   the terms that some item asks for; no other coordinate can enter a score.  Items are taken in blocks of at
   most ``VOCABULARY`` different terms, so what is sent to the tasks is bounded however many items there are.
2. Starting bounds.  Each item scores the documents whose heaviest coordinate it holds.  The k-th best of
   these is a lower bound of the item's final k-th score.
3. Shards.  Documents are dealt by their heaviest coordinate, ``SHARD`` to a shard: a frequent coordinate fills
   shards of its own, rare ones share.  A shard is one group.
4. Geometric blocks.  Within a shard documents are clustered by the cosine of their vectors, and each term's posting list
   is cut by these clusters.  A block stores its summary: the largest impact of its documents at every coordinate
   that the items opening the list ask for.
5. Search.  An item opens its lists from the one with the greatest impact down, and stops where the summaries
   of the lists left (their greatest impacts) add up to less than the bound: a document in none of the opened lists cannot
   qualify.  In an opened list a block is skipped only when its summary's sum is below the bound; the blocks with the
   largest sums are read first and raise it.  Equal scores are never skipped, so ties go to the smaller id.
6. The best of each shard that reach the starting bound meet in one window per item.

A shard's task holds some ``SHARD`` vectors.  Defined results: a null or empty text, or one without terms, is no
document of N; a null document id may be ranked, before others of equal score; rows that share an id are documents of
their own; rows that share an item id are one item with all their terms; a null item id is an item; an item
without terms, or whose terms no document has, has no rows; further columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, stored

VOCABULARY = 50_000  # different terms of the items taken at once
SHARD = 4096
CLUSTER = 32  # documents of a cluster, on average
READ = 8  # blocks read before the bound is raised
UNKNOWN_ID = -(1 << 63)  # a null id's place in the order
# Upper case becomes lower case, and every other byte below 128 that is no letter or digit ends a term.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """All terms with repeats: runs of ASCII letters and digits and of characters beyond ASCII; only A-Z are lowered."""
    return text.encode("utf-8").translate(_FOLD).split(b" ") if text else []


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(weights: np.ndarray, tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Score parts of terms with ``weights`` and frequencies ``tf`` in documents of ``n`` terms; all int64."""
    m = 10 + (90 * n * n_docs) // n_terms
    return weights * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


@dataclass
class Items:
    """A block of items: their ids by number, and the terms each asks for, numbered by ``vocabulary``."""

    ids: list
    vocabulary: dict[bytes, int]
    terms: list[np.ndarray]

    def holders(self) -> dict[int, list[int]]:
        out: dict[int, list[int]] = {}
        for i, terms in enumerate(self.terms):
            for t in terms.tolist():
                out.setdefault(t, []).append(i)
        return out


def item_blocks(items: DataFrame, item_id: str, text: str, limit: int) -> Iterator[Items]:
    """The items in blocks of at most ``limit`` different terms (or of one item)."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [sorted(set(terms_of(t.as_py())) - {b""}) for t in batch.column("t")]
            yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(terms, pa.list_(pa.binary()))], ["i", "terms"])

    src = items.select(F.col(item_id).alias("i"), F.col(text).alias("t"))
    kind = src.schema["i"].dataType.simpleString()
    asked = map_arrow(src, cut, f"i {kind}, terms array<binary>").groupBy("i").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("terms")))).alias("terms")).where(F.size("terms") > 0)
    block = Items([], {}, [])
    # the driver holds one block at a time
    for row in stored(asked, "items").orderBy("i").toLocalIterator():
        terms = [bytes(t) for t in row["terms"]]
        if block.ids and len(block.vocabulary.keys() | set(terms)) > limit:
            yield block
            block = Items([], {}, [])
        block.ids.append(row["i"])
        block.terms.append(np.array([block.vocabulary.setdefault(t, len(block.vocabulary)) for t in terms], dtype=np.int64))
    if block.ids:
        yield block


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int64()), pa.array(values)).cast(
        pa.list_(pa.from_numpy_dtype(values.dtype)))


def _forward(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc, n, terms array<int>, tfs array<int>): length and asked frequencies of every document with a term."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value
        for batch in batches:
            n, sizes, terms, tfs = [], [], [], []
            for text in batch.column("t"):
                words = terms_of(text.as_py())
                found = Counter(words)
                n.append(len(words) - found.pop(b"", 0))
                known = sorted((number[w], c) for w, c in found.items() if w in number)
                sizes.append(len(known))
                terms.extend(k for k, _ in known)
                tfs.extend(c for _, c in known)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(n, pa.int64()), _lists(np.array(terms, dtype=np.int32), np.array(sizes)),
                 _lists(np.array(tfs, dtype=np.int32), np.array(sizes))], ["doc", "n", "terms", "tfs"])

    return map_arrow(docs, run, "doc long, n long, terms array<int>, tfs array<int>").where("n > 0")


class Vectors:
    """Sparse vectors of a batch or group: ``cols`` and ``values`` of row i are ``[at[i]:at[i + 1]]``."""

    def __init__(self, sizes: np.ndarray, cols: np.ndarray, values: np.ndarray):
        self.at = np.append(0, np.cumsum(sizes))
        self.cols, self.values = cols.astype(np.int64), values
        self.row = np.repeat(np.arange(len(sizes)), sizes)


def _flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and values of a column of lists."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    sizes = np.diff(column.offsets.to_numpy()).astype(np.int64)
    return sizes, column.flatten().to_numpy(zero_copy_only=False)


def _vectors(forward: DataFrame, weights: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """(doc, heavy, terms, impacts): vectors with a positive coordinate; ``heavy`` is the greatest one's term."""
    sent = forward.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, terms = _flat(batch.column("terms"))
            tf = _flat(batch.column("tfs"))[1].astype(np.int64)
            n = np.repeat(batch.column("n").to_numpy(), sizes)
            value = impacts(sent.value[terms], tf, n, n_docs, n_terms)
            row = np.repeat(np.arange(len(sizes)), sizes)[value > 0]
            terms, value = terms[value > 0], value[value > 0]
            if not len(row):
                continue
            rows, sizes = np.unique(row, return_counts=True)
            order = np.lexsort((terms, -value, row))
            heavy = terms[order[np.append(0, np.cumsum(sizes)[:-1])]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc").take(pa.array(rows)), pa.array(heavy.astype(np.int32)),
                 _lists(terms.astype(np.int32), sizes), _lists(value, sizes)], ["doc", "heavy", "terms", "impacts"])

    return map_arrow(forward, run, "doc long, heavy int, terms array<int>, impacts array<long>")


def _best(rows: DataFrame, k: int) -> DataFrame:
    """The ``k`` best (item, doc, score) of each item, with ``rank``; equal scores by ascending id."""
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _starting_bounds(vectors: DataFrame, items: Items, k: int) -> np.ndarray:
    """For every item the k-th best score among the documents whose heaviest coordinate it holds; 0 if there are fewer."""
    sent = vectors.sparkSession.sparkContext.broadcast((items.holders(), items.terms, len(items.vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holders, terms, width = sent.value
        best: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes, cols = _flat(batch.column("terms"))
            v = Vectors(sizes, cols, _flat(batch.column("impacts"))[1])
            heavy = batch.column("heavy").to_numpy()
            asked: dict[int, list[int]] = {}
            for t in np.unique(heavy).tolist():
                rows = np.flatnonzero(heavy == t)
                for item in holders[t]:
                    asked.setdefault(item, []).append(rows)
            held = np.zeros(width, dtype=bool)
            for item, parts in asked.items():
                rows = np.concatenate(parts)
                held[terms[item]] = True
                score = np.bincount(v.row, weights=np.where(held[v.cols], v.values, 0), minlength=len(sizes))[rows]
                held[terms[item]] = False
                best[item] = -np.sort(-np.append(best.get(item, np.zeros(0)), score))[:k]
        rows = [(i, int(s)) for i, scores in best.items() for s in scores.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()),
                                          pa.array([r[1] for r in rows], pa.int64())], ["item", "score"])

    found = map_arrow(vectors, run, "item int, score long").withColumn("doc", F.lit(0).cast("long"))
    out = np.zeros(len(items.ids), dtype=np.int64)
    for r in _best(found, k).where(F.col("rank") == k).collect():  # a number per item of the block
        out[r["item"]] = r["score"]
    return out


def clusters(v: Vectors, n: int, width: int, size: int) -> np.ndarray:
    """Cluster of each of the ``n`` vectors: that of the nearest of n / size spread-out vectors, by cosine."""
    dense = np.zeros((n, width), dtype=np.float32)
    dense[v.row, v.cols] = v.values
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    centres = np.unique(np.linspace(0, n - 1, max(1, n // size)).astype(np.int64))
    return np.argmax(dense @ dense[centres].T, axis=1)


class Shard:
    """Posting lists of a shard, each cut into blocks of similar documents, with the summaries of the blocks."""

    def __init__(self, docs: np.ndarray, v: Vectors, cluster: int = CLUSTER):
        self.terms, cols = np.unique(v.cols, return_inverse=True)
        local = Vectors(np.diff(v.at), cols, v.values)
        label = clusters(local, len(docs), len(self.terms), cluster)
        place = np.argsort(label, kind="stable")  # documents of a cluster stand together
        self.docs, self.label = docs[place], label[place]
        new = np.empty(len(docs), dtype=np.int64)
        new[place] = np.arange(len(docs))
        row = new[local.row]
        order = np.lexsort((row, cols))
        self.rows, self.values = row[order], v.values[order]
        self.first = np.searchsorted(cols[order], np.arange(len(self.terms) + 1))

    def postings(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.first[t], self.first[t + 1]
        return self.rows[a:b], self.values[a:b]

    def search(self, asked: np.ndarray, bound: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(docs, scores) of the shard's ``k`` best that reach ``bound``, equal scores by ascending id."""
        cols = np.flatnonzero(np.isin(self.terms, asked))
        none = np.zeros(0, dtype=np.int64)
        if not len(cols):
            return none, none
        top = np.array([self.values[self.first[t]:self.first[t + 1]].max() for t in cols.tolist()])
        cols, top = cols[np.argsort(-top)], -np.sort(-top)
        rest = np.cumsum(top[::-1])[::-1]  # what this list and those after it can still give
        if rest[0] < bound:
            return none, none
        matrix = np.zeros((len(self.docs), len(cols)), dtype=np.int64)
        for j, t in enumerate(cols.tolist()):
            rows, values = self.postings(t)
            matrix[rows, j] = values
        seen = np.zeros(len(self.docs), dtype=bool)
        best_rows, best = none, none
        for j, t in enumerate(cols.tolist()):
            if rest[j] < bound:
                break
            rows = self.postings(t)[0]
            rows = rows[~seen[rows]]
            if not len(rows):
                continue
            label = self.label[rows]
            starts = np.flatnonzero(np.append(True, label[1:] != label[:-1]))
            ends = np.append(starts[1:], len(rows))
            summary = np.maximum.reduceat(matrix[rows], starts, axis=0)
            limit = summary.sum(axis=1)
            order = np.argsort(-limit, kind="stable")
            for begin in range(0, len(order), READ):
                blocks = order[begin:begin + READ]
                blocks = blocks[limit[blocks] >= bound]
                if not len(blocks):
                    break
                read = np.concatenate([rows[a:b] for a, b in zip(starts[blocks].tolist(), ends[blocks].tolist(), strict=True)])
                seen[read] = True
                best_rows = np.concatenate([best_rows, read])
                best = np.concatenate([best, matrix[read].sum(axis=1)])
                first = np.lexsort((self.docs[best_rows], -best))[:k]
                best_rows, best = best_rows[first], best[first]
                if len(best) == k:
                    bound = max(bound, int(best[-1]))
        reach = best >= max(bound, 1)
        return self.docs[best_rows[reach]], best[reach]


def _sharded(vectors: DataFrame) -> DataFrame:
    """``vectors`` with ``shard``: documents with the same heaviest coordinate lie together, some ``SHARD`` to a shard."""
    # a row per asked term at most: ``VOCABULARY`` bounds it
    cells = vectors.groupBy("heavy").agg(F.count(F.lit(1)).alias("held")).orderBy("heavy").collect()
    start = np.append(0, np.cumsum([c["held"] for c in cells]))[:-1].tolist()
    spark = vectors.sparkSession
    places = spark.createDataFrame([(c["heavy"], c["held"], s) for c, s in zip(cells, start, strict=True)],
                                   "heavy int, held long, start long")
    at = F.col("start") + F.pmod(F.xxhash64(F.monotonically_increasing_id()), "held")
    return vectors.join(F.broadcast(places), "heavy").withColumn("shard", F.floor(at / SHARD))


def _search_block(docs: DataFrame, items: Items, k: int) -> DataFrame:
    """(item, doc, score, rank) of a block of items, ``item`` by number."""
    spark = docs.sparkSession
    forward = stored(_forward(docs, items.vocabulary), "forward")
    totals = forward.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = totals["docs"], totals["terms"] or 0
    weights = np.zeros(len(items.vocabulary), dtype=np.int64)
    held = forward.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    for r in held.collect():  # a row per asked term at most
        weights[r["t"]] = weight(n_docs, r["df"])
    vectors = stored(_vectors(forward, weights, n_docs, n_terms), "vectors")
    bounds = _starting_bounds(vectors, items, k)
    sent = spark.sparkContext.broadcast((items.terms, bounds))

    def serve(group: pa.Table) -> pa.Table:
        sizes, cols = _flat(group.column("terms"))
        ids = group.column("doc").fill_null(UNKNOWN_ID).to_numpy()
        shard = Shard(ids, Vectors(sizes, cols, _flat(group.column("impacts"))[1]))
        terms, least = sent.value
        item, doc, score = [], [], []
        for i, asked in enumerate(terms):
            d, s = shard.search(asked, int(least[i]), k)
            item.append(np.full(len(d), i, dtype=np.int32))
            doc.append(d)
            score.append(s)
        ids = np.concatenate(doc)
        return pa.table({"item": pa.array(np.concatenate(item)), "doc": pa.array(ids, mask=ids == UNKNOWN_ID),
                         "score": pa.array(np.concatenate(score))})

    return _best(_sharded(vectors).groupBy("shard").applyInArrow(serve, "item int, doc long, score long"), k)


def lexical_search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id",
                   item_text: str = "text", k: int = 10) -> DataFrame:
    """(item_id, rank int, doc_id, score long): the ``k`` highest-scoring documents of every item, scores above 0."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text).alias("t"))
    kind = items.schema[item_id].dataType.simpleString()
    out = None
    for block in item_blocks(items, item_id, item_text, VOCABULARY):
        names = spark.createDataFrame(list(enumerate(block.ids)), f"item int, name {kind}")
        found = _search_block(src, block, k).join(F.broadcast(names), "item").select(
            F.col("name").alias(item_id), F.col("rank").cast("int").alias("rank"), F.col("doc").alias(id_col), "score")
        found = stored(found, "ranked")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], f"{item_id} {kind}, rank int, {id_col} long, score long")
    return out
