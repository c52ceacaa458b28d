"""Suffix-array dedup: bytes covered by a string of ``LENGTH`` bytes that also starts earlier are removed.

Sorting every suffix of the corpus would ship ``LENGTH`` bytes a position.  Instead every window of
``LENGTH`` bytes is represented by an anchor that its content chooses (winnowing: the leftmost
``GRAM``-byte string of least hash in it), so equal windows have equal anchors at equal offsets, and one
anchor serves some thirty neighbouring windows.

0. Documents whose whole text an earlier one has (by a digest) lose all of it and leave the search.
1. Anchors that occur very often are found first (counts combined map-side) and broadcast; their number is
   bounded by ``HOT_SHARE``.  Windows at such anchors are dealt by a digest of the whole window, equal ones
   combined in each task, so a passage that a third of all documents share meets nowhere.
2. All other anchors are dealt by their hash, packed in blobs; those that occur once are dropped.
3. Documents cut out the bytes around their repeated anchors; these segments are dealt by the anchor.
4. In each part the strings to the right of the anchors and, reversed, those to the left are put in
   order by deep-shallow sorting (``suffix_sort``).  Two windows at offset d are equal when their anchors agree in
   ``LENGTH - d`` bytes to the right and d bytes to the left, which the sorted orders and their common prefixes
   tell for all d; all but the first of each class are marked.
5. Marked windows return to their documents as runs, and the covered bytes go.

Earlier means smaller id, then earlier start.  Defined results: a null text is an empty one; a null id comes
after all others; rows that share an id are documents of their own, ordered by a hash of the text (a repeated row is a
later copy); texts shorter than ``LENGTH`` bytes lose nothing; matches never cross documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_arrow, ship, small_side, stored
from .suffix_sort import classes_at, sort_strings

LENGTH = 100
GRAM = 32
SPAN = LENGTH - GRAM + 1  # grams in a window
SCAN = 2_000_000  # bytes scanned at a time
HELD = 400_000  # anchors or windows that a task holds before it deals them out
PART = 400_000  # anchors of a part
HOT_LOCAL = 3  # counted as candidates for hot anchors from so many in one scan on
HOT_LEAST = 400
HOT_SHARE = 1e-5  # of all anchors, so there are 100,000 hot ones at most
_BYTE = np.random.default_rng(20240607).integers(0, 2**64, 256, dtype=np.uint64)  # fixed random byte values
_MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                                       0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]

ANCHOR = np.dtype([("key", "<u8"), ("doc", "<i8"), ("copy", "<i4"), ("pos", "<i4"), ("lo", "<i4"), ("hi", "<i4")])
WINDOW = np.dtype([("a", "<u8"), ("b", "<u8"), ("doc", "<i8"), ("copy", "<i4"), ("pos", "<i4")])
RUN = np.dtype([("doc", "<i8"), ("copy", "<i4"), ("pos", "<i4"), ("n", "<i4")])
LAST = np.iinfo(np.int64).max


def anchors_of(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text index, anchor, lo, hi, key): for each anchor the starts lo..hi of the windows that it stands for,
    all within their text."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    none = np.zeros(0, dtype=np.int64)
    if len(data) < LENGTH:
        return none, none, none, none, none.astype(np.uint64)
    h = _BYTE[data]
    width = 1
    for m in _MULTIPLIERS:  # 2, 4, 8, 16, 32 bytes
        h = (h[:-width] * m) ^ (h[width:] + (h[:-width] >> np.uint64(31)))
        width *= 2
    h *= _MULTIPLIERS[1]
    h ^= h >> np.uint64(32)
    # hash before position: the least value is the leftmost least hash
    least = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while 2 * size <= SPAN:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    rest = SPAN - size
    least = np.minimum(least[:len(least) - rest], least[rest:])
    chosen = (least & np.uint64(0xFFFFFF)).astype(np.int64)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    # window starts that fit into their text
    valid = np.ones(len(chosen), dtype=bool)
    for b, e in zip(begins.tolist(), ends.tolist(), strict=True):
        valid[max(b, e - LENGTH + 1):e] = False
    i = np.flatnonzero(valid)
    if not len(i):
        return none, none, none, none, none.astype(np.uint64)
    a = chosen[i]
    first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    last = np.append(first[1:], len(i)) - 1
    text = np.searchsorted(ends, i[first], side="right")
    return text, a[first] - begins[text], i[first] - begins[text], i[last] - begins[text], h[a[first]]


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Rows in slices of about ``SCAN`` bytes (one row at least); null texts are empty."""
    for batch in batches:
        texts = [b"" if t is None else t for t in batch.column("text").cast(pa.binary()).to_pylist()]
        begin = size = 0
        for i, t in enumerate(texts):
            if size and size + len(t) > SCAN:
                yield batch.slice(begin, i - begin), texts[begin:i]
                begin, size = i, 0
            size += len(t)
        if begin < len(texts):
            yield batch.slice(begin), texts[begin:]


def scan_anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """``anchors_of`` for texts of any length: those too long for the position bits are cut with an overlap."""
    limit = 1 << 23
    if sum(map(len, texts)) <= 2 * limit:
        return anchors_of(texts)
    parts = []
    for k, t in enumerate(texts):
        for begin in range(0, max(1, len(t) - LENGTH + 1), limit):
            # windows that start in [begin, begin + limit)
            piece = anchors_of([t[begin:begin + limit + LENGTH - 1]])
            parts.append((np.full(len(piece[0]), k), *(x + begin for x in piece[1:4]), piece[4]))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _hot_anchors(docs: DataFrame) -> tuple[int, np.ndarray]:
    """(number of anchors, hashes of the hot ones)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _documents(batches):
            key, n = np.unique(scan_anchors(texts)[4], return_counts=True)
            often = n >= HOT_LOCAL
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(key[often].view(np.int64), 0)), pa.array(np.append(n[often], 0)),
                 pa.array(np.append(np.zeros(int(often.sum()), dtype=np.int64), n.sum()))], ["key", "n", "total"])

    counted = map_arrow(docs.select("text"), run, "key long, n long, total long").groupBy("key").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"))
    counted = stored(counted, "anchor-counts")
    total = counted.agg(F.sum("total")).first()[0] or 0
    least = max(HOT_LEAST, int(total * HOT_SHARE))
    hot = counted.where(F.col("n") >= least).select("key").toPandas()["key"].to_numpy(dtype=np.int64)
    return total, np.sort(hot.view(np.uint64))


def _runs(rows: np.ndarray) -> np.ndarray:
    """Marked windows (doc, copy, pos) as maximal runs of consecutive starts."""
    rows = rows[np.lexsort((rows["pos"], rows["copy"], rows["doc"]))]
    if not len(rows):
        return np.zeros(0, dtype=RUN)
    new = np.ones(len(rows), dtype=bool)
    new[1:] = ((rows["doc"][1:] != rows["doc"][:-1]) | (rows["copy"][1:] != rows["copy"][:-1])
               | (rows["pos"][1:] != rows["pos"][:-1] + 1))
    first = np.flatnonzero(new)
    out = np.zeros(len(first), dtype=RUN)
    for f in ("doc", "copy", "pos"):
        out[f] = rows[f][first]
    out["n"] = np.diff(np.append(first, len(rows)))
    return out


def _later_copies(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first of each digest, all others)."""
    w = windows[np.lexsort((windows["pos"], windows["copy"], windows["doc"], windows["b"], windows["a"]))]
    first = np.ones(len(w), dtype=bool)
    first[1:] = (w["a"][1:] != w["a"][:-1]) | (w["b"][1:] != w["b"][:-1])
    return w[first], w[~first]


def _deal(kind: int, rows: np.ndarray, by: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """Rows of (kind, part, blob), one for each part."""
    part = (by % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    numbers, first = np.unique(part[order], return_index=True)
    last = np.append(first[1:], len(rows))
    blobs = [rows[order[a:b]].tobytes() for a, b in zip(first.tolist(), last.tolist(), strict=True)]
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(numbers), kind, dtype=np.int32)), pa.array(numbers), pa.array(blobs, pa.binary())],
        ["kind", "part", "blob"])


ANCHORS, WINDOWS, RUNS = 0, 1, 2


def _scan(docs: DataFrame, hot: np.ndarray, parts: int) -> DataFrame:
    """(kind, part, blob): anchors by hash, windows at hot anchors by digest, runs already known."""
    sent = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = sent.value
        anchors: list[np.ndarray] = []
        windows: list[np.ndarray] = []

        def flush(all_of: list[np.ndarray], least: int) -> Iterator[pa.RecordBatch]:
            if sum(map(len, all_of)) <= least:
                return
            rows = np.concatenate(all_of)
            all_of.clear()
            if rows.dtype == ANCHOR:
                yield from _deal(ANCHORS, rows, rows["key"] >> np.uint64(8), parts)
                return
            first, later = _later_copies(rows)
            yield from _deal(WINDOWS, first, first["a"], parts)
            runs = _runs(later)
            if len(runs):
                yield from _deal(RUNS, runs, runs["doc"].view(np.uint64), parts)

        for batch, texts in _documents(batches):
            text, pos, lo, hi, key = scan_anchors(texts)
            doc, copy = (batch.column(c).to_numpy() for c in ("doc", "copy"))
            at = np.searchsorted(hot, key)
            often = (hot[np.minimum(at, len(hot) - 1)] == key) if len(hot) else np.zeros(len(key), dtype=bool)
            rows = np.zeros(int((~often).sum()), dtype=ANCHOR)
            rest = ~often
            for f, x in (("key", key), ("doc", doc[text]), ("copy", copy[text]), ("pos", pos), ("lo", lo), ("hi", hi)):
                rows[f] = x[rest]
            anchors.append(rows)
            count = (hi - lo + 1)[often]
            if len(count):
                w = np.zeros(int(count.sum()), dtype=WINDOW)
                own = np.repeat(np.flatnonzero(often), count)
                w["pos"] = lo[own] + np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
                w["doc"], w["copy"] = doc[text[own]], copy[text[own]]
                digests = b"".join([xxhash.xxh3_128_digest(texts[t][p:p + LENGTH])
                                    for t, p in zip(text[own].tolist(), w["pos"].tolist(), strict=True)])
                w["a"], w["b"] = np.frombuffer(digests, dtype="<u8").reshape(-1, 2).T
                windows.append(w)
            yield from flush(anchors, HELD)
            yield from flush(windows, HELD)
        yield from flush(anchors, 0)
        yield from flush(windows, 0)

    return map_arrow(docs.select("doc", "copy", "text"), run, "kind int, part long, blob binary")


def _match(scanned: DataFrame) -> DataFrame:
    """(kind, doc, copy, pos, lo, hi, key): repeated anchors, or runs (pos, hi = number of windows)."""
    def run(group: pa.Table) -> pa.Table:
        kind = group.column("kind")[0].as_py()
        raw = b"".join(group.column("blob").to_pylist())
        out_kind = RUNS
        if kind == ANCHORS:
            rows = np.frombuffer(raw, dtype=ANCHOR)
            _, inverse, n = np.unique(rows["key"], return_inverse=True, return_counts=True)
            rows = rows[n[inverse] > 1]
            out_kind = ANCHORS
            cols = [rows[f] for f in ("doc", "copy", "pos", "lo", "hi")] + [rows["key"].view(np.int64)]
        else:
            runs = (np.frombuffer(raw, dtype=RUN) if kind == RUNS
                    else _runs(_later_copies(np.frombuffer(raw, dtype=WINDOW))[1]))
            zero = np.zeros(len(runs), dtype=np.int64)
            cols = [runs["doc"], runs["copy"], runs["pos"], zero.astype(np.int32), runs["n"], zero]
        names = ["doc", "copy", "pos", "lo", "hi", "key"]
        return pa.table({"kind": np.full(len(cols[0]), out_kind, dtype=np.int32)}
                        | {c: np.ascontiguousarray(x) for c, x in zip(names, cols, strict=True)})

    return scanned.groupBy("kind", "part").applyInArrow(
        run, "kind int, doc long, copy int, pos int, lo int, hi int, key long")


def _segments(with_anchors: DataFrame, parts: int) -> DataFrame:
    """(part, head, bytes): repeated anchors and the bytes of their windows, by the anchor's hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads: list[np.ndarray] = []
        texts: list[bytes] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not heads:
                return
            rows = np.concatenate(heads)
            part = ((rows["key"] >> np.uint64(8)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            numbers, first = np.unique(part[order], return_index=True)
            last = np.append(first[1:], len(rows))
            cuts = [order[a:b] for a, b in zip(first.tolist(), last.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(numbers), pa.array([rows[c].tobytes() for c in cuts], pa.binary()),
                 pa.array([b"".join([texts[i] for i in c.tolist()]) for c in cuts], pa.binary())],
                ["part", "head", "bytes"])
            heads.clear()
            texts.clear()

        for batch in batches:
            doc, copy = batch.column("doc").to_numpy(), batch.column("copy").to_numpy()
            lists = batch.column("anchors")
            fields = {f: lists.flatten().field(f).to_numpy() for f in ("pos", "lo", "hi", "key")}
            cuts = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            for k in range(batch.num_rows):
                a, b = int(cuts[k]), int(cuts[k + 1])
                rows = np.zeros(b - a, dtype=ANCHOR)
                rows["doc"], rows["copy"] = doc[k], copy[k]
                for f in ("pos", "lo", "hi"):
                    rows[f] = fields[f][a:b]
                rows["key"] = fields["key"][a:b].view(np.uint64)
                heads.append(rows)
                text = batch.column("text")[k].as_py()
                text = text.encode("utf-8") if isinstance(text, str) else text
                texts += [text[lo:hi + LENGTH] for lo, hi in zip(rows["lo"].tolist(), rows["hi"].tolist(), strict=True)]
                if len(texts) > HELD // 2:
                    yield from flush()
        yield from flush()

    return map_arrow(with_anchors.select("doc", "copy", "text", "anchors"), run, "part long, head binary, bytes binary")


def mark_windows(heads: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Runs of windows that an earlier equal window precedes, among the segments of one part."""
    size = heads["hi"] - heads["lo"] + LENGTH
    begin = np.cumsum(size, dtype=np.int64) - size
    order = np.lexsort((heads["pos"], heads["copy"], heads["doc"]))  # from now on, earlier rows stand first
    heads, begin, size = heads[order], begin[order], size[order].astype(np.int64)
    left = (heads["pos"] - heads["lo"]).astype(np.int64)  # bytes before the anchor
    right = size - left
    n = len(heads)

    def around(width: int, have: np.ndarray, step: int, base: np.ndarray) -> np.ndarray:
        """Up to ``width`` bytes from ``base`` on in the direction of ``step``, zeros beyond ``have``."""
        at = np.arange(width)
        inside = at < have[:, None]
        index = np.where(inside, base[:, None] + step * at, 0)
        return np.where(inside, data[index], 0).astype(np.uint8)

    r_order, r_lcp = sort_strings(around(LENGTH, right, 1, begin + left))
    l_order, l_lcp = sort_strings(around(SPAN - 1, left, -1, begin + left - 1))
    low, high = (heads["pos"] - heads["hi"]).astype(np.int64), left  # offsets of the anchor in its windows
    marked = np.zeros((n, SPAN), dtype=bool)  # by window start, counted from lo
    for d in range(SPAN):
        active = np.flatnonzero((low <= d) & (d <= high))
        if len(active) < 2:
            continue
        key = classes_at(r_order, r_lcp, LENGTH - d)[active] * (n + 1) + classes_at(l_order, l_lcp, d)[active]
        first = np.unique(key, return_index=True)[1]
        later = np.ones(len(active), dtype=bool)
        later[first] = False
        hit = active[later]
        marked[hit, left[hit] - d] = True
    row, start = np.nonzero(marked)
    windows = np.zeros(len(row), dtype=RUN)
    for f in ("doc", "copy"):
        windows[f] = heads[f][row]
    windows["pos"] = heads["lo"][row] + start
    return _runs(windows)


def _sorted_runs(segments: DataFrame) -> DataFrame:
    """(doc, copy, pos, n): marked runs of every part."""
    def run(group: pa.Table) -> pa.Table:
        heads = np.frombuffer(b"".join(group.column("head").to_pylist()), dtype=ANCHOR)
        data = np.frombuffer(b"".join(group.column("bytes").to_pylist()), dtype=np.uint8)
        runs = mark_windows(heads, data)
        return pa.table({f: np.ascontiguousarray(runs[f]) for f in ("doc", "copy", "pos", "n")})

    return segments.groupBy("part").applyInArrow(run, "doc long, copy int, pos int, n int")


def _numbered(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """``docs`` with ``doc`` (the id, null last) and ``copy``: 0, or the place among the rows that share the id."""
    keyed = docs.withColumn("doc", F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)))
    if keyed.groupBy("doc").count().where("count > 1").isEmpty():
        return keyed.withColumn("copy", F.lit(0))
    same = W.partitionBy("doc").orderBy(F.xxhash64(text), F.md5(text))
    return keyed.withColumn("copy", (F.row_number().over(same) - 1).cast("int"))


def _equal_texts(numbered: DataFrame) -> DataFrame:
    """(doc, copy, pos, n): the runs of documents whose whole text an earlier document has."""
    long_ones = numbered.where(F.octet_length("text") >= LENGTH).select(
        "doc", "copy", F.octet_length("text").alias("size"), F.unhex(F.md5("text")).alias("digest"))
    # stored, so that the join below deals its sides by itself and Spark can split a large group of copies
    first = stored(long_ones.groupBy("digest", "size").agg(
        F.min(F.struct("doc", "copy")).alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1"), "first-texts")
    later = long_ones.join(first, ["digest", "size"]).where(
        (F.col("doc") != F.col("first.doc")) | (F.col("copy") != F.col("first.copy")))
    return stored(later.select("doc", "copy", F.lit(0).alias("pos"), (F.col("size") - LENGTH + 1).cast("int").alias("n")),
                  "equal-texts")


def duplicate_runs(numbered: DataFrame) -> DataFrame:
    """(doc, copy, runs): starts and counts of the windows of each document that also start earlier."""
    ship(numbered.sparkSession)
    equal = _equal_texts(numbered)
    numbered = numbered.join(small_side(equal.select("doc", "copy")), ["doc", "copy"], "left_anti")
    total, hot = _hot_anchors(numbered)
    parts = max(int(numbered.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PART))
    found = stored(_match(_scan(numbered, hot, parts)), "anchors")
    anchors = found.where(F.col("kind") == ANCHORS).groupBy("doc", "copy").agg(
        F.collect_list(F.struct("pos", "lo", "hi", "key")).alias("anchors"))
    segments = _segments(numbered.join(anchors, ["doc", "copy"]), parts)
    runs = _sorted_runs(segments).unionByName(
        found.where(F.col("kind") == RUNS).select("doc", "copy", "pos", F.col("hi").alias("n"))).unionByName(equal)
    return stored(runs.groupBy("doc", "copy").agg(F.collect_list(F.struct("pos", "n")).alias("runs")), "runs")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept binary) for every row."""
    numbered = _numbered(docs.select(F.col(id_col), F.col(text).alias("text")), id_col, "text")
    marked = numbered.join(duplicate_runs(numbered), ["doc", "copy"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, texts in _documents(iter([whole])):
                runs = batch.column("runs").to_pylist()
                kept, removed, spans = [], [], []
                for t, marks in zip(texts, runs, strict=True):
                    cover = sorted((r["pos"], r["pos"] + r["n"] - 1 + LENGTH) for r in marks or ())
                    merged: list[list[int]] = []
                    for a, b in cover:
                        if merged and a <= merged[-1][1]:
                            merged[-1][1] = max(b, merged[-1][1])
                        else:
                            merged.append([a, b])
                    edges = [0, *(x for m in merged for x in m), len(t)]
                    kept.append(b"".join([t[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]))
                    removed.append(sum(b - a for a, b in merged))
                    spans.append(len(merged))
                size = [len(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(id_col), pa.array(size, pa.int64()), pa.array(removed, pa.int64()),
                     pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
                    [id_col, "n_bytes", "n_removed", "n_spans", "kept"])

    kind = numbered.schema[id_col].dataType.simpleString()
    return map_arrow(marked.select(id_col, "text", "runs"), run,
                     f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
