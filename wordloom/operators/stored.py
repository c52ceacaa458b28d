"""Labelled rows of any number for the fits of a search: written in order once, read in slices inside tasks.

``write_rows`` sorts the rows by the md5 of their ids and writes them as packed Parquet rows below the shared folder; the
driver keeps the names and sizes of the files only.  The first tasks of a machine lay the files out as memory-mapped arrays
in the executor's own folder (non-zero entries, bins, base of the kernel maps, labels, folds), each file by whoever comes
first; all tasks there read them.  A fit holds a few numbers a row and slices of dense rows, never the table.
"""

from __future__ import annotations

import fcntl
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path, ship
from .blocks import DENSE_ROWS, Sparse, sample_columns
from .fits import Prepared
from .kernels import COMPONENTS, KernelMap
from .trees import MAX_BINS, Bins

# Rows of a subset up to which a fit holds them dense.
HELD_ROWS = 2_000
# Rows whose entries boosting counts at a time.
COUNTED_ROWS = 16_384
PACKED = "n long, entries long, lens binary, cols binary, vals binary, y binary, fold binary"


@dataclass
class Store:
    """Files of packed rows in md5 order; what the driver keeps and a task is told."""

    folder: str
    files: list[tuple[str, int, int]]  # name, rows, entries
    dim: int
    levels: list[str]
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    @property
    def n(self) -> int:
        return sum(rows for _, rows, _ in self.files)

    def source(self) -> str:
        """The folder as this machine sees it: shared, or fetched from the cluster's file system."""
        url = urlparse(self.folder)
        return unquote(url.path) if url.scheme in ("", "file") else SparkFiles.get(os.path.basename(url.path))

    def open(self, bins: Bins) -> StoredRows:
        """All rows, laid out on this machine if they are not yet."""
        at = os.path.join(SparkFiles.getRootDirectory(), f"rows-{self.name}")
        os.makedirs(at, exist_ok=True)
        maps = self._maps(at)
        first = os.getpid() % max(len(self.files), 1)  # workers that start together begin with different files
        starts = np.cumsum([(0, 0)] + [(rows, entries) for _, rows, entries in self.files], axis=0)
        for i in [*range(first, len(self.files)), *range(first)]:
            with open(f"{at}/{i}.lock", "w") as lock:
                fcntl.flock(lock, fcntl.LOCK_EX)
                if not os.path.exists(f"{at}/{i}.done"):
                    self._lay_out(maps, bins, at, i, *starts[i].tolist())
                    open(f"{at}/{i}.done", "w").close()
        cells = [(int(starts[i][0]), np.load(f"{at}/{i}.ends.npy", mmap_mode="r"), np.load(f"{at}/{i}.cells.npy", mmap_mode="r"))
                 for i in range(len(self.files))]
        return StoredRows(maps, cells, bins, self.levels, np.arange(self.n))

    def _maps(self, at: str) -> dict[str, np.ndarray]:
        entries, levels = sum(e for *_, e in self.files), len(self.levels)
        forms = {"lens": (np.int32, (self.n,)), "cols": (np.int32, (entries,)), "vals": (np.float64, (entries,)),
                 "y": (np.int8, (self.n, levels)), "fold": (np.int32, (self.n, levels)), "binned": (np.uint8, (self.n, self.dim)),
                 "rbf": (np.float32, (self.n, COMPONENTS // 2)), "poly": (np.float32, (self.n, COMPONENTS))}
        maps = {}
        with open(f"{at}/lock", "w") as lock:
            fcntl.flock(lock, fcntl.LOCK_EX)
            for name, (kind, shape) in forms.items():
                size = max(int(np.prod(shape)), 1) * np.dtype(kind).itemsize
                with open(f"{at}/{name}", "ab") as f:  # made at its size by the first, kept by the others
                    if f.tell() < size:
                        f.truncate(size)
                maps[name] = np.memmap(f"{at}/{name}", dtype=kind, mode="r+", shape=shape) if np.prod(shape) else np.zeros(shape, kind)
        return maps

    def _lay_out(self, maps: dict[str, np.ndarray], bins: Bins, at: str, i: int, row: int, entry: int) -> None:
        """Writes the rows of file ``i``, which begin at ``row`` and ``entry``."""
        ends, cells = [np.zeros(1, dtype=np.int64)], [np.zeros(0, dtype=np.int32)]
        bases = {kind: KernelMap(kind, 1.0, self.dim) for kind in ("rbf", "poly")}
        for batch in pq.ParquetFile(os.path.join(self.source(), self.files[i][0])).iter_batches(1):
            for p in batch.to_pylist():
                n, m = p["n"], p["entries"]
                lens, cols, vals = (np.frombuffer(p[k], dtype=maps[k].dtype) for k in ("lens", "cols", "vals"))
                maps["lens"][row:row + n], maps["cols"][entry:entry + m], maps["vals"][entry:entry + m] = lens, cols, vals
                for k in ("y", "fold"):
                    maps[k][row:row + n] = np.frombuffer(p[k], dtype=maps[k].dtype).reshape(n, -1)
                for start, x in Sparse(np.append(0, np.cumsum(lens, dtype=np.int64)), cols, vals, self.dim).slices():
                    here = slice(row + start, row + start + len(x))
                    binned = maps["binned"][here] = bins.apply(x)
                    for kind, mapping in bases.items():
                        maps[kind][here] = mapping.base(x)
                    r, c = np.nonzero(binned)
                    ends.append(ends[-1][-1] + np.cumsum(np.bincount(r, minlength=len(x))))
                    cells.append((bins.at[c] + binned[r, c] - 1).astype(np.int32))
                row, entry = row + n, entry + m
        for name, parts in (("ends", ends), ("cells", cells)):
            np.save(f"{at}/{i}.{name}.npy", np.concatenate(parts))


class _Slice(Prepared):
    """Some stored rows, each form read when first asked for."""

    def __init__(self, whole: StoredRows, which: np.ndarray):
        self.whole, self.of_whole, self.bins, self._made = whole, which, whole.bins, {}

    n = property(lambda self: len(self.of_whole))
    d = property(lambda self: self.whole.d)

    @property
    def x(self) -> np.ndarray:
        return self._once("x", lambda: self.whole.dense(self.of_whole))

    @property
    def binned(self) -> np.ndarray:
        return self._once("binned", lambda: np.array(self.whole.binned[self.of_whole]))

    @property
    def single(self) -> np.ndarray:
        return self._once("single", lambda: self.whole.dense(self.of_whole, np.float32))

    def base(self, mapping: KernelMap) -> np.ndarray:
        return self._once(mapping.kind, lambda: self.whole.maps[mapping.kind][self.of_whole].astype(np.float64))


class StoredRows:
    """Rows ``which`` of a store, with the forms of ``Prepared`` slice by slice."""

    held = False

    def __init__(self, maps: dict, cells: list, bins: Bins, levels: list[str], which: np.ndarray, ends: np.ndarray | None = None):
        self.maps, self.cells, self.bins, self.levels, self.which = maps, cells, bins, levels, which
        self.ends = np.append(0, np.cumsum(maps["lens"], dtype=np.int64)) if ends is None else ends
        self.y, self.fold, self.binned = maps["y"], maps["fold"], maps["binned"]
        self.n, self.d = len(which), maps["binned"].shape[1]

    def rows(self, which: np.ndarray) -> Prepared | StoredRows:
        """Some of the rows; few of them as they are held in memory."""
        which = self.which[which]
        return _Slice(self, which) if len(which) <= HELD_ROWS else StoredRows(
            self.maps, self.cells, self.bins, self.levels, which, self.ends)

    def parts(self, rows: int = DENSE_ROWS) -> Iterator[tuple[int, Prepared]]:
        for start in range(0, self.n, rows):
            yield start, _Slice(self, self.which[start:start + rows])

    def _entries(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each row's entries in the stored arrays, and the row (by place in ``which``) of each."""
        first, lens = self.ends[which], self.ends[which + 1] - self.ends[which]
        row = np.repeat(np.arange(len(which)), lens)
        return np.arange(len(row)) + np.repeat(first - (np.cumsum(lens) - lens), lens), row

    def dense(self, which: np.ndarray, dtype=np.float64) -> np.ndarray:
        at, row = self._entries(which)
        out = np.zeros((len(which), self.d), dtype=dtype)
        out[row, self.maps["cols"][at]] = self.maps["vals"][at]
        return out

    def gamma(self, setting: str | float) -> float:
        """``kernels.gamma_of`` without a dense table: the variance of all entries in two passes over the non-zero ones."""
        if setting != "scale":
            return 1.0 / self.d if setting == "auto" else float(setting)

        def total(of) -> float:
            return sum(float(of(self.maps["vals"][self._entries(self.which[s:s + COUNTED_ROWS])[0]])) for s in range(
                0, self.n, COUNTED_ROWS))

        size = self.n * self.d
        mean = total(np.sum) / size
        square, entries = total(lambda v: ((v - mean) ** 2).sum()), total(len)
        variance = (square + (size - entries) * mean * mean) / size
        return 1.0 / (self.d * variance) if variance > 0 else 1.0

    def segments(self) -> StoredSegments:
        return StoredSegments(self)


class StoredSegments:
    """``trees.Segments`` of stored rows: the entries are read anew for each histogram, some rows at a time."""

    def __init__(self, rows: StoredRows):
        at = rows.bins.at
        self.rows, self.width = rows, int(at[-1])
        self.feature = np.repeat(np.arange(len(at) - 1), np.diff(at))
        self.cut = np.arange(at[-1]) - at[:-1][self.feature]
        self.end = at[1:][self.feature]

    def right_sums(self, place: np.ndarray, stats: np.ndarray, n: int) -> np.ndarray:
        whole = np.full(len(self.rows.binned), -1, dtype=np.int64)
        whole[self.rows.which] = place
        local = np.zeros(len(whole), dtype=np.int64)
        local[self.rows.which] = np.arange(self.rows.n)
        hist = np.zeros((len(stats), n * self.width))
        for begin, ends, cells in self.rows.cells:
            for s in range(0, len(ends) - 1, COUNTED_ROWS):
                e = min(s + COUNTED_ROWS, len(ends) - 1)
                used = s + np.flatnonzero(whole[begin + s:begin + e] >= 0)
                if not len(used):
                    continue
                lens = ends[used + 1] - ends[used]
                at = np.arange(lens.sum()) + np.repeat(ends[used] - (np.cumsum(lens) - lens), lens)
                key = np.repeat(whole[begin + used] * self.width, lens) + cells[at]
                for to, stat in zip(hist, stats, strict=True):
                    to += np.bincount(key, weights=np.repeat(stat[local[begin + used]], lens), minlength=n * self.width)
        run = np.zeros((len(stats), n, self.width + 1), dtype=np.float32)
        for to, h in zip(run, hist, strict=True):
            to[:, :-1] = np.cumsum(h.reshape(n, self.width)[:, ::-1], axis=1)[:, ::-1]
        return run[..., :-1] - run[..., self.end]


# ------------------------------------------------------------ writing

def bins_of(frame: DataFrame, dim: int, n: int, features_col: str = "features", max_bins: int = MAX_BINS) -> Bins:
    """``Bins.fit`` of all rows of ``frame``: distinct values are counted by feature, and the driver gets at most
    ``max_bins`` of each."""
    ship(frame.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = Sparse.of_vectors(batch.column("_x"), dim)
            keep = x.vals != 0
            cols, vals = x.cols[keep].astype(np.int64), x.vals[keep]
            order = np.lexsort((vals, cols))
            cols, vals = cols[order], vals[order]
            new = np.flatnonzero(np.append(True, (cols[1:] != cols[:-1]) | (vals[1:] != vals[:-1]))[:len(cols)])
            yield pa.RecordBatch.from_arrays([pa.array(cols[new]), pa.array(vals[new]), pa.array(np.diff(np.append(new, len(cols))))],
                                             ["feature", "value", "k"])

    seen = frame.select(F.col(features_col).alias("_x")).mapInArrow(counted, "feature long, value double, k long")
    seen = seen.groupBy("feature", "value").agg(F.sum("k").alias("k"))
    # a zero for every row in which the feature is not
    zeros = frame.sparkSession.range(dim).select(F.col("id").alias("feature")).join(
        seen.groupBy("feature").agg(F.sum("k").alias("_k")), "feature", "left").select(
        "feature", F.lit(0.0).alias("value"), (F.lit(n) - F.coalesce("_k", F.lit(0))).alias("k")).where("k > 0")
    places = np.quantile(np.arange(n), np.linspace(0, 1, max_bins + 1)[1:-1], method="lower").astype(int).tolist()
    by = Window.partitionBy("feature")
    up = by.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = seen.unionByName(zeros).select("feature", "value", "k", F.sum("k").over(up).alias("_to"),
                                            F.count(F.lit(1)).over(up).alias("_i"))
    met = F.exists(F.array(*map(F.lit, places)), lambda i: (i >= F.col("_to") - F.col("k")) & (i < F.col("_to")))
    # the values at the places, the last one, and the first of all up to one more than few
    kept = ranked.where(met | (F.col("_to") == n) | (F.col("_i") <= max_bins + 1)).select(
        "feature", "value", "_i", met.alias("_met")).collect()
    found: dict[int, list] = {}
    for r in kept:
        found.setdefault(r["feature"], []).append((r["value"], r["_i"], r["_met"]))
    edges = []
    for j in range(dim):
        values = sorted(found.get(j, []))
        v = np.array([value for value, *_ in values])
        if values and max(i for _, i, _ in values) > max_bins:
            cut = np.unique([value for value, _, hit in values if hit])
            edges.append(cut[cut < v.max()])
        else:
            edges.append((v[1:] + v[:-1]) / 2)
    return Bins(np.append(0, np.cumsum([len(e) for e in edges])), np.concatenate(edges) if edges else np.zeros(0))


def write_rows(frame: DataFrame, levels: list[str], dim: int, seed: str, **columns) -> Store:
    """All rows of ``frame`` in md5 order, packed a batch at a time, as files below the shared folder."""
    spark = frame.sparkSession
    ship(spark)

    def whole(column: pa.Array, dtype) -> bytes:
        flat = column.flatten()
        if flat.null_count or column.null_count:
            raise ValueError("a row to be fitted has no label or no fold")
        return flat.to_numpy(zero_copy_only=False).astype(dtype).tobytes()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = Sparse.of_vectors(batch.column("_x"), dim)
                row = [len(x), len(x.vals), np.diff(x.at).astype(np.int32).tobytes(), x.cols.astype(np.int32).tobytes(),
                       x.vals.astype(np.float64).tobytes(), whole(batch.column("_y"), np.int8), whole(batch.column("_fold"), np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row], [c.split(" ")[0] for c in PACKED.split(", ")])

    path = scratch_path(spark, "rows")
    sample_columns(frame, levels, seed, **columns).orderBy("_key").drop("_key").mapInArrow(pack, PACKED).write.parquet(path)
    sizes = spark.read.parquet(path).groupBy(F.input_file_name().alias("file")).agg(F.sum("n").alias("n"), F.sum("entries").alias("m"))
    files = sorted((os.path.basename(unquote(r["file"])), r["n"], r["m"]) for r in sizes.collect())
    if urlparse(path).scheme not in ("", "file"):
        spark.sparkContext.addFile(path, recursive=True)
    return Store(path, files, dim, list(levels))
