"""Rows of sparse feature vectors as numpy blocks inside tasks, and labelled rows of a bounded number."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of a vector batch that are made dense at a time.
DENSE_ROWS = 512


@dataclass
class Sparse:
    """Rows of non-zero entries: row i has ``cols[at[i]:at[i + 1]]`` and ``vals`` alike."""

    at: np.ndarray
    cols: np.ndarray
    vals: np.ndarray
    dim: int

    def __len__(self) -> int:
        return len(self.at) - 1

    def dense(self, start: int = 0, stop: int | None = None, dtype=np.float64) -> np.ndarray:
        stop = len(self) if stop is None else min(stop, len(self))
        a, b = self.at[start], self.at[stop]
        out = np.zeros((stop - start, self.dim), dtype=dtype)
        row = np.repeat(np.arange(stop - start), np.diff(self.at[start:stop + 1]))
        out[row, self.cols[a:b]] = self.vals[a:b]
        return out

    @classmethod
    def of_vectors(cls, column: pa.Array | pa.ChunkedArray, dim: int) -> Sparse:
        """A column of ML vectors, which cross Arrow as their stored parts: type (0 sparse, 1 dense), indices, values."""
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
        kind, _, indices, values = column.flatten()
        sizes = np.diff(values.offsets.to_numpy()).astype(np.int64)
        at = np.append(0, np.cumsum(sizes))
        cols = np.arange(at[-1]) - np.repeat(at[:-1], sizes)  # of dense rows
        cols[np.repeat(kind.to_numpy(zero_copy_only=False) == 0, sizes)] = indices.flatten().to_numpy()
        return cls(at, cols, values.flatten().to_numpy(), dim)

    def slices(self, rows: int = DENSE_ROWS, dtype=np.float64) -> Iterator[tuple[int, np.ndarray]]:
        for start in range(0, len(self), rows):
            yield start, self.dense(start, start + rows, dtype)


@dataclass
class Sample:
    """At most a stated number of labelled rows, in md5 order of their ids."""

    x: Sparse
    y: np.ndarray  # rows × levels, 0 or 1
    fold: np.ndarray  # rows × levels
    levels: list[str]


def sample_columns(frame: DataFrame, levels: list[str], seed: str, id_col: str = "doc_id", features_col: str = "features",
                   fold_col: str = "fold_{level}") -> DataFrame:
    """(_key, _y, _fold, _x): md5 of the id, labels and folds by level, vector."""
    folds = [fold_col.format(level=lv) for lv in levels]
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    return frame.select(key.alias("_key"), F.array(*[F.col(lv).cast("int") for lv in levels]).alias("_y"),
                        F.array(*[F.col(f).cast("int") for f in folds]).alias("_fold"), F.col(features_col).alias("_x"))


def labelled_sample(frame: DataFrame, levels: list[str], dim: int, rows: int, seed: str, **columns) -> Sample:
    """The first ``rows`` rows of ``frame`` in md5 order, with labels and folds; ``rows`` bounds what the driver holds."""
    first = sample_columns(frame, levels, seed, **columns).orderBy("_key").limit(rows).toArrow()
    lists = {n: np.array(first.column(n).to_pylist(), dtype=np.int64).reshape(-1, len(levels)) for n in ("_y", "_fold")}
    return Sample(Sparse.of_vectors(first.column("_x"), dim), lists["_y"], lists["_fold"], list(levels))
