"""All-pairs work on vectors in bounded blocks.

Rows are dealt to blocks by a hash of their id; a task gets one block of queries
and one of data, so its memory doesn't depend on the table, and each pair of rows
meets exactly once. Only what a kernel keeps (the k best, or sums by label) leaves
a block; no plan node holds the pairs themselves.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 4096


def block_count(rows: int, block_rows: int = BLOCK_ROWS) -> int:
    return max(1, -(-rows // block_rows))


def pair_blocks(queries: DataFrame, data: DataFrame, kernel: Callable[[pa.Table, pa.Table], pa.Table], schema: str, key: str = "id", block_rows: int = BLOCK_ROWS, rows: tuple[int, int] | None = None) -> DataFrame:
    """Runs kernel(queries of a block, data of a block) over all pairs of blocks; both sides need the column key. rows: how many there are of each, if known."""
    n_queries, n_data = rows or (queries.count(), data.count())
    nq, nd = block_count(n_queries, block_rows), block_count(n_data, block_rows)

    def dealt(df: DataFrame, own: Column, mine: int, other: int, names: tuple[str, str]) -> DataFrame:
        there = F.explode(F.sequence(F.lit(0), F.lit(other - 1))) if other > 1 else F.lit(0)
        return df.withColumn(names[0], F.pmod(own, F.lit(mine)).cast("int")).withColumn(names[1], there)

    left = dealt(queries, F.xxhash64(key), nq, nd, ("qb", "db"))
    right = dealt(data, F.xxhash64(key), nd, nq, ("db", "qb"))
    return left.groupBy("qb", "db").cogroup(right.groupBy("qb", "db")).applyInArrow(kernel, schema)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows of a float64 matrix; a null vector, one of another length and a component that is null or not finite are errors."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(array):
        return np.zeros((0, 0))
    if array.null_count:
        raise ValueError("a vector is null")
    sizes, held = np.diff(array.offsets.to_numpy()), array.flatten()
    if (sizes != sizes[0]).any():
        raise ValueError("vectors differ in length")
    if held.null_count:
        raise ValueError("a vector has a null component")
    flat = held.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if not np.isfinite(flat).all():
        raise ValueError("a vector has a component that is not finite")
    return flat.reshape(len(array), -1)


def square_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances, to rounding; see `exact_distance` for the ones that are kept."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T), 0.0)


def exact_distance(a: np.ndarray, rows: np.ndarray) -> np.ndarray:
    diff = rows - a
    return np.sqrt((diff * diff).sum(axis=1))
