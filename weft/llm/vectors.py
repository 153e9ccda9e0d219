"""Current, usable vectors and how they travel: unit length, packed into bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

DIMENSION = 64


def usable(c: str, dimension: int = DIMENSION) -> Column:
    """True for ``dimension`` finite values that are not all zero; false for anything else, null included."""
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(c) == dimension) & finite & F.exists(c, lambda x: x != 0), F.lit(False))


def current_vectors(payloads: DataFrame, dimension: int = DIMENSION) -> DataFrame:
    """vec_id, vector: of each vec_id the vector of its row with the highest lsn, if it is usable.

    A null lsn is older than any other; rows of one lsn that differ are ordered by written_at, then by vector. Rows
    without vec_id are left out. If the latest vector isn't usable, the vec_id has no row, whatever earlier ones hold.
    """
    last = payloads.where("vec_id IS NOT NULL").groupBy("vec_id").agg(F.max_by("vector", F.struct("lsn", "written_at", "vector")).alias("vector"))
    return last.where(usable("vector", dimension))


def matrix(column: pa.Array | pa.ChunkedArray, dtype: str = "float32", dimension: int = DIMENSION) -> np.ndarray:
    """Rows of packed bytes as a matrix; a view of the column's own memory."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if not len(column):
        return np.zeros((0, dimension), dtype)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(dtype).reshape(-1, dimension)


def as_bytes(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as packed bytes."""
    ends = np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] * x.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(x))])


def listed(column: pa.Array, dimension: int = DIMENSION) -> np.ndarray:
    """Rows of usable lists as a matrix of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)


def packed(df: DataFrame, key: str, vector: str, dtype: str = "float32") -> DataFrame:
    """key, unit: the vectors scaled to length one, as bytes of ``dtype``."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = listed(batch.column(1))
            # by the greatest value first, so that no square overflows or vanishes
            x /= np.abs(x).max(axis=1, keepdims=True)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), as_bytes(x.astype(dtype))], [key, "unit"])

    return df.select(F.col(key).cast("long").alias(key), vector).mapInArrow(pack, f"{key} long, unit binary")
