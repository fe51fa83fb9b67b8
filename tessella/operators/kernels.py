"""Arrow batches to dense NumPy blocks and back, for the few array kernels that run in Python."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

Kernel = Callable[..., np.ndarray]


def dense_block(column: pa.Array | pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """View a list column as a float64 block ``(rows, width)``; ragged or null data is an error."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        raise ValueError("vector column contains nulls")
    rows = len(column)
    flat = column.flatten()
    if flat.null_count:
        raise ValueError("vector column contains null entries")
    if rows == 0:
        return np.empty((0, width or 0))
    lengths = np.diff(column.offsets.to_numpy())
    found = int(lengths[0])
    if (lengths != found).any():
        raise ValueError("vector column is ragged")
    if width is not None and found != width:
        raise ValueError(f"feature dim {found} != expected {width}")
    return flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(rows, found)


def list_column(block: np.ndarray) -> pa.ListArray:
    rows, width = block.shape
    offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * width)
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(block).ravel()))


def block_function(kernel: Kernel, *columns: Column) -> Column:
    """Run ``kernel(*blocks) -> block`` on whole Arrow batches of vector columns.

    Chained kernels are fused into one Python evaluation. A filter on a result, or an ``explode``
    of it (which implies one), is pushed below and runs the kernel twice; ``explode_outer`` on
    these never-empty vectors avoids that.
    """

    def run(*arrays: pa.Array) -> pa.Array:
        return list_column(kernel(*[dense_block(a) for a in arrays]))

    return F.arrow_udf(run, "array<double>")(*columns)


def row_function(kernel: Kernel, *columns: Column) -> Column:
    """Run ``kernel(*blocks) -> vector`` giving one double per row."""

    def run(*arrays: pa.Array) -> pa.Array:
        return pa.array(kernel(*[dense_block(a) for a in arrays]), pa.float64())

    return F.arrow_udf(run, "double")(*columns)


def affine(column: Column, matrix: np.ndarray, offset: np.ndarray | None = None) -> Column:
    """``x @ matrix + offset`` for every row."""
    shift = np.zeros(matrix.shape[1]) if offset is None else offset

    def kernel(x: np.ndarray) -> np.ndarray:
        if x.shape[1] != matrix.shape[0]:
            raise ValueError(f"feature dim {x.shape[1]} != fitted {matrix.shape[0]}")
        return x @ matrix + shift

    return block_function(kernel, column)
