"""Distributed matrix sums: covariance and outer-product totals in one pass over the data.

Every task folds its rows into one partial matrix and emits it row by row, on the splits as they are. The
partial rows of one matrix row are merged by a tree: each level shuffles on the matrix row and the group of
tasks, and a reducer folds at most ``FAN_IN`` partials of a row at a time, in the order of their tasks, so
sums repeat bit by bit on the same splits. What reaches the driver is one ``width x width`` matrix.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.errors import SizeBoundError
from tessella.operators.kernels import dense_block, list_column
from tessella.session import MAX_MODEL_CELLS, bounded_rows, size_in_bytes, size_setting

# Partials of one key that a reducer of the merge tree folds.
FAN_IN = 32

BlockMap = Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Moments:
    """Count, mean and centered second-moment matrix of a vector column."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray

    def covariance(self) -> np.ndarray:
        return self.scatter / max(self.n - 1, 1)

    def rms(self) -> float:
        """Uncentered root mean square over all entries."""
        power = np.trace(self.scatter) / self.n + self.mean @ self.mean
        return float(np.sqrt(power / len(self.mean)))


def vector_width(df: DataFrame, column: str) -> int:
    row = df.select(F.size(column)).first()
    if row is None or row[0] is None or row[0] < 1:
        raise ValueError(f"no vectors in column {column!r}")
    return int(row[0])


def _check_width(rows: int, cols: int) -> None:
    if rows * cols > MAX_MODEL_CELLS:
        raise SizeBoundError(f"{rows}x{cols} aggregate exceeds the model bound")


def expected_tasks(df: DataFrame) -> int:
    """Tasks a pass over the table will roughly have; the merge tree gets its depth from it."""
    spark = df.sparkSession
    splits = size_in_bytes(df) // size_setting(spark, "spark.sql.files.maxPartitionBytes")
    return int(max(splits, int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


Merge = Callable[[tuple, tuple, tuple], tuple]


def _fold(n_keys: int, merge: Merge):
    """Streams rows ``(*keys, group, part, *payload)`` sorted by these, and folds neighbours of one group."""

    def payload(columns: list[pa.Array], at: int) -> tuple:
        values = []
        for column in columns:
            value = column[at]
            if isinstance(value, pa.ListScalar):
                values.append(value.values.to_numpy(zero_copy_only=False))
            elif isinstance(value, pa.BinaryScalar):
                values.append(np.frombuffer(value.as_buffer(), dtype="<f8"))
            else:
                values.append(value.as_py())
        return tuple(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held, schema = None, None, None

        def row() -> pa.RecordBatch:
            cells = [
                pa.array([v.astype("<f8").tobytes() if pa.types.is_binary(f.type) else v], f.type)
                for v, f in zip((held_key[-1], *held_key[:-1], *held), schema, strict=True)
            ]
            return pa.RecordBatch.from_arrays(cells, schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            if schema is None:
                named = {f.name: f for f in batch.schema}
                names = [f.name for f in batch.schema]
                kept = ["part", *names[:n_keys], *names[n_keys + 2 :]]
                schema = pa.schema([named[n] for n in kept])
            keys = list(zip(*(c.to_pylist() for c in batch.columns[: n_keys + 1]), strict=True))
            columns = batch.columns[n_keys + 2 :]
            for at, key in enumerate(keys):
                if key == held_key:
                    held = merge(key[:-1], held, payload(columns, at))
                    continue
                if held_key is not None:
                    yield row()
                held_key, held = key, payload(columns, at)
        if held_key is not None:
            yield row()

    return run


def tree_merge(partials: DataFrame, keys: list[str], merge: Merge, *, leaves: int, fan_in: int = FAN_IN, span: int = 1) -> DataFrame:
    """Merge the partials ``(part, *keys, *payload)`` of every key into one row, level by level.

    A level groups ``fan_in`` neighbouring parts (the first one ``fan_in * span``, where parts number tasks in steps
    of ``span``), and the last merges what is left, so with about ``leaves`` tasks no reducer folds more than
    ``fan_in`` tasks' partials of one group. ``merge(key, a, b)`` takes payloads as numbers and arrays; binary
    columns hold doubles. Only the running value of one group is held beside the batch that is read.
    """
    payload = [c for c in partials.columns if c not in ("part", *keys)]
    schema = partials.select("part", *keys, *payload).schema
    levels = 1
    while fan_in**levels < leaves:
        levels += 1
    for level in range(levels):
        step = fan_in * span if level == 0 else fan_in
        group = F.lit(0).cast("long") if level == levels - 1 else F.floor(F.col("part") / step).cast("long")
        grouped = partials.select(*keys, group.alias("group"), "part", *payload)
        dealt = grouped.repartition(*keys, "group").sortWithinPartitions(*keys, "group", "part")
        partials = dealt.mapInArrow(_fold(len(keys), merge), schema)
    return partials.drop("part")


def vector_moments(
    df: DataFrame, column: str | Column, *, width: int, block_map: BlockMap | None = None
) -> Moments:
    """Moments of a vector column, or of ``block_map`` applied to it (``width`` outputs).

    Partials are centered on their own mean and merged pairwise, so a mean that dwarfs the
    spread does not cancel.
    """
    _check_width(width, width)
    vectors = df.select((F.col(column) if isinstance(column, str) else column).alias("v"))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, scatter = 0, np.zeros(width), np.zeros((width, width))
        for batch in batches:
            block = dense_block(batch.column(0))
            if len(block) == 0:
                continue
            block = block_map(block) if block_map else block
            if block.shape[1] != width:
                raise ValueError(f"feature dim {block.shape[1]} != expected {width}")
            mean_b = block.mean(axis=0)
            centered = block - mean_b
            delta, total = mean_b - mean, n + len(block)
            scatter += centered.T @ centered
            scatter += np.outer(delta, delta) * (n * len(block) / total)
            mean = mean + delta * (len(block) / total)
            n = total
        if n:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(width, TaskContext.get().partitionId(), dtype=np.int64)),
                    pa.array(np.arange(width, dtype=np.int32)),
                    pa.array(np.full(width, n, dtype=np.int64)),
                    list_column(np.broadcast_to(mean, (width, width))),
                    list_column(scatter),
                ],
                names=["part", "i", "n", "mean", "scatter"],
            )

    def merge(key: tuple, a: tuple, b: tuple) -> tuple:
        (n_a, mean_a, row_a), (n_b, mean_b, row_b) = a, b
        delta, total = mean_b - mean_a, n_a + n_b
        row = row_a + row_b + delta[key[0]] * delta * (n_a * n_b / total)
        return total, mean_a + delta * (n_b / total), row

    schema = "part bigint, i int, n bigint, mean array<double>, scatter array<double>"
    merged = tree_merge(vectors.mapInArrow(partial, schema), ["i"], merge, leaves=expected_tasks(df))
    rows = sorted(bounded_rows(merged, width, "moment rows"), key=lambda r: r["i"])
    if not rows:
        return Moments(0, np.zeros(width), np.zeros((width, width)))
    return Moments(rows[0]["n"], np.array(rows[0]["mean"]), np.array([r["scatter"] for r in rows]))


def outer_sum(
    df: DataFrame,
    columns: list[str | Column],
    kernel: Callable[..., np.ndarray],
    shape: tuple[int, int],
) -> DataFrame:
    """Sum ``kernel(*blocks)`` (a matrix of ``shape`` per batch) over the whole table.

    Returns the matrix as a table ``(i, row ARRAY<DOUBLE>)``.
    """
    n_rows, n_cols = shape
    _check_width(n_rows, n_cols)
    inputs = df.select(
        *[(F.col(c) if isinstance(c, str) else c).alias(f"c{k}") for k, c in enumerate(columns)]
    )

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(shape), False
        for batch in batches:
            if batch.num_rows:
                total += kernel(*[dense_block(c) for c in batch.columns])
                seen = True
        if seen:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n_rows, TaskContext.get().partitionId(), dtype=np.int64)),
                    pa.array(np.arange(n_rows, dtype=np.int32)),
                    list_column(total),
                ],
                names=["part", "i", "row"],
            )

    schema = "part bigint, i int, row array<double>"
    partials = inputs.mapInArrow(partial, schema)
    merged = tree_merge(partials, ["i"], lambda _, a, b: (a[0] + b[0],), leaves=expected_tasks(df))
    return merged.select("i", "row")


def table_matrix(table: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """Collect an ``(i, row)`` table produced by :func:`outer_sum`."""
    _check_width(*shape)
    dense = np.zeros(shape)
    for row in bounded_rows(table, shape[0], "matrix rows"):
        dense[row["i"]] = row["row"]
    return dense
