"""Matrices too large for one task: tables of dense blocks, their products, and whitening through them.

A matrix of any size is a table ``(bi, bj, block)`` of square blocks (ragged at the lower and right edges), each
a binary column of row-major doubles. A pass over vectors yields the outer product of one pair of column blocks
at a time, and partial blocks are merged by block pair through a tree. Products join block columns with block
rows. The inverse square root of a covariance is found by coupled Newton-Schulz steps of such products, each a
written table, so a lost executor repeats at most a step. Neither a task nor the driver ever holds a whole matrix:
tasks hold a few blocks and a bounded batch of vectors, the driver a mean vector and single numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.guards import above, at_least
from tessella.operators.kernels import dense_block, list_column
from tessella.operators.moments import FAN_IN, expected_tasks, tree_merge
from tessella.operators.whitening import DEFAULT_EPS
from tessella.session import saved, union_all

# Rows and columns of a block (8 MB), bytes of vectors a task gathers before it forms their products.
BLOCK_SIZE, BATCH_BYTES = 1024, 1 << 26
BLOCK_SCHEMA = "bi int, bj int, block binary"
# Chunks of one task, in the numbers of partials.
_CHUNKS = 1 << 20


def _packed(block: np.ndarray) -> bytes:
    return np.ascontiguousarray(block, dtype="<f8").tobytes()


def _span(size: int, index: int, width: int) -> slice:
    return slice(index * size, min(width, (index + 1) * size))


def _shapes(n_rows: int, n_cols: int, size: int):
    """The shape of a block from its numbers; what tasks need to know of a matrix."""

    def shape_of(bi: int, bj: int) -> tuple[int, int]:
        rows, cols = _span(size, bi, n_rows), _span(size, bj, n_cols)
        return rows.stop - rows.start, cols.stop - cols.start

    return shape_of


@dataclass(frozen=True)
class BlockMatrix:
    """A matrix as a table of blocks; blocks that are absent are zero."""

    blocks: DataFrame
    n_rows: int
    n_cols: int
    size: int

    @property
    def shapes(self):
        return _shapes(self.n_rows, self.n_cols, self.size)

    def map(self, function) -> BlockMatrix:
        """``function(bi, bj, block)`` on every block, in place."""
        shape_of = self.shapes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for bi, bj, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    made = function(bi, bj, np.frombuffer(block, dtype="<f8").reshape(shape_of(bi, bj)))
                    yield _block_row(bi, bj, made)

        return BlockMatrix(self.blocks.mapInArrow(run, BLOCK_SCHEMA), self.n_rows, self.n_cols, self.size)

    def scaled(self, factor: float) -> BlockMatrix:
        return self.map(lambda bi, bj, block: block * factor)

    def saved(self) -> BlockMatrix:
        return BlockMatrix(saved(self.blocks, "blocks"), self.n_rows, self.n_cols, self.size)

    def squared_norm(self) -> float:
        """Sum of squares of all entries; one number a block reaches the driver's aggregation."""
        squares = F.udf(lambda b: float(np.square(np.frombuffer(b, dtype="<f8")).sum()), "double", useArrow=True)
        return self.blocks.agg(F.sum(squares("block")).alias("s")).first()["s"] or 0.0

    def entries(self) -> DataFrame:
        """The long form ``(i, j, v)`` of the blocks that are present."""
        shape_of, size = self.shapes, self.size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for bi, bj, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    rows, cols = shape_of(bi, bj)
                    i, j = np.divmod(np.arange(rows * cols), cols)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(bi * size + i), pa.array(bj * size + j), pa.array(np.frombuffer(block, dtype="<f8"))], names=["i", "j", "v"]
                    )

        return self.blocks.mapInArrow(run, "i long, j long, v double")


def _block_row(bi: int, bj: int, block: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([bi], pa.int32()), pa.array([bj], pa.int32()), pa.array([_packed(block)], pa.binary())], names=["bi", "bj", "block"]
    )


def from_entries(entries: DataFrame, n_rows: int, n_cols: int, *, size: int = BLOCK_SIZE) -> BlockMatrix:
    """Blocks of a long table ``(i, j, v)``; entries that repeat are added, absent ones are zero."""
    outside = (F.col("i") < 0) | (F.col("i") >= n_rows) | (F.col("j") < 0) | (F.col("j") >= n_cols)
    placed = entries.select(
        F.when(outside, F.raise_error(F.lit("an entry lies outside the matrix"))).otherwise(F.floor(F.col("i") / size)).cast("int").alias("bi"),
        F.floor(F.col("j") / size).cast("int").alias("bj"),
        (F.col("i") % size).cast("int").alias("i"),
        (F.col("j") % size).cast("int").alias("j"),
        F.col("v").cast("double").alias("v"),
    )
    shape_of = _shapes(n_rows, n_cols, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block = None, None
        for batch in batches:
            bi, bj, i, j, v = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            cuts = np.flatnonzero((bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])) + 1
            for at in np.split(np.arange(len(bi)), cuts):
                if not len(at):
                    continue
                here = int(bi[at[0]]), int(bj[at[0]])
                if here != key:
                    if key is not None:
                        yield _block_row(*key, block)
                    key, block = here, np.zeros(shape_of(*here))
                np.add.at(block, (i[at], j[at]), v[at])
        if key is not None:
            yield _block_row(*key, block)

    # Entries of one block are summed before the shuffle where they repeat, so no block is a hot key.
    summed = placed.groupBy("bi", "bj", "i", "j").agg(F.sum("v").alias("v"))
    dealt = summed.repartition("bi", "bj").sortWithinPartitions("bi", "bj").select("bi", "bj", "i", "j", "v")
    return BlockMatrix(dealt.mapInArrow(run, BLOCK_SCHEMA), n_rows, n_cols, size)


def multiply(a: BlockMatrix, b: BlockMatrix, *, then=None) -> BlockMatrix:
    """``a @ b``: block columns of ``a`` meet block rows of ``b``, products are added by block in the order of k.

    ``then(bi, bj, block)`` changes a finished block in the same pass. Blocks without a product are absent.
    """
    out = BlockMatrix(_product_blocks(a, b).select("bi", "bj", "block"), a.n_rows, b.n_cols, a.size)
    return out.map(then) if then else out


def _products(pairs: list[tuple[BlockMatrix, BlockMatrix]]) -> list[BlockMatrix]:
    """Several products written by one job."""
    tagged = [_product_blocks(a, b).withColumn("nth", F.lit(k)) for k, (a, b) in enumerate(pairs)]
    both = saved(union_all(tagged), "products")
    return [
        BlockMatrix(both.where(F.col("nth") == k).select("bi", "bj", "block"), a.n_rows, b.n_cols, a.size)
        for k, (a, b) in enumerate(pairs)
    ]


def _product_blocks(a: BlockMatrix, b: BlockMatrix) -> DataFrame:
    if (a.n_cols, a.size) != (b.n_rows, b.size):
        raise ValueError(f"blocks of {a.n_rows}x{a.n_cols} and {b.n_rows}x{b.n_cols} do not fit together")
    left, right = a.shapes, b.shapes
    joined = a.blocks.select("bi", F.col("bj").alias("k"), F.col("block").alias("a")).join(
        b.blocks.select(F.col("bi").alias("k"), "bj", F.col("block").alias("b")), "k"
    )

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                bi, bj, k, x, y = (c[at].as_py() for c in batch.columns)
                made = np.frombuffer(x, dtype="<f8").reshape(left(bi, k)) @ np.frombuffer(y, dtype="<f8").reshape(right(k, bj))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k], pa.int64()), pa.array([bi], pa.int32()), pa.array([bj], pa.int32()), pa.array([_packed(made)], pa.binary())],
                    names=["part", "bi", "bj", "block"],
                )

    pairs = joined.select("bi", "bj", "k", "a", "b")
    partials = pairs.mapInArrow(product, "part bigint, bi int, bj int, block binary")
    return tree_merge(partials, ["bi", "bj"], lambda _, x, y: (x[0] + y[0],), leaves=-(-a.n_cols // a.size))


def _batched(batches: Iterator[pa.RecordBatch], row_bytes: int) -> Iterator[list[np.ndarray]]:
    """Dense blocks of some columns, gathered up to a bounded size."""
    most, held, count = max(1, BATCH_BYTES // row_bytes), [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            part = batch.slice(at, most)
            held.append([dense_block(c) for c in part.columns])
            count += part.num_rows
            if count >= most:
                yield [np.concatenate(x) for x in zip(*held, strict=True)]
                held, count = [], 0
    if count:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _check_widths(parts: list[np.ndarray], widths: tuple[int, ...]) -> None:
    for x, width in zip(parts, widths, strict=True):
        if x.shape[1] != width:
            raise ValueError(f"feature dim {x.shape[1]} != expected {width}")


def cross_product(
    df: DataFrame, left: str, right: str, widths: tuple[int, int], *, size: int = BLOCK_SIZE, fan_in: int = FAN_IN
) -> BlockMatrix:
    """``sum over rows of left right^T`` as blocks, in one pass; an empty table gives no blocks."""
    n_left, n_right = (-(-w // size) for w in widths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for chunk, (x, y) in enumerate(_batched(batches, 8 * sum(widths))):
            _check_widths([x, y], widths)
            for bi in range(n_left):
                for bj in range(n_right):
                    made = x[:, _span(size, bi, widths[0])].T @ y[:, _span(size, bj, widths[1])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([task * _CHUNKS + chunk]), pa.array([bi], pa.int32()), pa.array([bj], pa.int32()), pa.array([_packed(made)], pa.binary())],
                        names=["part", "bi", "bj", "block"],
                    )

    partials = df.select(F.col(left).alias("x"), F.col(right).alias("y")).mapInArrow(run, "part bigint, bi int, bj int, block binary")
    blocks = tree_merge(
        partials, ["bi", "bj"], lambda _, a, b: (a[0] + b[0],), leaves=expected_tasks(df), fan_in=fan_in, span=_CHUNKS
    )
    return BlockMatrix(blocks.select("bi", "bj", "block"), *widths, size)


@dataclass(frozen=True)
class BlockMoments:
    """Count, mean and centered second moments (upper blocks only) of a vector column."""

    n: int
    mean: np.ndarray
    upper: BlockMatrix

    def covariance(self, eps: float = 0.0) -> BlockMatrix:
        """All blocks of the covariance, with ``eps`` on the diagonal."""
        scatter, divisor, shape_of = self.upper, max(self.n - 1, 1), self.upper.shapes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for bi, bj, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    own = np.frombuffer(block, dtype="<f8").reshape(shape_of(bi, bj)) / divisor
                    if bi == bj:
                        yield _block_row(bi, bj, own + eps * np.eye(len(own)))
                    else:
                        yield _block_row(bi, bj, own)
                        yield _block_row(bj, bi, own.T)

        return BlockMatrix(scatter.blocks.mapInArrow(run, BLOCK_SCHEMA), scatter.n_rows, scatter.n_cols, scatter.size)


def block_moments(df: DataFrame, column: str, *, width: int, size: int = BLOCK_SIZE, fan_in: int = FAN_IN) -> BlockMoments:
    """Moments of a vector column of any width, in one pass.

    Partials are centered on their own mean and merged pairwise, as in the one-matrix form. Only the counts and the
    mean (one vector) come to the driver; the blocks are a written table.
    """
    n_blocks = -(-width // size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for chunk, (x,) in enumerate(_batched(batches, 8 * width)):
            _check_widths([x], (width,))
            mean = x.mean(axis=0)
            x = x - mean
            for bi in range(n_blocks):
                for bj in range(bi, n_blocks):
                    rows, cols = _span(size, bi, width), _span(size, bj, width)
                    cells = [task * _CHUNKS + chunk, bi, bj, len(x), _packed(mean[rows]), _packed(mean[cols]), _packed(x[:, rows].T @ x[:, cols])]
                    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([c], k) for c, k in zip(cells, kinds, strict=True)], names=["part", "bi", "bj", "n", "mean_i", "mean_j", "block"]
                    )

    def merge(_: tuple, a: tuple, b: tuple) -> tuple:
        (n_a, i_a, j_a, block_a), (n_b, i_b, j_b, block_b) = a, b
        total, delta_i, delta_j = n_a + n_b, i_b - i_a, j_b - j_a
        block = block_a + block_b + (np.outer(delta_i, delta_j) * (n_a * n_b / total)).ravel()
        return total, i_a + delta_i * (n_b / total), j_a + delta_j * (n_b / total), block

    schema = "part bigint, bi int, bj int, n bigint, mean_i binary, mean_j binary, block binary"
    partials = df.select(F.col(column).alias("x")).mapInArrow(run, schema)
    merged = saved(
        tree_merge(partials, ["bi", "bj"], merge, leaves=expected_tasks(df), fan_in=fan_in, span=_CHUNKS), "block-moments"
    )
    diagonal = sorted(merged.where("bi = bj").select("bi", "n", "mean_i").collect(), key=lambda r: r["bi"])
    mean = np.concatenate([np.frombuffer(r["mean_i"], dtype="<f8") for r in diagonal]) if diagonal else np.zeros(width)
    return BlockMoments(diagonal[0]["n"] if diagonal else 0, mean, BlockMatrix(merged.select("bi", "bj", "block"), width, width, size))


def roots(matrix: BlockMatrix, *, tolerance: float = 1e-11, most_steps: int = 80) -> tuple[BlockMatrix, BlockMatrix]:
    """Square root and inverse square root of a symmetric positive definite matrix.

    Coupled Newton-Schulz steps ``T = (3 I - Z Y) / 2, Y = Y T, Z = T Z`` from the matrix divided by its norm, until
    ``Z Y`` is the identity up to ``tolerance`` an entry, or stops coming closer to it. Every step is a written table,
    and both new factors come from one job.
    """
    norm = math.sqrt(matrix.squared_norm())
    above("matrix norm", norm)
    width = matrix.n_rows
    y = matrix.scaled(1 / norm).saved()
    z = matrix.map(lambda bi, bj, block: np.eye(*block.shape) if bi == bj else np.zeros(block.shape)).saved()
    last = math.inf
    for _ in range(most_steps):
        off = multiply(z, y, then=lambda bi, bj, block: block - np.eye(*block.shape) if bi == bj else block).saved()
        distance = math.sqrt(off.squared_norm()) / width
        # Rounding leaves a floor; near the identity the distance otherwise squares itself.
        if distance <= tolerance or (distance < 1e-6 and distance >= last):
            return y.scaled(math.sqrt(norm)), z.scaled(1 / math.sqrt(norm))
        last = distance
        t = off.map(lambda bi, bj, block: np.eye(*block.shape) - block / 2 if bi == bj else -block / 2)
        y, z = _products([(y, t), (t, z)])
    raise ValueError(f"no square root within {most_steps} steps, distance {last:g}: is the matrix positive definite?")


def multiply_rows(
    df: DataFrame,
    key: str,
    column: str,
    matrix: BlockMatrix,
    *,
    before: np.ndarray | None = None,
    after: np.ndarray | None = None,
    name: str = "product",
) -> DataFrame:
    """``(x + before) @ matrix + after`` of every row: ``(key, name)``; rows may repeat keys.

    Batches of rows are cut into column slices, a slice meets the blocks of its block row, and the products of a
    batch are added up by one task. Block rows are few, so each is repeated under some salts and batches are dealt
    over them. Slices are a written table, so that a repeated task cannot deal rows differently.
    """
    n_in, size = -(-matrix.n_rows // matrix.size), matrix.size
    width, shape_of, matrix_cols = matrix.n_rows, matrix.shapes, matrix.n_cols
    shift = np.zeros(width) if before is None else before
    offset = np.zeros(matrix.n_cols) if after is None else after
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    salts = max(1, -(-4 * spark.sparkContext.defaultParallelism // n_in))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, chunk = TaskContext.get().partitionId(), 0
        most = max(1, BATCH_BYTES // (32 * max(width, matrix_cols)))
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                x = dense_block(part.column(1))
                _check_widths([x], (width,))
                x = x + shift
                own = task * _CHUNKS + chunk
                chunk += 1
                keys = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), part.column(0))
                none = pa.nulls(1, keys.type)
                for bi in range(n_in):
                    cells = [pa.array([own]), pa.array([bi], pa.int32()), keys if bi == 0 else none, pa.array([_packed(x[:, _span(size, bi, width)])], pa.binary())]
                    yield pa.RecordBatch.from_arrays(cells, names=["batch", "bi", "keys", "slice"])

    cuts = df.select(F.col(key), F.col(column)).mapInArrow(cut, f"batch bigint, bi int, keys array<{kind}>, slice binary")
    slices = saved(cuts, "slices")
    salted = slices.withColumn("salt", F.pmod(F.xxhash64("batch"), F.lit(salts)).cast("int"))
    blocks = matrix.blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    joined = salted.join(blocks, ["bi", "salt"])

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                own, bi, bj, piece, block = (batch.column(c)[at].as_py() for c in ("batch", "bi", "bj", "slice", "block"))
                rows, cols = shape_of(bi, bj)
                made = np.frombuffer(piece, dtype="<f8").reshape(-1, rows) @ np.frombuffer(block, dtype="<f8").reshape(rows, cols)
                keys = batch.column("keys").slice(at, 1) if bj == 0 else pa.nulls(1, batch.schema.field("keys").type)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([own]), pa.array([bj], pa.int32()), pa.array([bi], pa.int32()), keys, pa.array([_packed(made)], pa.binary())],
                    names=["batch", "bj", "bi", "keys", "piece"],
                )

    products = joined.select("batch", "bi", "bj", "keys", "slice", "block").mapInArrow(
        product, f"batch bigint, bj int, bi int, keys array<{kind}>, piece binary"
    )
    dealt = products.repartition("batch").sortWithinPartitions("batch", "bj", "bi")

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, keys, total = None, None, None

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([keys, list_column(total + offset)], names=[key, name])

        for batch in batches:
            for k in range(batch.num_rows):
                own, bj, piece = batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), batch.column(4)[k].as_py()
                part = np.frombuffer(piece, dtype="<f8").reshape(-1, shape_of(0, bj)[1])
                if own != at:
                    if at is not None:
                        yield rows()
                    at, keys, total = own, None, np.zeros((len(part), matrix_cols))
                if batch.column(3)[k].is_valid:
                    keys = batch.column(3)[k].values
                total[:, _span(size, bj, matrix_cols)] += part
        if at is not None:
            yield rows()

    return dealt.mapInArrow(assemble, f"`{key}` {kind}, `{name}` array<double>")


@dataclass(frozen=True)
class BlockWhitening:
    """Whitening of vectors of any width: the mean, and both roots of the covariance as blocks."""

    mean: np.ndarray
    whiten: BlockMatrix
    unwhiten: BlockMatrix
    eps: float
    n_samples: int


def fit_block_whitening(
    train: DataFrame, column: str, *, width: int, eps: float = DEFAULT_EPS, size: int = BLOCK_SIZE, fan_in: int = FAN_IN
) -> BlockWhitening:
    """The statistics of ``fit_whitening`` without its bound on the width; ``eps`` is added to the variances."""
    above("eps", eps)
    moments = block_moments(train, column, width=width, size=size, fan_in=fan_in)
    at_least("training rows", moments.n, 2)
    root, inverse = roots(moments.covariance(eps).saved())
    return BlockWhitening(moments.mean, inverse.saved(), root.saved(), eps, moments.n)


def apply_block_whitening(df: DataFrame, key: str, column: str, stats: BlockWhitening, *, name: str = "whitened") -> DataFrame:
    return multiply_rows(df, key, column, stats.whiten, before=-stats.mean, name=name)


def invert_block_whitening(df: DataFrame, key: str, column: str, stats: BlockWhitening, *, name: str = "restored") -> DataFrame:
    return multiply_rows(df, key, column, stats.unwhiten, after=stats.mean, name=name)


def reconstruct_rows(df: DataFrame, key: str, code: str, transposed: BlockMatrix, *, name: str = "restored") -> DataFrame:
    """``Phi s`` of every row for a dictionary of any size, given as the blocks of ``Phi^T``."""
    return multiply_rows(df, key, code, transposed, name=name)


def dictionary_gradient(df: DataFrame, x: str, code: str, phi: BlockMatrix) -> BlockMatrix:
    """``sum over rows of (x - Phi s) s^T`` as blocks: ``X^T S - Phi (S^T S)``, for a dictionary of any size."""
    features, atoms = phi.n_rows, phi.n_cols
    direct = cross_product(df, x, code, (features, atoms), size=phi.size)
    modelled = multiply(phi, cross_product(df, code, code, (atoms, atoms), size=phi.size)).scaled(-1.0)
    both = direct.blocks.withColumn("part", F.lit(0).cast("long")).union(modelled.blocks.withColumn("part", F.lit(1).cast("long")))
    partials = both.select("part", "bi", "bj", "block")
    merged = tree_merge(partials, ["bi", "bj"], lambda _, a, b: (a[0] + b[0],), leaves=2)
    return BlockMatrix(merged.select("bi", "bj", "block"), features, atoms, phi.size)
