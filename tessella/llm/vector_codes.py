"""Vector code compression: product codes fitted by dual-tree Lloyd rounds in integers.

Vectors become integers and are cut into equal parts; every part position has a codebook of its own. Rows are
gathered into chunks, and each part of a chunk gets a tree of boxes with cached counts and sums, written once
to the shared folder. A round walks the chunk trees against a tree of the few codebook entries: a bound on
the distances of two boxes drops entries, the corner farthest along a difference of two entries settles which
of them is nearer for a whole box, a box with one entry left adds its cached sums, and only the points of leaves
that stay uncertain are compared one by one. All of it is exact, so ties go to the lower index as stated.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import sent_if_small, written

# Vectors of a chunk, points of a leaf.
CHUNK_ROWS, LEAF = 1024, 16


def finite_vector(vector: Column) -> Column:
    """True where a vector has components and none is null or not finite."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(sound & (F.size(vector) > 0), F.lit(False))


def scaled_floor(vector: Column, scale: int) -> Column:
    """``floor(scale * x)`` of every component as longs, taken in double precision."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def largest_component(width: int) -> int:
    """Components up to this size keep the distances and margins of vectors of ``width`` within a long."""
    return min((1 << 31) - 1, math.isqrt((1 << 59) // width))


@dataclass(frozen=True)
class BoxTree:
    """A balanced binary tree over points in tree order: level k cuts them into ``2**k`` runs of nearly equal size."""

    points: np.ndarray
    order: np.ndarray
    bounds: list[np.ndarray]
    low: list[np.ndarray]
    high: list[np.ndarray]
    sums: list[np.ndarray]


def build_tree(points: np.ndarray, leaf: int = LEAF) -> BoxTree:
    """Halve runs of points along their widest side until they have at most ``leaf`` points."""
    n = len(points)
    depth = max(0, int(np.ceil(np.log2(max(1, n) / leaf))))
    bounds = [np.linspace(0, n, (1 << k) + 1).astype(np.int64) for k in range(depth + 1)]
    order = np.arange(n)
    for k in range(depth):
        for start, middle, end in zip(bounds[k][:-1], bounds[k + 1][1::2], bounds[k][1:], strict=True):
            run = points[order[start:end]]
            side = int(np.argmax(run.max(axis=0) - run.min(axis=0)))
            order[start:end] = order[start:end][np.argpartition(run[:, side], middle - start)]
    points = points[order]
    starts = [b[:-1] for b in bounds]
    return BoxTree(
        points,
        order,
        bounds,
        [np.minimum.reduceat(points, s) for s in starts],
        [np.maximum.reduceat(points, s) for s in starts],
        [np.add.reduceat(points, s) for s in starts],
    )


def entry_tree(entries: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Levels ``(members, low, high)`` of a tree over codebook entries, down to single ones."""
    groups, levels = [np.arange(len(entries))], []
    while True:
        members = np.zeros((len(groups), len(entries)), dtype=bool)
        for row, g in zip(members, groups, strict=True):
            row[g] = True
        levels.append((members, np.stack([entries[g].min(axis=0) for g in groups]), np.stack([entries[g].max(axis=0) for g in groups])))
        if all(len(g) == 1 for g in groups):
            return levels
        halves = []
        for g in groups:
            if len(g) == 1:
                halves.append(g)
                continue
            side = int(np.argmax(entries[g].max(axis=0) - entries[g].min(axis=0)))
            along = g[np.argsort(entries[g, side], kind="stable")]
            halves += [along[: len(g) // 2], along[len(g) // 2 :]]
        groups = halves


def _box_distances(low: np.ndarray, high: np.ndarray, other_low: np.ndarray, other_high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest squared distance of each box to each other box."""
    gap = np.maximum(np.maximum(other_low[None] - high[:, None], low[:, None] - other_high[None]), 0)
    reach = np.maximum(other_high[None] - low[:, None], high[:, None] - other_low[None])
    return (gap * gap).sum(axis=2), (reach * reach).sum(axis=2)


def _candidates(low: np.ndarray, high: np.ndarray, alive: np.ndarray, entries: np.ndarray, levels) -> np.ndarray:
    """Entries that may be nearest to some point of each box, out of those that may be for the box above."""
    for members, entry_low, entry_high in levels:
        least, largest = _box_distances(low, high, entry_low, entry_high)
        present = (alive[:, None, :] & members[None]).any(axis=2)
        best = np.where(present, largest, np.iinfo(np.int64).max).min(axis=1)
        dropped = present & (least > best[:, None])
        alive = alive & ~(dropped @ members)
    # Between two entries the nearer one changes only along their difference, so one corner of the box decides.
    norms = (entries * entries).sum(axis=1)
    rows = np.arange(len(low))
    _, to_points = _box_distances(low, high, entries, entries)
    pivot = np.where(alive, to_points, np.iinfo(np.int64).max).argmin(axis=1)
    towards = entries[pivot][:, None, :] - entries[None]
    # The largest value over the box of |p - pivot|^2 - |p - entry|^2 = |pivot|^2 - |entry|^2 - 2 p (pivot - entry).
    corner = np.where(towards > 0, low[:, None, :], high[:, None, :])
    margin = norms[pivot][:, None] - norms[None] - 2 * (corner * towards).sum(axis=2)
    beaten = (margin < 0) | ((margin == 0) & (pivot[:, None] < np.arange(len(entries))[None]))
    beaten[rows, pivot] = False
    return alive & ~beaten


def nearest_entries(tree: BoxTree, entries: np.ndarray, *, totals: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry of every point in tree order (ties to the lower index), and points and sums of each entry.

    With ``totals`` boxes that are settled add their cached sums, and their points get no entry of their own
    (-1); without, every point gets its entry, and the sums are left out.
    """
    k, width = entries.shape
    levels = entry_tree(entries)
    owner = np.full(len(tree.points), -1, dtype=np.int64)
    counts, sums = np.zeros(k, dtype=np.int64), np.zeros((k, width), dtype=np.int64)
    nodes, alive = np.zeros(1, dtype=np.int64), np.ones((1, k), dtype=bool)
    last = len(tree.bounds) - 1
    for depth, bounds in enumerate(tree.bounds):
        alive = _candidates(tree.low[depth][nodes], tree.high[depth][nodes], alive, entries, levels)
        settled = alive.sum(axis=1) == 1
        for node, entry in zip(nodes[settled], alive[settled].argmax(axis=1), strict=True):
            start, end = bounds[node], bounds[node + 1]
            if totals:
                counts[entry] += end - start
                sums[entry] += tree.sums[depth][node]
            else:
                owner[start:end] = entry
        nodes, alive = nodes[~settled], alive[~settled]
        if depth < last:
            nodes, alive = np.repeat(2 * nodes, 2) + np.tile([0, 1], len(nodes)), np.repeat(alive, 2, axis=0)
    if len(nodes):
        sizes = np.diff(tree.bounds[last])[nodes]
        at = np.repeat(tree.bounds[last][nodes] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
        points = tree.points[at]
        distance = np.where(np.repeat(alive, sizes, axis=0), ((points[:, None, :] - entries[None]) ** 2).sum(axis=2), np.iinfo(np.int64).max)
        near = distance.argmin(axis=1)
        if totals:
            counts += np.bincount(near, minlength=k)
            np.add.at(sums, near, points)
        else:
            owner[at] = near
    return owner, counts, sums


_CHUNK = "ids array<{0}>, labels array<{1}>, points array<binary>, orders array<binary>, lows array<binary>, highs array<binary>, sums array<binary>"


def _packed(tree: BoxTree) -> tuple[bytes, ...]:
    flat = lambda levels: np.concatenate(levels).astype("<i8").tobytes()
    return tree.points.astype("<i4").tobytes(), tree.order.astype("<i4").tobytes(), *(np.concatenate(x).astype("<i4").tobytes() for x in (tree.low, tree.high)), flat(tree.sums)


def _unpacked(packed: tuple, width: int, leaf: int) -> BoxTree:
    points, order, low, high, sums = (
        np.frombuffer(b, dtype=d).astype(np.int64) for b, d in zip(packed, ("<i4", "<i4", "<i4", "<i4", "<i8"), strict=True)
    )
    n = len(order)
    depth = max(0, int(np.ceil(np.log2(max(1, n) / leaf))))
    cuts = np.cumsum([1 << k for k in range(depth + 1)])[:-1]
    levels = lambda x: np.split(x.reshape(-1, width), cuts)
    bounds = [np.linspace(0, n, (1 << k) + 1).astype(np.int64) for k in range(depth + 1)]
    return BoxTree(points.reshape(-1, width), order, bounds, levels(low), levels(high), levels(sums))


def _build_chunks(parts: int, width: int, rows: int, leaf: int, schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)

        def chunk(ids: list, labels: list, values: np.ndarray) -> pa.RecordBatch:
            packed = [_packed(build_tree(values[:, p * width : (p + 1) * width], leaf)) for p in range(parts)]
            columns = [[ids], [labels], *[[list(x)] for x in zip(*packed, strict=True)]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        for batch in batches:
            vectors = batch.column(2)
            if not len(vectors):
                continue
            values = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), parts * width)
            most = largest_component(parts * width)
            if values.max() > most or values.min() < -most:
                raise ValueError(f"a scaled component beyond {most} leaves the range of exact distances")
            ids, labels = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(ids), rows):
                yield chunk(ids[at : at + rows], labels[at : at + rows], values[at : at + rows])

    return run


def _trees(batch: pa.RecordBatch, width: int, leaf: int) -> Iterator[tuple[list, list, list[BoxTree]]]:
    for i in range(batch.num_rows):
        ids, labels, *packed = (c[i].as_py() for c in batch.columns)
        yield ids, labels, [_unpacked(p, width, leaf) for p in zip(*packed, strict=True)]


def lloyd_round(chunks: DataFrame, books: np.ndarray, leaf: int) -> np.ndarray:
    """One round: every entry becomes the floor of the mean of its parts; unused entries stay.

    The sums of a task are rows of (part, entry), merged by Spark; the driver receives one row for each.
    """
    parts, k, width = books.shape
    schema = "part int, entry int, n long, total array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((parts, k), dtype=np.int64), np.zeros(books.shape, dtype=np.int64)
        for batch in batches:
            for _, _, trees in _trees(batch, width, leaf):
                for p, tree in enumerate(trees):
                    _, n, total = nearest_entries(tree, books[p], totals=True)
                    counts[p] += n
                    sums[p] += total
        at_part, at_entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at_part, pa.int32()), pa.array(at_entry, pa.int32()), pa.array(counts[at_part, at_entry]), pa.array(sums[at_part, at_entry].tolist(), pa.list_(pa.int64()))],
            names=["part", "entry", "n", "total"],
        )

    partial = chunks.mapInArrow(run, schema)
    totals = [F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(width)]
    merged = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *totals)
    new = books.copy()
    for row in merged.collect():
        new[row.part, row.entry] = [row[f"t{i}"] // row.n for i in range(width)]
    return new


@dataclass(frozen=True)
class VectorCodes:
    """Coded rows ``(id, label, code, error)`` and the codebooks (part, entry, place) they refer to."""

    rows: DataFrame
    books: np.ndarray

    def digest(self) -> str:
        """SHA-256 of all entries' components, comma-joined in order."""
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def compress(
    vectors: DataFrame,
    *,
    id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    scale: int = 4096,
    parts: int = 8,
    entries: int = 16,
    rounds: int = 6,
    chunk_rows: int = CHUNK_ROWS,
    leaf: int = LEAF,
) -> VectorCodes:
    """Product codes of every sound vector: a hexadecimal digit pair for each part, and the squared error.

    Rows whose vector is null or empty, or has a null or a component that is not finite, have no code and are left
    out. Codebooks start as the parts of the ``entries`` smallest ids (all rows, if fewer; null ids come first,
    repeated ids by their vectors), so the fit starts from a fixed few rows; every round and the last assignment
    cover all rows. Vectors of differing widths, a width that ``parts`` does not divide and components too large
    for exact distances in longs (``largest_component``) are errors. Repeated rows each get their row; an empty table gives an empty result and empty codebooks.
    Other columns, and columns named like the results, are not looked at.

    A lost executor repeats its tasks: chunks are a written table, and the state between rounds is the codebooks.
    """
    spark = vectors.sparkSession
    if not 0 < entries <= 256:
        raise ValueError("a code of two hex digits needs 1 to 256 entries")
    kept = vectors.where(finite_vector(F.col(vector))).select(
        F.col(id).alias("id"), F.col(label).alias("label"), scaled_floor(F.col(vector), scale).alias("v")
    )
    kinds = dict(kept.dtypes)
    first = [r.v for r in kept.orderBy("id", "v").limit(entries).collect()]
    result = f"id {kinds['id']}, label {kinds['label']}, code string, error long"
    if not first:
        return VectorCodes(spark.createDataFrame([], result), np.zeros((parts, 0, 0), dtype=np.int64))
    if len({len(v) for v in first}) > 1 or len(first[0]) % parts:
        raise ValueError(f"vectors must have one width that {parts} parts divide")
    width = len(first[0]) // parts
    books = np.array(first, dtype=np.int64).reshape(len(first), parts, width).transpose(1, 0, 2)
    whole = kept.withColumn("v", F.when(F.size("v") == parts * width, F.col("v")).otherwise(F.raise_error(F.lit("vectors differ in width"))))
    schema = spark.createDataFrame([], _CHUNK.format(kinds["id"], kinds["label"])).schema
    chunks = written(whole.mapInArrow(_build_chunks(parts, width, chunk_rows, leaf, schema), schema), "vector-chunks")
    for _ in range(rounds):
        books = lloyd_round(chunks, books, leaf)
    target = spark.createDataFrame([], result).schema

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(target)
        for batch in batches:
            for ids, labels, trees in _trees(batch, width, leaf):
                codes = np.empty((len(ids), parts), dtype=np.uint8)
                error = np.zeros(len(ids), dtype=np.int64)
                for p, tree in enumerate(trees):
                    owner, _, _ = nearest_entries(tree, books[p], totals=False)
                    codes[tree.order, p] = owner
                    error[tree.order] += ((tree.points - books[p][owner]) ** 2).sum(axis=1)
                columns = [ids, labels, [c.tobytes().hex() for c in codes], error]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return VectorCodes(written(chunks.mapInArrow(assign, target), "vector-codes"), books)


def with_label_errors(coded: DataFrame, *, salts: int = 64) -> DataFrame:
    """Add ``label_error``, the error summed over the rows of the same label (null is a label of its own).

    Sums are made before the shuffle, one row for each label and task. They are broadcast only if counted few;
    more are repeated once for each salt, so that a label with a third of all rows is joined by many tasks.
    """
    sums = written(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    few = sent_if_small(sums)
    if few is not sums:
        other = few.withColumnRenamed("label", "of")
        return coded.join(other, F.col("label").eqNullSafe(F.col("of")), "left").drop("of")
    salted = coded.withColumn("salt", F.pmod(F.xxhash64("id", "code"), F.lit(salts)))
    other = sums.select(F.col("label").alias("of"), "label_error", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("at"))
    same = F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("at"))
    return salted.join(other, same, "left").drop("of", "salt", "at")
