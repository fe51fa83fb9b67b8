"""Matrices held as edge tables ``(src, dst, w)``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.session import broadcast_if_small

# Entries of a matrix that is sent to the rows it multiplies.
MATRIX_ROWS = 1 << 14


def _half_mirror(edges: DataFrame, sign: float) -> DataFrame:
    mirrored = F.inline(
        F.array(
            F.struct(F.col("src"), F.col("dst"), (F.col("w") * 0.5).alias("w")),
            F.struct(
                F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("w") * (0.5 * sign)).alias("w")
            ),
        )
    )
    return edges.select(mirrored).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def symmetric_part(edges: DataFrame) -> DataFrame:
    """``(W + W^T) / 2``; absent edges count as zero."""
    return _half_mirror(edges, 1.0)


def antisymmetric_part(edges: DataFrame) -> DataFrame:
    """``(W - W^T) / 2``; the diagonal comes out as zero."""
    return _half_mirror(edges, -1.0)


def split_parts(edges: DataFrame) -> DataFrame:
    """Both parts in one pass: ``(src, dst, s, a)``."""
    half = F.col("w") * 0.5
    mirrored = F.inline(
        F.array(
            F.struct(F.col("src"), F.col("dst"), half.alias("s"), half.alias("a")),
            F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), half.alias("s"), (-half).alias("a")),
        )
    )
    sums = edges.select(mirrored).groupBy("src", "dst")
    return sums.agg(F.sum("s").alias("s"), F.sum("a").alias("a"))


def effective_weight(
    base: DataFrame,
    transport: DataFrame | Sequence[DataFrame],
    velocities: float | Sequence[float],
    *,
    alpha: float,
) -> DataFrame:
    """``S + alpha * sum_d v_d A_d`` for one transport table per direction."""
    tables = [transport] if isinstance(transport, DataFrame) else list(transport)
    speeds = [velocities] if isinstance(velocities, (int, float)) else list(velocities)
    if len(tables) != len(speeds):
        raise ValueError(f"every direction needs its velocity: {len(tables)} tables, {len(speeds)} numbers")
    total = base.select("src", "dst", "w")
    for table, speed in zip(tables, speeds, strict=True):
        gain = F.lit(float(alpha) * float(speed))
        total = total.unionByName(table.select("src", "dst", (F.col("w") * gain).alias("w")))
    return total.groupBy("src", "dst").agg(F.sum("w").alias("w"))


def effective_weight_by_direction(
    base: DataFrame, transport: DataFrame, velocities: Mapping[int, float], *, alpha: float
) -> DataFrame:
    """The same with all directions in one table ``(d, src, dst, w)``.

    A direction without a velocity fails the job, as does a velocity no direction uses.
    """
    present = {r["d"] for r in transport.select("d").distinct().limit(len(velocities) + 1).collect()}
    if present != set(velocities):
        raise ValueError(f"directions {sorted(present)} do not match velocities {sorted(velocities)}")
    gains = F.create_map(
        *[F.lit(v) for d, speed in velocities.items() for v in (d, float(alpha) * float(speed))]
    )
    moved = transport.select("src", "dst", (F.col("w") * F.element_at(gains, F.col("d"))).alias("w"))
    return (
        base.select("src", "dst", "w")
        .unionByName(moved)
        .groupBy("src", "dst")
        .agg(F.sum("w").alias("w"))
    )


def matrix_vector(edges: DataFrame, vector: DataFrame) -> DataFrame:
    """``W f`` for an edge table and a vector table ``(dst, f)``: ``(src, v)``.

    A vector of few entries is sent to the edges, so a column with most of the edges is not one task.
    """
    products = edges.join(broadcast_if_small(vector), "dst").select("src", (F.col("w") * F.col("f")).alias("p"))
    return products.groupBy("src").agg(F.sum("p").alias("v"))


def rows_times_matrix(rows: DataFrame, edges: DataFrame, rows_per_salt: int = 1 << 20) -> DataFrame:
    """``W f`` for many sparse vectors at once: ``(row_id, dst, f)`` to ``(row_id, src, v)``.

    A small matrix is sent to the vectors. A larger one has many columns, of which some may be hot: entries
    are then salted by row, with as many salts as the busiest column needs, and the matrix is repeated.
    """
    small = edges.limit(MATRIX_ROWS + 1).count() <= MATRIX_ROWS
    if small:
        joined = rows.join(broadcast_if_small(edges, MATRIX_ROWS), "dst")
    else:
        busiest = rows.groupBy("dst").count().agg(F.max("count")).first()[0] or 1
        salts = F.lit(max(1, -(-busiest // rows_per_salt)))
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("row_id"), salts).cast("int"))
        repeated = edges.withColumn("salt", F.explode(F.sequence(F.lit(0), (salts - 1).cast("int"))))
        joined = salted.join(repeated, ["dst", "salt"])
    products = joined.select("row_id", "src", (F.col("w") * F.col("f")).alias("p"))
    return products.groupBy("row_id", "src").agg(F.sum("p").alias("v"))
