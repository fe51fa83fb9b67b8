"""Nearest-neighbour cosine of test rows against train rows.

Three ways, by size: a bounded train side travels to every task as one matrix; otherwise train rows
are grouped into cells around sampled pivots, and by the triangle inequality on angles a test
row visits only cells that can beat what it has already found. Both are exact.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import vectors as vec
from tessella.operators.kernels import block_function, dense_block, row_function
from tessella.operators.moments import vector_width
from tessella.session import bounded_rows, reliable_checkpoint

NORM_FLOOR = 1e-12
BROADCAST_ROWS = 1 << 16
BROADCAST_CELLS = 1 << 24  # 128 MB of doubles
BLOCK_ROWS = 4096
MAX_PIVOTS = 1024


def unit_block(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), NORM_FLOOR)


def first_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    """The first ``n`` rows in key order, null keys ahead, repeated keys by the hash of their row.

    The last key that belongs to them is found on the keys alone; vectors are read and computed for rows up
    to it only.
    """
    order = F.asc_nulls_first(key)
    last = df.select(key).orderBy(order).limit(n).agg(F.max(key)).first()[0]
    near = F.col(key).isNull() if last is None else F.col(key).isNull() | (F.col(key) <= F.lit(last))
    row = F.xxhash64(*[c for c, kind in df.dtypes if "map<" not in kind])
    return df.filter(near).orderBy(order, row).limit(n)


def nearest_cosine(
    train: DataFrame,
    test: DataFrame,
    column: str,
    key: str,
    *,
    max_pairs: int | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Best cosine of every test row: ``(key, cosine)``, one row each, whatever its key.

    Keys may repeat or be null on either side. ``max_pairs`` keeps the first rows of each side in key order;
    by default whole tables are compared.
    """
    if max_pairs is not None:
        train, test = first_rows(train, key, max_pairs), first_rows(test, key, max_pairs)
    train, test = train.select(key, column), test.select(key, column)
    width = vector_width(train, column)
    limit = min(broadcast_rows, BROADCAST_CELLS // width)
    sample = train.select(column).limit(limit + 1).toArrow()
    if sample.num_rows <= limit:
        matrix = unit_block(dense_block(sample.column(0))).T
        best = row_function(lambda x: (unit_block(x) @ matrix).max(axis=1), F.col(column))
        return test.select(key, best.alias("cosine"))
    return _nearest_by_cells(train, test, column, key)


def _nearest_by_cells(train: DataFrame, test: DataFrame, column: str, key: str) -> DataFrame:
    norm = F.sqrt(vec.sum_squares(F.col(column)))
    # The result of a row depends on its vector only, so vectors are the probes and rows look theirs up.
    name_of = F.concat_ws(":", F.xxhash64(column), F.xxhash64(F.lit(1), column))
    rows = test.select(F.col(key).alias("key"), name_of.alias("id"))
    test = test.select(column).withColumn("id", name_of).dropDuplicates(["id"])
    train = train.select(column).withColumn("id", name_of)
    sides = {
        name: side.select(
            "id", block_function(unit_block, F.col(column)).alias("u"), norm.alias("norm")
        )
        for name, side in (("train", train), ("test", test))
    }
    full = sides["train"].filter(F.col("norm") >= NORM_FLOOR)
    # Vectors shorter than the floor keep a length below one; all-zero ones only contribute 0.
    short = sides["train"].filter((F.col("norm") < NORM_FLOOR) & (F.col("norm") > 0))
    has_zero = not sides["train"].filter(F.col("norm") == 0).isEmpty()

    n_full = full.count()
    pivots = max(1, min(MAX_PIVOTS, math.isqrt(n_full)))
    ordered = full.select("u", F.xxhash64(F.col("id").cast("string")).alias("h"), "id")
    chosen = bounded_rows(ordered.orderBy("h", "id").limit(pivots), pivots, "pivots")
    centers = np.array([r["u"] for r in chosen]).reshape(len(chosen), -1)

    def assign(u: np.ndarray) -> np.ndarray:
        cosine = np.clip(u @ centers.T, -1.0, 1.0)
        cell = cosine.argmax(axis=1)
        return np.column_stack([cell, np.arccos(cosine[np.arange(len(u)), cell])])

    if len(chosen):
        placed = full.withColumn("a", block_function(assign, F.col("u"))).select(
            "id", "u", F.get("a", 0).cast("int").alias("cell"), F.get("a", 1).alias("angle")
        )
    else:
        placed = full.select("id", "u", F.lit(0).alias("cell"), F.lit(0.0).alias("angle"))
    always = len(chosen)  # one more cell that every test row visits
    members = placed.select("id", "u", "cell").unionByName(
        short.select("id", "u", F.lit(always).alias("cell"))
    )
    sizes = np.zeros(always + 1, dtype=np.int64)
    radius = np.zeros(always + 1)
    for r in bounded_rows(
        placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("r")),
        always + 1,
        "cells",
    ):
        sizes[r["cell"]], radius[r["cell"]] = r["n"], r["r"]
    sizes[always] = short.count()
    occupied = np.flatnonzero(sizes[:always])

    probes = sides["test"].select(
        "id", "u", F.least(F.lit(1.0), F.col("norm") / F.lit(NORM_FLOOR)).alias("length")
    )
    # Search along the direction of a short test vector; its length scales the result at the end.
    direction = block_function(
        lambda u: u / np.maximum(np.linalg.norm(u, axis=1, keepdims=True), np.finfo(float).tiny),
        F.col("u"),
    )
    probes = probes.withColumn("u", direction)

    @F.arrow_udf("array<int>")
    def home(u: pa.Array) -> pa.Array:
        cosine = dense_block(u) @ centers[occupied].T
        nearest = occupied[cosine.argmax(axis=1)]
        return pa.array([[int(c)] for c in nearest], pa.list_(pa.int32()))

    @F.arrow_udf("array<int>")
    def rivals(u: pa.Array, best: pa.Array, at_home: pa.Array) -> pa.Array:
        block = dense_block(u)
        angle = np.arccos(np.clip(block @ centers[occupied].T, -1.0, 1.0))
        reach = np.arccos(np.clip(best.to_numpy(zero_copy_only=False), -1.0, 1.0))
        # The slack covers the rounding of arccos near 0 and pi.
        open_cells = angle - radius[occupied] <= reach[:, None] + 1e-6
        open_cells &= occupied != at_home.to_numpy(zero_copy_only=False)[:, None]
        return pa.array([occupied[row].tolist() for row in open_cells], pa.list_(pa.int32()))

    found = []
    if len(occupied):
        homes = probes.select("id", "u", F.explode(home("u")).alias("cell"))
        first = reliable_checkpoint(_best_in_cells(homes, members, sizes))
        known = probes.select("id", "u").join(first, "id").join(
            homes.select("id", F.col("cell").alias("at_home")), "id"
        )
        visits = known.select(
            "id", "u", F.explode(rivals("u", F.col("cosine"), F.col("at_home"))).alias("cell")
        )
        found += [first, _best_in_cells(visits, members, sizes)]
    if sizes[always]:
        everywhere = probes.select("id", "u", F.lit(always).alias("cell"))
        found.append(_best_in_cells(everywhere, members, sizes))
    if has_zero:
        found.append(probes.select("id", F.lit(0.0).alias("cosine")))
    if not found:
        raise ValueError("no training vectors")
    pool = found[0]
    for part in found[1:]:
        pool = pool.unionByName(part)
    best = pool.groupBy("id").agg(F.max("cosine").alias("cosine"))
    scaled = best.join(probes.select("id", "length"), "id").select(
        "id", (F.col("cosine") * F.col("length")).alias("cosine")
    )
    return rows.join(scaled, "id").select(F.col("key").alias(key), "cosine")


def _best_in_cells(probes: DataFrame, members: DataFrame, sizes: np.ndarray) -> DataFrame:
    """Best cosine of each probe within the cells it visits: ``(id, cosine)``.

    A cell is split into blocks on both sides, so a cell holding most of either table becomes
    many bounded tasks; only maxima leave a block.
    """
    visits = np.zeros(len(sizes), dtype=np.int64)
    tallies = probes.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    for r in bounded_rows(tallies, len(sizes), "visited cells"):
        visits[r["cell"]] = r["n"]

    def blocks(counts: np.ndarray) -> Column:
        return F.lit(np.maximum(1, -(-counts // BLOCK_ROWS)).tolist())

    def own(name: str, counts: np.ndarray) -> Column:
        return F.pmod(F.xxhash64("id"), F.get(blocks(counts), F.col("cell"))).cast("int").alias(name)

    def every(name: str, counts: np.ndarray) -> Column:
        last = (F.get(blocks(counts), F.col("cell")) - 1).cast("int")
        return F.explode(F.sequence(F.lit(0), last)).alias(name)

    left = probes.select("id", "u", "cell", own("pb", visits), every("mb", sizes))
    right = members.select("id", "u", "cell", own("mb", sizes), every("pb", visits))

    def best(probe: pa.Table, member: pa.Table) -> pa.Table:
        if probe.num_rows == 0 or member.num_rows == 0:
            return pa.table({"id": probe.column("id").slice(0, 0), "cosine": pa.array([], pa.float64())})
        cosine = dense_block(probe.column("u")) @ dense_block(member.column("u")).T
        return pa.table({"id": probe.column("id"), "cosine": pa.array(cosine.max(axis=1))})

    grid = ["cell", "mb", "pb"]
    id_type = probes.schema["id"].dataType.simpleString()
    scored = left.groupBy(*grid).cogroup(right.groupBy(*grid)).applyInArrow(
        best, f"id {id_type}, cosine double"
    )
    return scored.groupBy("id").agg(F.max("cosine").alias("cosine"))
