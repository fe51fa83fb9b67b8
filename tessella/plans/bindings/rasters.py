"""Patches, augmentation, reassembly and the denoising track over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import vectors as vec
from tessella.functions.dihedral import AUGMENTATIONS, augment, moved_position
from tessella.operators import patches
from tessella.operators.patches import PatchConfig
from tessella.plans import tracks
from tessella.plans.bindings.common import (
    LONG,
    RGB_LONG,
    Bound,
    embeddings,
    entries,
    normal_sql,
    r6_sql,
    rgb_patches,
    uniform_sql,
)
from tessella.session import r6, read_table

# Events as one raster per event type: day of month by hour, summed values.
HEIGHT, WIDTH = 31, 24
SIZE, STRIDE = 8, 5


def event_raster(spark: SparkSession, directory: str) -> DataFrame:
    """Dense pixels ``(image_id, y, x, c, v)``; hours without events are zero."""
    sums = (
        read_table(spark, directory, "events", "ts", "event_type", "value")
        .groupBy(
            F.col("event_type").alias("image_id"),
            (F.dayofmonth("ts") - 1).alias("y"),
            F.hour("ts").alias("x"),
        )
        .agg(F.sum("value").alias("v"))
    )
    frame = (
        sums.select("image_id")
        .distinct()
        .withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(HEIGHT - 1))))
        .withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(WIDTH - 1))))
    )
    return frame.join(sums, ["image_id", "y", "x"], "left").select(
        "image_id", "y", "x", F.lit(0).alias("c"), F.coalesce("v", F.lit(0.0)).alias("v")
    )


_RASTER = (
    "ras AS (SELECT image_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, coalesce(sum(value), 0.0::DOUBLE) AS v FROM "
    f"(SELECT DISTINCT event_type AS image_id FROM events), range({HEIGHT}) a(y), range({WIDTH}) b(x) "
    "LEFT JOIN events ON event_type = image_id AND day(ts) - 1 = y AND hour(ts) = x GROUP BY ALL)"
)


def _positions(name: str, length: int) -> str:
    last = length - SIZE
    return (
        f"{name} AS (SELECT CAST(p AS INTEGER) AS p FROM (SELECT unnest(generate_series(0, {last}, {STRIDE})) AS p "
        f"UNION SELECT {last}))"
    )


_CUT = (
    f"{_positions('tops', HEIGHT)}, {_positions('lefts', WIDTH)}, "
    "cut AS (SELECT image_id, tops.p AS top, lefts.p AS left_, y - tops.p AS dy, x - lefts.p AS dx, v FROM ras, tops, lefts "
    f"WHERE y BETWEEN tops.p AND tops.p + {SIZE - 1} AND x BETWEEN lefts.p AND lefts.p + {SIZE - 1})"
)


def _cut(spark: SparkSession, directory: str) -> DataFrame:
    pixels = event_raster(spark, directory)
    return patches.grid_patch_pixels(pixels, SIZE, STRIDE, F.lit(HEIGHT), F.lit(WIDTH))


def grid_patches(spark: SparkSession, directory: str) -> DataFrame:
    return _cut(spark, directory).withColumn("v", r6(F.col("v")))


def reassemble(spark: SparkSession, directory: str) -> DataFrame:
    """Patches scaled by their row position, so that the blending weights matter."""
    tilted = _cut(spark, directory).withColumn("v", F.col("v") * (F.col("top") + 1))
    rows = patches.reassemble(tilted, SIZE)
    return rows.select(
        "image_id", "y", "x", "c", r6(F.col("v"), 5).alias("v"), r6(F.col("weight")).alias("weight")
    )


def _hann(d: str) -> str:
    return f"greatest(0.5 - 0.5 * cos(2 * pi() * ({d} + 1) / {SIZE + 1}), 1e-3)"


_REASSEMBLE_SQL = f"""
WITH {_RASTER}, {_CUT}, w AS (SELECT *, {_hann("dy")} * {_hann("dx")} AS w FROM cut)
SELECT image_id, top + dy AS y, left_ + dx AS x, 0 AS c, {r6_sql("sum(w * v * (top + 1)) / sum(w)", 5)} AS v,
  {r6_sql("sum(w)")} AS weight FROM w GROUP BY image_id, top + dy, left_ + dx
"""


def uncovered(spark: SparkSession, directory: str) -> DataFrame:
    """Images whose reassembly misses pixels once the last hours' patches are dropped."""
    kept = _cut(spark, directory).filter(~((F.col("image_id") < "p") & (F.col("left") == WIDTH - SIZE)))
    shapes = event_raster(spark, directory).select(
        "image_id", F.lit(HEIGHT).alias("height"), F.lit(WIDTH).alias("width"), F.lit(1).alias("channels")
    ).distinct()
    return patches.uncovered_images(patches.reassemble(kept, SIZE, blend=False), shapes)


_UNCOVERED_SQL = f"""
WITH {_RASTER}, {_CUT},
k AS (SELECT DISTINCT image_id, top + dy AS y, left_ + dx AS x FROM cut WHERE NOT (image_id < 'p' AND left_ = {WIDTH - SIZE}))
SELECT image_id, count(k.y) AS covered, {HEIGHT * WIDTH}::BIGINT AS wanted
FROM (SELECT DISTINCT image_id FROM ras) LEFT JOIN k USING (image_id) GROUP BY image_id HAVING count(k.y) <> {HEIGHT * WIDTH}
"""


def _square_images(spark: SparkSession, directory: str, side: int, channels: int) -> DataFrame:
    source = rgb_patches if channels == 3 else embeddings
    return source(spark, directory, spread=True).select(
        F.col("vec_id").alias("image_id"),
        "role",
        F.lit(side).alias("height"),
        F.lit(side).alias("width"),
        F.lit(channels).alias("channels"),
        F.col("f").alias("values"),
    )


def grid_patch_arrays(spark: SparkSession, directory: str) -> DataFrame:
    """Array form: 8x8 RGB embeddings into 2x2 patches, unfolded again."""
    cut = patches.grid_patches(_square_images(spark, directory, 8, 3), 2, 2)
    rows = patches.patch_pixels(cut, 2, 3)
    return rows.withColumn("v", r6(F.col("v")))


_ARRAYS_SQL = f"""
WITH {LONG}, {RGB_LONG}, q AS (SELECT vec_id, CAST(i // 24 AS INTEGER) AS y, CAST(i // 3 % 8 AS INTEGER) AS x, CAST(i % 3 AS INTEGER) AS c, v
  FROM x)
SELECT vec_id AS image_id, y - y % 2 AS top, x - x % 2 AS left, y % 2 AS dy, x % 2 AS dx, c, {r6_sql("v")} AS v FROM q
"""

_RANDOM = PatchConfig(size=4, n_random=3, border=1, augment=True)


def random_patches(spark: SparkSession, directory: str) -> DataFrame:
    crops = patches.random_patches(
        _square_images(spark, directory, 8, 1), _RANDOM, dataset="embeddings", seed=7
    )
    return entries(crops, "values", "image_id", "patch_index", "top", "left", "aug", index="pos")


def _turned(y: str, x: str, last: int) -> str:
    """Output position of input pixel (y, x) per operation, as two CASE expressions."""
    moves = {
        "identity": (y, x),
        "rot90": (f"{last} - {x}", y),
        "rot180": (f"{last} - {y}", f"{last} - {x}"),
        "rot270": (x, f"{last} - {y}"),
        "flip_h": (y, f"{last} - {x}"),
        "flip_v": (f"{last} - {y}", x),
        "transpose": (x, y),
        "anti_transpose": (f"{last} - {x}", f"{last} - {y}"),
    }
    rows = " ".join(f"WHEN '{k}' THEN {a}" for k, (a, _) in moves.items())
    cols = " ".join(f"WHEN '{k}' THEN {b}" for k, (_, b) in moves.items())
    return f"CAST((CASE aug {rows} END) * {last + 1} + (CASE aug {cols} END) AS INTEGER)"


_NAMES = "[" + ", ".join(f"'{a}'" for a in AUGMENTATIONS) + "]"
_RANDOM_SQL = f"""
WITH {LONG}, k AS (SELECT vec_id, CAST(k AS INTEGER) AS patch_index, sha256('embeddings|' || vec_id || '|7|' || k) AS d
  FROM embeddings, range(3) r(k)),
b AS (SELECT vec_id, patch_index, CAST(1 + floor({uniform_sql("d", 0)} * 3) AS INTEGER) AS top,
  CAST(1 + floor({uniform_sql("d", 1)} * 3) AS INTEGER) AS left_, {_NAMES}[CAST(floor({uniform_sql("d", 2)} * 8) AS INTEGER) + 1] AS aug FROM k)
SELECT vec_id AS image_id, patch_index, top, left_ AS left, aug, {_turned("(i // 8 - top)", "(i % 8 - left_)", 3)} AS pos, {r6_sql("v")} AS v
FROM b JOIN e USING (vec_id) WHERE i // 8 BETWEEN top AND top + 3 AND i % 8 BETWEEN left_ AND left_ + 3
"""


def augmented(spark: SparkSession, directory: str) -> DataFrame:
    """Each embedding as an 8x8 patch under the operation its key picks."""
    names = F.array(*[F.lit(name) for name in AUGMENTATIONS])
    e = embeddings(spark, directory, spread=True).withColumn("aug", F.get(names, (F.col("vec_id") % 8).cast("int")))
    return entries(e.select("vec_id", "aug", augment(F.col("f"), F.col("aug"), 8, 1).alias("f")), "f", "vec_id", "aug", index="pos")


def augmented_pixels(spark: SparkSession, directory: str) -> DataFrame:
    """The same operations on long-form pixels, for every operation at once."""
    pixels = embeddings(spark, directory, spread=True).select("vec_id", F.posexplode("f").alias("i", "v"))
    y, x = F.floor(F.col("i") / 8).cast("int"), F.col("i") % 8
    moved = [
        F.struct(F.lit(name).alias("aug"), (p[0] * 8 + p[1]).cast("int").alias("pos"))
        for name in AUGMENTATIONS
        for p in [moved_position(name, y, x, 8)]
    ]
    return pixels.select("vec_id", "v", F.inline(F.array(*moved))).select("vec_id", "aug", "pos", r6(F.col("v")).alias("v"))


_AUGMENT_SQL = f"""
WITH {LONG}, a AS (SELECT vec_id, i, v, {_NAMES}[vec_id % 8 + 1] AS aug FROM e)
SELECT vec_id, aug, {_turned("i // 8", "i % 8", 7)} AS pos, {r6_sql("v")} AS v FROM a
"""
_AUGMENT_ALL_SQL = f"""
WITH {LONG}, a AS (SELECT vec_id, i, v, unnest({_NAMES}) AS aug FROM e)
SELECT vec_id, aug, {_turned("i // 8", "i % 8", 7)} AS pos, {r6_sql("v")} AS v FROM a
"""

_TRACK = PatchConfig(size=2, stride=1)
_TRACK_SIGMAS = (0.1, 0.4)


def denoising_track(spark: SparkSession, directory: str) -> DataFrame:
    """Grid patches, own scale, fixed noise, scale undone, Hann blend; RGB 8x8 embeddings."""
    images = _square_images(spark, directory, 8, 3)
    noisy = tracks.color_rgb_patches(images, seed=9, patches=_TRACK, sigmas=_TRACK_SIGMAS)
    rows = tracks.color_rgb_images(noisy, "noisy", size=2)
    return rows.select("image_id", "sigma", "y", "x", "c", r6(F.col("v")).alias("v"))


_DRAW = normal_sql("sha256('9|' || vec_id || '|' || top || '|' || lf || '|' || ((dy * 2 + dx) * 3 + c))")
_TRACK_SQL = f"""
WITH {LONG}, {RGB_LONG}, q AS (SELECT vec_id, CAST(i // 24 AS INTEGER) AS y, CAST(i // 3 % 8 AS INTEGER) AS x, CAST(i % 3 AS INTEGER) AS c, v
  FROM x),
g AS (SELECT q.*, CAST(t AS INTEGER) AS top, CAST(l AS INTEGER) AS lf, CAST(y - t AS INTEGER) AS dy, CAST(x - l AS INTEGER) AS dx
  FROM q, range(7) a(t), range(7) b(l) WHERE y - t BETWEEN 0 AND 1 AND x - l BETWEEN 0 AND 1),
s AS (SELECT *, greatest(sqrt(avg(v * v) OVER (PARTITION BY vec_id, top, lf)), 1e-8) AS scale FROM g),
n AS (SELECT *, v + scale * sigma * {_DRAW} AS z,
  greatest(0.5 - 0.5 * cos(2 * pi() * (dy + 1) / 3), 1e-3) * greatest(0.5 - 0.5 * cos(2 * pi() * (dx + 1) / 3), 1e-3) AS w
  FROM s, (VALUES (0.1::DOUBLE), (0.4::DOUBLE)) v(sigma))
SELECT vec_id AS image_id, sigma, y, x, c, {r6_sql("sum(w * z) / sum(w)")} AS v FROM n GROUP BY ALL
"""


def representation_track(spark: SparkSession, directory: str) -> DataFrame:
    """Keyed crops, train-only fit and calibrated noise: every row's draws, read back from what was added.

    The entries' draws are weighted by their place and added; the measured SNR is that of the row's role and level.
    """
    images = _square_images(spark, directory, 8, 3)
    config = PatchConfig(size=3, n_random=8, augment=True)
    _, noisy = tracks.color_whitened(images, dataset="embeddings", seed=3, patches=config)
    noisy = noisy.withColumn("gap", F.zip_with("noisy", "clean", lambda a, b: a - b))
    weighted = F.transform("gap", lambda v, i: v / F.col("sigma") * (i + 1))
    rows = noisy.select(
        "image_id", "patch_index", "role", "snr_db", r6(vec.total(weighted)).alias("draws"),
        vec.sum_squares(F.col("clean")).alias("signal"), vec.sum_squares(F.col("gap")).alias("error"),
    )
    # Whole groups meet here only as sums: two numbers a role and level.
    totals = rows.groupBy("role", "snr_db").agg((F.sum("signal") / F.sum("error")).alias("ratio"))
    measured = totals.select("role", "snr_db", (F.round(F.lit(20.0) * F.log10("ratio")) / 2).alias("measured_db"))
    return rows.join(F.broadcast(measured), ["role", "snr_db"]).select("image_id", "patch_index", "role", "snr_db", "measured_db", "draws")


_REPRESENTATION_DRAW = normal_sql("sha256('3|' || vec_id || '|' || p || '|' || i)")
_REPRESENTATION_SQL = f"""
SELECT vec_id AS image_id, CAST(p AS INTEGER) AS patch_index, CASE WHEN label < 7 THEN 'train' WHEN label < 9 THEN 'val' ELSE 'test' END AS role,
  db AS snr_db, db AS measured_db, {r6_sql(f"sum({_REPRESENTATION_DRAW} * (i + 1))")} AS draws
FROM embeddings, range(8) a(p), range(27) b(i), (VALUES (0.0::DOUBLE), (3.0::DOUBLE), (6.0::DOUBLE)) t(db) GROUP BY ALL
"""

BOUND = {
    "grid_patches": Bound(
        grid_patches,
        f"WITH {_RASTER}, {_CUT} SELECT image_id, top, left_ AS left, dy, dx, 0 AS c, {r6_sql('v')} AS v FROM cut",
    ),
    "grid_patch_arrays": Bound(grid_patch_arrays, _ARRAYS_SQL),
    "reassemble": Bound(reassemble, _REASSEMBLE_SQL),
    "uncovered_images": Bound(uncovered, _UNCOVERED_SQL),
    "random_patches": Bound(random_patches, _RANDOM_SQL),
    "augment": Bound(augmented, _AUGMENT_SQL),
    "augment_pixels": Bound(augmented_pixels, _AUGMENT_ALL_SQL),
    "denoising_track": Bound(denoising_track, _TRACK_SQL),
    "representation_track": Bound(representation_track, _REPRESENTATION_SQL),
}
