"""Grid and keyed random patches of rasters, and weighted overlap-add reassembly.

Array form: one row per image, ``values ARRAY<DOUBLE>`` channel-last; patches are cut inside the
row, so extraction never shuffles. Long form: one row per pixel ``(image_id, y, x, c, v)``; every
pixel lists the patches covering it, again without a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.dihedral import AUGMENTATIONS, augment
from tessella.functions.keyed import patch_digest, uniform_from_digest
from tessella.guards import at_least
from tessella.session import broadcast_if_small

HANN_FLOOR = 1e-3


@dataclass(frozen=True)
class PatchConfig:
    size: int = 16
    stride: int = 8
    n_random: int = 64
    border: int = 0
    augment: bool = False

    def __post_init__(self) -> None:
        for name, floor in (("size", 1), ("stride", 1), ("n_random", 0), ("border", 0)):
            at_least(name, getattr(self, name), floor)


def _whole(quotient: Column) -> Column:
    return F.floor(quotient).cast("int")


def _fits(length: Column, size: int) -> Column:
    message = F.lit(f"an image side is shorter than a patch side of {size}")
    return F.when(length >= size, length).otherwise(F.raise_error(message).cast("int"))


def grid_positions(length: Column, size: int, stride: int) -> Column:
    """Regular positions plus one flush with the far edge."""
    last = _fits(length, size) - size
    return F.array_union(F.sequence(F.lit(0), last, F.lit(stride)), F.array(last))


def covering_positions(coordinate: Column, length: Column, size: int, stride: int) -> Column:
    """Grid positions of the patches that contain a coordinate."""
    last = _fits(length, size) - size
    low = F.greatest(F.lit(0), _whole((coordinate - size + stride) / stride))
    high = F.least(_whole(coordinate / stride), _whole(last / stride))
    regular = F.when(
        low <= high, F.transform(F.sequence(low, F.greatest(low, high)), lambda k: k * stride)
    ).otherwise(F.array().cast("array<int>"))
    flush = F.when(
        (last % stride != 0) & (coordinate >= last), F.array(last)
    ).otherwise(F.array().cast("array<int>"))
    return F.concat(regular, flush)


def _crop(values: Column, top: Column, left: Column, width: Column, channels: Column, size: int):
    """``size x size`` window of a channel-last raster, row by row."""
    return F.flatten(
        F.transform(
            F.sequence(top, top + (size - 1)),
            lambda y: F.slice(values, (y * width + left) * channels + 1, channels * size),
        )
    )


def grid_patches(images: DataFrame, size: int, stride: int) -> DataFrame:
    """Cut ``(image_id, height, width, channels, values)`` into overlapping grid patches."""
    PatchConfig(size=size, stride=stride)
    tops = grid_positions(F.col("height"), size, stride)
    lefts = grid_positions(F.col("width"), size, stride)
    cut = F.flatten(
        F.transform(
            tops,
            lambda t: F.transform(
                lefts,
                lambda ln: F.struct(
                    t.alias("top"),
                    ln.alias("left"),
                    _crop(F.col("values"), t, ln, F.col("width"), F.col("channels"), size).alias(
                        "values"
                    ),
                ),
            ),
        )
    )
    kept = [c for c in images.columns if c != "values"]
    return images.select(*kept, F.inline(cut))


def grid_patch_pixels(
    pixels: DataFrame, size: int, stride: int, height: Column, width: Column
) -> DataFrame:
    """Long form: ``(image_id, top, left, dy, dx, c, v)`` for every pixel of every patch."""
    PatchConfig(size=size, stride=stride)
    tops = covering_positions(F.col("y"), height, size, stride)
    lefts = covering_positions(F.col("x"), width, size, stride)
    placed = pixels.withColumn("top", F.explode(tops)).withColumn("left", F.explode(lefts))
    return placed.select(
        "image_id",
        "top",
        "left",
        (F.col("y") - F.col("top")).alias("dy"),
        (F.col("x") - F.col("left")).alias("dx"),
        "c",
        "v",
    )


def patch_pixels(
    patches: DataFrame, size: int, channels: int, keys: Sequence[str] = ("image_id",)
) -> DataFrame:
    """Unfold array-form patches into ``(*keys, top, left, dy, dx, c, v)``."""
    long = patches.select(*keys, "top", "left", F.posexplode_outer("values").alias("pos", "v"))
    cell = _whole(F.col("pos") / channels)
    return long.select(
        *keys,
        "top",
        "left",
        _whole(cell / size).alias("dy"),
        (cell % size).alias("dx"),
        (F.col("pos") % channels).alias("c"),
        "v",
    )


def _hann(offset: Column, size: int) -> Column:
    arc = F.cos(F.lit(2.0 * np.pi) * (offset + 1) / F.lit(size + 1))
    return F.greatest(F.lit(0.5) - F.lit(0.5) * arc, F.lit(HANN_FLOOR))


def reassemble(
    patch_pixel_rows: DataFrame,
    size: int,
    *,
    blend: bool = True,
    keys: Sequence[str] = ("image_id",),
) -> DataFrame:
    """Weighted overlap-add of patch pixels into ``(*keys, y, x, c, v, weight)``.

    Weighted sums combine before the shuffle, so an image that holds a third of all patches still
    spreads over the tasks that read it and over the reducers its pixels hash to.
    """
    weight = _hann(F.col("dy"), size) * _hann(F.col("dx"), size) if blend else F.lit(1.0)
    placed = patch_pixel_rows.select(
        *keys,
        (F.col("top") + F.col("dy")).alias("y"),
        (F.col("left") + F.col("dx")).alias("x"),
        "c",
        (weight * F.col("v")).alias("wv"),
        weight.alias("w"),
    )
    return (
        placed.groupBy(*keys, "y", "x", "c")
        .agg(F.sum("wv").alias("wv"), F.sum("w").alias("weight"))
        .select(*keys, "y", "x", "c", (F.col("wv") / F.col("weight")).alias("v"), "weight")
    )


def uncovered_images(reassembled: DataFrame, shapes: DataFrame) -> DataFrame:
    """Images whose reassembly leaves pixels out: ``(image_id, covered, wanted)``.

    ``shapes`` is ``(image_id, height, width, channels)``. Pixels are unique after
    reassembly, so counting those inside the frame is enough and no pixel grid is built.
    """
    # Pixels are counted per image, task by task, before shapes are looked up; only images that reach beyond
    # their frame are counted again with the frame at hand.
    drawn = reassembled.filter((F.col("y") >= 0) & (F.col("x") >= 0) & (F.col("weight") > 0)).select("image_id", "y", "x")
    totals = drawn.groupBy("image_id").agg(F.count(F.lit(1)).alias("covered"), F.max("y").alias("y"), F.max("x").alias("x"))
    framed = (F.col("y") < F.col("height")) & (F.col("x") < F.col("width"))
    counted = shapes.select("image_id", "height", "width").join(totals, "image_id")
    within = counted.filter(framed).select("image_id", "covered")
    beyond = counted.filter(~framed).select("image_id", "height", "width")
    recounted = drawn.join(broadcast_if_small(beyond), "image_id").groupBy("image_id")
    counts = within.unionByName(recounted.agg(F.count_if(framed).alias("covered")))
    wanted = (F.col("height") * F.col("width") * F.col("channels")).cast("bigint")
    return (
        shapes.select("image_id", wanted.alias("wanted"))
        .join(counts, "image_id", "left")
        .select("image_id", F.coalesce("covered", F.lit(0)).alias("covered"), "wanted")
        .filter(F.col("covered") != F.col("wanted"))
    )


def require_full_cover(reassembled: DataFrame, shapes: DataFrame) -> DataFrame:
    if not uncovered_images(reassembled, shapes).isEmpty():
        raise ValueError("reassembly leaves uncovered pixels; check stride and positions")
    return reassembled


def random_patches(
    images: DataFrame,
    config: PatchConfig,
    *,
    dataset: str,
    seed: int,
    rng: str = "hash",
) -> DataFrame:
    """Keyed random crops ``(.., patch_index, top, left, aug, values)`` of array-form images.

    Each crop depends only on ``(dataset, image_id, seed, patch_index)``. ``rng='hash'`` draws
    from the key digest with built-in functions; ``rng='pcg64'`` seeds NumPy's generator with the
    first eight digest bytes and draws top, left and augmentation from it, in that order.
    """
    if rng == "pcg64":
        return _random_patches_pcg64(images, config, dataset, seed)
    if rng != "hash":
        raise ValueError(f"unknown rng {rng!r}; expected 'hash' or 'pcg64'")
    size, border = config.size, config.border

    def span(length: str) -> Column:
        room = F.col(length) - size - 2 * border
        message = F.lit(f"image too small for size {size} with border {border}")
        return F.when(room >= 0, room + 1).otherwise(F.raise_error(message).cast("int"))

    def draw(digest: Column, slot: int, n: Column) -> Column:
        return F.floor(uniform_from_digest(digest, slot) * n).cast("int")

    kept = [c for c in images.columns if c != "values"]
    if config.n_random == 0:
        indexes = F.array().cast("array<int>")
    else:
        indexes = F.sequence(F.lit(0), F.lit(config.n_random - 1))
    crops = F.transform(
        indexes,
        lambda i: F.struct(
            i.alias("patch_index"),
            patch_digest(dataset, F.col("image_id"), seed, i).alias("digest"),
        ),
    )
    placed = F.transform(
        crops,
        lambda s: F.struct(
            s["patch_index"].alias("patch_index"),
            (draw(s["digest"], 0, span("height")) + border).alias("top"),
            (draw(s["digest"], 1, span("width")) + border).alias("left"),
            draw(s["digest"], 2, F.lit(len(AUGMENTATIONS))).alias("aug"),
        ),
    )
    cut = F.transform(
        placed,
        lambda s: F.struct(
            s["patch_index"].alias("patch_index"),
            s["top"].alias("top"),
            s["left"].alias("left"),
            s["aug"].alias("aug"),
            _crop(
                F.col("values"), s["top"], s["left"], F.col("width"), F.col("channels"), size
            ).alias("values"),
        ),
    )
    out = images.select(*kept, F.inline(cut))
    if not config.augment:
        return out.withColumn("aug", F.lit(AUGMENTATIONS[0]))
    names = F.array(*[F.lit(name) for name in AUGMENTATIONS])
    out = out.withColumn("aug", F.get(names, F.col("aug")))
    counts = [r[0] for r in images.select("channels").distinct().limit(2).collect()]
    if len(counts) > 1:
        raise ValueError("augmentation needs one channel count per call")
    if not counts:
        return out
    return out.withColumn("values", augment(F.col("values"), F.col("aug"), size, counts[0]))


def _turn(patch: np.ndarray, name: str) -> np.ndarray:
    if name in ("transpose", "anti_transpose"):
        patch = patch.swapaxes(0, 1)
        return patch if name == "transpose" else patch[::-1, ::-1]
    if name.startswith("rot"):
        return np.rot90(patch, int(name[3:]) // 90)
    return {"flip_h": patch[:, ::-1], "flip_v": patch[::-1]}.get(name, patch)


def _random_patches_pcg64(
    images: DataFrame, config: PatchConfig, dataset: str, seed: int
) -> DataFrame:
    size, border = config.size, config.border
    names = AUGMENTATIONS

    kept = [f for f in images.schema.fields if f.name != "values"]
    added = "patch_index int, top int, left int, aug string, values array<double>"
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), added])

    def crops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            types = {f.name: f.type for f in batch.schema if f.name != "values"}
            for row in batch.to_pylist():
                h, w, c = row["height"], row["width"], row["channels"]
                if min(h, w) < size + 2 * border:
                    raise ValueError(f"image {h}x{w} too small for size {size}, border {border}")
                raster = np.asarray(row["values"], dtype=np.float64).reshape(h, w, c)
                out = []
                for k in range(config.n_random):
                    key = f"{dataset}|{row['image_id']}|{seed}|{k}".encode()
                    start = int.from_bytes(hashlib.sha256(key).digest()[:8], "big")
                    gen = np.random.default_rng(start)
                    top = int(gen.integers(border, h - size - border + 1))
                    left = int(gen.integers(border, w - size - border + 1))
                    name = names[int(gen.integers(0, len(names)))] if config.augment else names[0]
                    window = raster[top : top + size, left : left + size]
                    out.append((k, top, left, name, _turn(window, name).ravel()))
                if not out:
                    continue
                index, tops, lefts, chosen, values = zip(*out, strict=True)
                columns = {n: pa.array([row[n]] * len(out), t) for n, t in types.items()}
                columns |= {
                    "patch_index": pa.array(index, pa.int32()),
                    "top": pa.array(tops, pa.int32()),
                    "left": pa.array(lefts, pa.int32()),
                    "aug": pa.array(chosen, pa.string()),
                    "values": pa.array(list(values), pa.list_(pa.float64())),
                }
                yield pa.RecordBatch.from_pydict(columns)

    return images.select(*[f.name for f in kept], "values").mapInArrow(crops, schema)
