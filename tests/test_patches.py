import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions.dihedral import AUGMENTATIONS
from tessella.operators import patches as pt
from tessella.operators.patches import PatchConfig

IMAGES = "image_id string, height int, width int, channels int, values array<double>"


def image_frame(spark, *arrays):
    return spark.createDataFrame(
        [(f"im{k}", *a.shape, a.ravel().tolist()) for k, a in enumerate(arrays)], IMAGES
    )


@pytest.fixture
def raster():
    return np.random.default_rng(1).uniform(size=(13, 11, 3))


@pytest.mark.parametrize(("size", "stride", "blend"), [(4, 3, True), (4, 4, False), (5, 2, True), (11, 8, True)])
def test_grid_round_trip(spark, raster, size, stride, blend):
    images = image_frame(spark, raster, raster[:12])
    cut = pt.grid_patches(images, size, stride)
    back = pt.reassemble(pt.patch_pixels(cut, size, 3), size, blend=blend)
    pt.require_full_cover(back, images)
    for r in back.collect():
        assert r["v"] == pytest.approx(raster[r["y"], r["x"], r["c"]], abs=1e-9)


def test_grid_positions_reach_the_far_edge(spark):
    frame = spark.createDataFrame([(50,), (16,), (24,), (23,)], "n int")
    got = [r[0] for r in frame.select(pt.grid_positions(F.col("n"), 16, 8)).collect()]
    assert got == [[0, 8, 16, 24, 32, 34], [0], [0, 8], [0, 7]]
    with pytest.raises(Exception, match="shorter than a patch"):
        spark.range(1).select(pt.grid_positions(F.lit(15), 16, 8)).collect()


@pytest.mark.parametrize(("length", "size", "stride"), [(50, 16, 8), (13, 4, 3), (9, 2, 5), (7, 7, 1)])
def test_long_form_agrees_with_positions(spark, length, size, stride):
    tops = spark.range(1).select(pt.grid_positions(F.lit(length), size, stride)).first()[0]
    rows = spark.range(length).select("id", pt.covering_positions(F.col("id").cast("int"), F.lit(length), size, stride).alias("p"))
    for r in rows.collect():
        assert sorted(r["p"]) == [t for t in tops if t <= r["id"] < t + size]


def test_uncovered_pixels(spark, raster):
    images = image_frame(spark, raster)
    cut = pt.grid_patches(images, 4, 4).filter("top > 0")
    back = pt.reassemble(pt.patch_pixels(cut, 4, 3), 4)
    assert pt.uncovered_images(back, images).count() == 1
    with pytest.raises(ValueError, match="uncovered"):
        pt.require_full_cover(back, images)


def expected_pcg64(raster, image_id, config, dataset, seed):
    h, w, _ = raster.shape
    for k in range(config.n_random):
        start = hashlib.sha256(f"{dataset}|{image_id}|{seed}|{k}".encode()).digest()[:8]
        gen = np.random.default_rng(int.from_bytes(start, "big"))
        top = int(gen.integers(config.border, h - config.size - config.border + 1))
        left = int(gen.integers(config.border, w - config.size - config.border + 1))
        aug = AUGMENTATIONS[int(gen.integers(0, 8))] if config.augment else "identity"
        yield k, top, left, aug


@pytest.mark.parametrize("augment", [False, True])
@pytest.mark.parametrize("rng", ["hash", "pcg64"])
def test_random_patches(spark, raster, rng, augment):
    config = PatchConfig(size=4, n_random=12, border=1, augment=augment)
    crops = pt.random_patches(image_frame(spark, raster), config, dataset="d", seed=3, rng=rng)
    rows = sorted(crops.collect(), key=lambda r: r["patch_index"])
    turns = {
        "identity": lambda p: p, "rot90": np.rot90, "rot180": lambda p: np.rot90(p, 2), "rot270": lambda p: np.rot90(p, 3),
        "flip_h": lambda p: p[:, ::-1], "flip_v": lambda p: p[::-1], "transpose": lambda p: p.swapaxes(0, 1),
        "anti_transpose": lambda p: np.rot90(p.swapaxes(0, 1), 2),
    }
    for r in rows:
        assert 1 <= r["top"] <= 8 and 1 <= r["left"] <= 6
        window = raster[r["top"] : r["top"] + 4, r["left"] : r["left"] + 4]
        np.testing.assert_array_equal(r["values"], turns[r["aug"]](window).ravel())
    if rng == "pcg64":
        got = [(r["patch_index"], r["top"], r["left"], r["aug"]) for r in rows]
        assert got == list(expected_pcg64(raster, "im0", config, "d", 3))
    assert len({(r["top"], r["left"]) for r in rows}) > 3


def test_random_patches_ignore_partitioning_and_order(spark, raster):
    config = PatchConfig(size=4, n_random=5)
    images = image_frame(spark, raster, raster[::-1].copy(), raster * 2)
    key = lambda df: sorted((r["image_id"], r["patch_index"], r["top"], r["left"]) for r in df.collect())
    first = pt.random_patches(images, config, dataset="d", seed=3)
    other = pt.random_patches(images.repartition(3, F.rand()), config, dataset="d", seed=3)
    assert key(first) == key(other)
    assert key(first) != key(pt.random_patches(images, config, dataset="d", seed=4))
    assert key(first) != key(pt.random_patches(images, config, dataset="e", seed=3))


@pytest.mark.parametrize("rng", ["hash", "pcg64"])
def test_random_patch_guards(spark, raster, rng):
    small = PatchConfig(size=10, n_random=1, border=1)
    with pytest.raises(Exception, match="too small"):
        pt.random_patches(image_frame(spark, raster), small, dataset="d", seed=0, rng=rng).collect()
    none = PatchConfig(size=4, n_random=0)
    assert pt.random_patches(image_frame(spark, raster), none, dataset="d", seed=0, rng=rng).isEmpty()
    for bad in ({"size": 0}, {"stride": 0}, {"n_random": -1}, {"border": -1}):
        with pytest.raises(ValueError):
            PatchConfig(**bad)
    with pytest.raises(ValueError):
        pt.random_patches(image_frame(spark, raster), small, dataset="d", seed=0, rng="mt")
