import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import color, dihedral, gabor, keyed, population as pop, vectors as vec


def one(spark, column, **values):
    frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return frame.select(column.alias("out")).first()["out"]


def test_srgb_round_trip_and_fixed_points(spark):
    values = [0.0, 0.001, 0.04045, 0.0405, 0.2, 0.5, 1.0]
    frame = spark.createDataFrame([(v,) for v in values], "x double")
    linear = color.srgb_to_linear(F.col("x"))
    rows = frame.select("x", linear.alias("lin"), color.linear_to_srgb(linear).alias("back")).collect()
    for r in rows:
        # The two published thresholds meet only to eight digits.
        assert abs(r["back"] - r["x"]) < (1e-7 if r["x"] == 0.04045 else 1e-12)
    assert rows[2]["lin"] == pytest.approx(0.04045 / 12.92, abs=0)
    assert rows[-1]["lin"] == pytest.approx(1.0)


def test_opponent_is_orthonormal():
    m = color.opponent_matrix()
    np.testing.assert_allclose(m @ m.T, np.eye(3), atol=1e-15)


def test_rgb_length_is_checked(spark):
    with pytest.raises(Exception, match="multiple of 3"):
        spark.range(1).select(F.inline(color.rgb_pixels(F.array(F.lit(1.0), F.lit(2.0))))).collect()


def test_dc_removal(spark):
    values = [1.0, 2.0, 3.0, 5.0, 2.0, 9.0]
    frame = spark.createDataFrame([(values,)], "f array<double>").withColumn("dc", vec.channel_means(F.col("f"), 3))
    frame = frame.withColumn("z", vec.remove_dc(F.col("f"), F.col("dc"), 3))
    row = frame.withColumn("back", vec.restore_dc(F.col("z"), F.col("dc"), 3)).first()
    assert row["dc"] == [3.0, 2.0, 6.0] and row["z"] == [-2.0, 0.0, -3.0, 2.0, 0.0, 3.0] and row["back"] == values


def test_scalar_maps(spark):
    assert one(spark, vec.soft_threshold(F.col("v"), 0.5), v=-2.0) == -1.5
    assert one(spark, vec.soft_threshold(F.col("v"), 5.0), v=-2.0) == 0.0
    assert one(spark, vec.soft_threshold(F.col("v"), -1.0), v=-2.0) == -2.0
    assert one(spark, vec.softplus(F.col("v")), v=800.0) == 800.0
    assert one(spark, vec.softplus(F.col("v")), v=0.0) == pytest.approx(math.log(2))
    assert one(spark, vec.log_rectifier(F.col("v"), 2.0, 1.0, 3.0), v=0.5) == pytest.approx(2 * math.log1p(4.5))
    assert one(spark, vec.log_rectifier(F.col("v"), 2.0, 1.0, 3.0), v=-3.0) == 0.0
    for beta in (-0.1, 1.1, float("nan")):
        with pytest.raises(ValueError):
            vec.write_mix(F.col("v"), F.col("v"), beta)


def test_augmentations_match_array_operations(spark):
    size, channels = 3, 2
    patch = np.arange(size * size * channels, dtype=float).reshape(size, size, channels)
    wanted = {
        "identity": patch, "rot90": np.rot90(patch), "rot180": np.rot90(patch, 2), "rot270": np.rot90(patch, 3),
        "flip_h": patch[:, ::-1], "flip_v": patch[::-1], "transpose": patch.swapaxes(0, 1),
        "anti_transpose": np.rot90(patch.swapaxes(0, 1), 2),
    }
    rows = spark.createDataFrame([(n, patch.ravel().tolist()) for n in wanted], "aug string, f array<double>")
    out = rows.select("aug", dihedral.augment(F.col("f"), F.col("aug"), size, channels).alias("g")).collect()
    for r in out:
        np.testing.assert_array_equal(r["g"], wanted[r["aug"]].ravel())
    with pytest.raises(Exception, match="unknown augmentation"):
        rows.select(dihedral.augment(F.col("f"), F.lit("spin"), size, channels)).collect()
    with pytest.raises(ValueError):
        dihedral.moved_position("spin", F.col("y"), F.col("x"), 3)


def test_keyed_draws(spark):
    digest = hashlib.sha256(b"d|img|3|5").hexdigest()
    frame = spark.range(1).select(keyed.patch_digest("d", F.lit("img"), 3, F.lit(5)).alias("d"))
    row = frame.select("d", keyed.uniform_from_digest(F.col("d"), 1).alias("u")).first()
    assert row["d"] == digest and row["u"] == (int(digest[13:26], 16) + 0.5) / 2**52
    draws = spark.range(100_000).repartition(7).select(keyed.keyed_normal("s", F.col("id")).alias("z"))
    stats = draws.agg(F.avg("z"), F.stddev("z"), F.skewness("z"), F.kurtosis("z")).first()
    assert abs(stats[0]) < 0.02 and abs(stats[1] - 1) < 0.02 and abs(stats[2]) < 0.05 and abs(stats[3]) < 0.1
    fewer = spark.range(100).select("id", keyed.keyed_normal("s", F.col("id")).alias("z"))
    assert fewer.orderBy("id").collect() == fewer.repartition(13).orderBy("id").collect()


def test_pixel_digest_binds_shape(spark):
    pixels = bytes(range(12))
    frame = spark.createDataFrame([(bytearray(pixels), 2, 2, 3), (bytearray(pixels), 4, 3, 1)], "p binary, h int, w int, c int")
    got = [r[0] for r in frame.select(keyed.pixel_digest(F.col("p"), F.col("h"), F.col("w"), F.col("c"))).collect()]
    heads = (b"|u1|(2, 2, 3)", b"|u1|(4, 3)")
    assert got == ["sha256:" + hashlib.sha256(h + pixels).hexdigest() for h in heads]


def test_population_codes(spark):
    for n in (64, 100):  # written out, and by index
        for x in (0.3, 0.5, 0.7):
            code = pop.place_code(F.col("x"), n, 0.03)
            assert one(spark, pop.decode_place(code, n), x=x) == pytest.approx(x, abs=1e-3)
    edge = one(spark, pop.decode_place(pop.place_code(F.col("x"), 64, 0.03), 64), x=0.0)
    assert edge > 0.01  # biased inwards at the border
    distance = [one(spark, pop.circular_distance(F.lit(0.05), F.col("m")), m=m) for m in (0.0, 0.5, 0.9)]
    np.testing.assert_allclose(distance, [0.05, 0.45, 0.15], atol=1e-12)
    ring = [one(spark, pop.ring_code(F.col("q"), 8), q=q) for q in (0.1, 1.1, -0.9)]
    np.testing.assert_allclose(ring[1], ring[0], atol=1e-9)
    np.testing.assert_allclose(ring[2], ring[0], atol=1e-9)
    spec = pop.MixedCode(5, 4, 3)
    mixed = one(spark, pop.mixed_code(F.col("x"), spec), x=0.4)
    assert len(mixed) == spec.n_total
    np.testing.assert_allclose(mixed[5:], one(spark, pop.ring_code(F.col("q"), 4), q=1.2), atol=1e-12)
    silent = one(spark, pop.decode_place(F.array(*[F.lit(0.0)] * 3), 3))
    assert silent == 0.0
    for bad in ((1, 1, 1), (2, 0, 1), (2, 1, 0)):
        with pytest.raises(ValueError):
            pop.MixedCode(*bad)
    for width in (0.0, float("nan")):
        with pytest.raises(ValueError):
            pop.place_code(F.col("x"), 4, width)
    with pytest.raises(ValueError):
        pop.line_centers(1)


def test_gabor(spark):
    p = {"amplitude": 2.0, "t_x": 1.0, "t_y": 2.0, "theta": 0.3, "sigma_x": 1.5, "sigma_y": 0.7, "k": 1.1, "phi": 0.4}
    schema = "key int, " + ", ".join(f"{n} double" for n in gabor.PARAMETERS)
    bank = gabor.gabor_bank(spark.createDataFrame([(1, *p.values())], schema), "key", 4, 3)
    for r in bank.collect():
        dx, dy = r["x"] - 1.0, r["y"] - 2.0
        a, b = dx * math.cos(0.3) - dy * math.sin(0.3), dx * math.sin(0.3) + dy * math.cos(0.3)
        want = 2 * math.exp(-0.5 * (a * a / 1.5**2 + b * b / 0.7**2)) * math.cos(1.1 * a + 0.4)
        assert r["g"] == pytest.approx(want, abs=1e-12)
    assert bank.count() == 12
    for sigma in (0.0, -1.0, float("nan")):
        bad = spark.createDataFrame([(1, *(p | {"sigma_x": sigma}).values())], schema)
        with pytest.raises(Exception, match="positive"):
            gabor.gabor_bank(bad, "key", 2, 2).collect()
