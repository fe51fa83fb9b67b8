import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import features, noise


def signal(spark, n=40_000):
    gen = np.random.default_rng(0)
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(gen.standard_normal(n))], "id bigint, x double")


@pytest.mark.parametrize("db", [-3.0, 0.0, 3.0, 6.0, 10.0])
def test_snr_calibration(spark, db):
    table = signal(spark)
    noisy = noise.add_awgn_snr(table, "x", db, 1, "id")
    assert features.measured_snr_db(noisy, "x", "noisy").first()[0] == pytest.approx(db, abs=0.3)
    variance = table.agg(F.var_pop("x")).first()[0]
    assert noisy.first()["sigma"] == pytest.approx(math.sqrt(variance / 10 ** (db / 10)), rel=1e-12)


def test_degenerate_signals(spark):
    flat = spark.range(10).select("id", F.lit(0.5).alias("x"), F.lit(0.5).alias("y"), F.lit(0.7).alias("z"))
    with pytest.raises(Exception, match="constant signal"):
        features.sigma_for_snr(flat, "x", 3.0).collect()
    assert features.measured_snr_db(flat, "x", "y").first()[0] == math.inf
    assert features.measured_snr_db(flat, "x", "z").first()[0] == -math.inf


def test_sigma_guards_and_identity(spark):
    for bad in (-0.1, float("nan")):
        with pytest.raises(ValueError):
            noise.add_awgn_sigma(F.col("x"), bad, 0, F.col("id"))
        with pytest.raises(ValueError):
            noise.state_noise(signal(spark, 2), bad, 0, "id")
    same = signal(spark, 50).select("x", noise.add_awgn_sigma(F.col("x"), 0.0, 0, F.col("id")).alias("y"))
    assert all(r["x"] == r["y"] for r in same.collect())


def test_vector_noise_is_calibrated_per_group(spark):
    gen = np.random.default_rng(1)
    rows = [(k, "ab"[k % 2], (gen.standard_normal(64) * (1 + 4 * (k % 2)) + 3).tolist()) for k in range(600)]
    table = spark.createDataFrame(rows, "id bigint, g string, f array<double>")
    noisy = noise.add_awgn_snr_vectors(table, "f", 3.0, 2, "id", by=("g",)).collect()
    for g in "ab":
        clean = np.array([r["f"] for r in noisy if r["g"] == g])
        other = np.array([r["noisy"] for r in noisy if r["g"] == g])
        sigma = {r["sigma"] for r in noisy if r["g"] == g}.pop()
        assert sigma == pytest.approx(math.sqrt(clean.var() / 10**0.3), rel=1e-10)
        assert 10 * math.log10(clean.var() / ((other - clean) ** 2).mean()) == pytest.approx(3.0, abs=0.3)
    whole = noise.add_awgn_snr_vectors(table, "f", 0.0, 2, "id").first()
    assert whole["sigma"] == pytest.approx(np.array([r[2] for r in rows]).std(), rel=1e-10)


def edges(spark):
    return spark.createDataFrame(
        [(t, s, i, j) for t in range(2) for s in range(3) for i in range(4) for j in range(4)],
        "trajectory int, step int, src int, dst int",
    )


def test_resample_scopes(spark):
    def draws(scope, **kw):
        out = noise.scoped_weight_noise(edges(spark), scope, 0.5, 7, **kw)
        return {(r["trajectory"], r["step"], r["src"], r["dst"]): r["noise"] for r in out.collect()}

    per_step, per_traj = draws("per_step"), draws("per_trajectory")
    assert len(set(per_step.values())) == 96
    assert len(set(per_traj.values())) == 32 and per_traj[0, 0, 1, 2] == per_traj[0, 2, 1, 2]
    fixed = noise.uniform_weight_noise(edges(spark).select("src", "dst").distinct(), 0.25, 1)
    constant = draws("fixed", fixed=fixed)
    assert len(set(constant.values())) == 16 and max(map(abs, constant.values())) < 0.25
    with pytest.raises(ValueError):
        draws("per_epoch")
    with pytest.raises(ValueError):
        draws("fixed")
    with pytest.raises(ValueError):
        draws("per_step", fixed=fixed)
    with pytest.raises(Exception, match="cover every edge"):
        draws("fixed", fixed=fixed.filter("src > 0"))


def test_uniform_noise_fills_its_range(spark):
    grid = spark.range(20_000).select((F.col("id") % 200).alias("src"), F.floor(F.col("id") / 200).alias("dst"))
    row = noise.uniform_weight_noise(grid, 2.0, 0).agg(F.min("noise"), F.max("noise"), F.avg("noise"), F.stddev("noise")).first()
    assert -2 < row[0] < -1.99 and 1.99 < row[1] < 2 and abs(row[2]) < 0.03 and abs(row[3] - 2 / math.sqrt(3)) < 0.02


def test_normalisation(spark):
    gen = np.random.default_rng(2)
    x = gen.standard_normal((30, 5))
    table = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "id bigint, f array<double>")
    out = features.global_normalize(table, "f").orderBy("id").collect()
    scale = np.sqrt((x**2).mean())
    np.testing.assert_allclose([r["f"] for r in out], x / scale, rtol=1e-12)
    given = features.global_normalize(table, "f", scale=2.0).orderBy("id").collect()
    np.testing.assert_allclose([r["f"] for r in given], x / 2, rtol=1e-12)
    for bad in (0.0, -1.0, float("nan")):
        with pytest.raises(ValueError):
            features.global_normalize(table, "f", scale=bad)
    zeros = table.withColumn("f", F.transform("f", lambda v: v * 0))
    with pytest.raises(Exception, match="positive"):
        features.global_normalize(zeros, "f").collect()
    flat = features.per_row_normalize(zeros, "f").first()
    assert flat["scale"] == 1e-8 and set(flat["f"]) == {0.0}
    rows = features.per_row_normalize(table, "f").orderBy("id").collect()
    np.testing.assert_allclose([r["scale"] for r in rows], np.sqrt((x**2).mean(axis=1)), rtol=1e-12)
