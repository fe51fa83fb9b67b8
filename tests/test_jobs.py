import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.errors import OutputExistsError
from tessella.operators.patches import PatchConfig
from tessella.plans import jobs, tracks
from tessella.sources.models import read_json_record
from tessella.sources.registry import dataset_ids
from tessella.sources.synthetic import synthetic_images, unit_values


def fixture_images(spark, n=8, size=24):
    images = unit_values(synthetic_images(spark, n, size=size))
    role = F.when(F.col("idx") < n // 2, "train").when(F.col("idx") < 3 * n // 4, "val").otherwise("test")
    return images.select("image_id", role.alias("role"), "height", "width", "channels", "values")


def test_audit_report(spark, tmp_path):
    out = str(tmp_path / "audit")
    report = jobs.audit_fixture(spark, out, n=4, size=48)
    assert read_json_record(spark, out) == json.loads(json.dumps(report))
    assert (report["n_train_features"], report["n_test_features"], report["dataset"]) == (128, 128, "synthetic")
    counts = np.array(report["channel_histograms"]["counts_per_channel"])
    assert counts.shape == (3, 16) and (counts.sum(axis=1) == 128 * 256).all()
    assert len(report["channel_histograms"]["bin_edges"]) == 17
    power = report["patch_power"]
    assert power["p05"] <= power["median"] <= power["p95"]
    before = report["whitening_before_after"]["before"]
    assert abs(before["mean"]) < 1e-9 and before["min"] < 0 < before["max"]
    assert 0 < report["train_test_similarity"]["mean_nearest_cosine"] <= report["train_test_similarity"]["max_nearest_cosine"] <= 1 + 1e-9
    with pytest.raises(OutputExistsError):
        jobs.audit_fixture(spark, out, n=4, size=48)


def test_audit_of_one_image_compares_train_with_itself(spark, tmp_path):
    report = jobs.audit_fixture(spark, str(tmp_path / "one"), n=1, size=20)
    assert report["train_test_similarity"]["max_nearest_cosine"] == pytest.approx(1.0)


def test_whitened_track(spark):
    config = PatchConfig(size=6, n_random=40, augment=True)
    fitted, noisy = tracks.color_whitened(fixture_images(spark), dataset="d", seed=1, patches=config, snr_db=(0.0, 6.0))
    assert fitted.n_train == 160 and noisy.count() == 2 * 320
    power = lambda v: F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x)
    gap = F.zip_with("noisy", "clean", lambda a, b: a - b)
    ratio = F.sum(power(F.col("clean"))) / F.sum(power(gap))
    for row in noisy.groupBy("role", "snr_db").agg((F.lit(10.0) * F.log10(ratio)).alias("db")).collect():
        assert row["db"] == pytest.approx(row["snr_db"], abs=0.6)  # clean means are only near zero off train
    totals = noisy.groupBy("role", "snr_db").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("sigma").alias("levels"))
    assert {(r["role"], r["n"], r["levels"]) for r in totals.collect()} == {("train", 160, 1), ("val", 80, 1), ("test", 80, 1)}


def test_rgb_track_round_trip_and_noise_level(spark):
    images = fixture_images(spark, n=4)
    config = PatchConfig(size=8, stride=4)
    noisy = tracks.color_rgb_patches(images, seed=2, patches=config, sigmas=(0.0, 25 / 255))
    back = tracks.color_rgb_images(noisy, "noisy", size=8)
    truth = images.select("image_id", F.posexplode("values").alias("pos", "t"))
    at = (F.col("y") * 24 + F.col("x")) * 3 + F.col("c")
    errors = back.withColumn("pos", at.cast("int")).join(truth, ["image_id", "pos"])
    worst = {r["sigma"]: r["e"] for r in errors.groupBy("sigma").agg(F.max(F.abs(F.col("v") - F.col("t"))).alias("e")).collect()}
    assert worst[0.0] < 1e-9 < worst[25 / 255]
    gap = noisy.filter("sigma > 0").select(F.explode(F.zip_with("noisy", "clean", lambda a, b: a - b)).alias("d"))
    assert gap.agg(F.stddev_pop("d")).first()[0] == pytest.approx(25 / 255, rel=0.02)


def test_check_of_a_registered_dataset(spark, tmp_path):
    path = str(tmp_path / "m")
    rows = dataset_ids(spark, "div2k").selectExpr(
        "split_id", "role", "concat(split_id, '.png') AS relative_path", "'' AS sha256",
        "concat('sha256:', sha2(split_id, 256)) AS content_sha256", "'PNG' AS format", "8 AS height", "8 AS width", "'RGB' AS mode",
    )
    from tessella.sources.tables import write_manifest

    write_manifest(rows, path)
    counts = {"train": 720, "val": 80, "test": 100}
    assert jobs.check_dataset(spark, "div2k", path, expected_counts=counts, allowed_formats={"PNG"}).isEmpty()
    assert not jobs.check_dataset(spark, "bsds500", path).isEmpty()
    with pytest.raises(ValueError, match="role_count"):
        jobs.require_clean(jobs.check_dataset(spark, "div2k", path, expected_counts={"train": 1}), "check")
    with pytest.raises(ValueError, match="dataset"):
        jobs.check_dataset(spark, "mnist", path)


def test_lineage_job(spark):
    one = lambda rows, schema: spark.createDataFrame(rows, schema)
    kind = "translated-from"
    tuples = one([("a.tex", "b.tex", kind)], "source string, target string, derivation string")
    report = jobs.check_lineage(
        texts=one([(r"\label{fig:x}",)], "text string"),
        inventory=one([("fig:x",)], "label string"),
        expected=tuples,
        declared=tuples,
        file_map=one([(0, "b.tex", kind, "a.tex", "s", "t", "")], "pos int, dissertation_file string, derivation string, "
                     "source_2026_file string, source_sha256 string, current_sha256 string, notes string"),
        derived=one([("b.tex",)], "rel string"),
        targets=one([("b.tex", "t")], "rel string, sha256 string"),
        sources=one([("a.tex", "s")], "rel string, sha256 string"),
        frozen_sources=one([("a.tex",)], "rel string"),
    )
    assert report.isEmpty()
