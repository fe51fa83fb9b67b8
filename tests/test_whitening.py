import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.errors import LeakageError, RecordSchemaError
from tessella.operators import whitening as wh
from tessella.operators.moments import outer_sum, table_matrix, vector_moments
from tessella.plans import representation as rep


def frame(spark, x, **constant):
    rows = [(k, row.tolist(), *constant.values()) for k, row in enumerate(x)]
    return spark.createDataFrame(rows, "id bigint, f array<double>" + "".join(f", {c} string" for c in constant))


def correlated(n, f, seed=0):
    gen = np.random.default_rng(seed)
    return gen.standard_normal((n, f)) @ gen.standard_normal((f, f)) + gen.standard_normal(f)


def test_moments_match_numpy_with_a_large_mean(spark):
    x = correlated(503, 7) + 1e7
    m = vector_moments(frame(spark, x).repartition(9), "f", width=7)
    assert m.n == 503
    np.testing.assert_allclose(m.mean, x.mean(axis=0), rtol=1e-14)
    np.testing.assert_allclose(m.covariance(), np.cov(x.T), rtol=1e-6)


def test_empty_partitions_and_empty_tables(spark):
    x = correlated(3, 4)
    assert vector_moments(frame(spark, x).repartition(20), "f", width=4).n == 3
    assert vector_moments(frame(spark, x).filter("id < 0"), "f", width=4).n == 0


@pytest.mark.parametrize("bad", [[[1.0, 2.0], [1.0]], [[1.0, 2.0], None], [[1.0, None], [1.0, 2.0]]])
def test_ragged_or_null_vectors_fail(spark, bad):
    table = spark.createDataFrame([(v,) for v in bad], "f array<double>").coalesce(1)
    with pytest.raises(Exception, match="ragged|null"):
        vector_moments(table, "f", width=2)


def test_outer_sum(spark):
    x = correlated(200, 5)
    table = outer_sum(frame(spark, x).repartition(6), ["f"], lambda b: b.T @ b, (5, 5))
    np.testing.assert_allclose(table_matrix(table, (5, 5)), x.T @ x, rtol=1e-12)


def test_fit_matches_closed_form_and_inverts(spark):
    x = correlated(400, 10)
    df = frame(spark, x)
    stats = wh.fit_whitening(df, "f", eps=1e-8)
    values, vectors = np.linalg.eigh(np.cov(x.T))
    np.testing.assert_allclose(stats.whiten, (vectors / np.sqrt(values + 1e-8)) @ vectors.T, atol=1e-9)
    both = df.select("id", wh.apply_whitening(F.col("f"), stats).alias("w"))
    out = both.select("id", "w", wh.invert_whitening(F.col("w"), stats).alias("b")).orderBy("id").collect()
    np.testing.assert_allclose([r["b"] for r in out], x, atol=1e-8)
    np.testing.assert_allclose(np.cov(np.array([r["w"] for r in out]).T), np.eye(10), atol=1e-3)
    assert wh.covariance_residual(df, "f", stats)["max_abs_off_identity"] < 1e-3


def test_whitening_guards(spark):
    x = correlated(5, 3)
    for eps in (0.0, -1.0, float("nan")):
        with pytest.raises(ValueError, match="eps"):
            wh.fit_whitening(frame(spark, x), "f", eps=eps)
    with pytest.raises(ValueError, match="training rows"):
        wh.fit_whitening(frame(spark, x[:1]), "f")
    stats = wh.fit_whitening(frame(spark, x), "f")
    with pytest.raises(Exception, match="feature dim"):
        frame(spark, correlated(5, 4)).select(wh.apply_whitening(F.col("f"), stats)).collect()


def patches(spark, seed=0, test_shift=0.0, n=60):
    gen = np.random.default_rng(seed)
    x = gen.uniform(size=(n, 27))
    rows = []
    for k, row in enumerate(x):
        role = ("train", "train", "val", "test")[k % 4]
        rows.append((k, (row + test_shift if role != "train" else row).tolist(), role))
    return spark.createDataFrame(rows, "id bigint, f array<double>, role string"), x


def reference_features(x):
    m = np.array([[1, 1, 1], [1, -1, 0], [1, 1, -2]]) / np.sqrt([[3], [2], [6]])
    o = x.reshape(len(x), -1, 3) @ m.T
    return (o - o.mean(axis=1, keepdims=True)).reshape(len(x), -1)


def test_representation_matches_staged_arithmetic(spark, tmp_path):
    df, x = patches(spark)
    fitted = rep.fit_representation(df, "f", eps=1e-3)
    feats = reference_features(x)
    train = feats[[k for k in range(60) if k % 4 < 2]]
    assert fitted.n_train == 30
    assert fitted.global_scale == pytest.approx(np.sqrt((train**2).mean()), rel=1e-12)
    cov = np.cov(train.T)
    values, vectors = np.linalg.eigh(cov)
    whiten = (vectors / np.sqrt(np.clip(values, 0, None) + 1e-3)) @ vectors.T
    want = (feats - train.mean(axis=0)) @ whiten.T / fitted.global_scale
    got = df.orderBy("id").select(rep.apply_representation(F.col("f"), fitted).alias("z"))
    got = np.array([r["z"] for r in got.collect()])
    np.testing.assert_allclose(got, want, atol=1e-8)
    path = str(tmp_path / "model")
    rep.save_representation(spark, fitted, path)
    loaded = rep.load_representation(spark, path)
    assert (loaded.fit_id, loaded.global_scale, loaded.n_train) == (fitted.fit_id, fitted.global_scale, 30)
    np.testing.assert_array_equal(loaded.whitening.whiten, fitted.whitening.whiten)


def test_fit_sees_training_rows_only(spark):
    df, _ = patches(spark)
    moved, _ = patches(spark, test_shift=0.3)
    other, _ = patches(spark, seed=1)
    base = rep.fit_representation(df, "f")
    again = rep.fit_representation(moved.repartition(5), "f")
    assert base.fit_id == again.fit_id and base.fit_id.startswith("fit-") and len(base.fit_id) == 20
    np.testing.assert_allclose(again.whitening.whiten, base.whitening.whiten, atol=1e-9)
    assert rep.fit_representation(other, "f").fit_id != base.fit_id
    assert rep.fit_representation(df, "f", eps=1e-4).fit_id != base.fit_id
    assert rep.fit_representation(df, "f", config={"note": 1}).fit_id != base.fit_id


def test_leakage_guards(spark):
    df, _ = patches(spark)
    with pytest.raises(LeakageError, match="test"):
        rep.require_train_only(df)
    rep.require_train_only(rep.train_rows(df))
    with pytest.raises(LeakageError):
        rep.train_rows(df.withColumn("role", F.when(F.col("id") == 0, "dev").otherwise(F.col("role"))))
    with pytest.raises(LeakageError):
        rep.train_rows(df.withColumn("role", F.when(F.col("id") > 0, F.col("role"))))
    with pytest.raises(ValueError, match="no train"):
        rep.train_rows(df.filter("role <> 'train'"))
    with pytest.raises(ValueError, match="training rows"):
        rep.fit_representation(df.filter("id = 0"), "f")
    with pytest.raises(ValueError, match="RGB"):
        rep.fit_representation(df.withColumn("f", F.slice("f", 1, 4)), "f")


def test_model_tampering(spark, tmp_path):
    from tessella.sources.models import read_json_record, write_json_record

    df, _ = patches(spark)
    rep.save_representation(spark, rep.fit_representation(df, "f"), str(tmp_path / "m"))
    record = read_json_record(spark, str(tmp_path / "m"))
    for k, change in enumerate(({"kind": "x"}, {"schema_version": 1}, {"global_scale": 0.0}, {"global_scale": True})):
        path = str(tmp_path / f"bad{k}")
        write_json_record(spark, record | change, path)
        with pytest.raises(RecordSchemaError):
            rep.load_representation(spark, path)
