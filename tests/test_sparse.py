from decimal import Decimal, localcontext

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import inference as inf
from tessella.operators import matrices, sparse
from tessella.operators.moments import table_matrix
from tessella.plans.bindings import coding
from tessella.session import bounded_matrix

GEN = np.random.default_rng(0)
N, M, K, ROWS = 6, 8, 3, 20
PHI = GEN.standard_normal((N, M))
PHI /= np.linalg.norm(PHI, axis=0)
LAM = np.log1p(np.exp(GEN.standard_normal((K, M))))
LAM /= LAM.sum(axis=1, keepdims=True)
X, S = GEN.standard_normal((ROWS, N)), GEN.standard_normal((ROWS, M))
EPS = 1e-6


@pytest.fixture
def table(spark):
    rows = [(k, X[k].tolist(), S[k].tolist()) for k in range(ROWS)]
    return spark.createDataFrame(rows, "id bigint, x array<double>, s array<double>").repartition(4)


def values(table, column):
    return np.array([r["out"] for r in table.select("id", column.alias("out")).orderBy("id").collect()])


def omega(s, lam=LAM, eps=EPS):
    return np.sqrt(eps + (s * s) @ lam.T).sum(axis=-1)


def central(f, at, h=1e-6):
    grad = np.zeros_like(at)
    for k in np.ndindex(at.shape):
        up, down = at.copy(), at.copy()
        up[k] += h
        down[k] -= h
        grad[k] = (f(up) - f(down)) / (2 * h)
    return grad


def test_linear_model(table):
    np.testing.assert_allclose(values(table, sparse.reconstruct(F.col("s"), PHI)), S @ PHI.T, atol=1e-12)
    error = values(table, sparse.reconstruction_error(F.col("x"), F.col("s"), PHI))
    np.testing.assert_allclose(error, 0.5 * ((X - S @ PHI.T) ** 2).sum(axis=1), atol=1e-12)
    grad = values(table, sparse.data_gradient(F.col("x"), F.col("s"), PHI))
    numeric = central(lambda s: 0.5 * ((X[0] - PHI @ s) ** 2).sum(), S[0])
    np.testing.assert_allclose(grad[0], numeric, rtol=1e-6, atol=1e-8)
    loss = sparse.denoising_loss(table, "x", "s", PHI).first()["loss"]
    assert loss == pytest.approx(2 * error.mean())


def test_dictionary_gradient_matches_differences(table):
    got = table_matrix(sparse.dictionary_gradient(table, "x", "s", PHI), PHI.shape)
    numeric = -central(lambda p: 0.5 * ((X - S @ p.T) ** 2).sum(), PHI)
    np.testing.assert_allclose(got, numeric, rtol=1e-6, atol=1e-7)


def test_group_gradients_match_differences(table):
    np.testing.assert_allclose(values(table, sparse.group_penalty(F.col("s"), LAM, EPS)), omega(S), atol=1e-12)
    grad = values(table, sparse.group_penalty_gradient(F.col("s"), LAM, EPS))
    np.testing.assert_allclose(grad[3], central(omega, S[3]), rtol=1e-6, atol=1e-8)
    weights = values(table, sparse.group_weight_gradient(F.col("s"), LAM, EPS)).reshape(ROWS, K, M)
    numeric = central(lambda lam: omega(S[5], lam), LAM)
    np.testing.assert_allclose(weights[5], numeric, rtol=1e-5, atol=1e-8)
    mean = np.zeros((K, M))
    for r in sparse.mean_group_weight_gradient(table, "s", LAM, EPS).collect():
        mean[r["k"], r["i"]] = r["grad"]
    np.testing.assert_allclose(mean, weights.mean(axis=0), rtol=1e-12)


def test_silent_group_stays_finite(spark):
    zero = spark.createDataFrame([([0.0] * M,)], "s array<double>")
    row = zero.select(
        sparse.group_activity(F.col("s"), LAM, EPS).alias("z"), sparse.group_penalty_gradient(F.col("s"), LAM, EPS).alias("g")
    ).first()
    np.testing.assert_allclose(row["z"], np.sqrt(EPS))
    assert set(row["g"]) == {0.0}


def test_group_guards():
    for lam, eps in ((-LAM, EPS), (LAM, 0.0), (LAM, -1.0), (LAM, float("nan")), (LAM * np.nan, EPS)):
        with pytest.raises(ValueError):
            sparse.group_activity(F.col("s"), lam, eps)


def phi_table(spark, phi):
    return spark.createDataFrame(
        [(n, m, float(phi[n, m])) for n in range(phi.shape[0]) for m in range(phi.shape[1])], "n int, m int, w double"
    )


def test_normalize_columns(spark):
    raw = PHI * np.arange(1, M + 1)
    got = bounded_matrix(sparse.normalize_columns(phi_table(spark, raw)), "n", "m", "w")
    np.testing.assert_allclose(got, PHI, atol=1e-12)
    np.testing.assert_allclose(sparse.unit_columns(raw), PHI, atol=1e-12)
    dead = raw.copy()
    dead[:, 2] = 0.0
    with pytest.raises(Exception, match="no length"):
        sparse.normalize_columns(phi_table(spark, dead)).collect()
    with pytest.raises(ValueError):
        sparse.unit_columns(dead)
    kept = bounded_matrix(sparse.normalize_columns(phi_table(spark, dead), on_zero="keep"), "n", "m", "w")
    assert not kept[:, 2].any()
    for kw in ({"on_zero": "drop"}, {"eps": 0.0}, {"eps": float("nan")}):
        with pytest.raises(ValueError):
            sparse.normalize_columns(phi_table(spark, raw), **kw)


def test_softplus_groups(spark):
    raw = np.array([[-800.0, 0.0], [3.0, 800.0]])
    frame = spark.createDataFrame([(k, m, float(raw[k, m])) for k in range(2) for m in range(2)], "k int, m int, w double")
    got = bounded_matrix(sparse.softplus_groups(frame), "k", "m", "w")
    np.testing.assert_allclose(got.sum(axis=1), 1.0)
    plain = bounded_matrix(sparse.softplus_groups(frame, "none"), "k", "m", "w")
    np.testing.assert_allclose(plain, np.logaddexp(0.0, raw), atol=1e-12)
    with pytest.raises(ValueError):
        sparse.softplus_groups(frame, "columns")
    bound = sparse.penalty_lipschitz_table(sparse.softplus_groups(frame), 0.5, 1e-4).first()[0]
    assert bound == pytest.approx(sparse.penalty_curvature(got.sum(axis=0).max(), 0.5, 1e-4))


def test_softplus_groups_keep_the_digits_of_many_rows(spark, tmp_path):
    counts = (9878, 10400, 11362)
    labels = spark.range(sum(counts)).select(
        F.col("id").alias("vec_id"),
        F.expr("array(cast(0 as float))").alias("embedding"),
        F.expr(f"CASE WHEN id < {counts[0]} THEN 0 WHEN id < {sum(counts[:2])} THEN 1 ELSE 2 END").alias("label"),
    )
    labels.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r["k"], r["m"]): r for r in coding.softplus_groups(spark, str(tmp_path)).collect()}
    with localcontext() as context:
        context.prec = 60
        exact = np.empty((coding.GROUPS, len(counts)), dtype=object)
        for k, m in np.ndindex(exact.shape):
            w = (Decimal(counts[m]) / 50).ln() * (4 * k - 6)
            exact[k, m] = max(w, Decimal(0)) + (1 + (-abs(w)).exp()).ln()
        exact /= exact.sum(axis=1, keepdims=True)
        bound = exact.sum(axis=0).max() * Decimal(str(coding.WEIGHT)) / Decimal(str(coding.EPS)).sqrt()
    assert got.keys() == set(np.ndindex(exact.shape))
    for at, row in got.items():
        assert row["w"] == pytest.approx(float(exact[at]), rel=0, abs=6e-7)
        assert row["bound"] == pytest.approx(float(bound), rel=0, abs=6e-7)


def slow_infer(variant, x, steps, eta, weight, eps, s=None):
    s = np.zeros((len(x), M)) if s is None else s
    for _ in range(steps):
        z = np.sqrt(eps + (s * s) @ LAM.T)
        coupling = (1 / z) @ LAM
        grad = (s @ PHI.T - x) @ PHI
        if variant == "smooth_gradient":
            s = s - eta * (grad + weight * s * coupling)
        else:
            v = s - eta * grad
            s = np.sign(v) * np.maximum(np.abs(v) - eta * weight * coupling, 0.0)
    return s


@pytest.mark.parametrize("variant", inf.VARIANTS)
def test_inference_matches_the_recurrence(table, variant):
    options = {"eta": 0.1, "penalty_weight": 0.2, "eps": 1e-4}
    code = inf.infer(variant, F.col("x"), PHI, LAM, n_steps=7, **options)
    np.testing.assert_allclose(values(table, code), slow_infer(variant, X, 7, 0.1, 0.2, 1e-4), atol=1e-12)
    warm = inf.infer(variant, F.col("x"), PHI, LAM, n_steps=3, start=F.col("s"), **options)
    np.testing.assert_allclose(values(table, warm), slow_infer(variant, X, 3, 0.1, 0.2, 1e-4, S), atol=1e-12)
    none = inf.infer(variant, F.col("x"), PHI, LAM, n_steps=0, **options)
    assert not values(table, none).any()


def test_long_inference_without_penalty_is_least_squares(spark):
    phi = np.random.default_rng(7).standard_normal((8, 6))
    x = np.random.default_rng(8).standard_normal((3, 8))
    frame = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "id bigint, x array<double>")
    eta = inf.step_size(phi)
    code = inf.infer("smooth_gradient", F.col("x"), phi, np.ones((1, 6)), n_steps=20_000, eta=eta, penalty_weight=0.0)
    np.testing.assert_allclose(values(frame, code), np.linalg.lstsq(phi, x.T, rcond=None)[0].T, rtol=1e-3, atol=1e-4)


@pytest.mark.parametrize("eps", [1e-3, 1e-6, 1e-9])
@pytest.mark.parametrize("weight", [0.01, 1.0, 10.0])
def test_stable_step_never_raises_the_objective(table, eps, weight):
    eta = inf.step_size(PHI, LAM, weight, eps=eps)
    trail = []
    for steps in (0, 1, 5, 20):
        code = inf.infer("smooth_gradient", F.col("x"), PHI, LAM, n_steps=steps, eta=eta, penalty_weight=weight, eps=eps)
        trail.append(values(table, inf.objective(F.col("x"), code, PHI, LAM, weight, eps)))
    for before, after in zip(trail, trail[1:]):
        assert (after <= before + 1e-10).all()


def test_inference_guards():
    good = {"n_steps": 1, "eta": 0.1, "penalty_weight": 0.1}
    for bad in ({"n_steps": -1}, {"eta": 0.0}, {"eta": float("nan")}, {"penalty_weight": -0.1}):
        with pytest.raises(ValueError):
            inf.infer("smooth_gradient", F.col("x"), PHI, LAM, **(good | bad))
    with pytest.raises(ValueError, match="variant"):
        inf.infer("newton", F.col("x"), PHI, LAM, **good)
    for safety in (0.0, 1.5, float("nan")):
        with pytest.raises(ValueError):
            inf.step_size(PHI, safety=safety)
    with pytest.raises(ValueError):
        inf.step_size(np.zeros((3, 3)))


def test_dictionary_steps_reduce_the_residual(table):
    phi = PHI
    residual = lambda p: ((X - slow_code(p) @ p.T) ** 2).sum()

    def slow_code(p):
        s = np.zeros((ROWS, M))
        for _ in range(15):
            s = s - 0.2 * (s @ p.T - X) @ p
        return s

    start = residual(phi)
    for _ in range(3):
        phi = inf.dictionary_step(table, "x", phi, LAM, rate=0.2, n_steps=15, eta=0.2, penalty_weight=0.0)
    np.testing.assert_allclose(np.linalg.norm(phi, axis=0), 1.0)
    assert residual(phi) < start


def edge_frame(spark, w):
    return spark.createDataFrame(
        [(i, j, float(w[i, j])) for i in range(len(w)) for j in range(len(w)) if w[i, j]], "src int, dst int, w double"
    )


def dense(df, n):
    out = np.zeros((n, n))
    for r in df.collect():
        out[r["src"], r["dst"]] = r["w"]
    return out


def test_edge_tables(spark):
    gen = np.random.default_rng(3)
    w = gen.standard_normal((5, 5)) * (gen.uniform(size=(5, 5)) < 0.6)
    v = gen.standard_normal((5, 5))
    s, a = matrices.symmetric_part(edge_frame(spark, w)), matrices.antisymmetric_part(edge_frame(spark, w))
    np.testing.assert_allclose(dense(s, 5) + dense(a, 5), w, atol=1e-15)
    np.testing.assert_array_equal(dense(s, 5), dense(s, 5).T)
    np.testing.assert_array_equal(dense(a, 5), -dense(a, 5).T)
    both = matrices.split_parts(edge_frame(spark, w))
    np.testing.assert_array_equal(dense(both.select("src", "dst", both["s"].alias("w")), 5), dense(s, 5))
    np.testing.assert_array_equal(dense(both.select("src", "dst", both["a"].alias("w")), 5), dense(a, 5))
    total = matrices.effective_weight(edge_frame(spark, w), [edge_frame(spark, v), a], [0.5, -2.0], alpha=3.0)
    np.testing.assert_allclose(dense(total, 5), w + 3 * (0.5 * v - 2 * dense(a, 5)), atol=1e-12)
    with pytest.raises(ValueError):
        matrices.effective_weight(s, a, [1.0, 2.0], alpha=1.0)
    f = gen.standard_normal(5)
    vector = spark.createDataFrame([(k, float(x)) for k, x in enumerate(f)], "dst int, f double")
    out = {r["src"]: r["v"] for r in matrices.matrix_vector(edge_frame(spark, v), vector).collect()}
    np.testing.assert_allclose([out[k] for k in range(5)], v @ f, atol=1e-12)
    many = spark.createDataFrame([(r, k, float(f[k] * (r + 1))) for r in range(40) for k in range(5)], "row_id int, dst int, f double")
    for r in matrices.rows_times_matrix(many, edge_frame(spark, v)).collect():
        assert r["v"] == pytest.approx((v @ f)[r["src"]] * (r["row_id"] + 1))
    stacked = edge_frame(spark, v).selectExpr("1 AS d", "*")
    with pytest.raises(ValueError, match="directions"):
        matrices.effective_weight_by_direction(s, stacked, {1: 1.0, 2: 1.0}, alpha=1.0)
