import numpy as np
import pytest

from tessella.operators import audit, similarity
from tessella.operators.similarity import nearest_cosine


def frame(spark, x, start=0):
    return spark.createDataFrame([(start + k, r.tolist()) for k, r in enumerate(x)], "id bigint, f array<double>")


def test_histogram_matches_numpy_on_edges(spark):
    edges = np.linspace(0.0, 1.0, 17)
    gen = np.random.default_rng(0)
    values = np.concatenate([edges, np.nextafter(edges, -1), np.nextafter(edges, 2), gen.uniform(-0.2, 1.2, 99), [np.nan]])
    values = values[: len(values) // 3 * 3]
    rows = audit.channel_histograms(frame(spark, values.reshape(-1, 3)), "f", 3).collect()
    assert len(rows) == 48
    got = np.zeros((3, 16))
    for r in rows:
        got[r["c"], r["bin"]] = r["n"]
    for c in range(3):
        np.testing.assert_array_equal(got[c], np.histogram(values.reshape(-1, 3)[:, c], bins=edges)[0])


@pytest.mark.parametrize("bins", [5, 7, 16, 30])
def test_histogram_other_ranges(spark, bins):
    low, high = -0.3, 0.7
    edges = np.linspace(low, high, bins + 1)
    values = np.concatenate([edges, np.random.default_rng(bins).uniform(low, high, 100)])
    rows = audit.channel_histograms(frame(spark, values[:, None]), "f", 1, bins=bins, low=low, high=high).orderBy("bin")
    # An edge value itself may differ by one ulp between edge formulas, so interior edges are left out.
    inner = audit.channel_histograms(frame(spark, values[bins + 1 :, None]), "f", 1, bins=bins, low=low, high=high)
    want = np.histogram(values[bins + 1 :], bins=edges)[0]
    assert [r["n"] for r in inner.orderBy("bin").collect()] == want.tolist()
    assert sum(r["n"] for r in rows.collect()) == len(values)


def test_power_and_moments(spark):
    x = np.random.default_rng(2).standard_normal((41, 6))
    got = {r["key"]: r["value"] for r in audit.patch_power(frame(spark, x), "f").collect()}
    p = (x**2).mean(axis=1)
    want = {"mean": p.mean(), "median": np.median(p), "p05": np.percentile(p, 5), "p95": np.percentile(p, 95)}
    assert got == pytest.approx(want, rel=1e-12)
    moments = {r["key"]: r["value"] for r in audit.value_moments(frame(spark, x), "f").collect()}
    assert moments == pytest.approx({"mean": x.mean(), "std": x.std(), "min": x.min(), "max": x.max()}, rel=1e-12)


@pytest.mark.parametrize("shape", ["spread", "hot", "two_peaks", "constant"])
def test_percentile_search_is_exact(spark, shape):
    gen = np.random.default_rng(3)
    values = {
        "spread": gen.standard_normal(20_000),
        "hot": np.where(np.arange(20_000) % 3 == 0, 0.25, gen.standard_normal(20_000)),
        "two_peaks": np.concatenate([np.zeros(9_900), gen.uniform(0, 1, 200), np.ones(9_900)]),
        "constant": np.full(5_000, 2.5),
    }[shape]
    table = spark.createDataFrame([(float(v),) for v in values], "v double")
    quantiles = [0.0, 0.05, 0.495, 0.5, 0.504, 0.95, 1.0]
    got = audit.exact_percentiles(table, "v", quantiles, in_memory=64)
    np.testing.assert_allclose(got, np.quantile(values, quantiles), rtol=1e-12, atol=1e-12)


def best_cosine(train, test):
    unit = lambda a: a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-12)
    return (unit(test) @ unit(train).T).max(axis=1)


def collected(df):
    return [r["cosine"] for r in df.orderBy("id").collect()]


@pytest.mark.parametrize("broadcast_rows", [1 << 16, 0])
def test_nearest_cosine_is_exact(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 16)  # hot cells fall into many blocks
    gen = np.random.default_rng(4)
    centers = gen.standard_normal((6, 8))
    train = centers[gen.integers(0, 6, 220)] + 0.1 * gen.standard_normal((220, 8))
    train[:80] = train[0]  # copies: more than a third of one side
    train[80], train[81] = 0.0, 1e-14
    test = np.concatenate([train[100:110], gen.standard_normal((60, 8)), np.zeros((1, 8)), np.full((1, 8), 1e-13)])
    got = collected(
        nearest_cosine(frame(spark, train), frame(spark, test, 1000), "f", "id", max_pairs=None, broadcast_rows=broadcast_rows)
    )
    np.testing.assert_allclose(got, best_cosine(train, test), atol=1e-9)
    assert max(got) > 0.999


def test_first_rows_only(spark):
    x = np.random.default_rng(5).standard_normal((90, 5))
    train, test = frame(spark, x[:60]).repartition(7, "id"), frame(spark, x[60:])
    got = collected(nearest_cosine(train, test, "f", "id", max_pairs=20))
    np.testing.assert_allclose(got, best_cosine(x[:20], x[60:80]), atol=1e-12)


def test_opposed_vectors_keep_negative_cosines(spark):
    train = np.array([[1.0, 0.0], [0.9, 0.1]])
    test = np.array([[-1.0, 0.0]])
    got = collected(nearest_cosine(frame(spark, train), frame(spark, test), "f", "id", max_pairs=None, broadcast_rows=0))
    np.testing.assert_allclose(got, best_cosine(train, test), atol=1e-12)


def test_percentile_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "v double")
    assert audit.exact_percentiles(empty, "v", [0.5]) == [None]


@pytest.mark.parametrize("broadcast_rows", [1 << 16, 0])
def test_nearest_cosine_keeps_rows_of_repeated_and_null_keys(spark, broadcast_rows):
    train = spark.createDataFrame([(7, [1.0, 0.0]), (7, [0.6, 0.8]), (None, [0.0, 1.0])], "id long, f array<double>")
    rows = [(7, [1.0, 1.0]), (7, [0.1, 1.0]), (None, [3.0, 0.2]), (9, [1.0, 1.0]), (9, [1.0, 1.0])]
    test = spark.createDataFrame(rows, "id long, f array<double>")
    got = nearest_cosine(train, test, "f", "id", broadcast_rows=broadcast_rows).collect()
    want = best_cosine(np.array([[1.0, 0.0], [0.6, 0.8], [0.0, 1.0]]), np.array([r[1] for r in rows]))
    assert sorted(((r.id or 0), round(r.cosine, 9)) for r in got) == sorted(
        ((r[0] or 0), round(c, 9)) for r, c in zip(rows, want)
    )


def test_first_rows_with_null_and_tied_keys(spark):
    frame_ = spark.createDataFrame([(None, 1), (3, 2), (1, 3), (1, 4), (2, 5)], "id int, v int")
    assert [r.id for r in similarity.first_rows(frame_, "id", 3).collect()] == [None, 1, 1]
    assert similarity.first_rows(frame_, "id", 9).count() == 5
    assert similarity.first_rows(frame_.limit(0), "id", 2).count() == 0


@pytest.mark.parametrize("in_memory", [1000, 1])
def test_percentiles_of_nan_are_nan(spark, in_memory):
    values = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),), (4.0,)], "v double")
    assert all(np.isnan(q) for q in audit.exact_percentiles(values, "v", [0.5, 0.1], in_memory=in_memory))


def test_value_moments_by_entry(spark):
    rows = [[1.0, 2.0, 4.0], [0.5], [], None, [-3.0, 8.0]]
    got = {r.key: r.value for r in audit.value_moments(spark.createDataFrame([(r,) for r in rows], "f array<double>"), "f").collect()}
    flat = np.array([v for r in rows for v in (r or [])])
    np.testing.assert_allclose([got["mean"], got["std"], got["min"], got["max"]], [flat.mean(), flat.std(), flat.min(), flat.max()])
