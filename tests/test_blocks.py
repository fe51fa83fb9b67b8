import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import blocks, moments
from tessella.operators import whitening as wh


def frame(spark, x, partitions=5):
    rows = [(k, row.tolist()) for k, row in enumerate(x)]
    return spark.createDataFrame(rows, "id bigint, f array<double>").repartition(partitions)


def correlated(n, f, seed=0):
    gen = np.random.default_rng(seed)
    return gen.standard_normal((n, f)) @ gen.standard_normal((f, f)) + gen.standard_normal(f)


def dense(matrix):
    out = np.zeros((matrix.n_rows, matrix.n_cols))
    for r in matrix.entries().collect():
        out[r["i"], r["j"]] += r["v"]
    return out


def matrix(spark, x, size):
    rows = [(i, j, float(v)) for (i, j), v in np.ndenumerate(x)]
    return blocks.from_entries(spark.createDataFrame(rows, "i int, j int, v double"), *x.shape, size=size)


def test_products_of_ragged_blocks(spark):
    gen = np.random.default_rng(1)
    a, b = gen.standard_normal((7, 10)), gen.standard_normal((10, 5))
    product = blocks.multiply(matrix(spark, a, 4), matrix(spark, b, 4))
    np.testing.assert_allclose(dense(product), a @ b, rtol=1e-12)
    assert product.squared_norm() == pytest.approx(((a @ b) ** 2).sum())
    assert max(len(r["block"]) for r in product.blocks.collect()) <= 8 * 16
    with pytest.raises(ValueError, match="fit"):
        blocks.multiply(matrix(spark, a, 4), matrix(spark, a, 4))
    with pytest.raises(Exception, match="outside"):
        blocks.from_entries(spark.createDataFrame([(9, 0, 1.0)], "i int, j int, v double"), 3, 3).blocks.collect()


def test_moments_equal_those_of_one_matrix(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BATCH_BYTES", 8 * 10 * 7)  # seven rows a chunk
    x = correlated(211, 10) + 1e6
    made = blocks.block_moments(frame(spark, x), "f", width=10, size=4, fan_in=2)
    assert made.n == 211
    np.testing.assert_allclose(made.mean, x.mean(axis=0), rtol=1e-13)
    np.testing.assert_allclose(dense(made.covariance(0.5)), np.cov(x.T) + 0.5 * np.eye(10), rtol=1e-7, atol=1e-7)
    cross = blocks.cross_product(frame(spark, x), "f", "f", (10, 10), size=3, fan_in=2)
    np.testing.assert_allclose(dense(cross), x.T @ x, rtol=1e-12)


def test_merge_tree_is_bounded_and_repeatable(spark):
    x = correlated(300, 4)
    table = frame(spark, x, 40)
    folded = []
    for fan_in in (2, 3, 64):
        seen = spark.sparkContext.accumulator(0)

        def partial(batches):
            import pyarrow as pa
            from pyspark import TaskContext

            task = TaskContext.get().partitionId()
            rows = np.concatenate([np.stack(b.column(0).to_numpy(zero_copy_only=False)) for b in batches] or [np.zeros((0, 4))])
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array([task]), pa.array([0], pa.int32()), pa.array([rows.sum(axis=0).tolist()])], names=["part", "i", "row"])

        def add(key, a, b, seen=seen):
            seen.add(1)
            return (a[0] + b[0],)

        sums = table.select("f").mapInArrow(partial, "part bigint, i int, row array<double>")
        merged = moments.tree_merge(sums, ["i"], add, leaves=40, fan_in=fan_in)
        first = merged.collect()
        folded.append(seen.value)
        second = merged.collect()
        assert len(first) == 1 and first == second
        np.testing.assert_allclose(first[0]["row"], x.sum(axis=0), rtol=1e-12)
    # Forty partials are folded once each, whatever the depth of the tree.
    assert folded == [39, 39, 39]
    plan = merged._jdf.queryExecution().toString()
    assert "Coalesce" not in plan


def test_block_whitening_equals_the_one_matrix_form(spark):
    x = correlated(400, 10)
    df = frame(spark, x, 2)
    one = wh.fit_whitening(df, "f", width=10, eps=1e-1)
    many = blocks.fit_block_whitening(df, "f", width=10, eps=1e-1, size=4)
    np.testing.assert_allclose(dense(many.whiten), one.whiten, atol=1e-8)
    np.testing.assert_allclose(dense(many.unwhiten), one.unwhiten, atol=1e-8)
    twice = df.union(df.limit(3))
    white = blocks.apply_block_whitening(twice, "id", "f", many)
    got = white.orderBy("id").collect()
    assert len(got) == 403
    want = (x - one.mean) @ one.whiten.T
    np.testing.assert_allclose([r["whitened"] for r in got], [want[r["id"]] for r in got], atol=1e-7)
    back = blocks.invert_block_whitening(white, "id", "whitened", many).collect()
    np.testing.assert_allclose([r["restored"] for r in back], [x[r["id"]] for r in back], atol=1e-6)


def test_block_whitening_guards(spark):
    x = correlated(6, 4)
    with pytest.raises(ValueError, match="eps"):
        blocks.fit_block_whitening(frame(spark, x), "f", width=4, eps=0.0)
    with pytest.raises(ValueError, match="training rows"):
        blocks.fit_block_whitening(frame(spark, x[:1]), "f", width=4)
    with pytest.raises(Exception, match="feature dim"):
        blocks.fit_block_whitening(frame(spark, x), "f", width=5)
    with pytest.raises(ValueError, match="positive definite"):
        blocks.roots(matrix(spark, -np.eye(3), 2), most_steps=5)


def test_dictionary_gradient_in_blocks(spark):
    gen = np.random.default_rng(3)
    x, s, phi = gen.standard_normal((50, 6)), gen.standard_normal((50, 9)), gen.standard_normal((6, 9))
    df = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, s)], "x array<double>, s array<double>")
    got = blocks.dictionary_gradient(df.repartition(3), "x", "s", matrix(spark, phi, 4))
    np.testing.assert_allclose(dense(got), (x - s @ phi.T).T @ s, atol=1e-9)
    named = df.withColumn("id", F.monotonically_increasing_id())
    rows = blocks.reconstruct_rows(named, "id", "s", matrix(spark, phi.T, 4)).collect()
    got = sorted(tuple(np.round(r["restored"], 9)) for r in rows)
    assert got == sorted(tuple(r) for r in np.round(s @ phi.T, 9).tolist())
