"""Oracles must fail when an operator is wrong; large sides must not move to a few hot keys."""

import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.errors import PinConflictError
from tessella.operators import ledger, matrices, whitening
from tessella.plans.bindings import features
from tessella.plans.bindings.catalog import CATALOG
from tessella.sources import ledgers, registry

WHITENED = ("whiten_roundtrip", "whiten_pairs", "whiten_check", "representation_fit_apply", "audit_metrics")


def rows(frame):
    return sorted(tuple(map(str, r)) for r in frame)


def expected(data_dir, name, columns):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{data_dir}/embeddings.parquet'")
    return rows(con.execute(f"SELECT {', '.join(columns)} FROM ({CATALOG[name].sql})").fetchall())


def pca(moments, *, eps=whitening.DEFAULT_EPS, input_manifest_sha256=None):
    values, vectors = np.linalg.eigh(moments.scatter / (moments.n - 1))
    root = np.sqrt(np.clip(values, 0.0, None) + eps)
    return whitening.WhiteningStats(moments.mean, (vectors / root).T, vectors * root, eps, moments.n, None)


def identity(moments, *, eps=whitening.DEFAULT_EPS, input_manifest_sha256=None):
    eye = np.eye(len(moments.mean))
    return whitening.WhiteningStats(moments.mean, eye, eye, eps, moments.n, None)


@pytest.mark.parametrize("wrong", [pca, identity])
@pytest.mark.parametrize("name", WHITENED)
def test_wrong_whitening_turns_rows_red(spark, data_dir, monkeypatch, wrong, name):
    if name == "whiten_check" and wrong is pca:
        pytest.skip("its covariance is the identity under any rotation")
    from tessella.plans import representation

    for module in (whitening, features, representation):
        monkeypatch.setattr(module, "whitening_from_moments", wrong)
    got = CATALOG[name].run(spark, data_dir)
    assert rows(got.collect()) != expected(data_dir, name, got.columns)


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)


@pytest.fixture
def no_auto_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_requests_are_not_dealt_by_dataset(spark, no_auto_broadcast):
    asked = spark.range(1000).select(
        F.lit("div2k").alias("dataset"), F.lit("x").alias("token"), F.lit("y").alias("terms_sha256"), F.lit("z").alias("accepted_at_iso")
    )
    assert not exchanges(ledger.judge_terms(asked, registry.registry_table(spark)))


def test_rows_are_not_dealt_by_matrix_column(spark, no_auto_broadcast):
    vectors = spark.range(1000).select(F.col("id").alias("row_id"), (F.col("id") % 3).alias("dst"), F.lit(1.0).alias("f"))
    edges = spark.createDataFrame([(s, d, 1.0 + s + d) for s in range(3) for d in range(3)], "src long, dst long, w double")
    product = matrices.rows_times_matrix(vectors, edges)
    assert not [e for e in exchanges(product) if e.startswith("dst")]
    small = {(r.row_id, r.src): r.v for r in product.collect()}
    matrices.MATRIX_ROWS, kept = 1, matrices.MATRIX_ROWS
    try:
        salted = matrices.rows_times_matrix(vectors, edges, rows_per_salt=50)
        assert {(r.row_id, r.src): r.v for r in salted.collect()} == small
    finally:
        matrices.MATRIX_ROWS = kept


def test_a_conflict_is_named_whatever_was_refused(spark, tmp_path):
    root = str(tmp_path)
    pin = lambda pairs: spark.createDataFrame([(d, a, s * 64) for d, a, s in pairs], "dataset string, archive string, sha256 string")
    ledgers.record_pins(pin([("zz", "a.zip", "1")]), root, require_acceptance=False)
    terms = spark.createDataFrame([("zz", "u", "t", "s", "2020-01-01")], "dataset string, terms_url string, terms_acceptance_token string, terms_sha256 string, accepted_at_iso string")
    terms.write.mode("append").partitionBy("dataset").parquet(f"{root}/terms")
    mixed = pin([*[("aa", f"{k}.zip", "2") for k in range(40)], ("zz", "a.zip", "3")])
    with pytest.raises(PinConflictError, match="1 pins"):
        ledgers.record_pins(mixed, root)
    with pytest.raises(ValueError, match="40 archives"):
        ledgers.record_pins(mixed.where("dataset = 'aa'"), root)
