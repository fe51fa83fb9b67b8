import json

import numpy as np
import pytest

from tessella.errors import OutputExistsError, RecordSchemaError
from tessella.operators.records import (
    ENVIRONMENT_SCHEMA,
    NOT_FINGERPRINTED,
    canonical_fingerprint,
    first_problems,
    validate_environment_records,
)
from tessella.operators.whitening import WhiteningStats
from tessella.sources import models

DIGEST = "sha256:" + "a" * 64
BASE = {name: "x" for name in ENVIRONMENT_SCHEMA} | {
    "schema_version": "1",
    "package_versions": {"numpy": "2"},
    "torch": {"torch_version": "2.1", "cuda_available": False, "cudnn_version": None},
    "runtime": {"cpu_count": 4, "total_ram_gib": 31.5, "torch_build_config_sha256": DIGEST},
    "determinism_flags": {"cudnn_benchmark": True},
    "uv_lock_sha256": None,
    "determinism_mode": "debug",
    "install_mode": "local",
    "reference_compatibility_status": "unknown",
    "public_reference_environment_digest": None,
}


def record(**changes):
    merged = BASE | changes
    kept = {k: v for k, v in merged.items() if k not in NOT_FINGERPRINTED}
    return merged | {"execution_environment_fingerprint": canonical_fingerprint(kept)}


def without(name):
    base = record()
    del base[name]
    return base


CASES = [
    (record(), None),
    (record(reference_compatibility_status="public-reference-run", uv_lock_sha256=DIGEST), None),
    (record(hostname="h"), ("unknown_field", "")),
    (without("machine"), ("missing_field", "machine")),
    (record(machine=3), ("wrong_type", "machine")),
    (record(machine=None), ("wrong_type", "machine")),
    (record(runtime={"cpu_count": True}), ("wrong_type", "runtime.cpu_count")),
    (record(runtime={"cpu_count": 4.0}), ("wrong_type", "runtime.cpu_count")),
    (record(runtime={"cpu_count": 10**30}), None),
    (record(runtime={"total_ram_gib": 4}), None),
    (record(runtime={"total_ram_gib": False}), ("wrong_type", "runtime.total_ram_gib")),
    (record(runtime={"hostname": "h"}), ("unknown_field", "runtime")),
    (record(torch={"torch_version": ["2"]}), ("wrong_type", "torch.torch_version")),
    (record(torch={"driver_version": "/home/bob/x"}), ("leak_shaped", "torch.driver_version")),
    (record(runtime={"torch_build_config_sha256": "sha256:12"}), ("bad_digest", "runtime.torch_build_config_sha256")),
    (record(package_versions={"a": 1}), ("not_str_to_str", "package_versions")),
    (record(install_mode="cloud"), ("unknown_value", "install_mode")),
    (record(uv_lock_sha256="sha256:AA"), ("bad_digest", "uv_lock_sha256")),
    (record(reference_compatibility_status="equivalence-verified"), ("incomplete", "uv_lock_sha256")),
    (record(reference_compatibility_status="equivalence-verified", uv_lock_sha256=DIGEST, torch={}), ("incomplete", "torch")),
    (record() | {"os_system": "changed"}, ("fingerprint_mismatch", "execution_environment_fingerprint")),
    ([1], ("not_an_object", "")),
]


def test_environment_records(spark):
    rows = [(k, json.dumps(r)) for k, (r, _) in enumerate(CASES)] + [(99, '{"a": ')]
    frame = spark.createDataFrame(rows, "id int, json string")
    first = first_problems(validate_environment_records(frame, "id", "json"))
    got = {int(r["key"]): (r["rule"], r["label"]) for r in first.collect()}
    wanted = {k: p for k, (_, p) in enumerate(CASES) if p} | {99: ("not_an_object", "")}
    assert got == wanted


def stats():
    whiten = np.array([[2.0, 0.5], [0.5, 1.0]])
    return WhiteningStats(np.array([0.1, 0.2]), whiten, np.linalg.inv(whiten), 1e-5, 50, DIGEST)


def test_whitening_round_trip(spark, tmp_path):
    path = str(tmp_path / "model")
    models.save_whitening(spark, stats(), path)
    loaded = models.load_whitening(spark, path)
    np.testing.assert_array_equal(loaded.whiten, stats().whiten)
    assert (loaded.eps, loaded.n_samples, loaded.input_manifest_sha256) == (1e-5, 50, DIGEST)
    with pytest.raises(OutputExistsError):
        models.save_whitening(spark, stats(), path)


@pytest.mark.parametrize(
    ("change", "problem"),
    [
        ({"note": 1}, "unknown_field"),
        ({"schema_version": "2"}, "unknown_value"),
        ({"kind": "pca"}, "unknown_value"),
        ({"input_manifest_sha256": "sha256:1"}, "bad_digest"),
        ({"eps": -1.0}, "out_of_range"),
        ({"eps": True}, "wrong_type"),
        ({"n_samples": 1}, "out_of_range"),
        ({"n_features": 3}, "bad_shape"),
        ({"mean": [0.0]}, "bad_shape"),
        ({"whiten": [[1.0, 0.5], [0.0, 1.0]]}, "not_symmetric"),
        ({"unwhiten": [[1.0, 0.0], [0.0, 1.0]]}, "not_inverse"),
        ({"mean": [0.0, 1e999]}, "not_an_object"),
    ],
)
def test_whitening_tampering(spark, change, problem):
    payload = models.whitening_to_dict(stats()) | change
    with pytest.raises(RecordSchemaError, match=problem):
        models.whitening_from_dict(spark, payload)


def test_optional_digest(spark):
    payload = models.whitening_to_dict(stats()) | {"input_manifest_sha256": None}
    assert models.whitening_from_dict(spark, payload).input_manifest_sha256 is None


def test_records_are_read_by_compiled_code(spark):
    """No rule is evaluated inside a generator, and each object is taken apart once."""
    frame = spark.createDataFrame([(0, json.dumps(record()))], "id int, json string")
    plan = validate_environment_records(frame, "id", "json")._jdf.queryExecution().executedPlan().toString()
    generators = [line for line in plan.splitlines() if "Generate inline" in line]
    assert len(generators) == 1 and "CASE WHEN" not in generators[0]
    assert "schemaOfVariant(try_variant_get" not in plan


def test_object_after_a_line_break(spark):
    frame = spark.createDataFrame([(0, "\n" + json.dumps(record()))], "id int, json string")
    assert validate_environment_records(frame, "id", "json").isEmpty()
