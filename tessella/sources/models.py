"""Fitted models on storage: one validated JSON record each, never overwritten by default."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tessella.errors import RecordSchemaError
from tessella.operators.records import first_problems, validate_whitening_records
from tessella.operators.whitening import WhiteningStats
from tessella.session import bounded_rows
from tessella.sources.sinks import write_new

MODEL_SCHEMA_VERSION = "1"


def write_json_record(
    spark: SparkSession, record: Mapping[str, object], path: str, *, overwrite: bool = False
) -> None:
    text = json.dumps(record, sort_keys=True)
    frame = spark.createDataFrame([(text,)], "value string").coalesce(1)
    write_new(frame, path, "text", overwrite=overwrite)


def read_json_record(spark: SparkSession, path: str) -> dict[str, object]:
    rows = bounded_rows(spark.read.text(path), 1, "JSON record")
    if not rows:
        raise RecordSchemaError(f"no record in {path}")
    return json.loads(rows[0][0])


def require_valid(
    spark: SparkSession, payload: Mapping[str, object], report: Callable[[DataFrame], DataFrame]
) -> Mapping[str, object]:
    """The payload, if a validator of ``(id, json)`` tables finds nothing in it."""
    frame = spark.createDataFrame([("model", json.dumps(payload))], "id string, json string")
    for problem in bounded_rows(first_problems(report(frame)), 1, "problems"):
        raise RecordSchemaError(f"{problem['rule']}: {problem['label'] or 'record'}")
    return payload


def whitening_to_dict(stats: WhiteningStats) -> dict[str, object]:
    return {
        "schema_version": MODEL_SCHEMA_VERSION,
        "kind": "zca_whitening",
        "eps": stats.eps,
        "n_samples": stats.n_samples,
        "n_features": stats.n_features,
        "input_manifest_sha256": stats.input_manifest_sha256,
        "mean": stats.mean.tolist(),
        "whiten": stats.whiten.tolist(),
        "unwhiten": stats.unwhiten.tolist(),
    }


def whitening_from_dict(spark: SparkSession, payload: Mapping[str, object]) -> WhiteningStats:
    """Validate one artifact with the same rules as a table of artifacts, then load it."""
    require_valid(spark, payload, lambda df: validate_whitening_records(df, "id", "json"))
    return WhiteningStats(
        mean=np.array(payload["mean"], dtype=float),
        whiten=np.array(payload["whiten"], dtype=float),
        unwhiten=np.array(payload["unwhiten"], dtype=float),
        eps=float(payload["eps"]),
        n_samples=int(payload["n_samples"]),
        input_manifest_sha256=payload.get("input_manifest_sha256"),
    )


def save_whitening(
    spark: SparkSession, stats: WhiteningStats, path: str, *, overwrite: bool = False
) -> None:
    write_json_record(spark, whitening_to_dict(stats), path, overwrite=overwrite)


def load_whitening(spark: SparkSession, path: str) -> WhiteningStats:
    return whitening_from_dict(spark, read_json_record(spark, path))
