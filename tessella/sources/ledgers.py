"""Ledger tables on storage: accepted terms and digest pins, both append-only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.errors import PinConflictError
from tessella.operators.ledger import (
    PINS_SCHEMA,
    TERMS_SCHEMA,
    chain_problems,
    current_pins,
    pin_actions,
    rotation_entries,
    rotation_log,
)
from tessella.sources.sinks import read_if_present


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    stored = read_if_present(spark, path, "parquet", schema)
    return spark.createDataFrame([], schema) if stored is None else stored


def read_terms(spark: SparkSession, root: str) -> DataFrame:
    return _table(spark, f"{root}/terms", TERMS_SCHEMA)


def write_terms(accepted: DataFrame, root: str) -> None:
    names = [part.split()[0] for part in TERMS_SCHEMA.split(",")]
    accepted.select(*names).write.mode("append").partitionBy("dataset").parquet(f"{root}/terms")


def read_pin_ledger(spark: SparkSession, root: str) -> DataFrame:
    return _table(spark, f"{root}/pins", PINS_SCHEMA)


def read_pins(spark: SparkSession, root: str) -> DataFrame:
    return current_pins(read_pin_ledger(spark, root))


def read_rotation_log(spark: SparkSession, root: str) -> DataFrame:
    return rotation_log(read_pin_ledger(spark, root))


def verify_chains(spark: SparkSession, root: str) -> DataFrame:
    """Breaks of the recorded chains; appends that ran at the same time show as forks."""
    return chain_problems(read_pin_ledger(spark, root))


def _append(entries: DataFrame, root: str) -> None:
    entries.write.mode("append").partitionBy("dataset").parquet(f"{root}/pins")


def record_pins(incoming: DataFrame, root: str, *, require_acceptance: bool = True) -> DataFrame:
    """Pin new digests; any refused or conflicting request fails the whole batch unwritten."""
    spark = incoming.sparkSession
    terms = read_terms(spark, root) if require_acceptance else None
    actions = pin_actions(incoming, read_pins(spark, root), terms)
    for action, error, text in (
        ("conflict", PinConflictError, "pins that differ from the recorded ones"),
        ("refused", ValueError, "archives of datasets without accepted terms"),
    ):
        blocked = actions.filter(F.col("action") == action)
        if n := blocked.count():
            shown = ", ".join(f"{r['dataset']}/{r['archive']}" for r in blocked.limit(5).collect())
            raise error(f"{n} {text}, among them {shown}")
    fresh = actions.filter(F.col("action") == "insert").select(
        "dataset",
        "archive",
        "sha256",
        F.lit(None).cast("string").alias("prior"),
        F.lit(None).cast("string").alias("reason"),
        F.lit(0).cast("bigint").alias("seq"),
    )
    _append(fresh, root)
    return actions


def rotate_pins(changes: DataFrame, root: str) -> None:
    """Replace pins, keeping the previous digest and the reason on record."""
    spark = changes.sparkSession
    _append(rotation_entries(changes, read_pins(spark, root)), root)
