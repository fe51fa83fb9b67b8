"""A dictionary learned over many steps, as a job that can be stopped and resumed.

Every step is one pass over a mini-batch of rows chosen by their key, and leaves one row in a table of versions: the
dictionary, its objective and a digest of everything the fit depends on. Spark's commit makes a version appear
whole or not at all, so a run that starts over continues from the last one and gives what an uninterrupted run gives.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.keyed import keyed_uniform
from tessella.guards import above, at_least
from tessella.operators import inference
from tessella.session import bounded_rows, check_model_size
from tessella.sources.sinks import read_if_present

VERSION_SCHEMA = (
    "version int, config string, objective double, n_rows bigint, phi array<array<double>>"
)


@dataclass(frozen=True)
class DictionaryFit:
    version: int
    phi: np.ndarray
    objective: float | None
    stopped: bool


def versions(spark: SparkSession, root: str) -> DataFrame:
    """Every stored version; an empty table where there is none."""
    stored = read_if_present(spark, root, "parquet", VERSION_SCHEMA)
    return spark.createDataFrame([], VERSION_SCHEMA) if stored is None else stored


def config_digest(start: np.ndarray, lam: np.ndarray, options: dict) -> str:
    parts = hashlib.sha256(json.dumps(options, sort_keys=True).encode())
    for array in (start, lam):
        parts.update(f"{array.shape}".encode() + np.ascontiguousarray(array, dtype="<f8").tobytes())
    return parts.hexdigest()


def _store(spark: SparkSession, root: str, row: tuple) -> None:
    # One row, one file: the commit of the job publishes it.
    spark.createDataFrame([row], VERSION_SCHEMA).coalesce(1).write.mode("append").parquet(root)


def _known(spark: SparkSession, root: str, config: str) -> dict[int, float | None]:
    """Objectives of the stored versions; dictionaries stay in storage."""
    rows = bounded_rows(versions(spark, root).select("version", "config", "objective").distinct(), 1 << 20, "versions")
    if other := {r["config"] for r in rows} - {config}:
        raise ValueError(f"{root} holds versions of another fit ({sorted(other)[0][:12]}...)")
    known = {r["version"]: r["objective"] for r in rows}
    if len(known) < len(rows):
        raise ValueError(f"{root} holds different versions under one number: two fits wrote to it at the same time")
    if sorted(known) != list(range(len(known))):
        raise ValueError(f"{root} lacks versions below {max(known)}")
    return known


def _settled(objectives: dict[int, float | None], batches: int, tolerance: float) -> bool:
    """Whether each batch of the last round lowered its objective by less than the tolerance, as a share."""
    last = max(objectives)
    if tolerance <= 0 or last < 2 * batches:
        return False
    pairs = [(objectives[k - batches], objectives[k]) for k in range(last - batches + 1, last + 1)]
    return all(before - now <= tolerance * before for before, now in pairs)


def fit_dictionary(
    df: DataFrame,
    key: str,
    x: str,
    start: np.ndarray,
    lam: np.ndarray,
    *,
    root: str,
    steps: int,
    rate: float,
    batches: int = 1,
    tolerance: float = 0.0,
    variant: str = inference.VARIANTS[0],
    **options: float,
) -> DictionaryFit:
    """Run or resume a fit until version ``steps``, or until a round of batches hardly lowers its objective.

    Version 0 is ``start``. Step k learns from the rows whose key falls into batch ``k % batches``, whatever their
    partition; a batch without rows is an error. The last complete version is read back from ``root``; versions of other
    parameters there, gaps and doubly written numbers are errors.
    """
    spark = df.sparkSession
    check_model_size(start, lam)
    above("rate", rate)
    at_least("batches", batches, 1)
    config = config_digest(start, lam, {"key": key, "x": x, "rate": rate, "batches": batches, "variant": variant, **options})
    known = _known(spark, root, config)
    if not known:
        _store(spark, root, (0, config, None, 0, start.tolist()))
        known = {0: None}
    last = max(known)
    held = versions(spark, root).filter(F.col("version") == last).select("phi").first()["phi"]
    phi = np.array(held, dtype=float)
    batch = F.floor(keyed_uniform("batch", F.col(key)) * batches)
    while last < steps and not _settled(known, batches, tolerance):
        rows = df.filter(batch == last % batches)
        moved = inference.dictionary_move(rows, x, phi, lam, rate=rate, variant=variant, **options)
        last, phi = last + 1, moved.phi
        _store(spark, root, (last, config, moved.objective, moved.n_rows, phi.tolist()))
        known[last] = moved.objective
    return DictionaryFit(last, phi, known[last], _settled(known, batches, tolerance))
