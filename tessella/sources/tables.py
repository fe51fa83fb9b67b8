"""Fixed-schema CSV tables: manifests, file maps, expected tuples, inventories."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.lineage import FILE_MAP_SCHEMA
from tessella.operators.manifest import MANIFEST_SCHEMA
from tessella.sources.delimited import read_records
from tessella.sources.sinks import write_new

EXPECTED_TUPLES_SCHEMA = "source_2026_file string, dissertation_file string, derivation string"
CSV_DIALECT = {"header": True, "quote": '"', "escape": '"'}


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(",")]


def _header(spark: SparkSession, path: str) -> list[str]:
    """Names in the first line with content of some file; the others are held to them when they are read."""
    first = spark.read.text(path).filter(F.length(F.trim("value")) > 0).first()
    return [] if first is None else next(csv.reader([first[0]]))


def read_csv_strict(spark: SparkSession, path: str, schema: str, position: str | None = None) -> DataFrame:
    """Read CSV whose headers must equal the schema; a bad value or a record of another length fails the read.

    Quoted fields may hold line breaks. Empty fields are empty strings. ``position`` names a column that orders rows as
    their files list them.
    """
    names = _names(schema)
    header = _header(spark, path)
    if header != names:
        raise ValueError(f"columns {header} != expected {names}")
    records = read_records(spark, path, names)
    kinds = [part.split()[1] for part in schema.split(",")]
    fields = [F.col("fields")[k].cast(kind).alias(name) for k, (name, kind) in enumerate(zip(names, kinds, strict=True))]
    place = [F.struct("file", "block", "row").alias(position)] if position else []
    return records.select(*fields, *place)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return read_csv_strict(spark, path, MANIFEST_SCHEMA)


def write_manifest(manifest: DataFrame, path: str, *, overwrite: bool = False) -> None:
    """Canonical CSV, ordered by role and split id across the part files."""
    columns = _names(MANIFEST_SCHEMA)
    ordered = (
        manifest.select(*columns)
        .repartitionByRange("role", "split_id")
        .sortWithinPartitions("role", "split_id")
    )
    write_new(
        ordered, path, "csv", overwrite=overwrite, emptyValue="", lineSep="\n", **CSV_DIALECT
    )


def read_file_map(spark: SparkSession, path: str) -> DataFrame:
    """File map with ``pos``, which orders rows by file and by their place in it."""
    return read_csv_strict(spark, path, FILE_MAP_SCHEMA, position="pos")


def read_expected_tuples(spark: SparkSession, path: str) -> DataFrame:
    return read_csv_strict(spark, path, EXPECTED_TUPLES_SCHEMA).select(
        F.col("source_2026_file").alias("source"),
        F.col("dissertation_file").alias("target"),
        "derivation",
    )


def declared_tuples(file_map: DataFrame) -> DataFrame:
    return file_map.select(
        F.col("source_2026_file").alias("source"),
        F.col("dissertation_file").alias("target"),
        "derivation",
    ).distinct()


def read_inventory(spark: SparkSession, path: str, column: str = "latex_label") -> DataFrame:
    """Label inventory with any further columns: ``(label)``."""
    names = _header(spark, path)
    if column not in names:
        raise ValueError(f"inventory has no {column!r} column: {names}")
    return read_records(spark, path, names).select(F.col("fields")[names.index(column)].alias("label"))
