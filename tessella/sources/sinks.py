"""Writers that refuse to replace existing output."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.errors import OutputExistsError


def write_new(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    *,
    overwrite: bool = False,
    partition_by: Sequence[str] = (),
    **options: object,
) -> None:
    """Write through Spark's commit protocol; an existing target is an error by default."""
    writer = df.write.format(fmt).mode("overwrite" if overwrite else "errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    try:
        writer.options(**options).save(path)
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_ALREADY_EXISTS":
            raise OutputExistsError(f"{path} is already there; pass overwrite to replace it") from exc
        raise


def read_if_present(
    spark: SparkSession, path: str, fmt: str, schema: str, **options: object
) -> DataFrame | None:
    try:
        return spark.read.schema(schema).options(**options).format(fmt).load(path)
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def differing_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows whose multiplicity differs, with ``surplus`` = left minus right.

    One aggregation over both sides; copies combine before the shuffle.
    """
    columns = left.columns
    signed = left.withColumn("_sign", F.lit(1)).unionByName(right.withColumn("_sign", F.lit(-1)))
    return signed.groupBy(*columns).agg(F.sum("_sign").alias("surplus")).filter("surplus <> 0")


def write_or_verify(df: DataFrame, path: str, fmt: str = "parquet", **options: object) -> bool:
    """Write if absent (True); if present, require the same rows (False) and never replace."""
    existing = read_if_present(df.sparkSession, path, fmt, _ddl(df), **options)
    if existing is None:
        write_new(df, path, fmt, **options)
        return True
    if not differing_rows(df, existing).isEmpty():
        raise OutputExistsError(f"existing output {path} differs from the generated rows")
    return False


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
