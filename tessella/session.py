"""Session settings, table loading and bounded driver transfers."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Sequence
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tessella.errors import SizeBoundError

# Largest model (dictionary, whitening matrix, ...) shipped to every task, in matrix cells.
MAX_MODEL_CELLS = 1 << 22

# File bytes of a part of a small scan that is spread over the cores.
SPREAD_BYTES = 4 << 20

SESSION_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(app: str, master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    return ship_package(builder.getOrCreate())


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Make this package importable by Python workers, once per application.

    The archive is read on the driver only; Spark hands it to the executors.
    """
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="spark-")) / package.name
        context.addPyFile(
            shutil.make_archive(str(target), "zip", root_dir=package.parent, base_dir=package.name)
        )
        _shipped.add(context.applicationId)
    return spark


def read_table(
    spark: SparkSession, directory: str, name: str, *columns: str, spread: bool = False
) -> DataFrame:
    """Read one table; ``spread`` is for costly row-wise work on tables of few, small files."""
    df = spark.read.parquet(f"{directory}/{name}.parquet")
    df = df.select(*columns) if columns else df
    return spread_small(df) if spread else df


def spread_small(scan: DataFrame) -> DataFrame:
    """Spread a file scan with fewer splits than cores; larger scans stay as they are.

    Files pack many rows into a few bytes, so parts are bounded in bytes, too, and a task does not grow with the table.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    parts = max(cores, size_in_bytes(scan) // SPREAD_BYTES)
    return scan.repartition(parts) if scan.rdd.getNumPartitions() < cores else scan


def size_in_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a table's size; nothing is run."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def size_setting(spark: SparkSession, key: str) -> int:
    """A setting in bytes, whatever unit it is written in."""
    text = spark.conf.get(key).lower().strip().removesuffix("b")
    factor = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}.get(text[-1:], 1)
    return max(1, int(text.rstrip("kmgt")) * factor)


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder ``spark.checkpoint.dir`` names.

    Only a local master, whose tasks share the driver's disk, may go without that setting; a
    cluster without a shared folder is an error.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not configured:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(configured)
    return configured


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder."""
    context = df.sparkSession.sparkContext
    folder = checkpoint_folder(df.sparkSession)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def saved(df: DataFrame, what: str) -> DataFrame:
    """Cut lineage with a table in the shared checkpoint folder; unlike a checkpoint it is computed once."""
    path = f"{checkpoint_folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_rows(df: DataFrame, limit: int, what: str) -> list[Row]:
    """Collect a result that is small by construction; fail instead of truncating."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise SizeBoundError(f"{what}: more than {limit} rows, refusing to collect")
    return rows


def broadcast_if_small(df: DataFrame, max_rows: int = 4096) -> DataFrame:
    """A few rows per group to join back onto a large table.

    Plan-time estimates of an aggregate follow its input, so the large side would be shuffled on
    a handful of keys. The rows are counted instead: up to ``max_rows`` they are broadcast, and
    beyond that the table is joined as it is.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def bounded_matrix(
    df: DataFrame, row: str, col: str, value: str, *, max_cells: int = MAX_MODEL_CELLS
) -> np.ndarray:
    """Load a sparse-matrix table ``(row, col, value)`` as a dense array.

    At most the model size bound is read, and the extents are checked before the array is made.
    """
    entries = df.select(row, col, value).limit(max_cells + 1).toArrow()
    if entries.num_rows > max_cells:
        raise SizeBoundError(f"matrix table exceeds the model bound of {max_cells} cells")
    if entries.num_rows == 0:
        raise ValueError("empty matrix table")
    at_row, at_col, values = (c.to_numpy() for c in entries.columns)
    n_rows, n_cols = int(at_row.max()) + 1, int(at_col.max()) + 1
    if n_rows * n_cols > max_cells:
        raise SizeBoundError(f"{n_rows}x{n_cols} matrix exceeds the model bound of {max_cells} cells")
    dense = np.zeros((n_rows, n_cols))
    dense[at_row, at_col] = values
    return dense


def check_model_size(*arrays: np.ndarray) -> None:
    cells = sum(int(a.size) for a in arrays)
    if cells > MAX_MODEL_CELLS:
        raise SizeBoundError(f"model of {cells} cells exceeds the bound of {MAX_MODEL_CELLS}")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def r6(value: Column, digits: int = 6) -> Column:
    """Round for comparison across engines; adding 0.0 turns a negative zero into zero."""
    return F.round(value, digits) + F.lit(0.0)
