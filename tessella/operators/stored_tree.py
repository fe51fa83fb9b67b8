"""File trees stored with their hash levels, so that two versions are compared by what differs only.

Files are grouped by a hash of their path. The rows of a group are one partition folder of the stored table, and
its digest is a leaf of a hash tree whose levels are stored beside it. Two stored trees are compared from the top:
groups below equal digests are not looked at, and file rows are read from differing groups only.
"""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.fingerprint import row_digest
from tessella.operators.lineage import verify_tree
from tessella.session import bounded_rows
from tessella.sources.sinks import write_new

# Hex digits of the path's hash that name a folder, and a bucket inside it: 256 folders, 1,048,576 buckets.
FOLDER, BUCKET = 2, 5
_NODES = "width int, prefix string, h string, n bigint"


def _below(column: str, width: int) -> Column:
    return F.substring(column, 1, width)


def _hashed(nodes: DataFrame) -> DataFrame:
    """Digest and count of every prefix from its children ``(prefix, child, n)``, in the order of the children."""
    joined = F.array_join(F.array_sort(F.collect_list("child")), ",")
    return nodes.groupBy("prefix").agg(F.sha2(joined, 256).alias("h"), F.sum("n").alias("n"))


@dataclass(frozen=True)
class StoredTree:
    """A tree ``(rel, sha256)`` in a folder: ``files`` by path group, ``nodes`` of the three levels."""

    files: DataFrame
    nodes: DataFrame

    def level(self, width: int) -> DataFrame:
        return self.nodes.filter(F.col("width") == width).select("prefix", "h", "n")


def store_tree(tree: DataFrame, path: str, *, overwrite: bool = False) -> None:
    """Write a tree with its levels; copies of a row are counted first, so none of them swells a group."""
    spark = tree.sparkSession
    counted = tree.groupBy("rel", "sha256").agg(F.count(F.lit(1)).alias("n"))
    keyed = counted.withColumn("at", F.sha2(F.coalesce("rel", F.lit("")), 256)).select(
        "rel", "sha256", "n", _below("at", BUCKET).alias("bucket"), _below("at", FOLDER).alias("folder")
    )
    placed = keyed.repartition("folder", "bucket").sortWithinPartitions("folder", "bucket")
    write_new(placed, f"{path}/files", partition_by=["folder"], overwrite=overwrite)
    files = read_tree(spark, path, nodes=False).files
    row = F.concat_ws(":", row_digest("rel", "sha256"), F.col("n").cast("string"))
    buckets = _hashed(files.select(F.col("bucket").alias("prefix"), row.alias("child"), "n"))
    write_new(_level(buckets, BUCKET), f"{path}/nodes/buckets", overwrite=overwrite)
    stored = spark.read.schema(_NODES).parquet(f"{path}/nodes/buckets")
    child = F.concat_ws(":", "prefix", "h").alias("child")
    folders = _hashed(stored.select(_below("prefix", FOLDER).alias("prefix"), child, "n"))
    write_new(_level(folders, FOLDER), f"{path}/nodes/folders", overwrite=overwrite)
    stored = spark.read.schema(_NODES).parquet(f"{path}/nodes/folders")
    top = _hashed(stored.select(F.lit("").alias("prefix"), child, "n"))
    write_new(_level(top, 0), f"{path}/nodes/top", overwrite=overwrite)


def _level(nodes: DataFrame, width: int) -> DataFrame:
    return nodes.select(F.lit(width).alias("width"), "prefix", "h", "n")


def read_tree(spark: SparkSession, path: str, *, nodes: bool = True) -> StoredTree:
    files = spark.read.schema("rel string, sha256 string, n bigint, bucket string, folder string").parquet(f"{path}/files")
    levels = [f"{path}/nodes/{name}" for name in ("top", "folders", "buckets")] if nodes else []
    return StoredTree(files, spark.read.schema(_NODES).parquet(*levels) if nodes else files)


def _differing(old: DataFrame, new: DataFrame) -> DataFrame:
    """Prefixes whose digests differ, or that one side lacks."""
    both = old.select("prefix", F.col("h").alias("old")).join(new.select("prefix", F.col("h").alias("new")), "prefix", "full_outer")
    return both.filter(~F.col("old").eqNullSafe(F.col("new"))).select("prefix")


def _opened(tree: StoredTree, folders: list[str], buckets: DataFrame) -> DataFrame:
    """File rows of the differing buckets, from the differing folders only."""
    rows = tree.files.filter(F.col("folder").isin(*folders))
    return rows.join(F.broadcast(buckets.withColumnRenamed("prefix", "bucket")), "bucket", "left_semi")


def changed_rows(old: StoredTree, new: StoredTree) -> tuple[DataFrame, DataFrame]:
    """The file rows of both trees in the buckets that differ: ``(rel, sha256, n)`` each.

    The driver sees the digest of the top and at most 256 folder names. Bucket names are at most a million short strings.
    """
    none = [t.files.filter("false").select("rel", "sha256", "n") for t in (old, new)]
    if _differing(old.level(0), new.level(0)).isEmpty():
        return none[0], none[1]
    folders = sorted(r["prefix"] for r in bounded_rows(_differing(old.level(FOLDER), new.level(FOLDER)), 16**FOLDER, "folders"))
    inside = [t.level(BUCKET).filter(_below("prefix", FOLDER).isin(*folders)) for t in (old, new)]
    buckets = _differing(*inside)
    left, right = (_opened(t, folders, buckets).select("rel", "sha256", "n") for t in (old, new))
    return left, right


def compare_trees(old: StoredTree, new: StoredTree, allowed_unlisted: Collection[str] = ("README.md",)) -> DataFrame:
    """The report of ``verify_tree`` on whole trees, from what differs: missing, changed and unlisted files."""
    listed, actual = changed_rows(old, new)
    return verify_tree(listed.select("rel", "sha256"), actual.select("rel", "sha256"), allowed_unlisted)
