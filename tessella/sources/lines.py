"""Lines of files of any size, read split by split, with their numbers in the file.

Spark's text reader hands every line (up to a line feed, a carriage return or both) to exactly one split of its
file, whatever bytes the split's borders cut. A line is then placed by two passes: lines are counted by split,
sums over the splits before give each split its offset, and a line's number is that offset and its place in the
split. Only rows that need a number, and lines that hold further breaks, take part in a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.text import LINE_BREAK, RARE_BREAK
from tessella.sources.files import relative_path

SPLIT = ["file", "block"]


def read_lines(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """``(file, block, id, value)`` of every line under ``root``; ids ascend with the place inside a split.

    Ids of different splits do not compare, and are the same for every use of the table in one query only.
    """
    reader = spark.read.format("text").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(root).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"),
        "value",
    )


def line_count(value: Column) -> Column:
    """Lines a physical line stands for: further breaks (form feeds, Unicode separators, ...) open lines too."""
    return F.when(value.rlike(RARE_BREAK), F.size(F.split(value, LINE_BREAK))).otherwise(1)


def split_offsets(lines: DataFrame, wanted: Column | None = None) -> DataFrame:
    """Of every split: its first id, the lines before it in its file, and whether the whole file is UTF-8.

    One row a task and split is shuffled. The window over a file holds one row for each of its splits. Files that are
    not ``wanted``, a condition on ``file``, are not valid either; it is evaluated once a split. As a filter the
    optimizer would push it down to every line, past the grouping and, over the join of ``numbered``, into both sides.
    """
    counted = lines.groupBy(*SPLIT).agg(
        F.min("id").alias("base"),
        F.sum(line_count(F.col("value"))).alias("n"),
        F.bool_and(F.is_valid_utf8("value")).alias("valid"),
    )
    if wanted is not None:
        counted = counted.withColumn("valid", F.col("valid") & wanted)
    whole = Window.partitionBy("file")
    before = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return counted.select(
        *SPLIT,
        "base",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"),
        F.bool_and("valid").over(whole).alias("valid"),
    )


def numbered(
    found: DataFrame, lines: DataFrame, *, inner: str, lineno: str, wanted: Column | None = None
) -> DataFrame:
    """Replace the number inside the physical line (``inner``, from 1) by the number in the file.

    ``found`` has ``file``, ``block`` and ``id`` of ``lines``. Rows of files that are not UTF-8 are dropped, as
    their text has no characters to report, and so are those of files that are not ``wanted``. Lines with further
    breaks shift those after them in the split.
    """
    offsets = split_offsets(lines, wanted)
    more = lines.select(*SPLIT, "id", (line_count(F.col("value")) - 1).alias("more")).where("more > 0")
    shifts = more.select(*SPLIT, "id", "more", F.lit(None).cast(_kind(found)).alias("row"))
    wanted = found.select(*SPLIT, "id", F.lit(0).alias("more"), F.struct(*found.columns).alias("row"))
    # A split is a bounded group: at most its own lines.
    earlier = Window.partitionBy(*SPLIT).orderBy("id").rangeBetween(Window.unboundedPreceding, -1)
    shifted = wanted.union(shifts).withColumn("shift", F.coalesce(F.sum("more").over(earlier), F.lit(0)))
    placed = shifted.where("row is not null").join(offsets.where("valid"), SPLIT)
    number = F.col("before") + F.col("id") - F.col("base") + F.col("shift") + F.col(f"row.{inner}")
    others = [F.col(f"row.{c}").alias(c) for c in found.columns if c not in (*SPLIT, "id", inner)]
    return placed.select("file", number.cast("long").alias(lineno), *others)


def _kind(df: DataFrame) -> str:
    return df.schema.simpleString()


def file_paths(spark: SparkSession, root: str) -> DataFrame:
    """``(file)`` of every file under ``root``, empty ones too; no content is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.col("path").alias("file"))


def relative(spark: SparkSession, root: str) -> Column:
    return relative_path(spark, F.col("file"), root)
