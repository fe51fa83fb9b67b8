"""What the training-data operators share: reading, task-side batches, written tables, class ranks."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.session import checkpoint_folder

# Texts are handed to Python in small Arrow batches, so a task holds few of them at a time.
TEXT_ROWS_PER_BATCH = "1000"

_SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_UPPER = bytes(range(0x41, 0x5B))
# A-Z to lower case, every other character that is no word character to a space.
_WORD_TABLE = bytes(
    b + 32 if b in _UPPER else 32 if b in _SEPARATORS else b for b in range(256)
)


def alnum_words(text: str | None) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` as UTF-8; null has none."""
    return encode(text).translate(_WORD_TABLE).split() if text else []


def space_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words ``[^\\x20\\x09-\\x0D]+`` as UTF-8; null has none."""
    return encode(text).lower().split() if text else []


def encode(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", TEXT_ROWS_PER_BATCH)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that the table does not have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def row_hash(df: DataFrame) -> Column:
    """Hash of a whole row; columns that hold maps, which have no hash of their own, go in as JSON."""
    own = [F.to_json(F.struct(F.col(c))) if "map<" in kind else F.col(c) for c, kind in df.dtypes]
    return F.xxhash64(*own)


def map_rows(
    df: DataFrame,
    schema: str,
    rows: Callable[[dict[str, list]], Iterator[tuple] | list[tuple]],
) -> DataFrame:
    """``mapInArrow`` for functions from columns (as lists) to result tuples."""
    target = df.sparkSession.createDataFrame([], schema).schema
    names = target.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(target)
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = {n: c.to_pylist() for n, c in zip(batch.schema.names, batch.columns, strict=True)}
            made = list(rows(columns))
            parts = list(zip(*made, strict=True)) if made else [()] * len(names)
            yield pa.RecordBatch.from_arrays(
                [pa.array(p, f.type) for p, f in zip(parts, arrow, strict=True)], schema=arrow
            )

    return df.mapInArrow(run, schema)


def written(df: DataFrame, what: str) -> DataFrame:
    """Cut lineage with a table in the shared checkpoint folder; survives lost executors."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sent_if_small(df: DataFrame, most_rows: int = 50_000) -> DataFrame:
    """Hint a broadcast for a written table of few rows; a larger one is joined by its key."""
    return F.broadcast(df) if df.count() <= most_rows else df


def ranked(df: DataFrame, classes: list[str], order: list[Column], spread: Column, rank: str) -> DataFrame:
    """Add the gapless rank (from 0) of each row within its class.

    A class may hold a third of all rows, so no task ranks a whole one: classes are split by
    ``spread``, a small non-negative integer that is a function of the row, the parts are counted
    (with map-side combine), and rows are numbered inside their part, from the part's offset on.
    The order is by ``spread`` first, then ``order``.
    """
    from pyspark.sql import Window

    # The source is read twice: once for the counts, once for the rows.
    part, n, offset, nth = fresh(df, "part", "n", "offset", "nth")
    rows = df.withColumn(part, spread)
    keys = [*classes, part]
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
    before = Window.partitionBy(*classes).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(offset))
    inside = Window.partitionBy(*keys).orderBy(*order)
    numbered = rows.withColumn(nth, F.row_number().over(inside) - 1)
    return (
        numbered.join(offsets, keys)
        .withColumn(rank, (F.col(offset) + F.col(nth)).cast("long"))
        .drop(part, nth, offset)
    )


def ranked_sums(
    df: DataFrame, classes: list[str], part: Column, order: list[Column], value: str, total: str
) -> DataFrame:
    """Add the sum of ``value`` over the rows of a class that come before, by ``part`` first, then ``order``.

    As in ``ranked``, a class is summed part by part; parts must follow the order.
    """
    from pyspark.sql import Window

    own, whole, offset, inner = fresh(df, "own", "whole", "offset", "inner")
    rows = df.withColumn(own, part)
    keys = [*classes, own]
    sums = rows.groupBy(*keys).agg(F.sum(value).alias(whole))
    before = Window.partitionBy(*classes).orderBy(own).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*[F.col(c).alias(f"{c}_") for c in keys], F.coalesce(F.sum(whole).over(before), F.lit(0)).alias(offset))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn(inner, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_"))
    joined = summed.join(offsets, same).withColumn(total, (F.col(offset) + F.col(inner)).cast("long"))
    return joined.drop(own, inner, offset, *[f"{c}_" for c in keys])
