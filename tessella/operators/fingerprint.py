"""Order-independent content digests of whole tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Hex digits of the row digest that name a group on each level. Digests spread evenly, so with a
# trillion distinct rows the levels hold about 60 000, 4 096 and 4 096 children per group.
LEVELS = (6, 3, 0)


def row_digest(*columns: Column | str) -> Column:
    """SHA-256 of the columns as text; nulls and field borders are kept apart."""
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    parts = [F.coalesce(F.concat(F.lit("v"), c.cast("string")), F.lit("n")) for c in cols]
    return F.sha2(F.concat_ws("|", *[F.sha2(p, 256) for p in parts]), 256)


def vector_digest(values: Column) -> Column:
    """SHA-256 of a vector through the shortest exact decimal form of each entry."""
    return F.sha2(F.concat_ws(",", F.transform(values, lambda v: v.cast("string"))), 256)


def table_digest(df: DataFrame, digest: Column) -> DataFrame:
    """One row ``(digest, n_rows)``: a hash tree over the multiset of row digests.

    Equal rows are counted first and enter as one leaf, so copies cannot swell a group; leaves
    are then grouped by digest prefix, level by level, and each group is hashed in sorted order.
    """
    counted = df.select(digest.alias("d")).groupBy("d").agg(F.count(F.lit(1)).alias("n"))
    nodes = counted.select(
        F.substring("d", 1, LEVELS[0]).alias("prefix"),
        F.concat_ws(":", "d", F.col("n").cast("string")).alias("node"),
        "n",
    )
    for level, width in enumerate(LEVELS):
        joined = F.array_join(F.array_sort(F.collect_list("node")), ",")
        hashed = nodes.groupBy("prefix").agg(F.sha2(joined, 256).alias("h"), F.sum("n").alias("n"))
        if level + 1 == len(LEVELS):
            return hashed.select(F.col("h").alias("digest"), F.col("n").alias("n_rows"))
        nodes = hashed.select(
            F.substring("prefix", 1, LEVELS[level + 1]).alias("prefix"),
            F.concat_ws(":", "prefix", "h").alias("node"),
            "n",
        )
    raise AssertionError("unreachable")


def tree_digest(tree: DataFrame) -> DataFrame:
    """Digest of a file tree ``(rel, sha256)``, whatever order its files are listed in."""
    return table_digest(tree, row_digest("rel", "sha256"))


def config_lines(value: object, path: str = "") -> Iterator[str]:
    """One line per scalar of a configuration: its path, type and value; other types are refused."""
    if isinstance(value, Mapping):
        for key in sorted(value):
            yield from config_lines(value[key], f"{path}/{key}")
    elif isinstance(value, (list, tuple)):
        for k, item in enumerate(value):
            yield from config_lines(item, f"{path}[{k}]")
    elif value is None or isinstance(value, (bool, int, float, str)):
        yield f"{path} {type(value).__name__} {value!r}"
    else:
        raise TypeError(f"{path or 'configuration'} holds a {type(value).__name__}, which has no stable form")


def fit_identifier(train: DataFrame, column: str, width: int, config: Mapping[str, object]) -> str:
    """Identifier of a fit: its training vectors, their shape and the configuration."""
    row = table_digest(train, vector_digest(F.col(column))).first()
    if row is None:
        raise ValueError("no training rows")
    shape = {"rows": row["n_rows"], "width": width}
    content = "\n".join([row["digest"], *config_lines(shape), *config_lines(config)])
    return "fit-" + hashlib.sha256(content.encode()).hexdigest()[:16]
