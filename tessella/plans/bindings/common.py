"""Shared loading helpers of the bound queries."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.vectors import doubles
from tessella.session import r6, read_table

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Bound:
    """A query over the tables and, where SQL can state it, the same result in SQL."""

    run: Query
    sql: str | None = None


def derive(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Project input columns from expressions both engines read; ``<<x>>`` is the SHA-256 of x."""
    return df.selectExpr(
        *[
            f"{text.replace('<<', 'sha2(').replace('>>', ', 256)')} AS {name}"
            for name, text in columns.items()
        ]
    )


def derive_sql(source: str, columns: Mapping[str, str]) -> str:
    listed = ", ".join(
        f"{text.replace('<<', 'sha256(').replace('>>', ')')} AS {name}"
        for name, text in columns.items()
    )
    return f"SELECT {listed} FROM {source}"


def embeddings(spark: SparkSession, directory: str, *, spread: bool = False) -> DataFrame:
    """``(vec_id, label, role, f)``: labels below 7 train, below 9 val, the rest test."""
    values = doubles(F.col("embedding"))
    role = F.when(F.col("label") < 7, "train").when(F.col("label") < 9, "val").otherwise("test")
    return read_table(spark, directory, "embeddings", spread=spread).select(
        "vec_id", "label", role.alias("role"), values.alias("f")
    )


def rgb_patches(spark: SparkSession, directory: str, *, spread: bool = False) -> DataFrame:
    """Embeddings as 8x8 RGB patches, channel last: pixel p has entries p, p + 1 and p + 2, modulo 64."""
    e = embeddings(spark, directory, spread=spread)
    pixel = lambda v, p: F.array(v, *[F.get("f", ((p + k) % 64).cast("int")) for k in (1, 2)])
    return e.withColumn("f", F.flatten(F.transform("f", pixel)))


def rgb_crops(spark: SparkSession, directory: str) -> DataFrame:
    """The sixteen 2x2 RGB crops of each patch: twelve entries, channel last; ``crop_id`` is the key."""
    patches = rgb_patches(spark, directory, spread=True)
    entry = lambda y, x, c: F.get("f", F.lit((y * 8 + x) * 3 + c))
    crops = [
        F.struct(
            (F.col("vec_id") * 16 + by * 4 + bx).alias("crop_id"),
            F.array(*[entry(2 * by + d // 2, 2 * bx + d % 2, c) for d in range(4) for c in range(3)]).alias("f"),
        )
        for by in range(4)
        for bx in range(4)
    ]
    return patches.select("label", "role", F.inline(F.array(*crops)))


# The same in SQL, over LONG.
RGB_LONG = (
    "x AS (SELECT vec_id, label, CAST(3 * ((i - c + 64) % 64) + c AS INTEGER) AS i, v FROM e, "
    "(SELECT CAST(c AS INTEGER) AS c FROM range(3) r(c)))"
)
CROP_LONG = (
    "cr AS (SELECT vec_id * 16 + (i // 24 // 2) * 4 + (i // 3 % 8) // 2 AS crop_id, label, "
    "CAST((i // 24 % 2 * 2 + i // 3 % 8 % 2) * 3 + i % 3 AS INTEGER) AS i, v FROM x)"
)


def inverse_root_sql(covariance: str, size: int, steps: int, eps: float) -> str:
    """CTEs up to ``root(i, j, v)``, the inverse square root of ``covariance(i, j, v) + eps``: Newton-Schulz steps."""
    parts = [
        f"a AS MATERIALIZED (SELECT i, j, v + CASE WHEN i = j THEN {eps} ELSE 0 END AS v FROM {covariance})",
        "nrm AS MATERIALIZED (SELECT sqrt(sum(v * v)) AS s FROM a)",
        "y0 AS MATERIALIZED (SELECT i, j, v / s AS v FROM a, nrm)",
        "z0 AS MATERIALIZED (SELECT i, j, CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0 END AS v FROM a)",
    ]
    product = "SELECT p.i, q.j, sum(p.v * q.v) AS v FROM {0} p JOIN {1} q ON p.j = q.i GROUP BY p.i, q.j"
    for k in range(steps):
        parts += [
            f"t{k} AS MATERIALIZED (SELECT i, j, CASE WHEN i = j THEN 1.5 ELSE 0 END - v / 2 AS v FROM ({product.format(f'z{k}', f'y{k}')}))",
            f"y{k + 1} AS MATERIALIZED ({product.format(f'y{k}', f't{k}')})",
            f"z{k + 1} AS MATERIALIZED ({product.format(f't{k}', f'z{k}')})",
        ]
    parts.append(f"root AS MATERIALIZED (SELECT i, j, v / sqrt(s) AS v FROM z{steps}, nrm)")
    return ", ".join(parts)


# Long form of the embeddings, one row per entry.
LONG = (
    "e AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS v, "
    "CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS i FROM embeddings)"
)


def entries(df: DataFrame, column: str, *keep: str, index: str = "i", value: str = "v") -> DataFrame:
    """Unfold a vector column, rounded for comparison."""
    return df.select(*keep, F.posexplode_outer(column).alias(index, value)).withColumn(value, r6(F.col(value)))


def r6_sql(expression: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0"


def uniform_sql(digest: str, slot: int = 0) -> str:
    """The keyed uniform in SQL, from a hex digest expression."""
    return f"((('0x' || substr({digest}, {1 + 13 * slot}, 13))::BIGINT + 0.5) / 4503599627370496.0)"


def normal_sql(digest: str) -> str:
    u, v = uniform_sql(digest, 0), uniform_sql(digest, 1)
    return f"(sqrt(-2.0 * ln({u})) * cos(2.0 * pi() * {v}))"


def day_fraction() -> Column:
    """Time of day of an event in [0, 1)."""
    ts = F.col("ts")
    return (F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)) / F.lit(86400.0)


DAY_FRACTION = "((hour(ts) * 3600 + minute(ts) * 60 + second(ts)) / 86400.0::DOUBLE)"
