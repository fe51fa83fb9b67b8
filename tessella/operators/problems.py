"""Reports: every check returns rows ``(rule, key, detail)``; an empty report means valid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = tuple[str, Column, Column]


def flag_rows(df: DataFrame, key: Column, rules: Sequence[Rule]) -> DataFrame:
    """Evaluate ``(rule, violated, detail)`` on every row; one output row per violation."""
    entries = [
        F.when(
            violated,
            F.struct(
                F.lit(rule).alias("rule"),
                key.cast("string").alias("key"),
                detail.cast("string").alias("detail"),
            ),
        )
        for rule, violated, detail in rules
    ]
    hits = F.filter(F.array(*entries), lambda entry: entry.isNotNull())
    return df.select(F.inline(hits))


def as_problems(df: DataFrame, rule: str, key: Column, detail: Column) -> DataFrame:
    return df.select(
        F.lit(rule).alias("rule"),
        key.cast("string").alias("key"),
        detail.cast("string").alias("detail"),
    )


def key_sides(expected: DataFrame, seen: DataFrame, *keys: str) -> DataFrame:
    """Every distinct key of two tables, with ``in_expected`` and ``in_seen``; one aggregation."""
    tagged = expected.select(*keys, F.lit(True).alias("in_expected"), F.lit(False).alias("in_seen"))
    other = seen.select(*keys, F.lit(False).alias("in_expected"), F.lit(True).alias("in_seen"))
    merged = tagged.unionByName(other).groupBy(*keys).agg(
        F.bool_or("in_expected").alias("in_expected"), F.bool_or("in_seen").alias("in_seen")
    )
    return merged


def compare_keys(expected: DataFrame, seen: DataFrame, *keys: str) -> DataFrame:
    """Keys of one table only."""
    return key_sides(expected, seen, *keys).filter(F.col("in_expected") != F.col("in_seen"))
