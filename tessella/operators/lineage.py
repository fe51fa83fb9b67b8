"""Checksum-tree verification, migration fan-out, file-map validity, label coverage."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.problems import as_problems, compare_keys, flag_rows, key_sides
from tessella.session import union_all

TUPLE = ("source", "target", "derivation")
DERIVATIONS = ("byte-identical-copy", "translated-from")
FILE_MAP_SCHEMA = (
    "dissertation_file string, derivation string, source_2026_file string, "
    "source_sha256 string, current_sha256 string, notes string"
)
# File sizes tell little of how large digests and paths are in memory, so that a small file may be broadcast as a
# large table. Joins by path are therefore always sorted on both sides; nothing goes through the driver.
SHUFFLED = "merge"
LABEL_PATTERN = r"\\label\{((?:fig|tab):[^}]+)\}"


def verify_tree(
    listed: DataFrame, actual: DataFrame, allowed_unlisted: Collection[str] = ("README.md",)
) -> DataFrame:
    """Checksum list ``(rel, sha256)`` against a tree scan: missing, changed and unlisted files."""
    listing = listed.select("rel", F.col("sha256").alias("expected"), F.lit(True).alias("listed"))
    tree = actual.select("rel", F.col("sha256").alias("actual"), F.lit(True).alias("present"))
    joined = listing.join(tree.hint(SHUFFLED), "rel", "full_outer")
    is_listed, present = F.col("listed").isNotNull(), F.col("present").isNotNull()
    return flag_rows(
        joined,
        F.col("rel"),
        [
            ("missing_file", is_listed & ~present, F.col("expected")),
            (
                "hash_mismatch",
                is_listed & present & ~F.col("expected").eqNullSafe(F.col("actual")),
                F.col("actual"),
            ),
            (
                "unlisted_file",
                ~is_listed & ~F.col("rel").isin(*allowed_unlisted),
                F.col("actual"),
            ),
        ],
    )


def check_fanout(
    expected: DataFrame, declared: DataFrame, sources: DataFrame, targets: DataFrame
) -> DataFrame:
    """Frozen migration tuples against declared ones and against what exists.

    ``sources`` and ``targets`` are one-column tables ``(rel)``.
    """
    sides = key_sides(expected, declared, *TUPLE)
    for side, known in (("target", targets), ("source", sources)):
        there = known.select(F.col("rel").alias(side)).distinct().withColumn(f"has_{side}", F.lit(True))
        sides = sides.join(there.hint(SHUFFLED), side, "left")
    wanted, seen = F.col("in_expected"), F.col("in_seen")
    pair, detail = F.concat_ws(" -> ", "source", "target"), F.col("derivation")
    rules = [
        ("missing_tuple", wanted & ~seen, pair, detail),
        ("extra_tuple", seen & ~wanted, pair, detail),
        ("missing_source", wanted & F.col("has_source").isNull(), F.col("source"), F.lit("")),
        ("missing_target", wanted & F.col("has_target").isNull(), F.col("target"), F.concat_ws(" ", "source", "derivation")),
    ]
    entries = [
        F.when(broken, F.struct(F.lit(rule).alias("rule"), key.alias("key"), text.alias("detail")))
        for rule, broken, key, text in rules
    ]
    # Tuples are distinct; a lost source is named by each of its tuples.
    return sides.select(F.inline(F.array_compact(F.array(*entries)))).distinct()


def check_file_map(
    file_map: DataFrame,
    order: str,
    derived: DataFrame,
    targets: DataFrame,
    sources: DataFrame,
) -> DataFrame:
    """Coverage and per-row validity of a file map.

    ``file_map`` has the columns of ``FILE_MAP_SCHEMA`` plus a position column ``order``; of
    several rows for one target the first counts and the rest are reported. ``derived`` is
    ``(rel)``; ``targets`` and ``sources`` are ``(rel, sha256)``. A missing target, an unknown
    derivation or a missing source ends the checks of its row.
    """
    fields = ["derivation", "source_2026_file", "source_sha256", "current_sha256"]
    mapped = (
        file_map.groupBy(F.col("dissertation_file").alias("target"))
        .agg(
            F.min_by(F.struct(*fields), order).alias("row"),
            F.count(F.lit(1)).alias("n"),
        )
        .select("target", "n", "row.*")
    )
    repeated = mapped.filter(F.col("n") > 1)
    duplicates = as_problems(
        repeated.select("target", F.explode(F.sequence(F.lit(2), "n")).alias("copy")),
        "duplicate_row",
        F.col("target"),
        F.col("copy"),
    )
    expected = derived.select(F.col("rel").alias("target"))
    coverage = compare_keys(expected, mapped, "target").select(
        F.when(F.col("in_expected"), F.lit("missing_row"))
        .otherwise(F.lit("unexpected_target"))
        .alias("rule"),
        F.col("target").alias("key"),
        F.lit("").alias("detail"),
    )
    joined = mapped.join(
        targets.select(F.col("rel").alias("target"), F.col("sha256").alias("target_actual")).hint(SHUFFLED),
        "target",
        "left",
    ).join(
        sources.select(
            F.col("rel").alias("source_2026_file"), F.col("sha256").alias("source_actual")
        ).hint(SHUFFLED),
        "source_2026_file",
        "left",
    )

    def differs(a: str, b: str) -> Column:
        return ~F.col(a).eqNullSafe(F.col(b))

    on_disk = F.col("target_actual").isNotNull()
    known = F.coalesce(F.col("derivation").isin(*DERIVATIONS), F.lit(False))
    sourced = F.col("source_actual").isNotNull()
    valid = on_disk & known & sourced
    copied = F.col("derivation") == DERIVATIONS[0]
    rows = flag_rows(
        joined,
        F.col("target"),
        [
            ("missing_target", ~on_disk, F.lit("")),
            ("unknown_derivation", on_disk & ~known, F.col("derivation")),
            ("missing_source", on_disk & known & ~sourced, F.col("source_2026_file")),
            (
                "source_drift",
                valid & differs("source_actual", "source_sha256"),
                F.col("source_2026_file"),
            ),
            (
                "stale_hash",
                valid & differs("target_actual", "current_sha256"),
                F.col("current_sha256"),
            ),
            (
                "copy_differs",
                valid & copied & differs("current_sha256", "source_sha256"),
                F.col("source_2026_file"),
            ),
        ],
    )
    return union_all([duplicates, coverage, rows])


def uncovered_labels(
    texts: DataFrame, text: str, inventory: DataFrame, pattern: str = LABEL_PATTERN
) -> DataFrame:
    """Labels matched in a text column (first group of ``pattern``) with no ``(label)`` entry."""
    found = texts.select(
        F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1))).alias("label")
    ).distinct()
    lost = found.join(inventory.select("label").distinct().hint(SHUFFLED), "label", "left_anti")
    return as_problems(lost, "label_not_in_inventory", F.col("label"), F.lit(""))
