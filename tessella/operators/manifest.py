"""Split-manifest validation and reconciliation against stored files."""

from __future__ import annotations

from collections.abc import Collection, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import is_digest, is_safe_relative_path
from tessella.operators.problems import as_problems, compare_keys, flag_rows
from tessella.session import union_all

ROLES = ("train", "val", "test")
MANIFEST_SCHEMA = (
    "split_id string, role string, relative_path string, sha256 string, content_sha256 string, "
    "format string, height int, width int, mode string"
)


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def row_problems(
    manifest: DataFrame,
    *,
    allowed_formats: Collection[str] | None = None,
    allowed_modes: Collection[str] | None = None,
) -> DataFrame:
    """Role vocabulary, digest syntax, path safety, shape, and allowed formats and modes."""
    shape = F.concat_ws("x", F.col("height"), F.col("width"))
    flat = F.coalesce((F.col("height") <= 0) | (F.col("width") <= 0), F.lit(True))
    rules = [
        ("bad_role", ~_text("role").isin(*ROLES), _text("role")),
        ("bad_content_digest", ~is_digest(_text("content_sha256")), _text("content_sha256")),
        (
            "bad_file_digest",
            (_text("sha256") != "") & ~is_digest(_text("sha256")),
            _text("sha256"),
        ),
        ("unsafe_path", ~is_safe_relative_path(_text("relative_path")), _text("relative_path")),
        ("bad_shape", flat, shape),
    ]
    if allowed_formats is not None:
        rules.append(("bad_format", ~_text("format").isin(*allowed_formats), _text("format")))
    if allowed_modes is not None:
        rules.append(("bad_mode", ~_text("mode").isin(*allowed_modes), _text("mode")))
    return flag_rows(manifest, F.col("split_id"), rules)


def role_count_problems(manifest: DataFrame, expected: Mapping[str, int]) -> DataFrame:
    """Roles whose row count differs from the expected one; an absent role counts zero."""
    roles = list(expected)
    counts = manifest.agg(
        *[F.count_if(F.col("role") == role).alias(f"n{k}") for k, role in enumerate(roles)]
    )
    entries = F.array(
        *[
            F.struct(
                F.lit(role).alias("role"),
                F.col(f"n{k}").alias("actual"),
                F.lit(int(expected[role])).cast("bigint").alias("wanted"),
            )
            for k, role in enumerate(roles)
        ]
    )
    wrong = counts.select(F.inline(entries)).filter(F.col("actual") != F.col("wanted"))
    detail = F.format_string("%d images, expected %d", "actual", "wanted")
    return as_problems(wrong, "role_count", F.col("role"), detail)


def key_totals(manifest: DataFrame) -> DataFrame:
    """Occurrences of every split id and content digest, and the roles each digest appears in.

    Both groupings share one scan and one shuffle. Counting happens before the shuffle, so a
    digest carried by a third of the rows travels as one row per task.
    """
    entries = F.array(
        F.struct(
            F.lit("split_id").alias("kind"),
            F.col("split_id").alias("value"),
            F.lit(None).cast("string").alias("role"),
        ),
        F.struct(
            F.lit("content").alias("kind"),
            F.col("content_sha256").alias("value"),
            F.col("role").alias("role"),
        ),
    )
    return (
        manifest.select(F.inline(entries))
        .groupBy("kind", "value")
        .agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("role")).alias("roles"))
    )


def duplicate_ids(totals: DataFrame) -> DataFrame:
    hits = totals.filter((F.col("kind") == "split_id") & (F.col("n") > 1))
    return as_problems(hits, "duplicate_id", F.col("value"), F.col("n"))


def split_leakage(totals: DataFrame) -> DataFrame:
    hits = totals.filter((F.col("kind") == "content") & (F.size("roles") > 1))
    return as_problems(hits, "split_leakage", F.col("value"), F.array_join("roles", ","))


def duplicate_content(totals: DataFrame) -> DataFrame:
    hits = totals.filter((F.col("kind") == "content") & (F.col("n") > 1))
    return as_problems(hits, "duplicate_content", F.col("value"), F.col("n"))


def _total_problems(totals: DataFrame) -> DataFrame:
    """The three key-based rules evaluated together on the aggregated keys."""
    is_content = F.col("kind") == "content"
    repeated = F.col("n") > 1
    return flag_rows(
        totals,
        F.col("value"),
        [
            ("duplicate_id", ~is_content & repeated, F.col("n")),
            ("split_leakage", is_content & (F.size("roles") > 1), F.array_join("roles", ",")),
            ("duplicate_content", is_content & repeated, F.col("n")),
        ],
    )


def validate_manifest(
    manifest: DataFrame,
    *,
    expected_counts: Mapping[str, int] | None = None,
    allowed_formats: Collection[str] | None = None,
    allowed_modes: Collection[str] | None = None,
) -> DataFrame:
    """Full structural report of a manifest."""
    parts = [
        row_problems(manifest, allowed_formats=allowed_formats, allowed_modes=allowed_modes),
        _total_problems(key_totals(manifest)),
    ]
    if expected_counts:
        parts.append(role_count_problems(manifest, expected_counts))
    return union_all(parts)


def unexpected_roles(manifest: DataFrame, expected: Collection[str]) -> DataFrame:
    extra = manifest.select("role").distinct().filter(~F.col("role").isin(*expected))
    return as_problems(extra, "unexpected_role", F.col("role"), F.lit(",".join(sorted(expected))))


def id_problems(manifest: DataFrame, expected_ids: DataFrame) -> DataFrame:
    """Split ids missing from, or not belonging to, the expected set ``(split_id)``."""
    one_sided = compare_keys(expected_ids, manifest, "split_id")
    rule = F.when(F.col("in_expected"), F.lit("missing_id")).otherwise(F.lit("unexpected_id"))
    return one_sided.select(
        rule.alias("rule"), F.col("split_id").alias("key"), F.lit("").alias("detail")
    )


def structural_id_problems(manifest: DataFrame, expected_ids: DataFrame) -> DataFrame:
    """Without stored files only extra ids are wrong, plus a manifest matching none at all."""
    seen = manifest.select("split_id").distinct().withColumn("seen", F.lit(True))
    wanted = expected_ids.select("split_id").distinct().withColumn("wanted", F.lit(True))
    joined = seen.join(wanted, "split_id", "left")
    extra = as_problems(
        joined.filter(F.col("wanted").isNull()), "unexpected_id", F.col("split_id"), F.lit("")
    )
    matches = joined.agg(F.count("wanted").alias("n")).filter(F.col("n") == 0)
    return extra.unionByName(as_problems(matches, "no_expected_id", F.lit("*"), F.lit("")))


def reconcile_files(manifest: DataFrame, scan: DataFrame) -> DataFrame:
    """Manifest rows against a file scan keyed by ``relative_path``.

    ``scan`` carries ``corrupt`` plus the actual format, shape, mode and both digests. An unsafe
    path, a missing file or a corrupt file ends the checks of its row; the file-byte digest is
    compared only where the manifest pins one. Files the manifest does not list are ignored.
    """
    actual = scan.select(
        "relative_path",
        F.lit(True).alias("found"),
        F.col("corrupt").alias("a_corrupt"),
        *[F.col(c).alias(f"a_{c}") for c in ("format", "height", "width", "mode")],
        F.col("content_sha256").alias("a_content"),
        F.col("sha256").alias("a_file"),
    )
    joined = manifest.join(actual, "relative_path", "left")
    safe = is_safe_relative_path(_text("relative_path"))
    found = F.coalesce("found", F.lit(False))
    corrupt = F.coalesce("a_corrupt", F.lit(False))
    readable = safe & found & ~corrupt

    def differs(a: str, b: str) -> Column:
        return ~F.col(a).eqNullSafe(F.col(b))

    def facts(prefix: str) -> Column:
        return F.concat_ws(
            " ", *[F.col(prefix + c).cast("string") for c in ("format", "height", "width", "mode")]
        )

    metadata = (
        differs("a_format", "format")
        | differs("a_height", "height")
        | differs("a_width", "width")
        | differs("a_mode", "mode")
    )
    pinned = _text("sha256") != ""
    path = F.col("relative_path")
    return flag_rows(
        joined,
        F.col("split_id"),
        [
            ("path_escapes_root", ~safe, path),
            ("missing_file", safe & ~found, path),
            ("corrupt_file", safe & found & corrupt, path),
            ("metadata_mismatch", readable & metadata, facts("a_")),
            ("content_mismatch", readable & differs("a_content", "content_sha256"), F.col("a_content")),
            ("file_mismatch", readable & pinned & differs("a_file", "sha256"), F.col("a_file")),
        ],
    )


def verify_manifest(
    manifest: DataFrame,
    scan: DataFrame,
    *,
    expected_roles: Collection[str] | None = None,
    expected_ids: DataFrame | None = None,
    expected_counts: Mapping[str, int] | None = None,
    allowed_formats: Collection[str] | None = None,
    allowed_modes: Collection[str] | None = None,
) -> DataFrame:
    """Structure, expectations and stored bytes in one report."""
    parts = [
        validate_manifest(
            manifest,
            expected_counts=expected_counts,
            allowed_formats=allowed_formats,
            allowed_modes=allowed_modes,
        )
    ]
    if expected_roles is not None:
        parts.append(unexpected_roles(manifest, expected_roles))
    if expected_ids is not None:
        parts.append(id_problems(manifest, expected_ids))
    parts.append(reconcile_files(manifest, scan))
    return union_all(parts)
