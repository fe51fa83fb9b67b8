"""Jobs a user starts: dataset checks, audits, ledgers, lineage and baseline verification."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.guards import choice
from tessella.operators import ledger, lineage
from tessella.operators.audit import audit_metrics, audit_report
from tessella.operators.features import opponent_dc_features
from tessella.operators.manifest import (
    structural_id_problems,
    unexpected_roles,
    validate_manifest,
    verify_manifest,
)
from tessella.operators.patches import PatchConfig, random_patches
from tessella.operators.whitening import fit_whitening
from tessella.session import union_all
from tessella.sources.files import scan_images, scan_tree
from tessella.sources.ledgers import read_pins, record_pins, write_terms
from tessella.sources.models import write_json_record
from tessella.sources.registry import (
    archive_table,
    dataset_names,
    predicted_ids,
    registry_table,
    roles_of,
)
from tessella.sources.synthetic import synthetic_images, unit_values
from tessella.sources.tables import read_manifest


def require_clean(report: DataFrame, what: str) -> None:
    """Raise with the number of problems of a non-empty report, and some of them."""
    rows = report.limit(10).collect()
    if rows:
        listed = "; ".join(" ".join(str(v) for v in row) for row in rows)
        raise ValueError(f"{what} failed with {report.count()} problems, among them: {listed}")


def check_dataset(
    spark: SparkSession,
    dataset: str,
    manifest_path: str,
    root: str | None = None,
    *,
    expected_counts: Mapping[str, int] | None = None,
    allowed_formats: set[str] | None = None,
    allowed_modes: set[str] | None = None,
) -> DataFrame:
    """Problem report of a dataset's manifest and, given ``root``, of its stored images."""
    choice("dataset", dataset.lower(), ("synthetic", *dataset_names()))
    manifest = read_manifest(spark, manifest_path)
    roles, ids = {"train"}, None
    if dataset != "synthetic":
        roles, ids = roles_of(dataset), predicted_ids(spark, dataset)
    rules = {
        "expected_counts": expected_counts,
        "allowed_formats": allowed_formats,
        "allowed_modes": allowed_modes,
    }
    if root is not None:
        scan = scan_images(spark, root)
        return verify_manifest(manifest, scan, expected_roles=roles, expected_ids=ids, **rules)
    parts = [validate_manifest(manifest, **rules), unexpected_roles(manifest, roles)]
    if ids is not None:
        parts.append(structural_id_problems(manifest, ids))
    return union_all(parts)


def audit_images(
    images: DataFrame,
    *,
    dataset: str,
    dataset_sha256: str,
    seed: int,
    patches: PatchConfig = PatchConfig(size=16, n_random=64),
    rng: str = "hash",
    max_pairs: int | None = None,
) -> dict[str, object]:
    """Audit array-form images whose ``role`` is train or test; statistics are fitted on train."""
    crops = random_patches(images, patches, dataset=dataset_sha256, seed=seed, rng=rng)
    features = crops.select(
        F.concat_ws("|", "image_id", F.lpad(F.col("patch_index").cast("string"), 6, "0")).alias("key"),
        "role",
        "values",
        opponent_dc_features(F.col("values")).alias("f"),
    )
    train = features.filter(F.col("role") == "train")
    test = features.filter(F.col("role") == "test")
    stats = fit_whitening(train, "f", width=patches.size * patches.size * 3)
    metrics = audit_metrics(train, "values", train, test, "f", "key", stats, max_pairs=max_pairs)
    return audit_report(metrics, dataset)


def audit_fixture(
    spark: SparkSession, out: str, *, n: int = 8, size: int = 48, seed: int = 0, overwrite: bool = False
) -> dict[str, object]:
    """Audit generated images, first half train and second half test, into a JSON record."""
    images = unit_values(synthetic_images(spark, n, size=size, seed=seed))
    half = max(1, n // 2)
    roles = F.when(F.col("idx") < half, "train").otherwise("test")
    tagged = images.select(
        F.format_string("%04d", "idx").alias("image_id"),
        roles.alias("role"),
        "height",
        "width",
        "channels",
        "values",
    )
    if n <= half:  # nothing left for a test side: compare train with itself
        tagged = tagged.unionByName(tagged.withColumn("role", F.lit("test")))
    report = audit_images(tagged, dataset="synthetic", dataset_sha256="synthetic", seed=seed, rng="pcg64")
    write_json_record(spark, report, out, overwrite=overwrite)
    return report


def list_datasets(spark: SparkSession) -> DataFrame:
    archives = archive_table(spark).groupBy("dataset").agg(F.array_sort(F.collect_set("archive")).alias("archives"))
    return (
        registry_table(spark)
        .join(archives, "dataset")
        .select("dataset", "description", "official_url", "terms_url", "terms_acceptance_token", "archives")
        .orderBy("dataset")
    )


def accept_terms(requests: DataFrame, root: str) -> DataFrame:
    """Record acceptances; one bad request fails the batch before anything is written."""
    judged = ledger.judge_terms(requests, registry_table(requests.sparkSession))
    rejected = judged.filter(F.col("status") != "accepted").select("dataset", "status")
    require_clean(rejected, "terms acceptance")
    write_terms(judged, root)
    return judged


def _official_digests(spark: SparkSession, dataset: str, archive_root: str) -> DataFrame:
    name = choice("dataset", dataset.lower(), dataset_names())
    observed = scan_tree(spark, archive_root, tagged=True).select(
        F.lit(name).alias("dataset"), F.col("rel").alias("archive"), "sha256"
    )
    judged = ledger.judge_archive_names(observed, archive_table(spark))
    require_clean(judged.filter(~F.col("official")).select("dataset", "archive"), "archive names")
    return judged.drop("official")


def record_archives(spark: SparkSession, dataset: str, archive_root: str, ledger_root: str) -> DataFrame:
    """Pin every archive found under ``archive_root``."""
    return record_pins(_official_digests(spark, dataset, archive_root), ledger_root)


def verify_archives(spark: SparkSession, dataset: str, archive_root: str, ledger_root: str) -> DataFrame:
    """Status of every archive found under ``archive_root`` against its pin."""
    observed = _official_digests(spark, dataset, archive_root)
    return ledger.verify_pins(observed, read_pins(spark, ledger_root))


def check_lineage(
    *,
    texts: DataFrame,
    inventory: DataFrame,
    expected: DataFrame,
    declared: DataFrame,
    file_map: DataFrame,
    derived: DataFrame,
    targets: DataFrame,
    sources: DataFrame,
    frozen_sources: DataFrame,
) -> DataFrame:
    """Label coverage, migration fan-out and file-map validity in one report."""
    return union_all(
        [
            lineage.uncovered_labels(texts, "text", inventory),
            lineage.check_fanout(expected, declared, frozen_sources, targets.select("rel")),
            lineage.check_file_map(file_map, "pos", derived, targets, sources),
        ]
    )


def verify_baselines(trees: Mapping[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Checksum reports of several trees, ``{name: (listed, actual)}``, with the tree named.

    ``listed`` may carry the ``malformed`` flag of a parsed checksum file.
    """
    parts = []
    for name, (listed, actual) in trees.items():
        good = listed
        if "malformed" in listed.columns:
            good = listed.filter(~F.col("malformed"))
            bad = listed.filter("malformed").select(
                F.lit(name).alias("tree"),
                F.lit("malformed_line").alias("rule"),
                F.col("sha256").alias("key"),
                F.lit("").alias("detail"),
            )
            parts.append(bad)
        report = lineage.verify_tree(good, actual)
        parts.append(report.select(F.lit(name).alias("tree"), "rule", "key", "detail"))
    return union_all(parts)
