import pytest
from rowsets import pairs

from tessella.operators import manifest as m

A, B, C = ("sha256:" + ch * 64 for ch in "abc")


def rows(spark, *changes):
    base = [
        {"split_id": f"i{k}", "role": role, "relative_path": f"{k}.png", "sha256": "", "content_sha256": digest,
         "format": "PNG", "height": 8, "width": 8, "mode": "RGB"}
        for k, (role, digest) in enumerate([("train", A), ("train", B), ("test", C)])
    ]
    for index, change in changes:
        base[index].update(change)
    return spark.createDataFrame([tuple(r.values()) for r in base], m.MANIFEST_SCHEMA)


def rules(report):
    return sorted((r["rule"], r["key"]) for r in report.collect())


def test_clean_manifest_has_no_problems(spark):
    report = m.validate_manifest(
        rows(spark), expected_counts={"train": 2, "test": 1}, allowed_formats={"PNG"}, allowed_modes={"RGB"}
    )
    assert report.isEmpty()


def test_same_pixels_in_two_roles_is_leakage(spark):
    report = m.validate_manifest(rows(spark, (2, {"content_sha256": A})))
    assert rules(report) == [("duplicate_content", A), ("split_leakage", A)]


def test_structural_rules(spark):
    broken = rows(
        spark,
        (0, {"role": "dev", "content_sha256": "sha256:short", "relative_path": "../x", "sha256": "md5:1"}),
        (1, {"height": 0, "format": "BMP", "mode": "L"}),
        (2, {"split_id": "i1"}),
    )
    report = m.validate_manifest(broken, allowed_formats={"PNG"}, allowed_modes={"RGB"}, expected_counts={"val": 1})
    assert rules(report) == [
        ("bad_content_digest", "i0"), ("bad_file_digest", "i0"), ("bad_format", "i1"), ("bad_mode", "i1"),
        ("bad_role", "i0"), ("bad_shape", "i1"), ("duplicate_id", "i1"), ("role_count", "val"), ("unsafe_path", "i0"),
    ]


@pytest.mark.parametrize("path", ["", "/a", "\\a", "../a", "a/../b", "a/.."])
def test_unsafe_paths(spark, path):
    assert ("unsafe_path", "i0") in rules(m.row_problems(rows(spark, (0, {"relative_path": path}))))


@pytest.mark.parametrize("path", ["a..b/c", "..a", "a/b.png", "a/...", "./a"])
def test_safe_paths(spark, path):
    assert m.row_problems(rows(spark, (0, {"relative_path": path}))).isEmpty()


def test_digest_with_trailing_newline_is_rejected(spark):
    assert rules(m.row_problems(rows(spark, (0, {"content_sha256": A + "\n"})))) == [("bad_content_digest", "i0")]


def scan(spark, *found):
    return spark.createDataFrame(
        list(found),
        "relative_path string, corrupt boolean, format string, height int, width int, mode string, "
        "content_sha256 string, sha256 string",
    )


def test_reconcile_files(spark):
    table = rows(spark, (0, {"sha256": A}), (1, {"relative_path": "../1.png"}))
    stored = scan(
        spark, ("0.png", False, "JPEG", 8, 8, "RGB", B, C), ("2.png", True, None, -1, -1, None, None, None),
        ("extra.png", False, "PNG", 8, 8, "RGB", A, A),
    )
    assert rules(m.reconcile_files(table, stored)) == [
        ("content_mismatch", "i0"), ("corrupt_file", "i2"), ("file_mismatch", "i0"),
        ("metadata_mismatch", "i0"), ("path_escapes_root", "i1"),
    ]
    assert ("missing_file", "i2") in rules(m.reconcile_files(rows(spark), stored.filter("relative_path <> '2.png'")))


def test_unpinned_file_bytes_are_not_compared(spark):
    stored = scan(spark, *[(f"{k}.png", False, "PNG", 8, 8, "RGB", d, "other") for k, d in enumerate((A, B, C))])
    assert m.reconcile_files(rows(spark), stored).isEmpty()


def test_expected_roles_and_ids(spark):
    ids = spark.createDataFrame([("i0",), ("i9",)], "split_id string")
    assert pairs(m.id_problems(rows(spark), ids)) == {
        ("missing_id", "i9", ""), ("unexpected_id", "i1", ""), ("unexpected_id", "i2", "")
    }
    assert rules(m.structural_id_problems(rows(spark), ids)) == [("unexpected_id", "i1"), ("unexpected_id", "i2")]
    none = spark.createDataFrame([("z",)], "split_id string")
    assert ("no_expected_id", "*") in rules(m.structural_id_problems(rows(spark), none))
    assert rules(m.unexpected_roles(rows(spark), {"train"})) == [("unexpected_role", "test")]


def test_hot_digest_counts_whole(spark):
    """A third of all rows share one digest; the count stays exact."""
    big = spark.range(30_000).selectExpr(
        "CAST(id AS STRING) AS split_id", "IF(id % 2 = 0, 'train', 'test') AS role",
        "IF(id % 3 = 0, 'hot', CAST(id AS STRING)) AS content_sha256",
    )
    totals = m.key_totals(big)
    assert pairs(m.duplicate_content(totals)) == {("duplicate_content", "hot", "10000")}
    assert pairs(m.split_leakage(totals)) == {("split_leakage", "hot", "test,train")}
