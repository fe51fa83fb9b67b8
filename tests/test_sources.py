import hashlib

import numpy as np
import pytest
from rowsets import pairs
from pngfile import png_bytes
from pyspark.sql import functions as F

from tessella.errors import OutputExistsError
from tessella.plans import jobs
from tessella.sources import files, sinks, synthetic, tables

# Pixel digests of the eight 32x32 images with seed 0.
GOLDEN = [
    "de10cb13cddf3221be048f22265fd55122063bdb78eec810a2d1d0564f9c3713",
    "3e127d085502c7e3339e3f20147ccda993f084006a4c030b1bccdcf6b1dceff5",
    "d4529df1694c31ec35a485e3e1b61841a33fc25963167778edc9db44354d83a7",
    "ca8e9fd59696879aef6c0490b7efade0f90031b893eb4b2d3346353fdc8cbf9a",
    "7ef67b647e97921e4e5e2756d8591cd96d96118bec15755e26e5610a08cf88b2",
    "e53c88bbf8b4c86d00622eeb80d855c8779999318b050fa43fd7966012601b29",
    "7ee4482cc7c7f052e9fff1f28bcd61a0d1d7a6a809924a4883e0e1dfc236b876",
    "354372b214549dbb6e9f9c3b285f25bc6a435488a51687af01bd69dca2c368d3",
]


def test_golden_pixel_digests(spark):
    rows = synthetic.fixture_manifest(synthetic.synthetic_images(spark, 8)).orderBy("split_id").collect()
    assert [r["content_sha256"] for r in rows] == ["sha256:" + d for d in GOLDEN]


def test_fixture_round_trip_and_check(spark, tmp_path):
    images, manifest = str(tmp_path / "images"), str(tmp_path / "manifest")
    synthetic.make_fixture(spark, images, manifest, n=8)
    table = tables.read_manifest(spark, manifest)
    assert [r["split_id"] for r in table.orderBy("split_id").collect()][0] == "synth-0000"
    assert pairs(table.select("sha256")) == {("",)}
    assert jobs.check_dataset(spark, "synthetic", manifest).isEmpty()
    assert not jobs.check_dataset(spark, "div2k", manifest).isEmpty()
    with pytest.raises(OutputExistsError):
        synthetic.make_fixture(spark, images, manifest, n=8)
    synthetic.make_fixture(spark, images, manifest, n=8, overwrite=True)


def test_image_scan_against_manifest(spark, tmp_path):
    root, images = tmp_path / "root", str(tmp_path / "images")
    root.mkdir()
    synthetic.make_fixture(spark, images, str(tmp_path / "manifest"), n=4)
    for r in spark.read.parquet(images).collect():
        pixels = np.frombuffer(r["pixels"], dtype=np.uint8).reshape(32, 32, 3)
        (root / f"synth_{r['idx']:04d}.png").write_bytes(png_bytes(pixels))
    report = jobs.check_dataset(spark, "synthetic", str(tmp_path / "manifest"), str(root))
    assert report.isEmpty(), report.collect()
    rebuilt = files.manifest_from_images(
        files.scan_images(spark, str(root)), F.col("relative_path"), F.lit("train")
    )
    assert {r["content_sha256"] for r in rebuilt.collect()} == {"sha256:" + d for d in GOLDEN[:4]}
    (root / "synth_0001.png").write_bytes(b"not an image")
    (root / "synth_0002.png").unlink()
    gray = np.arange(32 * 32, dtype=np.uint8).reshape(32, 32)
    (root / "synth_0003.png").write_bytes(png_bytes(gray))
    report = jobs.check_dataset(spark, "synthetic", str(tmp_path / "manifest"), str(root))
    assert sorted((r["rule"], r["key"]) for r in report.collect()) == [
        ("content_mismatch", "synth-0003"), ("corrupt_file", "synth-0001"),
        ("metadata_mismatch", "synth-0003"), ("missing_file", "synth-0002"),
    ]
    with pytest.raises(Exception, match="unreadable"):
        files.manifest_from_images(files.scan_images(spark, str(root)), F.lit("x"), F.lit("train")).collect()
    scanned = files.scan_images(spark, str(root)).filter("relative_path = 'synth_0003.png'").first()
    wanted = hashlib.sha256(b"|u1|(32, 32)" + gray.tobytes()).hexdigest()
    assert (scanned["mode"], scanned["content_sha256"]) == ("L", "sha256:" + wanted)


def test_strict_header(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text("split_id,role\r\na,train\r\n")
    with pytest.raises(ValueError, match="columns"):
        tables.read_manifest(spark, str(path))
    good = "split_id,role,relative_path,sha256,content_sha256,format,height,width,mode\r\n"
    path.write_text(good + "a,train,a.png,,d,PNG,8,8,RGB\r\n", newline="")
    assert tables.read_manifest(spark, str(path)).first()["mode"] == "RGB"
    path.write_text(good + "a,train,a.png,,d,PNG,eight,8,RGB\r\n", newline="")
    with pytest.raises(Exception):  # noqa: B017
        tables.read_manifest(spark, str(path)).collect()


def test_write_or_verify(spark, tmp_path):
    path = str(tmp_path / "out")
    frame = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "k int, v string")
    assert sinks.write_or_verify(frame, path) is True
    assert sinks.write_or_verify(frame, path) is False
    with pytest.raises(OutputExistsError):
        sinks.write_or_verify(frame.distinct(), path)
    with pytest.raises(OutputExistsError):
        sinks.write_new(frame, path)


def test_checksums_and_trees(spark, tmp_path):
    tree = tmp_path / "tree"
    (tree / "sub").mkdir(parents=True)
    for name in ("a.txt", "sub/b.txt", "extra.txt", "README.md"):
        (tree / name).write_bytes(name.encode())
    digest = lambda name: hashlib.sha256(name.encode()).hexdigest()
    listing = tmp_path / "sums"
    listing.write_text(
        f"{digest('a.txt')}  a.txt\n\n{digest('x')}  sub/b.txt\n{digest('gone')}  gone.txt\nbroken\n"
    )
    listed = files.read_checksums(spark, str(listing))
    report = jobs.verify_baselines({"t": (listed, files.scan_tree(spark, str(tree)))})
    assert sorted((r["tree"], r["rule"], r["key"]) for r in report.collect()) == [
        ("t", "hash_mismatch", "sub/b.txt"), ("t", "malformed_line", "broken"),
        ("t", "missing_file", "gone.txt"), ("t", "unlisted_file", "extra.txt"),
    ]
    sums = files.parse_checksums(
        spark.createDataFrame([("h  source/x.tex",), ("h  source/images/y.png",), ("h  other/z",)], "value string")
    )
    assert pairs(files.checksum_sources(sums)) == {("x.tex",)}


def test_undecodable_text_is_null(spark, tmp_path):
    (tmp_path / "good.txt").write_text("héllo")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe\x00")
    texts = files.read_texts(spark, str(tmp_path))
    assert pairs(texts) == {("good.txt", "héllo"), ("bad.txt", None)}


def test_file_map_rows_follow_their_files(spark, tmp_path):
    from tessella.operators.lineage import FILE_MAP_SCHEMA
    from tessella.sources.tables import read_file_map

    names = [part.split()[0] for part in FILE_MAP_SCHEMA.split(",")]
    for name, rows in (("a.csv", 2), ("b.csv", 400)):
        lines = [",".join(names)] + [",".join([f"{name}-{k:04d}", *[f"v{k}"] * (len(names) - 1)]) for k in range(rows)]
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    read = read_file_map(spark, str(tmp_path)).orderBy("pos").select(names[0]).collect()
    assert [r[0] for r in read] == [f"a.csv-{k:04d}" for k in range(2)] + [f"b.csv-{k:04d}" for k in range(400)]
