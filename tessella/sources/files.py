"""File trees, checksum lists, text corpora and image scans."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.keyed import tagged_sha256

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:/+"


def relative_path(spark: SparkSession, path: Column, root: str) -> Column:
    """Path below ``root``, which its file system makes absolute; a root that is a file leaves its name."""
    context = spark.sparkContext
    given = context._jvm.org.apache.hadoop.fs.Path(root)
    absolute = given.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(given).toString()
    prefix = "/" + re.sub(_SCHEME, "", absolute).strip("/") + "/"
    located = F.concat(F.lit("/"), F.regexp_replace(path, _SCHEME, ""))
    below = F.substring(located, F.lit(len(prefix) + 1), F.length(located))
    return F.when(located.startswith(prefix), below).otherwise(F.element_at(F.split(located, "/"), -1))


def _binary_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(root).withColumn("rel", relative_path(spark, F.col("path"), root))


def scan_tree(spark: SparkSession, root: str, *, tagged: bool = False) -> DataFrame:
    """Every file under ``root`` with its digest: ``(rel, sha256)``."""
    digest = tagged_sha256(F.col("content")) if tagged else F.sha2("content", 256)
    return _binary_files(spark, root).select("rel", digest.alias("sha256"))


def parse_checksums(lines: DataFrame, column: str = "value") -> DataFrame:
    """``<hex>  <path>`` lines as ``(sha256, rel, malformed)``; blank lines are dropped."""
    parts = F.split(F.trim(F.regexp_replace(column, r"\s+$", "")), "  ", 2)
    return (
        lines.filter(F.trim(column) != "")
        .select(F.get(parts, 0).alias("sha256"), F.trim(F.coalesce(F.get(parts, 1), F.lit(""))).alias("rel"))
        .withColumn("malformed", F.col("rel") == "")
    )


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    return parse_checksums(spark.read.text(path))


def checksum_sources(checksums: DataFrame) -> DataFrame:
    """File names listed under ``source/``, images left out: ``(rel)``."""
    kept = checksums.filter(F.col("rel").startswith("source/") & ~F.col("rel").contains("/images/"))
    return kept.select(F.element_at(F.split("rel", "/"), -1).alias("rel")).distinct()


def read_texts(spark: SparkSession, root: str) -> DataFrame:
    """Whole files as ``(path, text)``; text is null where the bytes are not UTF-8."""
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return _binary_files(spark, root).select(F.col("rel").alias("path"), text.alias("text"))


# Leading bytes of the image formats, as hex.
_MAGIC = (
    ("89504E47", "PNG"),
    ("FFD8FF", "JPEG"),
    ("47494638", "GIF"),
    ("424D", "BMP"),
    ("49492A00", "TIFF"),
    ("4D4D002A", "TIFF"),
)
_MODES = {1: "L", 3: "RGB", 4: "RGBA"}
# Fixed values of PNG headers: bit depth and colour type, where they say more than the decoder's channels.
_PNG_MODES = {"0100": "1", "1000": "I;16", "0103": "P", "0203": "P", "0403": "P", "0803": "P", "0804": "LA", "1004": "LA", "0806": "RGBA", "1006": "RGBA"}


def image_format(content: Column) -> Column:
    lead = F.hex(F.substring(content, 1, 4))
    chain = F.when(lead.startswith(_MAGIC[0][0]), _MAGIC[0][1])
    for magic, name in _MAGIC[1:]:
        chain = chain.when(lead.startswith(magic), name)
    return chain.otherwise("UNKNOWN")


def stored_mode(content: Column) -> Column:
    """Mode a PNG header states, or null where the decoded channels tell it."""
    states = F.create_map(*[F.lit(v) for pair in _PNG_MODES.items() for v in pair])
    return F.when(image_format(content) == "PNG", F.try_element_at(states, F.hex(F.substring(content, 25, 2))))


def _pixel_digests(data: pa.Array, height: pa.Array, width: pa.Array, channels: pa.Array) -> pa.Array:
    """Digest decoded pixels after reordering the decoder's BGR(A) bytes to RGB(A)."""
    out = []
    for raw, h, w, c in zip(data, height.to_pylist(), width.to_pylist(), channels.to_pylist(), strict=True):
        if h is None or h < 1:
            out.append(None)
            continue
        pixels = np.frombuffer(raw.as_buffer(), dtype=np.uint8).reshape(h, w, c)
        if c >= 3:
            pixels = pixels[:, :, [2, 1, 0, *range(3, c)]]
        shape = (h, w) if c == 1 else (h, w, c)
        digest = hashlib.sha256(f"|u1|{shape}".encode())
        digest.update(np.ascontiguousarray(pixels).tobytes())
        out.append("sha256:" + digest.hexdigest())
    return pa.array(out, pa.string())


def scan_images(
    spark: SparkSession, root: str, *, include_file_hash: bool = True, glob: str | None = None
) -> DataFrame:
    """Decode every image under ``root`` into the columns a manifest row needs.

    Unreadable files have ``corrupt`` set. Pixels and bytes are digested before the join, so only
    short rows are shuffled.
    """
    reader = spark.read.format("image").option("dropInvalid", False)
    reader = reader.option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    digest = F.arrow_udf(_pixel_digests, "string")
    mode = F.create_map(*[F.lit(v) for pair in _MODES.items() for v in pair])
    decoded = reader.load(root).select(
        relative_path(spark, F.col("image.origin"), root).alias("relative_path"),
        F.col("image.height").alias("height"),
        F.col("image.width").alias("width"),
        F.try_element_at(mode, F.col("image.nChannels")).alias("decoded_mode"),
        (F.col("image.height") < 1).alias("corrupt"),
        digest("image.data", "image.height", "image.width", "image.nChannels").alias("content_sha256"),
    )
    stored = _binary_files(spark, root, glob).select(
        F.col("rel").alias("relative_path"),
        image_format(F.col("content")).alias("format"),
        stored_mode(F.col("content")).alias("stored_mode"),
        (tagged_sha256(F.col("content")) if include_file_hash else F.lit("")).alias("sha256"),
    )
    joined = decoded.join(stored, "relative_path")
    return joined.withColumn("mode", F.coalesce("stored_mode", "decoded_mode")).drop("stored_mode", "decoded_mode")


def manifest_from_images(scan: DataFrame, split_id: Column, role: Column) -> DataFrame:
    """Manifest rows of a scan; a corrupt image fails the job."""
    broken = F.raise_error(F.concat(F.lit("unreadable image "), F.col("relative_path")))
    checked = F.when(F.col("corrupt"), broken).otherwise(F.col("content_sha256"))
    return scan.select(
        split_id.alias("split_id"),
        role.alias("role"),
        "relative_path",
        "sha256",
        checked.alias("content_sha256"),
        "format",
        "height",
        "width",
        "mode",
    )
