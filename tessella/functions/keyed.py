"""Digests and keyed randomness: pure functions of a key, so independent of partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_HEX_DIGITS = 13  # 52 bits
_SCALE = float(1 << 52)


def key_digest(*parts: Column | str | int) -> Column:
    """SHA-256 hex of the parts joined by ``|``."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.sha2(F.concat_ws("|", *[c.cast("string") for c in cols]), 256)


def uniform_from_digest(digest: Column, slot: int = 0) -> Column:
    """Uniform in the open interval (0, 1) from the ``slot``-th 52-bit piece of a hex digest."""
    piece = F.substring(digest, 1 + slot * _HEX_DIGITS, _HEX_DIGITS)
    return (F.conv(piece, 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(_SCALE)


def keyed_uniform(*parts: Column | str | int) -> Column:
    return uniform_from_digest(key_digest(*parts))


def keyed_normal(*parts: Column | str | int) -> Column:
    """Standard normal per key: Box-Muller on two pieces of the same digest."""
    digest = key_digest(*parts)
    radius = F.sqrt(F.lit(-2.0) * F.log(uniform_from_digest(digest, 0)))
    return radius * F.cos(F.lit(2.0 * math.pi) * uniform_from_digest(digest, 1))


def patch_digest(dataset: Column | str, image: Column, seed: int, index: Column) -> Column:
    """Digest whose leading bytes seed patch ``index`` of an image."""
    return key_digest(dataset, image, seed, index)


def tagged_sha256(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def pixel_digest(pixels: Column, height: Column, width: Column, channels: Column) -> Column:
    """Digest of 8-bit pixels in row-major channel-last order, bound to their shape.

    A single-channel image is two-dimensional, so its header carries no channel count.
    """
    dims = F.when(
        channels == 1, F.format_string("|u1|(%d, %d)", height, width)
    ).otherwise(F.format_string("|u1|(%d, %d, %d)", height, width, channels))
    return tagged_sha256(F.concat(F.encode(dims, "UTF-8"), pixels))
