"""sRGB transfer curves and the orthonormal opponent basis as column expressions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the sRGB transfer function (IEC 61966-2-1).
ENCODED_THRESHOLD = 0.04045
LINEAR_THRESHOLD = 0.0031308
OFFSET = 0.055
GAMMA = 2.4
SLOPE = 12.92

# Fixed rows: luminance, red-green, blue-yellow.
OPPONENT = (
    (1 / math.sqrt(3), 1 / math.sqrt(3), 1 / math.sqrt(3)),
    (1 / math.sqrt(2), -1 / math.sqrt(2), 0.0),
    (1 / math.sqrt(6), 1 / math.sqrt(6), -2 / math.sqrt(6)),
)


def opponent_matrix() -> np.ndarray:
    return np.array(OPPONENT)


def srgb_to_linear(v: Column) -> Column:
    return F.when(v <= ENCODED_THRESHOLD, v / SLOPE).otherwise(
        F.pow((v + OFFSET) / (1 + OFFSET), F.lit(GAMMA))
    )


def linear_to_srgb(v: Column) -> Column:
    return F.when(v <= LINEAR_THRESHOLD, v * SLOPE).otherwise(
        (1 + OFFSET) * F.pow(v, F.lit(1 / GAMMA)) - OFFSET
    )


def _weighted(weights: tuple[float, ...], columns: tuple[Column, ...]) -> Column:
    total = F.lit(0.0)
    for weight, column in zip(weights, columns, strict=True):
        total = total + F.lit(weight) * column
    return total


def rgb_to_opponent(r: Column, g: Column, b: Column) -> tuple[Column, ...]:
    return tuple(_weighted(row, (r, g, b)) for row in OPPONENT)


def opponent_to_rgb(lum: Column, rg: Column, by: Column) -> tuple[Column, ...]:
    return tuple(_weighted(col, (lum, rg, by)) for col in zip(*OPPONENT, strict=True))


def rgb_pixels(values: Column) -> Column:
    """Channel-last RGB array to an array of ``(p, r, g, b)`` structs, for ``inline``.

    Fails on arrays whose length is not a multiple of three.
    """
    n = F.size(values)
    checked = F.when(n % 3 == 0, n / 3).otherwise(
        F.raise_error(F.lit("expected channel-last RGB, length not a multiple of 3"))
    )
    return F.transform(
        F.sequence(F.lit(0), checked.cast("int") - 1),
        lambda p: F.struct(
            p.alias("p"),
            F.get(values, p * 3).alias("r"),
            F.get(values, p * 3 + 1).alias("g"),
            F.get(values, p * 3 + 2).alias("b"),
        ),
    )
