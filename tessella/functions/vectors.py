"""Arithmetic on ``ARRAY<DOUBLE>`` columns and elementwise scalar maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(values: Column) -> Column:
    return values.cast("array<double>")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def sum_squares(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v * v)


def mean_square(values: Column) -> Column:
    return sum_squares(values) / F.size(values)


def dot(left: Column, right: Column) -> Column:
    return total(F.zip_with(left, right, lambda a, b: a * b))


def channel_means(values: Column, channels: int) -> Column:
    """Mean of each channel of a channel-last array."""
    per_channel = F.size(values) / F.lit(channels)

    def channel(c: int) -> Column:
        return F.filter(values, lambda v, i: i % channels == c)

    return F.array(*[total(channel(c)) / per_channel for c in range(channels)])


def remove_dc(values: Column, dc: Column, channels: int) -> Column:
    """Subtract per-channel means ``dc`` (see :func:`channel_means`)."""
    return F.transform(values, lambda v, i: v - F.get(dc, i % channels))


def restore_dc(centered: Column, dc: Column, channels: int) -> Column:
    return F.transform(centered, lambda v, i: v + F.get(dc, i % channels))


def row_rms(values: Column, eps: float = 1e-8) -> Column:
    """Root mean square of a row, floored so that a flat row stays finite."""
    rms = F.sqrt(mean_square(values))
    return F.when(F.isnan(rms), rms).otherwise(F.greatest(rms, F.lit(eps)))


def scale_by(values: Column, divisor: Column) -> Column:
    return F.transform(values, lambda v: v / divisor)


def soft_threshold(v: Column, theta: Column | float) -> Column:
    """Shrink towards zero; a negative threshold counts as zero."""
    bound = F.greatest(theta if isinstance(theta, Column) else F.lit(float(theta)), F.lit(0.0))
    return F.signum(v) * F.greatest(F.abs(v) - bound, F.lit(0.0))


def softplus(v: Column) -> Column:
    return F.greatest(v, F.lit(0.0)) + F.log1p(F.exp(-F.abs(v)))


def log_rectifier(u: Column, a: float, b: float, c: float) -> Column:
    return F.lit(a) * F.log1p(F.lit(c) * F.greatest(u + F.lit(b), F.lit(0.0)))


def write_mix(activity: Column, code: Column, beta: float) -> Column:
    """Blend an activity array with a codeword; ``beta`` = 1 writes, 0 keeps the activity."""
    if not 0.0 <= beta <= 1.0:
        raise ValueError(f"beta must lie in [0, 1], got {beta}")
    return F.zip_with(activity, code, lambda f, c: (1.0 - beta) * f + beta * c)
