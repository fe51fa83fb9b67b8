"""Additive noise as a pure function of row keys.

The same key always receives the same draw, on any number of partitions and after any retry.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import vectors as vec
from tessella.functions.keyed import keyed_normal, keyed_uniform
from tessella.guards import at_least
from tessella.operators.features import sigma_for_snr
from tessella.session import broadcast_if_small

SCOPES = ("per_step", "per_trajectory", "fixed")


def add_awgn_sigma(value: Column, sigma: float, seed: int, *key: Column) -> Column:
    """Gaussian noise of fixed level on a scalar column."""
    at_least("sigma", sigma)
    return value + F.lit(float(sigma)) * keyed_normal(F.lit(str(seed)), *key)


def add_awgn_sigma_vector(values: Column, sigma: float, seed: int, *key: Column) -> Column:
    """The same for every entry of a vector column; the entry index joins the key."""
    at_least("sigma", sigma)
    return F.transform(
        values,
        lambda v, i: v + F.lit(float(sigma)) * keyed_normal(F.lit(str(seed)), *key, i),
    )


def add_awgn_snr(
    df: DataFrame, column: str, snr_db: float, seed: int, *key: str, out: str = "noisy"
) -> DataFrame:
    """Noise calibrated to the signal's own variance; the level used is kept in ``sigma``."""
    sigma = sigma_for_snr(df, column, snr_db).select("sigma").scalar()
    noise = keyed_normal(F.lit(str(seed)), *[F.col(k) for k in key])
    return df.withColumn("sigma", sigma).withColumn(out, F.col(column) + F.col("sigma") * noise)


def vector_variance(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Population variance over all entries of equal-length vectors: ``(*by, variance)``.

    It is the mean of the row variances plus the variance of the row means, so entries are never
    unfolded and a large mean does not cancel.
    """
    values = F.col(column)
    mean = vec.total(values) / F.size(values)
    spread = vec.sum_squares(F.transform(values, lambda v: v - mean)) / F.size(values)
    rows = df.select(*by, mean.alias("mean"), spread.alias("spread"))
    return rows.groupBy(*by).agg((F.avg("spread") + F.var_pop("mean")).alias("variance"))


def add_awgn_snr_vectors(
    df: DataFrame,
    column: str,
    snr_db: float | Sequence[float],
    seed: int,
    *key: str,
    by: Sequence[str] = (),
) -> DataFrame:
    """Calibrated noise on a vector column: adds ``snr_db``, ``sigma`` and ``noisy``.

    ``by`` calibrates each group on its own. Several levels give one output row per level; they
    share one calibration pass and one draw per entry, scaled to each level.
    """
    levels = [snr_db] if isinstance(snr_db, (int, float)) else list(snr_db)
    variance = vector_variance(df, column, by)
    message = F.lit("target SNR is undefined for a constant signal")
    usable = F.when(F.col("variance") == 0, F.raise_error(message).cast("double")).otherwise(
        F.col("variance")
    )
    checked = variance.select(*by, usable.alias("variance"))
    if by:
        calibrated = df.join(broadcast_if_small(checked), list(by))
    else:
        calibrated = df.withColumn("variance", checked.scalar())
    columns = [F.col(k) for k in key]
    draws = F.transform(
        F.col(column), lambda _, i: keyed_normal(F.lit(str(seed)), *columns, i)
    )
    steps = F.array(*[F.struct(F.lit(float(db)).alias("snr_db"), F.lit(10.0 ** (db / 10.0)).alias("r")) for db in levels])
    leveled = calibrated.withColumn("draws", draws).select("*", F.inline(steps))
    leveled = leveled.withColumn("sigma", F.sqrt(F.col("variance") / F.col("r")))
    noisy = F.zip_with(column, "draws", lambda v, z: v + F.col("sigma") * z)
    return leveled.withColumn("noisy", noisy).drop("variance", "draws", "r")


def state_noise(keys: DataFrame, sigma: float, seed: int, *key: str) -> DataFrame:
    """One Gaussian draw per row of a key table."""
    at_least("sigma", sigma)
    draw = keyed_normal(F.lit(str(seed)), *[F.col(k) for k in key])
    return keys.withColumn("noise", F.lit(float(sigma)) * draw)


def gaussian_weight_noise(edges: DataFrame, sigma: float, seed: int, *scope: str) -> DataFrame:
    """Gaussian draw per edge ``(src, dst)``, refreshed per distinct value of ``scope``."""
    at_least("sigma", sigma)
    key = [F.col(c) for c in (*scope, "src", "dst")]
    draw = keyed_normal(F.lit(str(seed)), *key)
    return edges.withColumn("noise", F.lit(float(sigma)) * draw)


def uniform_weight_noise(edges: DataFrame, sigma: float, seed: int) -> DataFrame:
    """Uniform draw in ``(-sigma, sigma)`` per edge ``(src, dst)``."""
    at_least("sigma", sigma)
    draw = keyed_uniform(F.lit(str(seed)), F.col("src"), F.col("dst"))
    return edges.withColumn("noise", (F.lit(2.0) * draw - 1.0) * F.lit(float(sigma)))


def scoped_weight_noise(
    edges: DataFrame,
    scope: str,
    sigma: float,
    seed: int,
    *,
    trajectory: str = "trajectory",
    step: str = "step",
    fixed: DataFrame | None = None,
) -> DataFrame:
    """Edge noise redrawn per step, per trajectory, or taken from a fixed perturbation table.

    ``edges`` holds one row per ``(trajectory, step, src, dst)``; ``fixed`` holds
    ``(src, dst, noise)`` and must cover every edge.
    """
    if scope not in SCOPES:
        raise ValueError(f"unknown resample scope {scope!r}; expected one of {SCOPES}")
    at_least("sigma", sigma)
    if (scope == "fixed") != (fixed is not None):
        raise ValueError("a fixed perturbation table is required for, and only for, scope='fixed'")
    if scope == "per_step":
        return gaussian_weight_noise(edges, sigma, seed, trajectory, step)
    if scope == "per_trajectory":
        return gaussian_weight_noise(edges, sigma, seed, trajectory)
    # Few pairs may carry most edges; a small table goes to the edges instead of the edges to the pairs.
    drawn = broadcast_if_small(fixed.select("src", "dst", "noise"))
    joined = edges.join(drawn, ["src", "dst"], "left")
    missing = F.raise_error(F.lit("fixed perturbation does not cover every edge"))
    return joined.withColumn("noise", F.coalesce("noise", missing.cast("double")))
