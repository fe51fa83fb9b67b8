"""Feature preparation: colour features, normalisation, signal-to-noise bookkeeping."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import vectors as vec
from tessella.functions.color import opponent_matrix
from tessella.operators.kernels import block_function


def opponent_dc_map(width: int) -> np.ndarray:
    """Matrix of the linear map RGB patch -> DC-removed opponent features (channel-last)."""
    if width % 3:
        raise ValueError(f"expected channel-last RGB patches, got width {width}")
    pixels = width // 3
    centering = np.eye(pixels) - 1.0 / pixels
    return np.kron(centering, opponent_matrix().T)


def opponent_dc_block(x: np.ndarray) -> np.ndarray:
    if x.shape[1] % 3:
        raise ValueError(f"expected channel-last RGB patches, got width {x.shape[1]}")
    colors = x.reshape(len(x), -1, 3) @ opponent_matrix().T
    return (colors - colors.mean(axis=1, keepdims=True)).reshape(len(x), -1)


def opponent_dc_features(rgb: Column) -> Column:
    """Channel-last RGB vectors to flattened, DC-removed opponent features."""
    return block_function(opponent_dc_block, rgb)


def global_rms(df: DataFrame, column: str) -> DataFrame:
    """One-row table ``(scale)``: uncentered RMS over every entry of a vector column."""
    return df.agg(
        F.sqrt(F.sum(vec.sum_squares(F.col(column))) / F.sum(F.size(column))).alias("scale")
    )


def global_normalize(df: DataFrame, column: str, scale: float | None = None) -> DataFrame:
    """Divide a vector column by one table-wide scale (its own RMS unless given)."""
    if scale is not None and not scale > 0.0:
        raise ValueError(f"normalization scale must be a positive real number, got {scale!r}")
    value = F.lit(scale)
    if scale is None:
        message = F.lit("normalization scale must be a positive real number")
        bad = F.col("scale").isNull() | F.isnan("scale") | ~(F.col("scale") > 0)
        checked = F.when(bad, F.raise_error(message).cast("double")).otherwise(F.col("scale"))
        value = global_rms(df, column).select(checked.alias("scale")).scalar()
    return df.withColumn("scale", value).withColumn(
        column, vec.scale_by(F.col(column), F.col("scale"))
    )


def per_row_normalize(df: DataFrame, column: str, eps: float = 1e-8) -> DataFrame:
    """Divide each vector by its own floored RMS, kept in ``scale`` so it can be undone."""
    return df.withColumn("scale", vec.row_rms(F.col(column), eps)).withColumn(
        column, vec.scale_by(F.col(column), F.col("scale"))
    )


def sigma_for_snr(df: DataFrame, column: str, *snr_db: float) -> DataFrame:
    """Noise level per target SNR of a scalar signal column, from one variance: ``(snr_db, sigma)``."""
    message = "target SNR is undefined for a constant signal"
    spread = df.agg(F.var_pop(column).alias("variance")).select(
        F.when(F.col("variance") == 0, F.raise_error(F.lit(message))).otherwise(F.col("variance")).alias("variance")
    )
    levels = [
        F.struct(F.lit(float(db)).alias("snr_db"), F.sqrt(F.col("variance") / F.lit(10.0 ** (db / 10.0))).alias("sigma"))
        for db in snr_db
    ]
    return spread.select(F.inline(F.array(*levels)))


def measured_snr_db(df: DataFrame, clean: str, noisy: str) -> DataFrame:
    """One-row table ``(snr_db)``; no noise is +inf, a constant clean signal is -inf."""
    gap = F.col(noisy) - F.col(clean)
    return df.agg(
        F.avg(gap * gap).alias("noise"), F.var_pop(clean).alias("variance")
    ).select(
        F.when(F.col("noise") == 0, F.lit(float("inf")))
        .when(F.col("variance") == 0, F.lit(float("-inf")))
        .otherwise(F.lit(10.0) * F.log10(F.col("variance") / F.col("noise")))
        .alias("snr_db")
    )
