"""ZCA whitening: fitted once from a bounded covariance, applied per Arrow batch."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame

from tessella.guards import above, at_least
from tessella.operators.kernels import affine
from tessella.operators.moments import Moments, vector_moments, vector_width
from tessella.session import check_model_size

DEFAULT_EPS = 1e-5


@dataclass(frozen=True)
class WhiteningStats:
    mean: np.ndarray
    whiten: np.ndarray
    unwhiten: np.ndarray
    eps: float
    n_samples: int
    input_manifest_sha256: str | None = None

    @property
    def n_features(self) -> int:
        return len(self.mean)


def whitening_from_moments(
    moments: Moments, *, eps: float = DEFAULT_EPS, input_manifest_sha256: str | None = None
) -> WhiteningStats:
    above("eps", eps)
    at_least("training rows", moments.n, 2)
    check_model_size(moments.scatter)
    values, vectors = np.linalg.eigh(moments.scatter / (moments.n - 1))
    root = np.sqrt(np.clip(values, 0.0, None) + eps)
    return WhiteningStats(
        mean=moments.mean,
        whiten=(vectors / root) @ vectors.T,
        unwhiten=(vectors * root) @ vectors.T,
        eps=eps,
        n_samples=moments.n,
        input_manifest_sha256=input_manifest_sha256,
    )


def fit_whitening(
    train: DataFrame,
    column: str,
    *,
    eps: float = DEFAULT_EPS,
    width: int | None = None,
    input_manifest_sha256: str | None = None,
) -> WhiteningStats:
    """Fit on a table of training vectors: one pass over the data, one small matrix on the driver."""
    above("eps", eps)
    width = width or vector_width(train, column)
    return whitening_from_moments(
        vector_moments(train, column, width=width),
        eps=eps,
        input_manifest_sha256=input_manifest_sha256,
    )


def apply_whitening(column: Column, stats: WhiteningStats) -> Column:
    return affine(column, stats.whiten.T, -stats.mean @ stats.whiten.T)


def invert_whitening(column: Column, stats: WhiteningStats) -> Column:
    return affine(column, stats.unwhiten.T, stats.mean)


def covariance_residual(df: DataFrame, column: str, stats: WhiteningStats) -> dict[str, float]:
    """Largest and mean absolute deviation of the whitened covariance from the identity.

    The rows are whitened inside the aggregation, so the whitened vectors are never written out.
    """
    mean, whiten = stats.mean, stats.whiten
    moments = vector_moments(
        df, column, width=stats.n_features, block_map=lambda x: (x - mean) @ whiten.T
    )
    off = np.abs(moments.covariance() - np.eye(stats.n_features))
    return {"max_abs_off_identity": float(off.max()), "mean_abs_off_identity": float(off.mean())}
