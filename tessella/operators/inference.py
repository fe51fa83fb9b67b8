"""Finite sparse inference as a scoring job: every Arrow batch runs all steps as matrix products."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.guards import above, at_least, choice, share
from tessella.operators.kernels import block_function, row_function
from tessella.operators.moments import outer_sum, table_matrix
from tessella.operators.sparse import (
    DEFAULT_EPS,
    activity_block,
    coupling_block,
    require_groups,
    penalty_curvature,
    unit_columns,
)
from tessella.session import check_model_size

VARIANTS = ("smooth_gradient", "legacy_adaptive_threshold")


def step_size(
    phi: np.ndarray,
    lam: np.ndarray | None = None,
    penalty_weight: float = 0.0,
    *,
    eps: float = DEFAULT_EPS,
    safety: float = 1.0,
) -> float:
    """Step that cannot raise the objective: ``safety`` over a bound of its curvature.

    The data term curves by the top eigenvalue of the Gram matrix that the recurrence itself uses; group
    weights, if given, add the bound of their smoothed penalty.
    """
    bound = np.linalg.eigvalsh(atom_gram(phi))[-1]
    if lam is not None:
        bound = bound + penalty_curvature(lam.sum(axis=0).max(), penalty_weight, eps)
    return share("safety", safety) / float(above("curvature", bound))


def atom_gram(phi: np.ndarray) -> np.ndarray:
    check_model_size(phi)
    return phi.T @ phi


def infer(
    variant: str,
    x: Column,
    phi: np.ndarray,
    lam: np.ndarray,
    *,
    n_steps: int,
    eta: float,
    penalty_weight: float,
    eps: float = DEFAULT_EPS,
    start: Column | None = None,
) -> Column:
    """Code of each row after ``n_steps`` of the named recurrence, from zero or from ``start``."""
    choice("variant", variant, VARIANTS)
    at_least("n_steps", n_steps)
    above("eta", eta)
    at_least("penalty_weight", penalty_weight)
    require_groups(lam, eps)
    gram = atom_gram(phi)  # one (atoms x atoms) product per step instead of two through the features

    def gradient_step(s: np.ndarray, drive: np.ndarray) -> np.ndarray:
        pull = s @ gram - drive + penalty_weight * s * coupling_block(s, lam, eps)
        return s - eta * pull

    def threshold_step(s: np.ndarray, drive: np.ndarray) -> np.ndarray:
        moved = s - eta * (s @ gram - drive)
        theta = eta * penalty_weight * coupling_block(s, lam, eps)
        return np.sign(moved) * np.maximum(np.abs(moved) - theta, 0.0)

    step = gradient_step if variant == VARIANTS[0] else threshold_step

    def kernel(block: np.ndarray, *initial: np.ndarray) -> np.ndarray:
        drive = block @ phi
        s = initial[0] if initial else np.zeros((len(block), phi.shape[1]))
        for _ in range(n_steps):
            s = step(s, drive)
        return s

    return block_function(kernel, x, *([] if start is None else [start]))


def objective(
    x: Column,
    code: Column,
    phi: np.ndarray,
    lam: np.ndarray,
    penalty_weight: float,
    eps: float = DEFAULT_EPS,
) -> Column:
    """Half squared residual plus the weighted group penalty, per row."""
    require_groups(lam, eps)

    def kernel(block: np.ndarray, s: np.ndarray) -> np.ndarray:
        fit = 0.5 * ((block - s @ phi.T) ** 2).sum(axis=1)
        return fit + penalty_weight * activity_block(s, lam, eps).sum(axis=1)

    return row_function(kernel, x, code)


@dataclass(frozen=True)
class DictionaryMove:
    """A moved dictionary, with the mean half squared residual before the move and the rows it was learned from."""

    phi: np.ndarray
    objective: float
    n_rows: int


def dictionary_move(
    df: DataFrame,
    x: str,
    phi: np.ndarray,
    lam: np.ndarray,
    *,
    rate: float,
    variant: str = VARIANTS[0],
    **inference: float,
) -> DictionaryMove:
    """One alternation: infer codes, average the dictionary gradient, move and renormalise.

    One job over the data; the ``features x atoms`` gradient, the residual and the row count come back.
    """
    code = infer(variant, F.col(x), phi, lam, **inference)
    coded = df.select(F.col(x).alias("x"), code.alias("s"))

    # Two more rows of the sum hold the residual and the count, so the table is read once.
    def sums(xs: np.ndarray, s: np.ndarray) -> np.ndarray:
        gap = xs - s @ phi.T
        return np.vstack([gap.T @ s, np.full(phi.shape[1], 0.5 * (gap * gap).sum()), np.full(phi.shape[1], len(xs))])

    shape = (phi.shape[0] + 2, phi.shape[1])
    total = table_matrix(outer_sum(coded, ["x", "s"], sums, shape), shape)
    n = above("rows to learn from", total[-1, 0])
    return DictionaryMove(unit_columns(phi + rate * total[:-2] / n, on_zero="raise"), float(total[-2, 0] / n), int(n))


def dictionary_step(df: DataFrame, x: str, phi: np.ndarray, lam: np.ndarray, **options) -> np.ndarray:
    """The dictionary after one :func:`dictionary_move`."""
    return dictionary_move(df, x, phi, lam, **options).phi
