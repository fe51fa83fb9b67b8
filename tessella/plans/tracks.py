"""The two preprocessing tracks over array-form images."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.features import per_row_normalize
from tessella.operators.noise import add_awgn_sigma_vector, add_awgn_snr_vectors
from tessella.operators.patches import (
    PatchConfig,
    grid_patches,
    patch_pixels,
    random_patches,
    reassemble,
)
from tessella.plans.representation import (
    FittedRepresentation,
    apply_representation,
    fit_representation,
)

# Fixed values of the track configurations.
WHITENED_PATCHES = PatchConfig(size=16, stride=8, n_random=256, border=0, augment=True)
WHITENED_SNR_DB = (0.0, 3.0, 6.0)
RGB_PATCHES = PatchConfig(size=16, stride=8, n_random=0, border=0, augment=False)
RGB_SIGMAS = (15 / 255, 25 / 255, 50 / 255)


def color_whitened(
    images: DataFrame,
    *,
    dataset: str,
    seed: int,
    patches: PatchConfig = WHITENED_PATCHES,
    snr_db: Sequence[float] = WHITENED_SNR_DB,
    eps: float = 1e-5,
    rng: str = "hash",
) -> tuple[FittedRepresentation, DataFrame]:
    """Keyed crops, train-only fit, frozen application, then noise at each target SNR.

    ``images`` carries a ``role``. Returns the model and
    ``(image_id, patch_index, role, snr_db, sigma, clean, noisy)``; noise is calibrated per role.
    """
    crops = random_patches(images, patches, dataset=dataset, seed=seed, rng=rng)
    fitted = fit_representation(crops, "values", eps=eps)
    clean = crops.select(
        "image_id",
        "patch_index",
        "role",
        apply_representation(F.col("values"), fitted).alias("clean"),
    )
    noisy = add_awgn_snr_vectors(
        clean, "clean", snr_db, seed, "image_id", "patch_index", by=("role",)
    )
    columns = ["image_id", "patch_index", "role", "snr_db", "sigma", "clean", "noisy"]
    return fitted, noisy.select(*columns)


def color_rgb_patches(
    images: DataFrame,
    *,
    seed: int,
    patches: PatchConfig = RGB_PATCHES,
    sigmas: Sequence[float] = RGB_SIGMAS,
) -> DataFrame:
    """Grid patches scaled by their own RMS and corrupted at each noise level.

    ``(image_id, top, left, sigma, scale, clean, noisy)``; one pass, no shuffle.
    """
    cut = grid_patches(images, patches.size, patches.stride)
    scaled = per_row_normalize(cut, "values")
    noisy = scaled.select(
        "image_id",
        "top",
        "left",
        "scale",
        F.col("values").alias("clean"),
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(float(s)).alias("sigma"),
                        add_awgn_sigma_vector(
                            F.col("values"), s, seed, F.col("image_id"), F.col("top"), F.col("left")
                        ).alias("noisy"),
                    )
                    for s in sigmas
                ]
            )
        ).alias("level"),
    )
    return noisy.select(
        "image_id", "top", "left", "level.sigma", "scale", "clean", F.col("level.noisy").alias("noisy")
    )


def color_rgb_images(
    patches: DataFrame, column: str, *, size: int, channels: int = 3, blend: bool = True
) -> DataFrame:
    """Undo the patch scale and blend patches into images ``(image_id, sigma, y, x, c, v, weight)``."""
    restored = patches.withColumn(
        "values", F.transform(F.col(column), lambda v: v * F.col("scale"))
    )
    keys = ("image_id", "sigma")
    return reassemble(patch_pixels(restored, size, channels, keys), size, blend=blend, keys=keys)
