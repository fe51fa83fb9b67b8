"""Two-dimensional Gabor: a rotated Gaussian envelope times a cosine carrier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARAMETERS = ("amplitude", "t_x", "t_y", "theta", "sigma_x", "sigma_y", "k", "phi")


def gabor(x: Column, y: Column, p: dict[str, Column]) -> Column:
    dx, dy = x - p["t_x"], y - p["t_y"]
    cos_t, sin_t = F.cos(p["theta"]), F.sin(p["theta"])
    along = dx * cos_t - dy * sin_t
    across = dx * sin_t + dy * cos_t
    spread = along * along / (p["sigma_x"] * p["sigma_x"]) + across * across / (
        p["sigma_y"] * p["sigma_y"]
    )
    return p["amplitude"] * F.exp(F.lit(-0.5) * spread) * F.cos(p["k"] * along + p["phi"])


def gabor_bank(params: DataFrame, key: str, height: int, width: int) -> DataFrame:
    """Evaluate every parameter row on a pixel grid; one output row per ``(key, y, x)``.

    The grid comes from generators on the parameter row, so nothing is joined or shuffled.
    Rows with a non-positive (or NaN) standard deviation fail the job.
    """
    bad = ~(F.col("sigma_x") > 0) | ~(F.col("sigma_y") > 0)
    bad = bad | F.isnan("sigma_x") | F.isnan("sigma_y")
    checked = params.withColumn(
        "amplitude",
        F.when(bad, F.raise_error(F.lit("sigma_x and sigma_y must be positive"))).otherwise(
            F.col("amplitude")
        ),
    )
    grid = checked.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn(
        "x", F.explode(F.sequence(F.lit(0), F.lit(width - 1)))
    )
    columns = {name: F.col(name) for name in PARAMETERS}
    return grid.select(key, "y", "x", gabor(F.col("x"), F.col("y"), columns).alias("g"))
