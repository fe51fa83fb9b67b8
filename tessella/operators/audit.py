"""Quantitative audit of features: histograms, power, covariance, similarity, moments."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import vectors as vec
from tessella.operators.similarity import nearest_cosine
from tessella.operators.whitening import WhiteningStats, apply_whitening, covariance_residual
from tessella.session import bounded_rows, union_all

AUDIT_SCHEMA_VERSION = "1"
EXACT_PERCENTILE_ROWS = 1_000_000


def bin_edges(bins: int, low: float, high: float) -> list[float]:
    step = (high - low) / bins
    return [*(low + i * step for i in range(bins)), high]


def _bin(value: Column, bins: int, low: float, high: float) -> Column:
    """Index of the bin holding a value; the last bin is closed, outside values give null.

    The arithmetic guess is corrected against the neighbouring edges, so a value equal to an edge
    lands where a comparison with the edge list would put it.
    """
    step = (high - low) / bins
    edge = lambda k: F.lit(low) + k * F.lit(step)
    guess = F.floor((value - F.lit(low)) / F.lit(step))
    guess = F.when(value < edge(guess), guess - 1).when(value >= edge(guess + 1), guess + 1).otherwise(
        guess
    )
    inside = (value >= F.lit(low)) & (value <= F.lit(high)) & ~F.isnan(value)
    return F.when(inside, F.least(F.greatest(guess, F.lit(0)), F.lit(bins - 1))).cast("int")


def channel_histograms(
    df: DataFrame, column: str, channels: int, *, bins: int = 16, low: float = 0.0, high: float = 1.0
) -> DataFrame:
    """Counts ``(c, bin, low_edge, n)`` per channel of a channel-last vector column.

    Empty bins are present with a zero count: the grid is generated, not joined from data.
    """
    values = df.select(F.posexplode_outer(column).alias("pos", "v"))
    binned = values.select(
        (F.col("pos") % channels).alias("c"), _bin(F.col("v"), bins, low, high).alias("bin")
    ).filter(F.col("bin").isNotNull())
    counts = binned.groupBy("c", "bin").agg(F.count(F.lit(1)).alias("n"))
    cells = df.sparkSession.range(channels * bins).select(
        F.floor(F.col("id") / bins).cast("int").alias("c"), (F.col("id") % bins).cast("int").alias("bin")
    )
    edges = F.array(*[F.lit(e) for e in bin_edges(bins, low, high)])
    return cells.join(counts, ["c", "bin"], "left").select(
        "c",
        "bin",
        F.get(edges, F.col("bin")).alias("low_edge"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
    )


def exact_percentiles(
    df: DataFrame, column: str, quantiles: Sequence[float], *, in_memory: int = EXACT_PERCENTILE_ROWS
) -> list[float | None]:
    """Exact linearly interpolated percentiles without one task holding all values; NaN if any value is.

    Up to ``in_memory`` rows the built-in aggregate is used. Beyond that three passes usually
    serve all quantiles together: a sketch brackets each one, the rows below and inside every
    bracket are counted, and the distinct values inside are tallied. Ranks are counted, never
    estimated, so the sketch decides only the cost; a bracket that is still too large is narrowed.
    """
    values = df.select(F.col(column).cast("double").alias("v")).filter(F.col("v").isNotNull())
    sizes = values.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.isnan("v")).alias("nan")).first()
    n = sizes["n"]
    if n == 0:
        return [None for _ in quantiles]
    if sizes["nan"]:
        return [math.nan for _ in quantiles]
    if n <= in_memory:
        points = F.array(*[F.lit(float(q)) for q in quantiles])
        return list(values.agg(F.percentile("v", points)).first()[0])
    positions = [q * (n - 1) for q in quantiles]
    ranks = sorted({r for p in positions for r in (math.floor(p), min(math.floor(p) + 1, n - 1))})
    at_rank = _order_statistics(values, n, ranks, in_memory)
    results = []
    for p in positions:
        low, high = math.floor(p), min(math.floor(p) + 1, n - 1)
        results.append(at_rank[low] + (p - low) * (at_rank[high] - at_rank[low]))
    return results


def _order_statistics(
    values: DataFrame, n: int, ranks: Sequence[int], in_memory: int
) -> dict[int, float]:
    """Values of ``v`` at zero-based ranks of its sorted order, among ``n`` rows."""
    v = F.col("v")
    # The bracket is a few sketch errors wide.
    accuracy, margin = 20_000, 2e-4
    around = [min(max(r / n + d, 0.0), 1.0) for r in ranks for d in (-margin, margin)]
    points = F.array(*[F.lit(a) for a in around])
    sketch = values.agg(F.percentile_approx("v", points, F.lit(accuracy))).first()[0]
    brackets = list(zip(sketch[::2], sketch[1::2], strict=True))
    tallies = values.agg(
        *[
            count
            for lo, hi in brackets
            for count in (
                F.count_if(v < lo),
                F.count_if(v == lo),
                F.count_if((v > lo) & (v < hi)),
                F.count_if((v == hi) & (v > lo)),
            )
        ]
    ).first()
    found: dict[int, float] = {}
    small: list[tuple[int, float, float, int]] = []
    budget = in_memory
    for k, (rank, (lo, hi)) in enumerate(zip(ranks, brackets, strict=True)):
        below, at_lo, inside, at_hi = tallies[4 * k : 4 * k + 4]
        start = below + at_lo
        if below <= rank < start:
            found[rank] = lo
        elif start + inside <= rank < start + inside + at_hi:
            found[rank] = hi
        elif start <= rank < start + inside:
            if inside <= budget:
                budget -= inside
                small.append((rank, lo, hi, start))
            else:
                part = values.filter((v > lo) & (v < hi))
                found[rank] = _order_statistics(part, inside, [rank - start], in_memory)[rank - start]
        elif rank < below:  # the sketch missed; what lies on that side is known exactly
            found[rank] = _order_statistics(values.filter(v < lo), below, [rank], in_memory)[rank]
        else:
            skipped = start + inside + at_hi
            part = values.filter(v > hi)
            found[rank] = _order_statistics(part, n - skipped, [rank - skipped], in_memory)[rank - skipped]
    if small:
        wanted = F.lit(False)
        for lo, hi in {(lo, hi) for _, lo, hi, _ in small}:
            wanted = wanted | ((v > lo) & (v < hi))
        rows = bounded_rows(values.filter(wanted).groupBy("v").count(), in_memory, "bracket values")
        counted = sorted((r["v"], r["count"]) for r in rows)
        for rank, lo, hi, start in small:
            seen = start
            for value, count in counted:
                if lo < value < hi:
                    seen += count
                    if seen > rank:
                        found[rank] = value
                        break
    return found


def patch_power(df: DataFrame, column: str) -> DataFrame:
    """Tall ``(key, value)``: mean, median, p05 and p95 of the per-row mean square."""
    power = df.select(vec.mean_square(F.col(column)).alias("power"))
    median, p05, p95 = exact_percentiles(power, "power", [0.5, 0.05, 0.95])
    pairs = [("median", F.lit(median)), ("p05", F.lit(p05)), ("p95", F.lit(p95))]
    entries = [F.struct(F.lit("mean").alias("key"), F.col("mean").alias("value"))] + [
        F.struct(F.lit(k).alias("key"), v.cast("double").alias("value")) for k, v in pairs
    ]
    return power.agg(F.avg("power").alias("mean")).select(F.inline(F.array(*entries)))


def value_moments(df: DataFrame, column: str) -> DataFrame:
    """Tall ``(key, value)``: mean, population deviation, min and max over all vector entries."""
    # Rows are reduced before the aggregation: entries, their sum, and their extremes.
    own = df.select(F.col(column).alias("v")).select(
        "v",
        F.size("v").alias("n"),
        F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("total"),
        F.array_min("v").alias("low"),
        F.array_max("v").alias("high"),
    ).filter(F.col("n") > 0)
    mean = own.agg((F.sum("total") / F.sum("n")).alias("mean")).first()["mean"]
    gap = F.aggregate("v", F.lit(0.0), lambda a, x: a + (x - F.lit(mean)) * (x - F.lit(mean)))
    stats = own.agg(
        F.lit(mean).cast("double").alias("mean"),
        F.sqrt(F.sum(gap) / F.sum("n")).alias("std"),
        F.min("low").alias("min"),
        F.max("high").alias("max"),
    )
    names = ("mean", "std", "min", "max")
    return stats.select(
        F.inline(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in names]))
    )


def before_after(df: DataFrame, before: str, after: str) -> DataFrame:
    """Moments of two vector columns, keys prefixed ``before.`` and ``after.``."""
    parts = []
    for name, column in (("before", before), ("after", after)):
        moments = value_moments(df, column)
        parts.append(moments.select(F.concat(F.lit(name + "."), "key").alias("key"), "value"))
    return union_all(parts)


def _metric(name: str, frame: DataFrame) -> DataFrame:
    return frame.select(F.lit(name).alias("metric"), "key", F.col("value").cast("double").alias("value"))


def audit_metrics(
    rgb: DataFrame,
    rgb_column: str,
    train: DataFrame,
    test: DataFrame,
    feature_column: str,
    key: str,
    stats: WhiteningStats,
    *,
    max_pairs: int | None = None,
    bins: int = 16,
    low: float = 0.0,
    high: float = 1.0,
) -> DataFrame:
    """The whole audit in tall form ``(metric, key, value)``."""
    spark = train.sparkSession
    histogram = channel_histograms(rgb, rgb_column, 3, bins=bins, low=low, high=high).select(
        F.concat(F.lit("c"), "c", F.lit(".bin"), F.lpad(F.col("bin").cast("string"), 4, "0")).alias("key"),
        F.col("n").alias("value"),
    )
    counts = union_all(
        [
            frame.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("key"), "value")
            for name, frame in (("n_train_features", train), ("n_test_features", test))
        ]
    )
    residual = spark.createDataFrame(
        list(covariance_residual(train, feature_column, stats).items()), "key string, value double"
    )
    nearest = nearest_cosine(train, test, feature_column, key, max_pairs=max_pairs).agg(
        F.max("cosine").alias("max"), F.avg("cosine").alias("mean")
    )
    similarity = nearest.select(
        F.inline(
            F.array(
                F.struct(F.lit("max_nearest_cosine").alias("key"), F.col("max").alias("value")),
                F.struct(F.lit("mean_nearest_cosine").alias("key"), F.col("mean").alias("value")),
            )
        )
    )
    whitened = train.withColumn("whitened", apply_whitening(F.col(feature_column), stats))
    return union_all(
        [
            _metric("counts", counts),
            _metric("channel_histograms", histogram),
            _metric("patch_power", patch_power(rgb, rgb_column)),
            _metric("whitening_covariance", residual),
            _metric("train_test_similarity", similarity),
            _metric("whitening_before_after", before_after(whitened, feature_column, "whitened")),
        ]
    )


def audit_report(
    metrics: DataFrame,
    dataset: str,
    manifest_sha256: str | None = None,
    *,
    bins: int = 16,
    low: float = 0.0,
    high: float = 1.0,
) -> dict[str, object]:
    """Nested report of one audit; its size depends on the bin count only."""
    rows = bounded_rows(metrics, 3 * bins + 64, "audit metrics")
    table: dict[str, dict[str, float]] = {}
    for row in rows:
        table.setdefault(row["metric"], {})[row["key"]] = row["value"]
    moments = table["whitening_before_after"]
    histogram = table["channel_histograms"]
    return {
        "schema_version": AUDIT_SCHEMA_VERSION,
        "dataset": dataset,
        "input_manifest_sha256": manifest_sha256,
        "n_train_features": int(table["counts"]["n_train_features"]),
        "n_test_features": int(table["counts"]["n_test_features"]),
        "channel_histograms": {
            "bin_edges": bin_edges(bins, low, high),
            "counts_per_channel": [
                [int(histogram[f"c{c}.bin{b:04d}"]) for b in range(bins)] for c in range(3)
            ],
        },
        "patch_power": table["patch_power"],
        "whitening_covariance": table["whitening_covariance"],
        "train_test_similarity": table["train_test_similarity"],
        "whitening_before_after": {
            part: {k: moments[f"{part}.{k}"] for k in ("mean", "std", "min", "max")}
            for part in ("before", "after")
        },
    }
