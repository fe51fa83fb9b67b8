"""Colour, normalisation, whitening, noise and audit operators over the tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import color
from tessella.functions import vectors as vec
from tessella.operators import audit, features, noise
from tessella.operators.blocks import apply_block_whitening, fit_block_whitening, invert_block_whitening
from tessella.operators.moments import Moments, vector_moments
from tessella.operators.similarity import nearest_cosine
from tessella.operators.whitening import (
    WhiteningStats,
    apply_whitening,
    covariance_residual,
    fit_whitening,
    invert_whitening,
    whitening_from_moments,
)
from tessella.plans.bindings.common import (
    CROP_LONG,
    LONG,
    RGB_LONG,
    Bound,
    embeddings,
    entries,
    inverse_root_sql,
    normal_sql,
    r6_sql,
    rgb_crops,
    rgb_patches,
    uniform_sql,
)
from tessella.plans.representation import (
    apply_representation,
    fit_representation,
    invert_representation,
    require_train_only,
    train_rows,
)
from tessella.session import r6, read_table

_PIXELS = (
    f"{RGB_LONG}, px AS (SELECT vec_id, label, CAST(i // 3 AS INTEGER) AS p, max(v) FILTER (i % 3 = 0) AS r, "
    "max(v) FILTER (i % 3 = 1) AS g, max(v) FILTER (i % 3 = 2) AS b FROM x GROUP BY ALL)"
)
_OPPONENT = (
    "op AS (SELECT vec_id, label, p, (r + g + b) / sqrt(3.0) AS o0, (r - g) / sqrt(2.0) AS o1, "
    "(r + g - 2 * b) / sqrt(6.0) AS o2 FROM px)"
)
_FEATURES = (
    "fe AS (SELECT vec_id, label, CAST(3 * p + c AS INTEGER) AS i, o - avg(o) OVER (PARTITION BY vec_id, c) AS v FROM "
    "(SELECT vec_id, label, p, unnest([0, 1, 2]) AS c, unnest([o0, o1, o2]) AS o FROM op))"
)


def srgb(spark: SparkSession, directory: str) -> DataFrame:
    """Entries mapped into [0, 1], decoded to linear light and encoded again."""
    unit = embeddings(spark, directory, spread=True).select("vec_id", F.posexplode("f").alias("i", "x"))
    unit = unit.select("vec_id", "i", ((F.col("x") + 1) / 2).alias("x"))
    # Shrinking reaches the straight part of the curve as well.
    shrunk = unit.withColumn("x", F.when(F.col("i") % 2 == 0, F.col("x") * 0.05).otherwise(F.col("x")))
    linear = shrunk.withColumn("lin", color.srgb_to_linear(F.col("x")))
    return linear.select(
        "vec_id",
        "i",
        r6(F.col("lin"), 8).alias("lin"),
        r6(color.linear_to_srgb(F.col("lin"))).alias("back"),
        r6(color.linear_to_srgb(F.col("x"))).alias("enc"),
    )


_ENCODE = "CASE WHEN {0} <= 0.0031308 THEN {0} * 12.92 ELSE 1.055 * pow({0}, 1 / 2.4) - 0.055 END"
_SRGB_SQL = f"""
WITH {LONG}, x AS (SELECT vec_id, i, (v + 1) / 2 * CASE WHEN i % 2 = 0 THEN 0.05 ELSE 1 END AS x FROM e),
l AS (SELECT vec_id, i, x, CASE WHEN x <= 0.04045 THEN x / 12.92 ELSE pow((x + 0.055) / 1.055, 2.4) END AS lin FROM x)
SELECT vec_id, i, {r6_sql("lin", 8)} AS lin, {r6_sql(_ENCODE.format("lin"))} AS back, {r6_sql(_ENCODE.format("x"))} AS enc FROM l
"""


def opponent(spark: SparkSession, directory: str) -> DataFrame:
    pixels = rgb_patches(spark, directory).select("vec_id", F.inline(color.rgb_pixels(F.col("f"))))
    axes = color.rgb_to_opponent(F.col("r"), F.col("g"), F.col("b"))
    rotated = pixels.select("vec_id", "p", *[a.alias(f"o{k}") for k, a in enumerate(axes)])
    back = color.opponent_to_rgb(F.col("o0"), F.col("o1"), F.col("o2"))
    return rotated.select(
        "vec_id",
        "p",
        *[r6(F.col(f"o{k}")).alias(f"o{k}") for k in range(3)],
        *[r6(c).alias(n) for c, n in zip(back, "rgb", strict=True)],
    )


_OPPONENT_SQL = f"""
WITH {LONG}, {_PIXELS}, {_OPPONENT}
SELECT vec_id, p, {", ".join(f"{r6_sql(f'op.o{k}')} AS o{k}" for k in range(3))},
  {", ".join(f"{r6_sql(f'px.{n}')} AS {n}" for n in "rgb")} FROM op JOIN px USING (vec_id, p)
"""


def dc_remove(spark: SparkSession, directory: str) -> DataFrame:
    patches = rgb_patches(spark, directory).withColumn("dc", vec.channel_means(F.col("f"), 3))
    centered = patches.withColumn("centered", vec.remove_dc(F.col("f"), F.col("dc"), 3))
    rows = centered.select(
        "vec_id",
        "dc",
        F.posexplode(
            F.arrays_zip("centered", vec.restore_dc(F.col("centered"), F.col("dc"), 3).alias("restored"))
        ).alias("i", "z"),
    )
    return rows.select(
        "vec_id",
        "i",
        r6(F.col("z.centered")).alias("centered"),
        r6(F.get("dc", F.col("i") % 3)).alias("dc"),
        r6(F.col("z.restored")).alias("restored"),
    )


_DC_SQL = f"""
WITH {LONG}, {RGB_LONG}, m AS (SELECT vec_id, i, v, avg(v) OVER (PARTITION BY vec_id, i % 3) AS dc FROM x)
SELECT vec_id, i, {r6_sql("v - dc")} AS centered, {r6_sql("dc")} AS dc, {r6_sql("v")} AS restored FROM m
"""


def opponent_features(spark: SparkSession, directory: str) -> DataFrame:
    return entries(
        rgb_patches(spark, directory).select(
            "vec_id", features.opponent_dc_features(F.col("f")).alias("f")
        ),
        "f",
        "vec_id",
    )


def global_rms(spark: SparkSession, directory: str) -> DataFrame:
    normalized = features.global_normalize(embeddings(spark, directory), "f")
    return entries(normalized, "f", "vec_id", "scale").withColumn("scale", r6(F.col("scale")))


_GLOBAL_SQL = f"""
WITH {LONG}, s AS (SELECT sqrt(avg(v * v)) AS scale FROM e)
SELECT vec_id, i, {r6_sql("v / scale")} AS v, {r6_sql("scale")} AS scale FROM e, s
"""


def row_rms(spark: SparkSession, directory: str) -> DataFrame:
    normalized = features.per_row_normalize(embeddings(spark, directory, spread=True), "f")
    return entries(normalized, "f", "vec_id", "scale").withColumn("scale", r6(F.col("scale")))


_ROW_SQL = f"""
WITH {LONG}, s AS (SELECT vec_id, greatest(sqrt(avg(v * v)), 1e-8) AS scale FROM e GROUP BY vec_id)
SELECT vec_id, i, {r6_sql("v / scale")} AS v, {r6_sql("scale")} AS scale FROM e JOIN s USING (vec_id)
"""


def cov_matrix(spark: SparkSession, directory: str) -> DataFrame:
    moments = vector_moments(embeddings(spark, directory), "f", width=64)
    rows = [
        (i, float(moments.mean[i]), moments.n, [float(v) for v in row])
        for i, row in enumerate(moments.covariance())
    ]
    table = spark.createDataFrame(rows, "i int, mean double, n bigint, row array<double>")
    unfolded = table.select("i", "n", r6(F.col("mean"), 8).alias("mean"), F.posexplode("row").alias("j", "cov"))
    return unfolded.withColumn("cov", r6(F.col("cov"), 9))


_COV_SQL = f"""
WITH {LONG}, m AS (SELECT i, avg(v) AS mean, count(*) AS n FROM e GROUP BY i)
SELECT a.i, b.i AS j, {r6_sql("covar_samp(a.v, b.v)", 9)} AS cov, {r6_sql("any_value(m.mean)", 8)} AS mean, any_value(m.n) AS n
FROM e a JOIN e b USING (vec_id) JOIN m ON a.i = m.i GROUP BY a.i, b.i
"""


def whiten_roundtrip(spark: SparkSession, directory: str) -> DataFrame:
    """Whitening fitted on train rows, applied to every row, and undone."""
    e = embeddings(spark, directory)
    stats = fit_whitening(e.filter(F.col("role") == "train"), "f", width=64)
    whitened = e.select("vec_id", apply_whitening(F.col("f"), stats).alias("w"))
    both = whitened.withColumn("f", invert_whitening(F.col("w"), stats))
    rows = both.select("vec_id", F.posexplode(F.arrays_zip("w", "f")).alias("i", "z"))
    return rows.select("vec_id", "i", r6(F.col("z.w"), 5).alias("w"), r6(F.col("z.f")).alias("v"))


def whiten_blocks(spark: SparkSession, directory: str) -> DataFrame:
    """The same whitening through blocks of 16 x 16, without a whole matrix in any task or on the driver."""
    e = embeddings(spark, directory)
    stats = fit_block_whitening(e.filter(F.col("role") == "train"), "f", width=64, size=16)
    whitened = apply_block_whitening(e, "vec_id", "f", stats, name="w")
    restored = invert_block_whitening(whitened, "vec_id", "w", stats, name="f")
    w = whitened.select("vec_id", F.posexplode("w").alias("i", "w")).withColumn("w", r6(F.col("w"), 5))
    return w.join(entries(restored, "f", "vec_id"), ["vec_id", "i"])


def _whitened_sql(rows: str, key: str, size: int, steps: int, eps: float = 1e-5) -> str:
    """CTEs up to ``wh(key, label, i, w)``: long rows whitened with the statistics of labels below 7."""
    return (
        f"mu AS MATERIALIZED (SELECT i, avg(v) AS m FROM {rows} WHERE label < 7 GROUP BY i), "
        f"ce AS MATERIALIZED (SELECT {key}, label, i, v - m AS v FROM {rows} JOIN mu USING (i)), "
        f"co AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.v * b.v) / (count(*) - 1) AS v FROM ce a JOIN ce b USING ({key}) "
        f"WHERE a.label < 7 GROUP BY a.i, b.i), {inverse_root_sql('co', size, steps, eps)}, "
        f"wh AS MATERIALIZED (SELECT {key}, label, root.i, sum(root.v * ce.v) AS w FROM root JOIN ce ON root.j = ce.i "
        f"GROUP BY {key}, label, root.i)"
    )


_ROUNDTRIP_SQL = f"""
WITH {LONG}, {_whitened_sql("e", "vec_id", 64, 22)}
SELECT vec_id, i, {r6_sql("w", 5)} AS w, {r6_sql("v")} AS v FROM wh JOIN e USING (vec_id, i)
"""


def whiten_pairs(spark: SparkSession, directory: str) -> DataFrame:
    """Each two neighbouring entries whitened by themselves, where the inverse root has a closed form."""
    e = embeddings(spark, directory)
    every = vector_moments(e.filter(F.col("role") == "train"), "f", width=64)
    whiten = np.zeros((64, 64))
    for k in range(0, 64, 2):
        pair = slice(k, k + 2)
        own = Moments(every.n, every.mean[pair], every.scatter[pair, pair])
        whiten[pair, pair] = whitening_from_moments(own).whiten
    stats = WhiteningStats(every.mean, whiten, np.linalg.inv(whiten), 1e-5, every.n)
    return entries(e.select("vec_id", apply_whitening(F.col("f"), stats).alias("w")), "w", "vec_id")


_PAIRS_SQL = f"""
WITH {LONG}, mu AS (SELECT i, avg(v) AS m FROM e WHERE label < 7 GROUP BY i),
ce AS (SELECT vec_id, label, i, v - m AS v FROM e JOIN mu USING (i)),
pr AS (SELECT vec_id, label, i // 2 AS k, max(v) FILTER (i % 2 = 0) AS a, max(v) FILTER (i % 2 = 1) AS b FROM ce GROUP BY ALL),
mo AS (SELECT k, var_samp(a) + 1e-5 AS p, var_samp(b) + 1e-5 AS q, covar_samp(a, b) AS r FROM pr WHERE label < 7 GROUP BY k),
sq AS (SELECT k, sqrt(p * q - r * r) AS d, p, q, r, sqrt(p + q + 2 * sqrt(p * q - r * r)) AS t FROM mo),
ro AS (SELECT k, (q + d) / (t * d) AS p, (p + d) / (t * d) AS q, -r / (t * d) AS r FROM sq)
SELECT vec_id, CAST(2 * k + c AS INTEGER) AS i, {r6_sql("CASE c WHEN 0 THEN p * a + r * b ELSE r * a + q * b END")} AS v
FROM pr JOIN ro USING (k), range(2) s(c)
"""


def whiten_check(spark: SparkSession, directory: str) -> DataFrame:
    """Whitened train rows: largest mean, and how far their covariance is from the identity."""
    train = embeddings(spark, directory).filter(F.col("role") == "train")
    stats = fit_whitening(train, "f", width=64)
    residual = covariance_residual(train, "f", stats)
    whitened = train.select(apply_whitening(F.col("f"), stats).alias("w"))
    means = whitened.select(F.posexplode_outer("w").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"))
    return means.agg(
        (F.max(F.abs("m")) < 1e-9).alias("zero_mean"),
        r6(F.lit(residual["max_abs_off_identity"])).alias("max_off"),
        r6(F.lit(residual["mean_abs_off_identity"])).alias("mean_off"),
        F.lit(stats.n_samples).cast("bigint").alias("n_train"),
    )


_OFF = (
    "off AS (SELECT abs(sum(a.w * b.w) / (count(*) - 1) - CASE WHEN a.i = b.i THEN 1 ELSE 0 END) AS o "
    "FROM wh a JOIN wh b USING ({0}) WHERE a.label < 7 GROUP BY a.i, b.i)"
)
_WHITEN_SQL = f"""
WITH {LONG}, {_whitened_sql("e", "vec_id", 64, 22)}, {_OFF.format("vec_id")}
SELECT (SELECT max(abs(m)) < 1e-9 FROM (SELECT avg(w) AS m FROM wh WHERE label < 7 GROUP BY i)) AS zero_mean,
  {r6_sql("max(o)")} AS max_off, {r6_sql("avg(o)")} AS mean_off, (SELECT count(*) FROM embeddings WHERE label < 7) AS n_train FROM off
"""


def representation_fit_apply(spark: SparkSession, directory: str) -> DataFrame:
    """Fit on train crops, apply to all of them, and map back to features; the scale comes along."""
    crops = rgb_crops(spark, directory)
    require_train_only(train_rows(crops))
    fitted = fit_representation(crops, "f")
    applied = crops.select("crop_id", apply_representation(F.col("f"), fitted).alias("z"))
    both = applied.withColumn("f", invert_representation(F.col("z"), fitted))
    rows = both.select("crop_id", F.posexplode(F.arrays_zip("z", "f")).alias("i", "e"))
    return rows.select(
        "crop_id",
        "i",
        r6(F.col("e.z"), 5).alias("z"),
        r6(F.col("e.f")).alias("v"),
        r6(F.lit(fitted.global_scale), 8).alias("scale"),
        F.lit(fitted.n_train).cast("bigint").alias("n_train"),
    )


# Opponent features of the crops without their channel means.
_CROP_FEATURES = (
    f"{RGB_LONG}, {CROP_LONG}, cp AS (SELECT crop_id, label, i // 3 AS p, max(v) FILTER (i % 3 = 0) AS r, "
    "max(v) FILTER (i % 3 = 1) AS g, max(v) FILTER (i % 3 = 2) AS b FROM cr GROUP BY ALL), "
    "cf AS MATERIALIZED (SELECT crop_id, label, CAST(3 * p + c AS INTEGER) AS i, o - avg(o) OVER (PARTITION BY crop_id, c) AS v FROM "
    "(SELECT crop_id, label, p, unnest([0, 1, 2]) AS c, unnest([(r + g + b) / sqrt(3.0), (r - g) / sqrt(2.0), "
    "(r + g - 2 * b) / sqrt(6.0)]) AS o FROM cp))"
)
_FIT_SQL = f"""
WITH {LONG}, {_CROP_FEATURES}, {_whitened_sql("cf", "crop_id", 12, 30)},
s AS (SELECT sqrt(avg(v * v)) AS scale, count(DISTINCT crop_id) AS n_train FROM cf WHERE label < 7)
SELECT crop_id, i, {r6_sql("w / scale", 5)} AS z, {r6_sql("v")} AS v, {r6_sql("scale", 8)} AS scale, n_train
FROM wh JOIN cf USING (crop_id, i), s
"""


def snr_sigma(spark: SparkSession, directory: str) -> DataFrame:
    events = read_table(spark, directory, "events", "value")
    levels = features.sigma_for_snr(events, "value", 0.0, 3.0, 6.0)
    return levels.select("snr_db", r6(F.col("sigma")).alias("sigma"))


_SIGMA_SQL = f"""
SELECT db AS snr_db, {r6_sql("sqrt(var_pop(value) / pow(10, db / 10))")} AS sigma
FROM events, (VALUES (0.0::DOUBLE), (3.0::DOUBLE), (6.0::DOUBLE)) t(db) GROUP BY db
"""


def _noisy_events(spark: SparkSession, directory: str) -> DataFrame:
    events = read_table(spark, directory, "events", "event_id", "value", spread=True)
    return noise.add_awgn_snr(events, "value", 3.0, 11, "event_id")


def awgn(spark: SparkSession, directory: str) -> DataFrame:
    noisy = _noisy_events(spark, directory)
    fixed = noise.add_awgn_sigma(F.col("value"), 0.5, 12, F.col("event_id"))
    return noisy.select(
        "event_id", r6(F.col("sigma")).alias("sigma"), r6(F.col("noisy")).alias("noisy"), r6(fixed).alias("fixed")
    )


_NOISY = (
    "s AS (SELECT sqrt(var_pop(value) / pow(10, 0.3)) AS sigma FROM events), "
    f"n AS (SELECT event_id, value, sigma, value + sigma * {normal_sql('d11')} AS noisy, "
    f"value + 0.5 * {normal_sql('d12')} AS fixed FROM "
    "(SELECT *, sha256('11|' || event_id) AS d11, sha256('12|' || event_id) AS d12 FROM events, s))"
)


def awgn_vectors(spark: SparkSession, directory: str) -> DataFrame:
    """Per-role calibrated noise on embedding vectors."""
    e = embeddings(spark, directory, spread=True)
    noisy = noise.add_awgn_snr_vectors(e, "f", 6.0, 5, "vec_id", by=("role",))
    return entries(noisy, "noisy", "vec_id", "sigma").withColumn("sigma", r6(F.col("sigma")))


_AWGN_VECTORS_SQL = f"""
WITH {LONG}, r AS (SELECT *, CASE WHEN label < 7 THEN 0 WHEN label < 9 THEN 1 ELSE 2 END AS role,
  sha256('5|' || vec_id || '|' || i) AS d FROM e),
s AS (SELECT role, sqrt(var_pop(v) / pow(10, 0.6)) AS sigma FROM r GROUP BY role)
SELECT vec_id, i, {r6_sql(f"v + sigma * {normal_sql('d')}")} AS v, {r6_sql("sigma")} AS sigma FROM r JOIN s USING (role)
"""


def snr_measured(spark: SparkSession, directory: str) -> DataFrame:
    noisy = _noisy_events(spark, directory)
    return features.measured_snr_db(noisy, "value", "noisy").select(r6(F.col("snr_db")).alias("snr_db"))


def histogram(spark: SparkSession, directory: str) -> DataFrame:
    counts = audit.channel_histograms(
        rgb_patches(spark, directory), "f", 3, bins=16, low=-0.25, high=0.25
    )
    return counts.withColumn("low_edge", r6(F.col("low_edge")))


_HISTOGRAM_SQL = f"""
WITH {LONG}, {RGB_LONG}, cells AS (SELECT CAST(c AS INTEGER) AS c, CAST(b AS INTEGER) AS bin, -0.25 + b * 0.03125::DOUBLE AS lo
  FROM range(3) r(c), range(16) s(b))
SELECT c, bin, {r6_sql("lo")} AS low_edge, count(e.v) AS n
FROM cells LEFT JOIN x e ON e.i % 3 = c AND e.v >= lo AND (e.v < lo + 0.03125 OR (bin = 15 AND e.v <= 0.25))
GROUP BY c, bin, lo
"""


def power(spark: SparkSession, directory: str) -> DataFrame:
    rows = audit.patch_power(rgb_patches(spark, directory), "f")
    return rows.select("key", r6(F.col("value"), 9).alias("value"))


_POWER_SQL = f"""
WITH {LONG}, {RGB_LONG}, p AS (SELECT vec_id, avg(v * v) AS p FROM x GROUP BY vec_id)
SELECT 'mean' AS key, {r6_sql("avg(p)", 9)} AS value FROM p
UNION ALL SELECT 'median', {r6_sql("quantile_cont(p, 0.5)", 9)} FROM p
UNION ALL SELECT 'p05', {r6_sql("quantile_cont(p, 0.05)", 9)} FROM p
UNION ALL SELECT 'p95', {r6_sql("quantile_cont(p, 0.95)", 9)} FROM p
"""


def event_percentiles(spark: SparkSession, directory: str) -> DataFrame:
    """The bracketing percentile search, forced by a small in-memory bound."""
    events = read_table(spark, directory, "events", "value")
    quantiles = [0.05, 0.5, 0.95, 0.999]
    found = audit.exact_percentiles(events, "value", quantiles, in_memory=500)
    pairs = [(q, v) for q, v in zip(quantiles, found, strict=True)]
    return spark.createDataFrame(pairs, "q double, value double").withColumn("value", r6(F.col("value")))


_PERCENTILE_SQL = " UNION ALL ".join(
    f"SELECT {q}::DOUBLE AS q, {r6_sql(f'quantile_cont(value, {q})')} AS value FROM events"
    for q in (0.05, 0.5, 0.95, 0.999)
)


def moments(spark: SparkSession, directory: str) -> DataFrame:
    e = features.global_normalize(embeddings(spark, directory).withColumn("raw", F.col("f")), "f")
    return audit.before_after(e, "raw", "f").select("key", r6(F.col("value")).alias("value"))


def _moments_sql(prefix: str, value: str) -> str:
    parts = (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max"))
    return " UNION ALL ".join(
        f"SELECT '{prefix}.{name}' AS key, {r6_sql(f'{fn}({value})')} AS value FROM e, s" for name, fn in parts
    )


_MOMENTS_SQL = f"""
WITH {LONG}, s AS (SELECT sqrt(avg(v * v)) AS scale FROM e)
{_moments_sql("before", "v")} UNION ALL {_moments_sql("after", "v / scale")}
"""


def _sides(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    e = embeddings(spark, directory)
    return e.filter(F.col("role") == "train"), e.filter(F.col("role") == "test")


def nn_cosine(spark: SparkSession, directory: str) -> DataFrame:
    """Every test row against every train row."""
    train, test = _sides(spark, directory)
    best = nearest_cosine(train, test, "f", "vec_id", max_pairs=None)
    return best.select("vec_id", r6(F.col("cosine")).alias("cosine"))


def nn_cosine_cells(spark: SparkSession, directory: str) -> DataFrame:
    """The same through pivot cells, as beyond the broadcast bound."""
    train, test = _sides(spark, directory)
    best = nearest_cosine(train, test, "f", "vec_id", max_pairs=None, broadcast_rows=0)
    return best.select("vec_id", r6(F.col("cosine")).alias("cosine"))


def nn_cosine_first(spark: SparkSession, directory: str) -> DataFrame:
    """The audit's bounded form: the first rows of each side in key order."""
    train, test = _sides(spark, directory)
    best = nearest_cosine(train, test, "f", "vec_id", max_pairs=512)
    return best.agg(
        r6(F.max("cosine")).alias("max_nearest_cosine"), r6(F.avg("cosine")).alias("mean_nearest_cosine")
    )


_COSINE = (
    "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / "
    "(sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * "
    "sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"
)
_NN_SQL = f"""
SELECT a.vec_id, {r6_sql(f"max({_COSINE})")} AS cosine
FROM embeddings a, embeddings b WHERE a.label >= 9 AND b.label < 7 GROUP BY a.vec_id
"""
_NN_FIRST_SQL = f"""
WITH tr AS (SELECT * FROM embeddings WHERE label < 7 ORDER BY vec_id LIMIT 512),
te AS (SELECT * FROM embeddings WHERE label >= 9 ORDER BY vec_id LIMIT 512),
n AS (SELECT a.vec_id, max({_COSINE}) AS c FROM te a, tr b GROUP BY a.vec_id)
SELECT {r6_sql("max(c)")} AS max_nearest_cosine, {r6_sql("avg(c)")} AS mean_nearest_cosine FROM n
"""


def audit_metrics(spark: SparkSession, directory: str) -> DataFrame:
    """The whole audit of the crops in tall form."""
    tagged = rgb_crops(spark, directory).withColumn("feat", features.opponent_dc_features(F.col("f")))
    train, test = tagged.filter(F.col("role") == "train"), tagged.filter(F.col("role") == "test")
    stats = fit_whitening(train, "feat", width=12)
    metrics = audit.audit_metrics(train, "f", train, test, "feat", "crop_id", stats, low=-0.25, high=0.25, bins=8)
    return metrics.select("metric", "key", r6(F.col("value"), 5).alias("value"))


_AUDIT_SQL = f"""
WITH {LONG}, {_CROP_FEATURES}, {_whitened_sql("cf", "crop_id", 12, 30)}, {_OFF.format("crop_id")},
t AS (SELECT * FROM cr WHERE label < 7),
p AS (SELECT avg(v * v) AS p FROM t GROUP BY crop_id),
ft AS (SELECT v FROM cf WHERE label < 7), aft AS (SELECT w AS v FROM wh WHERE label < 7),
u AS MATERIALIZED (SELECT crop_id, label, list(v / n ORDER BY i) AS u
  FROM (SELECT *, greatest(sqrt(sum(v * v) OVER (PARTITION BY crop_id)), 1e-12) AS n FROM cf) GROUP BY ALL),
nn AS (SELECT max(list_dot_product(te.u, tr.u)) AS c FROM u te, u tr WHERE te.label >= 9 AND tr.label < 7 GROUP BY te.crop_id),
h AS (SELECT c, b, count(t.v) AS n FROM range(3) r(c), range(8) s(b) LEFT JOIN t ON t.i % 3 = c AND t.v >= -0.25 + b * 0.0625
  AND (t.v < -0.25 + (b + 1) * 0.0625 OR (b = 7 AND t.v <= 0.25)) GROUP BY ALL)
SELECT 'counts' AS metric, 'n_train_features' AS key, {r6_sql("count(*)::DOUBLE")} AS value FROM u WHERE label < 7
UNION ALL SELECT 'counts', 'n_test_features', {r6_sql("count(*)::DOUBLE")} FROM u WHERE label >= 9
UNION ALL SELECT 'channel_histograms', 'c' || c || '.bin' || lpad(CAST(b AS VARCHAR), 4, '0'), {r6_sql("n::DOUBLE")} FROM h
UNION ALL SELECT 'patch_power', 'mean', {r6_sql("avg(p)", 5)} FROM p
UNION ALL SELECT 'patch_power', 'median', {r6_sql("quantile_cont(p, 0.5)", 5)} FROM p
UNION ALL SELECT 'patch_power', 'p05', {r6_sql("quantile_cont(p, 0.05)", 5)} FROM p
UNION ALL SELECT 'patch_power', 'p95', {r6_sql("quantile_cont(p, 0.95)", 5)} FROM p
UNION ALL SELECT 'whitening_covariance', 'max_abs_off_identity', {r6_sql("max(o)", 5)} FROM off
UNION ALL SELECT 'whitening_covariance', 'mean_abs_off_identity', {r6_sql("avg(o)", 5)} FROM off
UNION ALL SELECT 'train_test_similarity', 'max_nearest_cosine', {r6_sql("max(c)", 5)} FROM nn
UNION ALL SELECT 'train_test_similarity', 'mean_nearest_cosine', {r6_sql("avg(c)", 5)} FROM nn
{"".join(
    f"UNION ALL SELECT 'whitening_before_after', '{when}.{name}', {r6_sql(f'{fn}(v)', 5)} FROM {table} "
    for when, table in (("before", "ft"), ("after", "aft"))
    for name, fn in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max"))
)}
"""


def noise_scopes(spark: SparkSession, directory: str) -> DataFrame:
    """Users as trajectories, events as steps, one edge per event type and hour."""
    edges = read_table(spark, directory, "events", spread=True).select(
        F.col("user_id").alias("trajectory"),
        F.col("event_id").alias("step"),
        F.ascii("event_type").alias("src"),
        F.hour("ts").alias("dst"),
    )
    fixed = noise.uniform_weight_noise(edges.select("src", "dst").distinct(), 0.25, 4)
    # One scan: each kind of draw becomes a column, and the columns are unfolded.
    drawn = edges
    for scope in noise.SCOPES:
        table = fixed if scope == "fixed" else None
        drawn = noise.scoped_weight_noise(drawn, scope, 0.5, 3, fixed=table).withColumnRenamed("noise", scope)
    drawn = noise.state_noise(drawn, 0.1, 6, "trajectory", "step").withColumnRenamed("noise", "state")
    kinds = [F.struct(F.lit(k).alias("scope"), F.col(k).alias("noise")) for k in (*noise.SCOPES, "state")]
    rows = drawn.select("trajectory", "step", "src", "dst", F.inline(F.array(*kinds)))
    return rows.withColumn("noise", r6(F.col("noise")))


_SCOPES_SQL = f"""
WITH g AS (SELECT user_id AS trajectory, event_id AS step, ascii(event_type) AS src, CAST(hour(ts) AS INTEGER) AS dst FROM events)
SELECT 'per_step' AS scope, *, {r6_sql(f"0.5 * {normal_sql('''sha256('3|' || trajectory || '|' || step || '|' || src || '|' || dst)''')}")} AS noise FROM g
UNION ALL SELECT 'per_trajectory', *, {r6_sql(f"0.5 * {normal_sql('''sha256('3|' || trajectory || '|' || src || '|' || dst)''')}")} FROM g
UNION ALL SELECT 'fixed', *, {r6_sql(f"(2 * {uniform_sql('''sha256('4|' || src || '|' || dst)''')} - 1) * 0.25")} FROM g
UNION ALL SELECT 'state', *, {r6_sql(f"0.1 * {normal_sql('''sha256('6|' || trajectory || '|' || step)''')}")} FROM g
"""

BOUND = {
    "srgb": Bound(srgb, _SRGB_SQL),
    "opponent": Bound(opponent, _OPPONENT_SQL),
    "dc_remove": Bound(dc_remove, _DC_SQL),
    "opponent_features": Bound(
        opponent_features, f"WITH {LONG}, {_PIXELS}, {_OPPONENT}, {_FEATURES} SELECT vec_id, i, {r6_sql('v')} AS v FROM fe"
    ),
    "global_rms": Bound(global_rms, _GLOBAL_SQL),
    "row_rms": Bound(row_rms, _ROW_SQL),
    "cov_matrix": Bound(cov_matrix, _COV_SQL),
    "whiten_roundtrip": Bound(whiten_roundtrip, _ROUNDTRIP_SQL),
    "whiten_blocks": Bound(whiten_blocks, _ROUNDTRIP_SQL),
    "whiten_pairs": Bound(whiten_pairs, _PAIRS_SQL),
    "whiten_check": Bound(whiten_check, _WHITEN_SQL),
    "representation_fit_apply": Bound(representation_fit_apply, _FIT_SQL),
    "snr_sigma": Bound(snr_sigma, _SIGMA_SQL),
    "snr_measured": Bound(
        snr_measured,
        f"WITH {_NOISY} SELECT {r6_sql('10 * log10(var_pop(value) / avg((noisy - value) * (noisy - value)))')} AS snr_db FROM n",
    ),
    "awgn": Bound(
        awgn,
        f"WITH {_NOISY} SELECT event_id, {r6_sql('sigma')} AS sigma, {r6_sql('noisy')} AS noisy, {r6_sql('fixed')} AS fixed FROM n",
    ),
    "awgn_vectors": Bound(awgn_vectors, _AWGN_VECTORS_SQL),
    "noise_scopes": Bound(noise_scopes, _SCOPES_SQL),
    "histogram": Bound(histogram, _HISTOGRAM_SQL),
    "power": Bound(power, _POWER_SQL),
    "event_percentiles": Bound(event_percentiles, _PERCENTILE_SQL),
    "moments": Bound(moments, _MOMENTS_SQL),
    "nn_cosine": Bound(nn_cosine, _NN_SQL),
    "nn_cosine_cells": Bound(nn_cosine_cells, _NN_SQL),
    "nn_cosine_first": Bound(nn_cosine_first, _NN_FIRST_SQL),
    "audit_metrics": Bound(audit_metrics, _AUDIT_SQL),
}
