"""Dictionary model, group penalties and finite inference over the embeddings.

Atoms are the normalised label means, codes are projections on them, and the group weights come
from a keyed draw; ten atoms and four groups keep the SQL statements readable.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.keyed import keyed_normal
from tessella.operators import blocks, inference, sparse
from tessella.plans.bindings.common import LONG, Bound, embeddings, entries, normal_sql, r6_sql, uniform_sql
from tessella.plans.dictionary_fit import fit_dictionary, versions
from tessella.session import bounded_matrix, checkpoint_folder, r6

GROUPS, ATOMS = 4, 10
EPS = 1e-6
ETA, WEIGHT = 0.3, 0.05


def atom_table(spark: SparkSession, directory: str) -> DataFrame:
    """Unit-length label means as ``(n, m, w)``."""
    means = (
        embeddings(spark, directory)
        .select(F.col("label").alias("m"), F.posexplode("f").alias("n", "v"))
        .groupBy("n", "m")
        .agg(F.avg("v").alias("w"))
    )
    return sparse.normalize_columns(means)


def group_table(spark: SparkSession) -> DataFrame:
    cells = spark.range(GROUPS * ATOMS).select(
        F.floor(F.col("id") / ATOMS).cast("int").alias("k"), (F.col("id") % ATOMS).cast("int").alias("m")
    )
    raw = cells.withColumn("w", keyed_normal("groups", F.col("k"), F.col("m")))
    return sparse.softplus_groups(raw)


def _model(spark: SparkSession, directory: str) -> tuple[np.ndarray, np.ndarray]:
    phi = bounded_matrix(atom_table(spark, directory), "n", "m", "w")
    return phi, bounded_matrix(group_table(spark), "k", "m", "w")


def _coded(spark: SparkSession, directory: str) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    phi, lam = _model(spark, directory)
    e = embeddings(spark, directory)
    return e.withColumn("s", sparse.project(F.col("f"), phi)), phi, lam


_PHI = (
    "mean AS (SELECT i, label AS m, avg(v) AS w FROM e GROUP BY ALL), "
    "phi AS (SELECT i, m, w / sqrt(sum(w * w) OVER (PARTITION BY m)) AS w FROM mean)"
)
_RAW = (
    "SELECT CAST(k AS INTEGER) AS k, CAST(m AS INTEGER) AS m, "
    + normal_sql("sha256('groups|' || k || '|' || m)")
    + f" AS w FROM range({GROUPS}) a(k), range({ATOMS}) b(m)"
)
_LAM = (
    f"pos AS (SELECT k, m, greatest(w, 0.0::DOUBLE) + ln(1 + exp(-abs(w))) AS w FROM ({_RAW})), "
    "lam AS (SELECT k, m, w / sum(w) OVER (PARTITION BY k) AS w FROM pos)"
)
_CODE = "code AS (SELECT vec_id, m, sum(v * w) AS s FROM e JOIN phi USING (i) GROUP BY ALL)"
_BASE = f"WITH {LONG}, {_PHI}, {_LAM}, {_CODE}"
_RECON = (
    "rec AS (SELECT vec_id, i, any_value(v) AS x, sum(w * s) AS xh FROM code JOIN phi USING (m) JOIN e USING (vec_id, i) GROUP BY ALL)"
)
_Z = f"z AS (SELECT vec_id, k, sqrt({EPS} + sum(w * s * s)) AS z FROM code JOIN lam USING (m) GROUP BY ALL)"


def normalize_atoms(spark: SparkSession, directory: str) -> DataFrame:
    return atom_table(spark, directory).withColumn("w", r6(F.col("w")))


def softplus_groups(spark: SparkSession, directory: str) -> DataFrame:
    """Raw weights from label pairs: log ratios of their row counts."""
    counts = embeddings(spark, directory).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    raw = counts.select(
        F.explode(F.sequence(F.lit(0), F.lit(GROUPS - 1))).alias("k"), F.col("label").alias("m"), "n"
    ).withColumn("w", F.log(F.col("n") / 50.0) * (F.col("k") * 4 - 6))
    lam = sparse.softplus_groups(raw)
    bound = sparse.penalty_lipschitz_table(lam, WEIGHT, EPS).scalar()
    return lam.select("k", "m", r6(F.col("w")).alias("w"), r6(bound).alias("bound"))


_SOFTPLUS_SQL = f"""
WITH c AS (SELECT label AS m, count(*) AS n FROM embeddings GROUP BY label),
raw AS (SELECT CAST(k AS INTEGER) AS k, m, ln(n / 50.0::DOUBLE) * (k * 4 - 6) AS w FROM c, range({GROUPS}) r(k)),
pos AS (SELECT k, m, greatest(w, 0.0::DOUBLE) + ln(1 + exp(-abs(w))) AS w FROM raw),
lam AS (SELECT k, m, w / sum(w) OVER (PARTITION BY k) AS w FROM pos)
SELECT k, m, {r6_sql("w")} AS w, {r6_sql(f"(SELECT max(t) FROM (SELECT sum(w) AS t FROM lam GROUP BY m)) * {WEIGHT} / sqrt({EPS})")} AS bound FROM lam
"""


def reconstruct(spark: SparkSession, directory: str) -> DataFrame:
    coded, phi, _ = _coded(spark, directory)
    return entries(coded.select("vec_id", sparse.reconstruct(F.col("s"), phi).alias("xh")), "xh", "vec_id")


def data_gradient(spark: SparkSession, directory: str) -> DataFrame:
    coded, phi, _ = _coded(spark, directory)
    half = coded.withColumn("s", F.transform("s", lambda v: v * 0.5))
    return entries(
        half.select("vec_id", sparse.data_gradient(F.col("f"), F.col("s"), phi).alias("g")), "g", "vec_id", index="m"
    )


_GRADIENT_SQL = f"""
{_BASE}, r AS (SELECT vec_id, i, sum(w * s * 0.5) - any_value(v) AS r FROM code JOIN phi USING (m) JOIN e USING (vec_id, i) GROUP BY ALL)
SELECT vec_id, m, {r6_sql("sum(w * r)")} AS v FROM r JOIN phi USING (i) GROUP BY ALL
"""


def recon_error(spark: SparkSession, directory: str) -> DataFrame:
    coded, phi, _ = _coded(spark, directory)
    loss = sparse.denoising_loss(coded, "f", "s", phi).scalar()
    error = sparse.reconstruction_error(F.col("f"), F.col("s"), phi)
    return coded.select("vec_id", r6(error).alias("error"), r6(loss).alias("loss"))


_ERROR_SQL = f"""
{_BASE}, {_RECON}, r AS (SELECT vec_id, sum((x - xh) * (x - xh)) AS q FROM rec GROUP BY vec_id)
SELECT vec_id, {r6_sql("q / 2")} AS error, {r6_sql("avg(q) OVER ()")} AS loss FROM r
"""


def dict_grad(spark: SparkSession, directory: str) -> DataFrame:
    coded, phi, _ = _coded(spark, directory)
    table = sparse.dictionary_gradient(coded, "f", "s", phi)
    return entries(table, "row", "i", index="m", value="g")


def dict_grad_blocks(spark: SparkSession, directory: str) -> DataFrame:
    """The same gradient through blocks of 16 x 16."""
    coded, phi, _ = _coded(spark, directory)
    cells = [(i, m, float(w)) for (i, m), w in np.ndenumerate(phi)]
    dictionary = blocks.from_entries(spark.createDataFrame(cells, "i int, j int, v double"), *phi.shape, size=16)
    gradient = blocks.dictionary_gradient(coded, "f", "s", dictionary).entries()
    return gradient.select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("m"), r6(F.col("v")).alias("g"))


_DICT_GRAD_SQL = f"""
{_BASE}, {_RECON}
SELECT i, m, {r6_sql("sum((x - xh) * s)")} AS g FROM rec JOIN code USING (vec_id) GROUP BY ALL
"""


def group_activity(spark: SparkSession, directory: str) -> DataFrame:
    coded, _, lam = _coded(spark, directory)
    rows = coded.select("vec_id", sparse.group_activity(F.col("s"), lam, EPS).alias("z"))
    return entries(rows, "z", "vec_id", index="k")


def group_penalty(spark: SparkSession, directory: str) -> DataFrame:
    coded, _, lam = _coded(spark, directory)
    return coded.select("vec_id", r6(sparse.group_penalty(F.col("s"), lam, EPS)).alias("omega"))


def group_gradient(spark: SparkSession, directory: str) -> DataFrame:
    coded, _, lam = _coded(spark, directory)
    rows = coded.select("vec_id", sparse.group_penalty_gradient(F.col("s"), lam, EPS).alias("g"))
    return entries(rows, "g", "vec_id", index="m")


def group_weight_gradient(spark: SparkSession, directory: str) -> DataFrame:
    coded, _, lam = _coded(spark, directory)
    rows = entries(
        coded.select("vec_id", sparse.group_weight_gradient(F.col("s"), lam, EPS).alias("g")), "g", "vec_id", index="at"
    )
    return rows.select(
        "vec_id", F.floor(F.col("at") / ATOMS).cast("int").alias("k"), (F.col("at") % ATOMS).alias("m"), "v"
    )


def group_weight_gradient_mean(spark: SparkSession, directory: str) -> DataFrame:
    coded, _, lam = _coded(spark, directory)
    rows = sparse.mean_group_weight_gradient(coded, "s", lam, EPS)
    return rows.select("k", F.col("i").alias("m"), r6(F.col("grad")).alias("grad"))


_WEIGHT_JOIN = f"{_BASE}, {_Z}, q AS (SELECT vec_id, k, m, s * s / (2 * z) AS g FROM z JOIN code USING (vec_id))"


def _step_sql(number: int, legacy: bool, eta: float | str = ETA, eps: float = EPS) -> str:
    """One inference step as four named queries, from ``s{number}`` to ``s{number + 1}``."""
    prev, n = f"s{number}", number
    moved = f"s - {eta} * g"
    if legacy:
        theta = f"{eta} * {WEIGHT} * cp"
        update = f"sign({moved}) * greatest(abs({moved}) - {theta}, 0.0::DOUBLE)"
    else:
        update = f"s - {eta} * (g + {WEIGHT} * s * cp)"
    return (
        f"r{n} AS (SELECT vec_id, i, sum(w * s) - any_value(v) AS r FROM {prev} JOIN phi USING (m) JOIN e USING (vec_id, i) GROUP BY ALL), "
        f"g{n} AS (SELECT vec_id, m, sum(w * r) AS g FROM r{n} JOIN phi USING (i) GROUP BY ALL), "
        f"z{n} AS (SELECT vec_id, k, sqrt({eps} + sum(w * s * s)) AS z FROM {prev} JOIN lam USING (m) GROUP BY ALL), "
        f"c{n} AS (SELECT vec_id, m, sum(w / z) AS cp FROM z{n} JOIN lam USING (k) GROUP BY ALL), "
        f"s{n + 1} AS (SELECT vec_id, m, {update} AS s FROM {prev} JOIN g{n} USING (vec_id, m) JOIN c{n} USING (vec_id, m))"
    )


def _infer_sql(steps: int, legacy: bool) -> str:
    chain = ", ".join(_step_sql(k, legacy) for k in range(steps))
    start = f"s0 AS (SELECT vec_id, CAST(m AS INTEGER) AS m, 0.0::DOUBLE AS s FROM embeddings, range({ATOMS}) r(m))"
    return f"{_BASE}, {start}, {chain}"


def _inferred(spark: SparkSession, directory: str, variant: str, steps: int) -> DataFrame:
    phi, lam = _model(spark, directory)
    code = inference.infer(
        variant, F.col("f"), phi, lam, n_steps=steps, eta=ETA, penalty_weight=WEIGHT, eps=EPS
    )
    return embeddings(spark, directory).select("vec_id", code.alias("s"))


def infer_smooth(spark: SparkSession, directory: str) -> DataFrame:
    return entries(_inferred(spark, directory, "smooth_gradient", 3), "s", "vec_id", index="m", value="s")


def infer_legacy(spark: SparkSession, directory: str) -> DataFrame:
    rows = _inferred(spark, directory, "legacy_adaptive_threshold", 3)
    return entries(rows, "s", "vec_id", index="m", value="s")


def infer_resumed(spark: SparkSession, directory: str) -> DataFrame:
    """Two steps, then one more from the stored code: the same as three."""
    phi, lam = _model(spark, directory)
    options = {"eta": ETA, "penalty_weight": WEIGHT, "eps": EPS}
    e = embeddings(spark, directory)
    first = e.withColumn("s", inference.infer("smooth_gradient", F.col("f"), phi, lam, n_steps=2, **options))
    more = inference.infer("smooth_gradient", F.col("f"), phi, lam, n_steps=1, start=F.col("s"), **options)
    return entries(first.select("vec_id", more.alias("s")), "s", "vec_id", index="m", value="s")


def dictionary_step(spark: SparkSession, directory: str) -> DataFrame:
    phi, lam = _model(spark, directory)
    moved = inference.dictionary_step(
        embeddings(spark, directory), "f", phi, lam, rate=0.5, n_steps=2, eta=ETA, penalty_weight=WEIGHT, eps=EPS
    )
    table = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(moved)], "i int, row array<double>")
    return entries(table, "row", "i", index="m", value="w")


_STEP_SQL = f"""
{_infer_sql(2, False)},
rec2 AS (SELECT vec_id, i, any_value(v) - sum(w * s) AS r FROM s2 JOIN phi USING (m) JOIN e USING (vec_id, i) GROUP BY ALL),
grad AS (SELECT i, m, sum(r * s) / count(*) AS g FROM rec2 JOIN s2 USING (vec_id) GROUP BY ALL),
moved AS (SELECT i, m, w + 0.5 * g AS w FROM phi JOIN grad USING (i, m))
SELECT i, m, {r6_sql("w / sqrt(sum(w * w) OVER (PARTITION BY m))")} AS w FROM moved
"""


def dictionary_fit(spark: SparkSession, directory: str) -> DataFrame:
    """Two steps of a fit, then a third by a run that resumes it: every version that was stored."""
    phi, lam = _model(spark, directory)
    root = f"{checkpoint_folder(spark)}/dictionary-{uuid.uuid4().hex}"
    rows = embeddings(spark, directory)
    for steps in (2, 3):
        fit_dictionary(
            rows, "vec_id", "f", phi, lam, root=root, steps=steps, batches=2, rate=0.5, n_steps=2, eta=ETA, penalty_weight=WEIGHT, eps=EPS
        )
    stored = versions(spark, root).filter("version > 0")
    wide = stored.select("version", r6(F.col("objective")).alias("objective"), "n_rows", F.posexplode("phi").alias("i", "row"))
    return wide.select("version", "objective", "n_rows", "i", F.posexplode("row").alias("m", "w")).withColumn("w", r6(F.col("w")))


def _fit_step_sql(k: int) -> str:
    """CTEs from ``phi{k}`` to ``phi{k + 1}``, learned from one of two keyed batches."""
    at = 10 * k
    chain = ", ".join(_step_sql(at + j, False) for j in range(2))
    chain = chain.replace("JOIN phi ", f"JOIN phi{k} ").replace("JOIN e ", f"JOIN e{k} ")
    return f"""
e{k} AS MATERIALIZED (SELECT * FROM e WHERE floor({uniform_sql("sha256('batch|' || vec_id)")} * 2) = {k % 2}),
s{at} AS (SELECT vec_id, CAST(m AS INTEGER) AS m, 0.0::DOUBLE AS s FROM (SELECT DISTINCT vec_id FROM e{k}), range({ATOMS}) r(m)), {chain},
rec{k} AS MATERIALIZED (SELECT vec_id, i, any_value(v) - sum(w * s) AS r FROM s{at + 2} JOIN phi{k} USING (m) JOIN e{k} USING (vec_id, i) GROUP BY ALL),
obj{k} AS (SELECT sum(r * r) / 2 / count(DISTINCT vec_id) AS objective, count(DISTINCT vec_id) AS n_rows FROM rec{k}),
grad{k} AS (SELECT i, m, sum(r * s) / count(*) AS g FROM rec{k} JOIN s{at + 2} USING (vec_id) GROUP BY ALL),
phi{k + 1} AS MATERIALIZED (SELECT i, m, w / sqrt(sum(w * w) OVER (PARTITION BY m)) AS w FROM
  (SELECT i, m, w + 0.5 * g AS w FROM phi{k} JOIN grad{k} USING (i, m)))"""


_FIT_SQL = f"""
{_BASE}, phi0 AS MATERIALIZED (SELECT * FROM phi), {", ".join(_fit_step_sql(k) for k in range(3))}
{" UNION ALL ".join(f"SELECT {k + 1} AS version, {r6_sql('objective')} AS objective, n_rows, i, m, {r6_sql('w')} AS w FROM phi{k + 1}, obj{k}" for k in range(3))}
"""


def sparse_code_batch(spark: SparkSession, directory: str) -> DataFrame:
    """Fifty stable steps: the mean objective after the first few, and how many rows it ever rose for."""
    phi, lam = _model(spark, directory)
    eta = inference.step_size(phi, lam, WEIGHT, eps=1e-3)
    options = {"eta": eta, "penalty_weight": WEIGHT, "eps": 1e-3}
    coded = embeddings(spark, directory)
    for steps in (0, 1, 3, 25, 50):
        code = inference.infer("smooth_gradient", F.col("f"), phi, lam, n_steps=steps, **options)
        value = inference.objective(F.col("f"), code, phi, lam, WEIGHT, 1e-3)
        coded = coded.withColumn(f"o{steps}", value)
    return coded.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("o25") > F.col("o0") + 1e-12).alias("rose_early"),
        F.count_if(F.col("o50") > F.col("o25") + 1e-12).alias("rose_late"),
        r6(F.avg("o0")).alias("start"),
        r6(F.avg("o1")).alias("after_1"),
        r6(F.avg("o3")).alias("after_3"),
        r6(F.lit(eta)).alias("eta"),
    )


def _top_eigenvalue_sql(squarings: int = 12) -> str:
    """CTEs up to ``top(v)``, the largest eigenvalue of the atoms' Gram matrix, by repeated squaring."""
    parts = ["g_0 AS MATERIALIZED (SELECT a.m AS i, b.m AS j, sum(a.w * b.w) AS v FROM phi a JOIN phi b USING (i) GROUP BY a.m, b.m)"]
    for k in range(squarings):
        product = f"SELECT p.i, q.j, sum(p.v * q.v) AS v FROM g_{k} p JOIN g_{k} q ON p.j = q.i GROUP BY p.i, q.j"
        parts.append(f"g_{k + 1} AS MATERIALIZED (SELECT i, j, v / sqrt(sum(v * v) OVER ()) AS v FROM ({product}))")
    last = f"g_{squarings}"
    parts.append(
        f"top AS MATERIALIZED (SELECT (SELECT sum(p.v * q.v) FROM g_0 p JOIN {last} q ON p.i = q.j AND p.j = q.i) / "
        f"(SELECT sum(v) FROM {last} WHERE i = j) AS v)"
    )
    return ", ".join(parts)


def _objective_sql(step: int) -> str:
    """Mean objective of the codes ``s{step}``."""
    fit = (
        f"SELECT vec_id, sum(r * r) / 2 AS o FROM (SELECT vec_id, i, any_value(v) - sum(w * s) AS r FROM s{step} JOIN phi USING (m) "
        "JOIN e USING (vec_id, i) GROUP BY ALL) GROUP BY vec_id"
    )
    active = (
        f"SELECT vec_id, sum(z) AS z FROM (SELECT vec_id, k, sqrt(1e-3 + sum(w * s * s)) AS z FROM s{step} JOIN lam USING (m) GROUP BY ALL) "
        "GROUP BY vec_id"
    )
    return f"(SELECT avg(o + {WEIGHT} * z) FROM ({fit}) JOIN ({active}) USING (vec_id))"


_BATCH_SQL = f"""
{_BASE}, {_top_eigenvalue_sql()},
eta AS MATERIALIZED (SELECT 1 / (v + {WEIGHT} * (SELECT max(t) FROM (SELECT sum(w) AS t FROM lam GROUP BY m)) / sqrt(1e-3)) AS eta FROM top),
s0 AS (SELECT vec_id, CAST(m AS INTEGER) AS m, 0.0::DOUBLE AS s FROM embeddings, range({ATOMS}) r(m)),
{", ".join(_step_sql(k, False, "(SELECT eta FROM eta)", 1e-3) for k in range(3))}
SELECT (SELECT count(*) FROM embeddings) AS n, 0::BIGINT AS rose_early, 0::BIGINT AS rose_late, {r6_sql(_objective_sql(0))} AS start,
  {r6_sql(_objective_sql(1))} AS after_1, {r6_sql(_objective_sql(3))} AS after_3, {r6_sql("(SELECT eta FROM eta)")} AS eta
"""

BOUND = {
    "normalize_atoms": Bound(normalize_atoms, f"WITH {LONG}, {_PHI} SELECT i AS n, m, {r6_sql('w')} AS w FROM phi"),
    "softplus_groups": Bound(softplus_groups, _SOFTPLUS_SQL),
    "reconstruct": Bound(reconstruct, f"{_BASE}, {_RECON} SELECT vec_id, i, {r6_sql('xh')} AS v FROM rec"),
    "data_gradient": Bound(data_gradient, _GRADIENT_SQL),
    "recon_error": Bound(recon_error, _ERROR_SQL),
    "dict_grad": Bound(dict_grad, _DICT_GRAD_SQL),
    "dict_grad_blocks": Bound(dict_grad_blocks, _DICT_GRAD_SQL),
    "group_activity": Bound(group_activity, f"{_BASE}, {_Z} SELECT vec_id, k, {r6_sql('z')} AS v FROM z"),
    "group_penalty": Bound(group_penalty, f"{_BASE}, {_Z} SELECT vec_id, {r6_sql('sum(z)')} AS omega FROM z GROUP BY vec_id"),
    "group_gradient": Bound(
        group_gradient,
        f"{_BASE}, {_Z}, c AS (SELECT vec_id, m, sum(w / z) AS c FROM z JOIN lam USING (k) GROUP BY ALL) "
        f"SELECT vec_id, m, {r6_sql('s * c')} AS v FROM code JOIN c USING (vec_id, m)",
    ),
    "group_weight_gradient": Bound(group_weight_gradient, f"{_WEIGHT_JOIN} SELECT vec_id, k, m, {r6_sql('g')} AS v FROM q"),
    "group_weight_gradient_mean": Bound(
        group_weight_gradient_mean, f"{_WEIGHT_JOIN} SELECT k, m, {r6_sql('avg(g)')} AS grad FROM q GROUP BY ALL"
    ),
    "infer_smooth": Bound(infer_smooth, f"{_infer_sql(3, False)} SELECT vec_id, m, {r6_sql('s')} AS s FROM s3"),
    "infer_legacy": Bound(infer_legacy, f"{_infer_sql(3, True)} SELECT vec_id, m, {r6_sql('s')} AS s FROM s3"),
    "infer_resumed": Bound(infer_resumed, f"{_infer_sql(3, False)} SELECT vec_id, m, {r6_sql('s')} AS s FROM s3"),
    "dictionary_step": Bound(dictionary_step, _STEP_SQL),
    "dictionary_fit": Bound(dictionary_fit, _FIT_SQL),
    "sparse_code_batch": Bound(sparse_code_batch, _BATCH_SQL),
}
