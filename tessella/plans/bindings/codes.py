"""Population codes, filter banks and edge-table matrices over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import population as pop
from tessella.functions import vectors as vec
from tessella.functions.gabor import gabor_bank
from tessella.operators import matrices
from tessella.plans.bindings.common import (
    DAY_FRACTION,
    LONG,
    Bound,
    day_fraction,
    derive,
    embeddings,
    entries,
    r6_sql,
)
from tessella.session import r6, read_table

UNITS, PLACE_WIDTH, RING_WIDTH = 12, 0.08, 0.1
_MIXED = pop.MixedCode(n_place=UNITS, n_periodic=6, frequency=3, width=PLACE_WIDTH)


def _located(spark: SparkSession, directory: str) -> DataFrame:
    return read_table(spark, directory, "events", "event_id", "ts", spread=True).select("event_id", day_fraction().alias("x"))


def place_code(spark: SparkSession, directory: str) -> DataFrame:
    located = _located(spark, directory)
    return entries(located.select("event_id", pop.place_code(F.col("x"), UNITS, PLACE_WIDTH).alias("f")), "f", "event_id")


def ring_code(spark: SparkSession, directory: str) -> DataFrame:
    """Phases shifted below zero, which wrap around."""
    located = _located(spark, directory)
    code = pop.ring_code(F.col("x") - 0.75, UNITS, RING_WIDTH)
    return entries(located.select("event_id", code.alias("f")), "f", "event_id")


def mixed_code(spark: SparkSession, directory: str) -> DataFrame:
    located = _located(spark, directory)
    return entries(located.select("event_id", pop.mixed_code(F.col("x"), _MIXED).alias("f")), "f", "event_id")


def decode_place(spark: SparkSession, directory: str) -> DataFrame:
    code = _located(spark, directory).withColumn("f", pop.mixed_code(F.col("x"), _MIXED))
    return code.select("event_id", r6(pop.decode_place(F.col("f"), UNITS)).alias("x_hat"))


_UNITS = f"u AS (SELECT event_id, {DAY_FRACTION} AS x, CAST(i AS INTEGER) AS i FROM events, range({{n}}) r(i))"


def _place_sql(x: str, i: str) -> str:
    return f"exp(-pow({x} - {i} / {UNITS - 1}.0::DOUBLE, 2) / (2 * {PLACE_WIDTH}::DOUBLE * {PLACE_WIDTH}::DOUBLE))"


def _ring_sql(q: str, i: str, n: int, width: float) -> str:
    gap = f"abs(({q}) - floor({q}) - ({i}) / {n}.0::DOUBLE)"
    return f"exp(-pow(least({gap}, 1 - {gap}), 2) / (2 * {width}::DOUBLE * {width}::DOUBLE))"


_PLACE_SQL = f"WITH {_UNITS.format(n=UNITS)} SELECT event_id, i, {r6_sql(_place_sql('x', 'i'))} AS v FROM u"
_RING_SQL = (
    f"WITH {_UNITS.format(n=UNITS)} SELECT event_id, i, "
    f"{r6_sql(_ring_sql('x - 0.75', 'i', UNITS, RING_WIDTH))} AS v FROM u"
)
_MIXED_SQL = (
    f"WITH {_UNITS.format(n=_MIXED.n_total)} SELECT event_id, i, CASE WHEN i < {UNITS} THEN {r6_sql(_place_sql('x', 'i'))} "
    f"ELSE {r6_sql(_ring_sql('3 * x', f'i - {UNITS}', 6, PLACE_WIDTH))} END AS v FROM u"
)
_DECODE_SQL = (
    f"WITH {_UNITS.format(n=UNITS)}, f AS (SELECT event_id, i, {_place_sql('x', 'i')} AS f FROM u) "
    f"SELECT event_id, {r6_sql(f'sum(f * i / {UNITS - 1}.0::DOUBLE) / greatest(sum(f), 1e-12)')} AS x_hat FROM f GROUP BY event_id"
)


def rectified_write(spark: SparkSession, directory: str) -> DataFrame:
    """Rectified embedding activity blended with the code of the row's own label."""
    e = embeddings(spark, directory)
    code = pop.place_code(F.col("label") / F.lit(9.0), 64, 0.2)
    activity = F.transform("f", lambda u: vec.log_rectifier(u, 1.5, 0.05, 4.0))
    shrunk = F.transform(vec.write_mix(activity, code, 0.25), lambda v: vec.soft_threshold(v, 0.1))
    return entries(e.select("vec_id", shrunk.alias("f")), "f", "vec_id")


_WRITE_SQL = f"""
WITH {LONG}, m AS (SELECT vec_id, i, 0.75 * (1.5 * ln(1 + 4 * greatest(v + 0.05, 0.0::DOUBLE)))
  + 0.25 * exp(-pow(label / 9.0::DOUBLE - i / 63.0::DOUBLE, 2) / 0.08) AS z FROM e)
SELECT vec_id, i, {r6_sql("sign(z) * greatest(abs(z) - 0.1, 0.0::DOUBLE)")} AS v FROM m
"""

# Filter parameters from parts; sizes run from 1 to 50.
_GABOR = {
    "p_partkey": "p_partkey",
    "amplitude": "p_retailprice / 1000",
    "t_x": "CAST(p_partkey % 5 AS DOUBLE)",
    "t_y": "CAST(p_partkey % 3 AS DOUBLE)",
    "theta": "CAST(p_partkey % 7 AS DOUBLE) / 2",
    "sigma_x": "CAST(p_size AS DOUBLE) / 10 + 0.5",
    "sigma_y": "CAST(p_partkey % 11 AS DOUBLE) / 4 + 0.5",
    "k": "CAST(p_partkey % 13 AS DOUBLE) / 3",
    "phi": "CAST(p_partkey % 17 AS DOUBLE) / 5",
}


def gabor(spark: SparkSession, directory: str) -> DataFrame:
    bank = gabor_bank(derive(read_table(spark, directory, "part", spread=True), _GABOR), "p_partkey", 5, 6)
    return bank.withColumn("g", r6(F.col("g")))


_GABOR_SQL = f"""
WITH p AS (SELECT {", ".join(f"{v} AS {k}" for k, v in _GABOR.items())} FROM part),
r AS (SELECT *, (x - t_x) * cos(theta) - (y - t_y) * sin(theta) AS a, (x - t_x) * sin(theta) + (y - t_y) * cos(theta) AS b
  FROM p, (SELECT CAST(y AS INTEGER) AS y FROM range(5) s(y)), (SELECT CAST(x AS INTEGER) AS x FROM range(6) s(x)))
SELECT p_partkey, y, x, {r6_sql("amplitude * exp(-0.5 * (a * a / (sigma_x * sigma_x) + b * b / (sigma_y * sigma_y))) * cos(k * a + phi)")} AS g FROM r
"""


def _flow(spark: SparkSession, directory: str) -> DataFrame:
    """Units shipped between nations as edges; sums are partial before they are exchanged."""
    lines = read_table(spark, directory, "lineitem", "l_orderkey", "l_suppkey", "l_quantity")
    orders = read_table(spark, directory, "orders", "o_orderkey", "o_custkey")
    customers = read_table(spark, directory, "customer", "c_custkey", "c_nationkey")
    suppliers = read_table(spark, directory, "supplier", "s_suppkey", "s_nationkey")
    placed = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    return (
        lines.join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst"))
        .agg((F.sum("l_quantity") / 100).alias("w"))
    )


_FLOW = (
    "flow AS (SELECT s_nationkey AS src, c_nationkey AS dst, sum(l_quantity) / 100 AS w FROM lineitem "
    "JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey "
    "JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"
)
_HALVES = (
    "sa AS (SELECT src, dst, sum(w) AS s, sum(x) AS a FROM (SELECT src, dst, w / 2 AS w, w / 2 AS x FROM flow "
    "UNION ALL SELECT dst, src, w / 2, -w / 2 FROM flow) GROUP BY src, dst)"
)


def sym_antisym(spark: SparkSession, directory: str) -> DataFrame:
    parts = matrices.split_parts(_flow(spark, directory))
    return parts.select("src", "dst", r6(F.col("s")).alias("s"), r6(F.col("a")).alias("a"))


def effective_weight(spark: SparkSession, directory: str) -> DataFrame:
    parts = matrices.split_parts(_flow(spark, directory))  # both parts in one pass over the flow
    edge = lambda w: parts.select("src", "dst", w.alias("w"))
    transport, second = edge(F.col("a")), edge(F.col("a") * F.col("a"))
    total = matrices.effective_weight(edge(F.col("s")), [transport, second], [0.5, -0.01], alpha=1.7320508)
    return total.withColumn("w", r6(F.col("w")))


def effective_weight_by_direction(spark: SparkSession, directory: str) -> DataFrame:
    """The same with both directions in one table."""
    parts = matrices.split_parts(_flow(spark, directory))
    both = F.array(
        F.struct(F.lit(1).alias("d"), F.col("a").alias("w")),
        F.struct(F.lit(2).alias("d"), (F.col("a") * F.col("a")).alias("w")),
    )
    stacked = parts.select("src", "dst", F.inline(both))
    base = parts.select("src", "dst", F.col("s").alias("w"))
    total = matrices.effective_weight_by_direction(base, stacked, {1: 0.5, 2: -0.01}, alpha=1.7320508)
    return total.withColumn("w", r6(F.col("w")))


_EFFECTIVE_SQL = f"WITH {_FLOW}, {_HALVES} SELECT src, dst, {r6_sql('s + 1.7320508 * (0.5 * a - 0.01 * a * a)')} AS w FROM sa"


def matvec(spark: SparkSession, directory: str) -> DataFrame:
    balances = (
        read_table(spark, directory, "customer", "c_nationkey", "c_acctbal")
        .groupBy(F.col("c_nationkey").alias("dst"))
        .agg((F.avg("c_acctbal") / 1000).alias("f"))
    )
    return matrices.matrix_vector(_flow(spark, directory), balances).withColumn("v", r6(F.col("v")))


_MATVEC_SQL = f"""
WITH {_FLOW}, f AS (SELECT c_nationkey AS dst, avg(c_acctbal) / 1000 AS f FROM customer GROUP BY 1)
SELECT src, {r6_sql("sum(w * f)")} AS v FROM flow JOIN f USING (dst) GROUP BY src
"""


def rows_times_matrix(spark: SparkSession, directory: str) -> DataFrame:
    """One sparse vector per customer: units ordered per returning nation, through the flow."""
    orders = read_table(spark, directory, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    rows = orders.groupBy(
        F.col("o_custkey").alias("row_id"), (F.col("o_orderkey") % 25).cast("int").alias("dst")
    ).agg(F.sqrt(F.sum("o_totalprice") / 1e6).alias("f"))
    return matrices.rows_times_matrix(rows, _flow(spark, directory)).withColumn("v", r6(F.col("v")))


_ROWS_SQL = f"""
WITH {_FLOW}, r AS (SELECT o_custkey AS row_id, CAST(o_orderkey % 25 AS INTEGER) AS dst, sqrt(sum(o_totalprice) / 1e6) AS f FROM orders GROUP BY ALL)
SELECT row_id, src, {r6_sql("sum(w * f)")} AS v FROM r JOIN flow USING (dst) GROUP BY ALL
"""

BOUND = {
    "place_code": Bound(place_code, _PLACE_SQL),
    "ring_code": Bound(ring_code, _RING_SQL),
    "mixed_code": Bound(mixed_code, _MIXED_SQL),
    "decode_place": Bound(decode_place, _DECODE_SQL),
    "rectified_write": Bound(rectified_write, _WRITE_SQL),
    "gabor_bank": Bound(gabor, _GABOR_SQL),
    "sym_antisym": Bound(
        sym_antisym, f"WITH {_FLOW}, {_HALVES} SELECT src, dst, {r6_sql('s')} AS s, {r6_sql('a')} AS a FROM sa"
    ),
    "effective_weight": Bound(effective_weight, _EFFECTIVE_SQL),
    "effective_weight_by_direction": Bound(effective_weight_by_direction, _EFFECTIVE_SQL),
    "matvec": Bound(matvec, _MATVEC_SQL),
    "rows_times_matrix": Bound(rows_times_matrix, _ROWS_SQL),
}
