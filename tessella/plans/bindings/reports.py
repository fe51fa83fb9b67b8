"""Whole reports and digests of jobs over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.keyed import pixel_digest
from tessella.operators import manifest
from tessella.operators.fingerprint import LEVELS, config_lines, fit_identifier, tree_digest
from tessella.plans import jobs
from tessella.plans.bindings import governance, integrity
from tessella.plans.bindings.common import LONG, Bound, derive, derive_sql, embeddings
from tessella.plans.representation import offending_roles
from tessella.session import read_table, union_all
from tessella.sources.files import parse_checksums

# Orders as lines of checksum lists: good ones, single spaces, trailing blanks, no path, blank lines.
_LINES = {
    "value": "CASE o_orderkey % 7 WHEN 0 THEN <<CAST(o_orderkey AS STRING)>> || ' dir/one' WHEN 1 THEN '   ' "
    "WHEN 2 THEN <<CAST(o_orderkey AS STRING)>> || '  dir/' || CAST(o_custkey AS STRING) || '.png   ' "
    "WHEN 3 THEN <<CAST(o_orderkey AS STRING)>> ELSE <<CAST(o_orderkey AS STRING)>> || '  a  b/' || CAST(o_custkey AS STRING) END",
}


def checksum_lines(spark: SparkSession, directory: str) -> DataFrame:
    return parse_checksums(derive(read_table(spark, directory, "orders", "o_orderkey", "o_custkey"), _LINES))


_LINES_SQL = f"""
WITH l AS ({derive_sql("orders", _LINES)}),
p AS (SELECT regexp_extract(rtrim(value), '^(.*?)(  (.*))?$', 1) AS sha256, trim(regexp_extract(rtrim(value), '^(.*?)(  (.*))?$', 3)) AS rel
  FROM l WHERE trim(value) <> '')
SELECT sha256, rel, rel = '' AS malformed FROM p
"""


def pixel_digests(spark: SparkSession, directory: str) -> DataFrame:
    """Embeddings as 8x8 images of bytes, in one and in four channels of a quarter of the pixels."""
    byte = lambda v: F.lpad(F.hex(F.floor(F.abs(v) * 255).cast("int")), 2, "0")
    pixels = embeddings(spark, directory, spread=True).withColumn("px", F.unhex(F.array_join(F.transform("f", byte), "")))
    shapes = F.explode(F.array(*[F.struct(F.lit(h).alias("h"), F.lit(w).alias("w"), F.lit(c).alias("c")) for h, w, c in ((8, 8, 1), (4, 4, 4))]))
    rows = pixels.select("vec_id", "px", shapes.alias("s"))
    digest = pixel_digest(F.col("px"), F.col("s.h"), F.col("s.w"), F.col("s.c"))
    return rows.select("vec_id", F.col("s.c").alias("channels"), digest.alias("content_sha256"))


_PIXELS_SQL = f"""
WITH {LONG}, p AS (SELECT vec_id, string_agg(printf('%02X', CAST(floor(abs(v) * 255) AS INTEGER)), '' ORDER BY i) AS px FROM e GROUP BY vec_id)
SELECT vec_id, c AS channels, 'sha256:' || sha256(encode(CASE c WHEN 1 THEN '|u1|(8, 8)' ELSE '|u1|(4, 4, 4)' END) || unhex(px)) AS content_sha256
FROM p, (VALUES (1), (4)) t(c)
"""

_TREE = {"rel": "source || '/' || CAST(doc_id AS STRING)", "sha256": "<<text>>"}


def tree_fingerprint(spark: SparkSession, directory: str) -> DataFrame:
    """Documents as a tree of files, one folder per source."""
    return tree_digest(derive(read_table(spark, directory, "documents", "doc_id", "source", "text"), _TREE))


def _tree_sql(digests: str) -> str:
    """Hash tree over the rows of a query ``(d)``."""
    levels = ["c AS (SELECT d AS k, d || ':' || count(*) AS node, count(*) AS n FROM d GROUP BY d)"]
    source = "c"
    for level, width in enumerate(LEVELS):
        levels.append(
            f"l{level} AS (SELECT p, sha256(string_agg(node, ',' ORDER BY node)) AS h, sum(n) AS n FROM "
            f"(SELECT substr(k, 1, {width}) AS p, node, n FROM {source}) GROUP BY p)"
        )
        source = f"(SELECT p AS k, p || ':' || h AS node, n FROM l{level})"
    return f"d AS ({digests}), {', '.join(levels)}"


_TREE_SQL = f"""
WITH {_tree_sql("SELECT sha256(sha256('v' || rel) || '|' || sha256('v' || sha256)) AS d FROM (" + derive_sql("documents", _TREE) + ")")}
SELECT h AS digest, CAST(n AS BIGINT) AS n_rows FROM l2
"""

_SETTINGS = {"track": "rgb", "eps": 1e-05, "stages": ["crop", "scale"], "augment": True}


def fit_identity(spark: SparkSession, directory: str) -> DataFrame:
    """Identifier of a fit on the train rows, in thousandths, under a configuration."""
    e = embeddings(spark, directory, spread=True).filter(F.col("role") == "train")
    coarse = e.select(F.transform("f", lambda v: F.floor(v * 1000).cast("double")).alias("f"))
    identifier = fit_identifier(coarse, "f", 64, _SETTINGS)
    return spark.createDataFrame([(identifier, coarse.count())], "fit_id string, n_train bigint")


_FIT_SQL = f"""
WITH {LONG}, v AS (SELECT vec_id, string_agg(CAST(floor(v * 1000) AS BIGINT) || '.0', ',' ORDER BY i) AS t FROM e WHERE label < 7 GROUP BY vec_id),
{_tree_sql("SELECT sha256(t) AS d FROM v")}
SELECT 'fit-' || substr(sha256(h || chr(10) || '/rows int ' || CAST(n AS BIGINT) || chr(10) || '/width int 64' || chr(10) ||
  '{"' || chr(10) || '".join(line.replace("'", "''") for line in config_lines(_SETTINGS))}'), 1, 16) AS fit_id, CAST(n AS BIGINT) AS n_train FROM l2
"""


def roles_outside_train(spark: SparkSession, directory: str) -> DataFrame:
    """Roles a train-only fit set of the document manifest would have to reject."""
    return offending_roles(integrity.document_manifest(spark, directory))


_OUTSIDE_SQL = f"WITH {integrity._MANIFEST_SQL} SELECT role, count(*) AS n FROM m WHERE role <> 'train' GROUP BY role"


def dataset_check(spark: SparkSession, directory: str) -> DataFrame:
    """The check of a manifest without stored files: rules, roles, and ids beyond the expected ones."""
    rows = integrity.document_manifest(spark, directory)
    ids = spark.range(900).select(F.format_string("doc-%09d", "id").alias("split_id"))
    return union_all(
        [
            manifest.validate_manifest(rows, allowed_formats=integrity._FORMATS, allowed_modes=integrity._MODES, expected_counts=integrity._COUNTS),
            manifest.unexpected_roles(rows, {"train", "val"}),
            manifest.structural_id_problems(rows, ids),
        ]
    )


_CHECK_SQL = f"""
SELECT * FROM ({integrity._VALIDATE_SQL})
UNION ALL SELECT 'unexpected_role', role, 'train,val' FROM (WITH {integrity._MANIFEST_SQL} SELECT DISTINCT role FROM m WHERE role NOT IN ('train', 'val'))
UNION ALL SELECT 'unexpected_id', split_id, '' FROM (WITH {integrity._MANIFEST_SQL} SELECT DISTINCT split_id FROM m
  WHERE CAST(substr(split_id, 5) AS BIGINT) >= 900)
"""


def lineage_report(spark: SparkSession, directory: str) -> DataFrame:
    """Labels, migration tuples and the file map in one report."""
    pages = read_table(spark, directory, "pages", "page_id")
    lines, part = read_table(spark, directory, "lineitem"), read_table(spark, directory, "part")
    rel = lambda prefix, key: f"'{prefix}' || CAST({key} AS STRING) AS rel"
    return jobs.check_lineage(
        texts=pages.selectExpr(r"'x \\label{fig:' || CAST(page_id % 97 AS STRING) || '} y' AS text"),
        inventory=pages.selectExpr("'fig:' || CAST(page_id % 89 AS STRING) AS label"),
        expected=derive(lines, governance._EXPECTED),
        declared=derive(lines.filter("l_discount < 0.1"), governance._DECLARED),
        frozen_sources=read_table(spark, directory, "orders").filter("o_totalprice > 5000").selectExpr(rel("o", "o_orderkey")),
        file_map=derive(part.filter("p_partkey % 37 <> 6"), governance._MAP),
        derived=derive(part.filter("p_partkey % 29 <> 7"), governance._DERIVED),
        targets=derive(part.filter("p_partkey % 31 <> 8"), governance._TARGETS).unionByName(
            part.filter("p_size < 50").selectExpr(rel("p", "p_partkey"), "sha2('', 256) AS sha256")
        ),
        sources=derive(part, governance._SOURCES),
    )


_LINEAGE_SQL = f"""
SELECT DISTINCT 'label_not_in_inventory' AS rule, label AS key, '' AS detail FROM (SELECT 'fig:' || page_id % 97 AS label FROM pages)
  WHERE label NOT IN (SELECT 'fig:' || page_id % 89 FROM pages)
UNION ALL SELECT * FROM ({governance._FANOUT_SQL}) UNION ALL SELECT * FROM ({governance._FILE_MAP_SQL})
"""

BOUND = {
    "checksum_lines": Bound(checksum_lines, _LINES_SQL),
    "pixel_digests": Bound(pixel_digests, _PIXELS_SQL),
    "tree_fingerprint": Bound(tree_fingerprint, _TREE_SQL),
    "fit_identity": Bound(fit_identity, _FIT_SQL),
    "roles_outside_train": Bound(roles_outside_train, _OUTSIDE_SQL),
    "dataset_check": Bound(dataset_check, _CHECK_SQL),
    "lineage_report": Bound(lineage_report, _LINEAGE_SQL),
}
