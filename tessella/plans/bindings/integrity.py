"""Manifests, reconciliation, ledgers and identifier ranges over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.keyed import tagged_sha256
from tessella.operators import ledger, lineage, manifest
from tessella.plans.bindings.common import Bound, derive, derive_sql
from tessella.session import read_table
from tessella.sources.registry import assign_roles, expand_ranges, registry_table

# Documents read as a manifest; one row in about a hundred breaks each rule.
_NUMBER = "CAST(regexp_extract(source, '[0-9]+', 0) AS INT)"
_MANIFEST = {
    "split_id": "'doc-' || lpad(CAST(CASE WHEN doc_id % 53 = 1 THEN doc_id - 1 ELSE doc_id END AS STRING), 9, '0')",
    "role": f"CASE WHEN doc_id % 101 = 7 THEN 'holdout' WHEN {_NUMBER} % 3 = 0 THEN 'val' "
    f"WHEN {_NUMBER} % 3 = 1 THEN 'test' ELSE 'train' END",
    "relative_path": "CASE WHEN doc_id % 103 = 5 THEN '../' WHEN doc_id % 107 = 3 THEN '/' "
    "WHEN doc_id % 109 = 3 THEN 'a/../' ELSE '' END || source || '/' || CAST(doc_id AS STRING) || '.png'",
    "sha256": "CASE WHEN doc_id % 2 = 0 THEN '' WHEN doc_id % 111 = 2 THEN 'md5:' || lang "
    "ELSE 'sha256:' || <<lang || CAST(doc_id AS STRING)>> END",
    "content_sha256": "'sha256:' || CASE WHEN doc_id % 113 = 4 THEN upper(<<text>>) ELSE <<text>> END",
    "format": "CASE WHEN doc_id % 117 = 9 THEN 'BMP' WHEN doc_id % 3 = 0 THEN 'JPEG' ELSE 'PNG' END",
    "height": "CAST(CASE WHEN doc_id % 127 = 1 THEN 0 ELSE n_chars END AS INT)",
    "width": "CAST(length(source) AS INT)",
    "mode": "CASE WHEN doc_id % 131 = 11 THEN 'CMYK' ELSE 'RGB' END",
}
_MANIFEST_SQL = "m AS (" + derive_sql("documents", _MANIFEST) + ")"
_COUNTS = {"train": 330, "val": 350, "test": 350, "spare": 0}
_FORMATS, _MODES = ("PNG", "JPEG"), ("RGB",)


def document_manifest(spark: SparkSession, directory: str) -> DataFrame:
    return derive(read_table(spark, directory, "documents"), _MANIFEST)


def manifest_validate(spark: SparkSession, directory: str) -> DataFrame:
    return manifest.validate_manifest(
        document_manifest(spark, directory),
        expected_counts=_COUNTS,
        allowed_formats=_FORMATS,
        allowed_modes=_MODES,
    )


_DIGEST_OK = "regexp_full_match({0}, 'sha256:[0-9a-f]{{64}}')"
_UNSAFE = r"(relative_path = '' OR regexp_matches(relative_path, '^[/\\]') OR regexp_matches(relative_path, '(^|/)\.\.(/|$)'))"
_LEAKAGE_SQL = (
    "SELECT 'split_leakage' AS rule, content_sha256 AS key, string_agg(DISTINCT role, ',' ORDER BY role) AS detail "
    "FROM m GROUP BY content_sha256 HAVING count(DISTINCT role) > 1"
)
_VALIDATE_SQL = f"""
WITH {_MANIFEST_SQL}
SELECT 'bad_role' AS rule, split_id AS key, role AS detail FROM m WHERE role NOT IN ('train', 'val', 'test')
UNION ALL SELECT 'bad_content_digest', split_id, content_sha256 FROM m WHERE NOT {_DIGEST_OK.format("content_sha256")}
UNION ALL SELECT 'bad_file_digest', split_id, sha256 FROM m WHERE sha256 <> '' AND NOT {_DIGEST_OK.format("sha256")}
UNION ALL SELECT 'unsafe_path', split_id, relative_path FROM m WHERE {_UNSAFE}
UNION ALL SELECT 'bad_shape', split_id, height || 'x' || width FROM m WHERE height <= 0 OR width <= 0
UNION ALL SELECT 'bad_format', split_id, format FROM m WHERE format NOT IN ('PNG', 'JPEG')
UNION ALL SELECT 'bad_mode', split_id, mode FROM m WHERE mode <> 'RGB'
UNION ALL SELECT 'duplicate_id', split_id, CAST(count(*) AS VARCHAR) FROM m GROUP BY split_id HAVING count(*) > 1
UNION ALL {_LEAKAGE_SQL}
UNION ALL SELECT 'duplicate_content', content_sha256, CAST(count(*) AS VARCHAR) FROM m
  GROUP BY content_sha256 HAVING count(*) > 1
UNION ALL SELECT 'role_count', w.role, count(m.role) || ' images, expected ' || w.n
  FROM (VALUES {", ".join(f"('{r}', {n})" for r, n in _COUNTS.items())}) w(role, n) LEFT JOIN m USING (role)
  GROUP BY w.role, w.n HAVING count(m.role) <> w.n
"""


def split_leakage(spark: SparkSession, directory: str) -> DataFrame:
    return manifest.split_leakage(manifest.key_totals(document_manifest(spark, directory)))


def _turn_manifest(spark: SparkSession, directory: str) -> DataFrame:
    return read_table(spark, directory, "conversations").select(
        F.format_string("conv-%06d", "conv_id").alias("split_id"),
        F.col("role"),
        tagged_sha256(F.col("text")).alias("content_sha256"),
    )


def duplicate_content(spark: SparkSession, directory: str) -> DataFrame:
    return manifest.duplicate_content(manifest.key_totals(document_manifest(spark, directory)))


def duplicate_ids(spark: SparkSession, directory: str) -> DataFrame:
    return manifest.duplicate_ids(manifest.key_totals(_turn_manifest(spark, directory)))


# Blocks of a hundred customers as inclusive ranges; the last ten keys of each block stay out.
def _customer_ranges(spark: SparkSession, directory: str) -> DataFrame:
    block = F.floor(F.col("c_custkey") / 100)
    role = F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test")), (block % 3 + 1).cast("int"))
    return (
        read_table(spark, directory, "customer", "c_custkey")
        .groupBy(block.alias("block"), role.alias("role"))
        .agg(F.min("c_custkey").alias("first_id"), (F.max("c_custkey") - 10).alias("last_id"))
        .filter("last_id >= first_id")
    )


_RANGES_SQL = (
    "ranges AS (SELECT c_custkey // 100 AS block, "
    "CASE c_custkey // 100 % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS role, "
    "min(c_custkey) AS first_id, max(c_custkey) - 10 AS last_id FROM customer GROUP BY 1, 2 "
    "HAVING max(c_custkey) - 10 >= min(c_custkey))"
)


def expected_ids(spark: SparkSession, directory: str) -> DataFrame:
    wanted = expand_ranges(_customer_ranges(spark, directory)).select(
        F.format_string("%06d", "id").alias("split_id")
    )
    seen = read_table(spark, directory, "orders", "o_custkey").select(
        F.format_string("%06d", "o_custkey").alias("split_id")
    )
    return manifest.id_problems(seen, wanted)


_EXPECTED_IDS_SQL = f"""
WITH {_RANGES_SQL},
wanted AS (SELECT DISTINCT printf('%06d', unnest(generate_series(first_id, last_id))) AS split_id FROM ranges),
seen AS (SELECT DISTINCT printf('%06d', o_custkey) AS split_id FROM orders)
SELECT 'missing_id' AS rule, split_id AS key, '' AS detail FROM (SELECT * FROM wanted EXCEPT SELECT * FROM seen)
UNION ALL
SELECT 'unexpected_id', split_id, '' FROM (SELECT * FROM seen EXCEPT SELECT * FROM wanted)
"""


def role_by_range(spark: SparkSession, directory: str) -> DataFrame:
    orders = read_table(spark, directory, "orders", "o_orderkey", "o_custkey")
    roles = assign_roles(orders, "o_custkey", _customer_ranges(spark, directory), chunk=256)
    return roles.select("o_orderkey", "o_custkey", "block", "role")


_ROLE_SQL = f"""
WITH {_RANGES_SQL}
SELECT o_orderkey, o_custkey, block, role FROM orders JOIN ranges ON o_custkey BETWEEN first_id AND last_id
"""

# What a file scan would find for the same documents, with about one in ten changed.
_SCAN = {
    "relative_path": _MANIFEST["relative_path"],
    "corrupt": "doc_id % 37 = 4",
    "format": _MANIFEST["format"],
    "height": "CAST(CASE WHEN doc_id % 41 = 5 THEN n_chars + 1 ELSE n_chars END AS INT)",
    "width": _MANIFEST["width"],
    "mode": _MANIFEST["mode"],
    "content_sha256": "'sha256:' || <<CASE WHEN doc_id % 43 = 6 THEN text || '!' ELSE text END>>",
    "sha256": "'sha256:' || <<lang || CAST(CASE WHEN doc_id % 47 = 8 THEN doc_id + 1 ELSE doc_id END AS STRING)>>",
}


def reconcile_manifest(spark: SparkSession, directory: str) -> DataFrame:
    stored = read_table(spark, directory, "documents").filter("doc_id % 29 <> 3")
    return manifest.reconcile_files(document_manifest(spark, directory), derive(stored, _SCAN))


_RECONCILE_SQL = f"""
WITH {_MANIFEST_SQL},
s AS ({derive_sql("documents", _SCAN)} WHERE doc_id % 29 <> 3),
j AS (SELECT m.*, {_UNSAFE.replace("relative_path", "m.relative_path")} AS unsafe, s.relative_path IS NOT NULL AS found,
  coalesce(s.corrupt, false) AS corrupt, s.format AS f2, s.height AS h2, s.width AS w2, s.mode AS m2,
  s.content_sha256 AS c2, s.sha256 AS s2
  FROM m LEFT JOIN s ON m.relative_path = s.relative_path),
ok AS (SELECT * FROM j WHERE NOT unsafe AND found AND NOT corrupt)
SELECT 'path_escapes_root' AS rule, split_id AS key, relative_path AS detail FROM j WHERE unsafe
UNION ALL SELECT 'missing_file', split_id, relative_path FROM j WHERE NOT unsafe AND NOT found
UNION ALL SELECT 'corrupt_file', split_id, relative_path FROM j WHERE NOT unsafe AND found AND corrupt
UNION ALL SELECT 'metadata_mismatch', split_id, concat_ws(' ', f2, h2, w2, m2) FROM ok
  WHERE (f2, h2, w2, m2) IS DISTINCT FROM (format, height, width, mode)
UNION ALL SELECT 'content_mismatch', split_id, c2 FROM ok WHERE c2 IS DISTINCT FROM content_sha256
UNION ALL SELECT 'file_mismatch', split_id, s2 FROM ok WHERE sha256 <> '' AND s2 IS DISTINCT FROM sha256
"""

_LISTED = {
    "rel": "p_brand || '/' || CAST(p_partkey AS STRING)",
    "sha256": "<<p_name || CAST(p_size AS STRING)>>",
}
_ACTUAL = {
    "rel": "CASE WHEN p_partkey % 31 = 2 THEN p_brand || '/extra-' || CAST(p_partkey AS STRING) "
    "WHEN p_partkey % 97 = 5 THEN 'README.md' ELSE p_brand || '/' || CAST(p_partkey AS STRING) END",
    "sha256": "<<p_name || CAST(CASE WHEN p_partkey % 23 = 1 THEN p_size + 1 ELSE p_size END AS STRING)>>",
}


def verify_tree(spark: SparkSession, directory: str) -> DataFrame:
    part = read_table(spark, directory, "part")
    return lineage.verify_tree(derive(part, _LISTED), derive(part, _ACTUAL))


_TREE_SQL = f"""
WITH l AS ({derive_sql("part", _LISTED)}), a AS ({derive_sql("part", _ACTUAL)})
SELECT CASE WHEN a.rel IS NULL THEN 'missing_file' WHEN l.rel IS NULL THEN 'unlisted_file' ELSE 'hash_mismatch' END AS rule,
  coalesce(l.rel, a.rel) AS key, coalesce(a.sha256, l.sha256) AS detail
FROM l FULL JOIN a ON l.rel = a.rel
WHERE a.rel IS NULL OR (l.rel IS NULL AND a.rel <> 'README.md') OR l.sha256 <> a.sha256
"""

_PINNED = {
    "dataset": "p_type",
    "archive": "p_name || '-' || CAST(p_partkey AS STRING)",
    "sha256": "<<p_name || CAST(p_partkey AS STRING)>>",
}
_INCOMING = {
    "dataset": "p_type",
    "archive": "p_name || '-' || CAST(CASE WHEN p_partkey % 59 = 9 THEN p_partkey - 1 ELSE p_partkey END AS STRING)",
    "sha256": "<<p_name || CAST(CASE WHEN p_partkey % 19 = 3 THEN p_partkey + 1 ELSE p_partkey END AS STRING)>>",
}


def pin_actions(spark: SparkSession, directory: str) -> DataFrame:
    part = read_table(spark, directory, "part")
    pins = derive(part.filter("p_partkey % 3 <> 0"), _PINNED)
    terms = part.filter("p_type <> 'SMALL'").select(F.col("p_type").alias("dataset"))
    return ledger.pin_actions(derive(part, _INCOMING), pins, terms)


_PIN_SQL = f"""
WITH pins AS ({derive_sql("part", _PINNED)} WHERE p_partkey % 3 <> 0), inc AS ({derive_sql("part", _INCOMING)}),
b AS (SELECT dataset, archive, min(sha256) AS sha256, max(sha256) AS other FROM inc GROUP BY 1, 2)
SELECT b.dataset, b.archive, b.sha256, p.sha256 AS pinned,
  CASE WHEN b.dataset = 'SMALL' THEN 'refused' WHEN b.sha256 <> other THEN 'conflict'
    WHEN p.sha256 IS NULL THEN 'insert' WHEN p.sha256 = b.sha256 THEN 'same' ELSE 'conflict' END AS action
FROM b LEFT JOIN pins p ON b.dataset = p.dataset AND b.archive = p.archive
"""


def verify_pins(spark: SparkSession, directory: str) -> DataFrame:
    part = read_table(spark, directory, "part")
    return ledger.verify_pins(derive(part, _INCOMING), derive(part.filter("p_partkey % 3 <> 0"), _PINNED))


_VERIFY_PINS_SQL = f"""
WITH pins AS ({derive_sql("part", _PINNED)} WHERE p_partkey % 3 <> 0), o AS ({derive_sql("part", _INCOMING)})
SELECT o.dataset, o.archive, o.sha256, p.sha256 AS pinned,
  CASE WHEN p.sha256 IS NULL THEN 'unpinned' WHEN p.sha256 = o.sha256 THEN 'ok' ELSE 'mismatch' END AS status
FROM o LEFT JOIN pins p ON o.dataset = p.dataset AND o.archive = p.archive
"""

# Order history of a customer as successive pins of one archive.
_LEDGER = {
    "dataset": "o_orderstatus",
    "archive": "'c' || CAST(o_custkey AS STRING)",
    "sha256": "<<o_orderpriority || CAST(o_orderkey AS STRING)>>",
    "seq": "o_orderkey",
}


def pin_rotation(spark: SparkSession, directory: str) -> DataFrame:
    orders = read_table(spark, directory, "orders")
    pins = ledger.current_pins(derive(orders, _LEDGER))
    changes = read_table(spark, directory, "customer").selectExpr(
        "CASE c_custkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'O' ELSE 'P' END AS dataset",
        "'c' || CAST(c_custkey AS STRING) AS archive",
        "sha2(c_name, 256) AS sha256",
        "c_mktsegment AS reason",
    )
    return ledger.rotation_entries(changes, pins)


_ROTATION_SQL = f"""
WITH l AS ({derive_sql("orders", _LEDGER)}),
pins AS (SELECT dataset, archive, arg_max(sha256, seq) AS sha256, max(seq) AS seq FROM l GROUP BY 1, 2),
c AS (SELECT CASE c_custkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'O' ELSE 'P' END AS dataset,
  'c' || c_custkey AS archive, sha256(c_name) AS sha256, c_mktsegment AS reason FROM customer)
SELECT c.dataset, c.archive, c.sha256, p.sha256 AS prior, c.reason, coalesce(p.seq, -1) + 1 AS seq
FROM c LEFT JOIN pins p ON c.dataset = p.dataset AND c.archive = p.archive
"""

# Chains of 25 entries, with forks, gaps, repeats, wrong priors and missing reasons planted by archive and number.
_CHAIN = {
    "dataset": "CASE WHEN o_orderkey DIV 25 % 2 = 0 THEN 'even' ELSE 'odd' END",
    "archive": "'a' || CAST(o_orderkey DIV 25 AS STRING)",
    "sha256": "<<'p' || CAST(o_orderkey AS STRING)>>",
    "prior": "CASE WHEN o_orderkey % 25 = 0 AND o_orderkey % 7 <> 3 THEN NULL WHEN o_orderkey % 97 = 5 THEN <<'x'>> "
    "ELSE <<'p' || CAST(o_orderkey - 1 AS STRING)>> END",
    "reason": "CASE WHEN o_orderkey % 25 = 0 THEN NULL WHEN o_orderkey % 89 = 7 THEN ' ' ELSE o_orderpriority END",
    "seq": "CASE WHEN o_orderkey % 997 = 4 THEN -1 ELSE o_orderkey % 25 END",
}
_FORKED = _CHAIN | {"sha256": "<<'q' || CAST(o_orderkey AS STRING)>>"}


def ledger_chain(spark: SparkSession, directory: str) -> DataFrame:
    orders = read_table(spark, directory, "orders").filter("o_orderkey % 83 <> 11")
    entries = derive(orders, _CHAIN).unionByName(derive(orders.filter("o_orderkey % 61 = 8"), _CHAIN))
    return ledger.chain_problems(entries.unionByName(derive(orders.filter("o_orderkey % 71 = 9"), _FORKED)))


def _entries_sql(columns: dict[str, str], where: str) -> str:
    return f"{derive_sql('orders', columns).replace(' DIV ', ' // ')} WHERE o_orderkey % 83 <> 11 {where}"


_CHAIN_SQL = f"""
WITH l AS ({_entries_sql(_CHAIN, "")} UNION ALL {_entries_sql(_CHAIN, "AND o_orderkey % 61 = 8")} UNION ALL {_entries_sql(_FORKED, "AND o_orderkey % 71 = 9")}),
e AS (SELECT *, count(*) AS copies FROM l GROUP BY ALL),
t AS (SELECT dataset, archive, seq, count(*) AS n FROM e WHERE seq >= 0 GROUP BY ALL)
SELECT dataset, archive, CAST(seq AS BIGINT) AS seq, rule, coalesce(detail, '') AS detail FROM (
  SELECT dataset, archive, seq, 'repeated_entry' AS rule, CAST(copies AS VARCHAR) AS detail FROM e WHERE copies > 1
  UNION ALL SELECT dataset, archive, seq, 'fork', CAST(n AS VARCHAR) FROM t WHERE n > 1
  UNION ALL SELECT dataset, archive, seq, 'gap', '' FROM t WHERE seq > 0
    AND NOT EXISTS (SELECT 1 FROM t b WHERE b.dataset = t.dataset AND b.archive = t.archive AND b.seq = t.seq - 1)
  UNION ALL SELECT dataset, archive, seq, 'broken_prior', prior FROM e WHERE seq > 0
    AND EXISTS (SELECT 1 FROM t b WHERE b.dataset = e.dataset AND b.archive = e.archive AND b.seq = e.seq - 1)
    AND NOT EXISTS (SELECT 1 FROM e b WHERE b.dataset = e.dataset AND b.archive = e.archive AND b.seq = e.seq - 1 AND b.sha256 = e.prior)
  UNION ALL SELECT dataset, archive, seq, 'first_with_prior', prior FROM e WHERE seq = 0 AND prior IS NOT NULL
  UNION ALL SELECT dataset, archive, seq, 'no_reason', sha256 FROM e WHERE seq > 0 AND trim(coalesce(reason, '')) = ''
  UNION ALL SELECT dataset, archive, seq, 'bad_number', sha256 FROM e WHERE seq IS NULL OR seq < 0)
"""


_REQUESTS = {
    "c_custkey": "c_custkey",
    "dataset": "CASE c_custkey % 4 WHEN 0 THEN 'DIV2K' WHEN 1 THEN 'bsds500' WHEN 2 THEN 'div2k' ELSE c_mktsegment END",
    "token": "CASE WHEN c_custkey % 4 = 1 THEN '--accept-noncommercial-research-terms' WHEN c_custkey % 7 = 2 THEN 'yes' "
    "ELSE '--accept-academic-research-terms' END",
    "terms_sha256": "CASE WHEN c_custkey % 11 <> 6 THEN 'sha256:' || <<c_name>> END",
    "accepted_at_iso": "'2023-' || lpad(CAST(c_custkey % 14 AS STRING), 2, '0') || '-' || "
    "lpad(CAST(c_custkey % 33 AS STRING), 2, '0') || CASE c_custkey % 3 WHEN 0 THEN 'T10:20:30Z' WHEN 1 THEN '' "
    "ELSE ' 10:20:30+02:00' END",
}


def judge_terms(spark: SparkSession, directory: str) -> DataFrame:
    requests = derive(read_table(spark, directory, "customer"), _REQUESTS)
    judged = ledger.judge_terms(requests, registry_table(spark))
    return judged.select("c_custkey", "dataset", "terms_url", "status")


_TERMS_SQL = f"""
WITH r AS ({derive_sql("customer", _REQUESTS)}),
reg(dataset, terms_url, wanted) AS (VALUES
  ('div2k', 'https://data.vision.ee.ethz.ch/cvl/DIV2K/', '--accept-academic-research-terms'),
  ('bsds500', 'https://www2.eecs.berkeley.edu/Research/Projects/CS/vision/grouping/resources.html',
   '--accept-noncommercial-research-terms'))
SELECT c_custkey, lower(r.dataset) AS dataset, terms_url,
  CASE WHEN wanted IS NULL THEN 'unknown_dataset' WHEN token <> wanted THEN 'wrong_token'
    WHEN terms_sha256 IS NULL THEN 'missing_terms'
    WHEN try_cast(substr(accepted_at_iso, 1, 10) AS DATE) IS NULL THEN 'bad_timestamp' ELSE 'accepted' END AS status
FROM r LEFT JOIN reg ON lower(r.dataset) = reg.dataset
"""

BOUND = {
    "manifest_validate": Bound(manifest_validate, _VALIDATE_SQL),
    "split_leakage": Bound(split_leakage, f"WITH {_MANIFEST_SQL} {_LEAKAGE_SQL}"),
    "dup_content": Bound(
        duplicate_content,
        f"WITH {_MANIFEST_SQL} SELECT 'duplicate_content' AS rule, content_sha256 AS key, "
        "CAST(count(*) AS VARCHAR) AS detail FROM m GROUP BY content_sha256 HAVING count(*) > 1",
    ),
    "dup_ids": Bound(
        duplicate_ids,
        "SELECT 'duplicate_id' AS rule, printf('conv-%06d', conv_id) AS key, CAST(count(*) AS VARCHAR) AS detail "
        "FROM conversations GROUP BY conv_id HAVING count(*) > 1",
    ),
    "expected_ids": Bound(expected_ids, _EXPECTED_IDS_SQL),
    "role_by_range": Bound(role_by_range, _ROLE_SQL),
    "reconcile_manifest": Bound(reconcile_manifest, _RECONCILE_SQL),
    "verify_tree": Bound(verify_tree, _TREE_SQL),
    "pin_actions": Bound(pin_actions, _PIN_SQL),
    "verify_pins": Bound(verify_pins, _VERIFY_PINS_SQL),
    "pin_rotation": Bound(pin_rotation, _ROTATION_SQL),
    "ledger_chain": Bound(ledger_chain, _CHAIN_SQL),
    "terms_requests": Bound(judge_terms, _TERMS_SQL),
}
