"""Lineage, text scans, JSON records and table digests over the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.canonical_json import canonical_json
from tessella.functions.keyed import tagged_sha256
from tessella.functions.text import CANARIES, LEAK_PATTERNS
from tessella.operators import lineage
from tessella.operators.fingerprint import LEVELS, row_digest, table_digest
from tessella.operators.leakscan import EXEMPT_MARKER, scan_texts
from tessella.operators.records import (
    Field,
    validate_environment_records,
    validate_records,
    validate_whitening_records,
)
from tessella.operators.stored_tree import compare_trees, read_tree, store_tree
from tessella.plans.bindings.common import Bound, derive, derive_sql, embeddings
from tessella.session import checkpoint_folder, read_table, union_all

# Order lines as migration tuples: order -> part under a return flag.
_EXPECTED = {
    "source": "'o' || CAST(l_orderkey AS STRING)",
    "target": "'p' || CAST(l_partkey AS STRING)",
    "derivation": "l_returnflag",
}
_DECLARED = {
    "source": _EXPECTED["source"],
    "target": "'p' || CAST(CASE WHEN l_quantity = 50 THEN l_partkey + 5 ELSE l_partkey END AS STRING)",
    "derivation": "CASE WHEN l_linenumber = 7 AND l_tax > 0.05 THEN 'X' ELSE l_returnflag END",
}


def lineage_fanout(spark: SparkSession, directory: str) -> DataFrame:
    lines = read_table(spark, directory, "lineitem")
    sources = read_table(spark, directory, "orders").filter("o_totalprice > 5000")
    targets = read_table(spark, directory, "part").filter("p_size < 50")
    return lineage.check_fanout(
        derive(lines, _EXPECTED),
        derive(lines.filter("l_discount < 0.1"), _DECLARED),
        sources.selectExpr("'o' || CAST(o_orderkey AS STRING) AS rel"),
        targets.selectExpr("'p' || CAST(p_partkey AS STRING) AS rel"),
    )


_FANOUT_SQL = f"""
WITH e AS (SELECT DISTINCT * FROM ({derive_sql("lineitem", _EXPECTED)})),
d AS (SELECT DISTINCT * FROM ({derive_sql("lineitem", _DECLARED)} WHERE l_discount < 0.1)),
s AS (SELECT 'o' || o_orderkey AS rel FROM orders WHERE o_totalprice > 5000),
t AS (SELECT 'p' || p_partkey AS rel FROM part WHERE p_size < 50)
SELECT 'missing_tuple' AS rule, source || ' -> ' || target AS key, derivation AS detail FROM (FROM e EXCEPT FROM d)
UNION ALL SELECT 'extra_tuple', source || ' -> ' || target, derivation FROM (FROM d EXCEPT FROM e)
UNION ALL SELECT 'missing_source', source, '' FROM (SELECT DISTINCT source FROM e) WHERE source NOT IN (SELECT rel FROM s)
UNION ALL SELECT 'missing_target', target, source || ' ' || derivation FROM e WHERE target NOT IN (SELECT rel FROM t)
"""

# Parts as a file map; a fixed share of rows breaks each rule.
_MAP = {
    "pos": "p_partkey",
    "dissertation_file": "'ch/' || CAST(CASE WHEN p_partkey % 61 = 1 THEN p_partkey - 1 ELSE p_partkey END AS STRING)",
    "derivation": "CASE WHEN p_partkey % 53 = 2 THEN 'guessed' WHEN p_partkey % 2 = 0 THEN 'byte-identical-copy' "
    "ELSE 'translated-from' END",
    "source_2026_file": "'src/' || CAST(CASE WHEN p_partkey % 47 = 3 THEN -1 ELSE p_partkey END AS STRING)",
    "source_sha256": "<<p_name || CAST(p_partkey + CASE WHEN p_partkey % 43 = 4 THEN 1 ELSE 0 END AS STRING)>>",
    "current_sha256": "<<p_name || CAST(p_partkey + CASE WHEN p_partkey % 41 = 5 THEN 1 ELSE 0 END AS STRING)>>",
    "notes": "p_type",
}
_DERIVED = {"rel": "'ch/' || CAST(p_partkey AS STRING)"}
_TARGETS = {"rel": _DERIVED["rel"], "sha256": "<<p_name || CAST(p_partkey AS STRING)>>"}
_SOURCES = {"rel": "'src/' || CAST(p_partkey AS STRING)", "sha256": _TARGETS["sha256"]}


def file_map(spark: SparkSession, directory: str) -> DataFrame:
    part = read_table(spark, directory, "part")
    return lineage.check_file_map(
        derive(part.filter("p_partkey % 37 <> 6"), _MAP),
        "pos",
        derive(part.filter("p_partkey % 29 <> 7"), _DERIVED),
        derive(part.filter("p_partkey % 31 <> 8"), _TARGETS),
        derive(part, _SOURCES),
    )


_FILE_MAP_SQL = f"""
WITH f AS ({derive_sql("part", _MAP)} WHERE p_partkey % 37 <> 6),
r AS (SELECT *, row_number() OVER (PARTITION BY dissertation_file ORDER BY pos) AS rn FROM f),
m AS (SELECT * FROM r WHERE rn = 1),
d AS ({derive_sql("part", _DERIVED)} WHERE p_partkey % 29 <> 7),
t AS ({derive_sql("part", _TARGETS)} WHERE p_partkey % 31 <> 8), s AS ({derive_sql("part", _SOURCES)}),
j AS (SELECT m.*, t.sha256 AS ta, s.sha256 AS sa, derivation IN ('byte-identical-copy', 'translated-from') AS known
  FROM m LEFT JOIN t ON m.dissertation_file = t.rel LEFT JOIN s ON m.source_2026_file = s.rel),
ok AS (SELECT * FROM j WHERE ta IS NOT NULL AND known AND sa IS NOT NULL)
SELECT 'duplicate_row' AS rule, dissertation_file AS key, CAST(rn AS VARCHAR) AS detail FROM r WHERE rn > 1
UNION ALL SELECT 'missing_row', rel, '' FROM d WHERE rel NOT IN (SELECT dissertation_file FROM m)
UNION ALL SELECT 'unexpected_target', dissertation_file, '' FROM m WHERE dissertation_file NOT IN (SELECT rel FROM d)
UNION ALL SELECT 'missing_target', dissertation_file, '' FROM j WHERE ta IS NULL
UNION ALL SELECT 'unknown_derivation', dissertation_file, derivation FROM j WHERE ta IS NOT NULL AND NOT known
UNION ALL SELECT 'missing_source', dissertation_file, source_2026_file FROM j WHERE ta IS NOT NULL AND known AND sa IS NULL
UNION ALL SELECT 'source_drift', dissertation_file, source_2026_file FROM ok WHERE sa <> source_sha256
UNION ALL SELECT 'stale_hash', dissertation_file, current_sha256 FROM ok WHERE ta <> current_sha256
UNION ALL SELECT 'copy_differs', dissertation_file, source_2026_file FROM ok
  WHERE derivation = 'byte-identical-copy' AND current_sha256 <> source_sha256
"""

_LINK = 'href="/([^"]+)"'


def label_coverage(spark: SparkSession, directory: str) -> DataFrame:
    """Link targets of pages that are not the topic segment of any page address."""
    pages = read_table(spark, directory, "pages")
    topics = pages.select(F.regexp_extract("url", "^https?://([a-z]+)", 1).alias("label"))
    known = topics.unionByName(pages.select(F.regexp_extract("url", r"/([a-z]+)/", 1).alias("label")))
    return lineage.uncovered_labels(pages, "html", known, _LINK)


_LABEL_SQL = f"""
SELECT DISTINCT 'label_not_in_inventory' AS rule, label AS key, '' AS detail
FROM (SELECT unnest(regexp_extract_all(html, '{_LINK}', 1)) AS label FROM pages)
WHERE label NOT IN (SELECT regexp_extract(url, '^https?://([a-z]+)', 1) FROM pages
  UNION SELECT regexp_extract(url, '/([a-z]+)/', 1) FROM pages)
"""

# Assignments of long hexadecimal strings occur in the texts; the built-in patterns do not.
_EXTRA = (
    (
        "token-assignment",
        r"(?i)\b(?:token|secret|password|api_key)\b\s*[:=]\s*\S+",
        ("token", "secret", "password", "api_key"),
    ),
    ("e-mail", r"[a-z0-9.]+@[a-z0-9-]+\.[a-z]{2,}", ("@",)),
)


def _corpus(spark: SparkSession, directory: str) -> DataFrame:
    return union_all(
        [
            read_table(spark, directory, "documents", spread=True).selectExpr("'documents/' || doc_id AS path", "text"),
            read_table(spark, directory, "pages", spread=True).selectExpr("'pages/' || page_id AS path", "html AS text"),
            read_table(spark, directory, "conversations", spread=True).selectExpr(
                "'conversations/' || conv_id || '/' || turn AS path", "text"
            ),
        ]
    )


_CORPUS_SQL = (
    "SELECT 'documents/' || doc_id AS path, text FROM documents UNION ALL "
    "SELECT 'pages/' || page_id, html FROM pages UNION ALL "
    "SELECT 'conversations/' || conv_id || '/' || turn, text FROM conversations"
)


def leak_scan(spark: SparkSession, directory: str) -> DataFrame:
    return scan_texts(_corpus(spark, directory), _EXTRA)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _scan_sql(corpus: str, extra: tuple[tuple[str, str, tuple[str, ...]], ...]) -> str:
    stripped = "line"
    for canary in CANARIES:
        stripped = f"replace({stripped}, {_quoted(canary)}, '')"

    breaks = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
    matches = " UNION ALL ".join(
        f"SELECT path, lineno, {_quoted(n)} AS pattern, line FROM probes WHERE regexp_matches(probe, {_quoted(p)})"
        for n, p, *_ in (*LEAK_PATTERNS, *extra)
    )

    return f"""
WITH corpus AS ({corpus}),
parts AS (SELECT path, string_split_regex(text, '{breaks}') AS ls FROM corpus
  WHERE NOT path LIKE '%.local.md' AND NOT regexp_matches(path, '(?i)[^/]\\.(png|gz)$')),
lines AS (SELECT path, unnest(ls) AS line, generate_subscripts(ls, 1) AS lineno, len(ls) AS n FROM parts),
probes AS (SELECT path, CAST(lineno AS INTEGER) AS lineno, line, {stripped} AS probe FROM lines
  WHERE NOT (lineno = n AND line = '') AND NOT contains(line, '{EXEMPT_MARKER}'))
SELECT path, lineno, pattern, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS snippet FROM ({matches})
UNION ALL SELECT path, 0, 'tracked-private-note', 'this file must never be tracked' FROM corpus WHERE path LIKE '%.local.md'
"""


# Every order as a three-line text; identifiers of each kind are planted by order number.
_PLANTED = {
    "path": "CASE WHEN o_orderkey % 997 = 5 THEN 'notes/' || CAST(o_orderkey AS STRING) || '.local.md' "
    "WHEN o_orderkey % 199 = 3 THEN 'img/' || CAST(o_orderkey AS STRING) || '.PNG' "
    "ELSE 'orders/' || CAST(o_orderkey AS STRING) || '.txt' END",
    "text": "'status ' || o_orderstatus || chr(10) || CASE o_orderkey % 24 "
    "WHEN 0 THEN '  account_id = ' || lpad(CAST(o_orderkey AS STRING), 12, '7') || '  ' "
    "WHEN 1 THEN 'see /home/user' || CAST(o_custkey AS STRING) || '/data and /scratch/user' || CAST(o_custkey AS STRING) "
    "WHEN 2 THEN 'push ' || lpad(CAST(o_orderkey AS STRING), 12, '3') || '.dkr.ecr.eu-west-1.amazonaws.com/x' "
    "WHEN 3 THEN 'account_id = 000000000000' "
    "WHEN 4 THEN 'account_id = 000000000000 then account-id: ' || lpad(CAST(o_orderkey AS STRING), 12, '9') "
    "WHEN 5 THEN 'arn:aws:iam::' || lpad(CAST(o_orderkey AS STRING), 12, '4') || ':role/x' "
    "WHEN 6 THEN 'Bearer = abcdefghij.klmnopqrst-' || CAST(o_orderkey AS STRING) "
    "WHEN 7 THEN 'AKIA' || lpad(CAST(o_orderkey AS STRING), 16, 'Q') || ' leak-scan-allow' "
    "WHEN 8 THEN 'AKIA' || lpad(CAST(o_orderkey AS STRING), 16, 'Q') "
    "WHEN 9 THEN 'https://wiki' || CAST(o_custkey AS STRING) || '.corp/page' "
    "WHEN 10 THEN 'plain ' || lpad(CAST(o_orderkey AS STRING), 12, '1') "
    "WHEN 11 THEN 'repo' || CAST(o_custkey AS STRING) || '.d.codeartifact.us-east-1.amazonaws.com' "
    "ELSE o_orderpriority END || chr(10) || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderpriority || chr(10) END",
}


def leak_scan_planted(spark: SparkSession, directory: str) -> DataFrame:
    return scan_texts(derive(read_table(spark, directory, "orders", spread=True), _PLANTED))


# Event properties under a closed schema, with faults planted by event number.
_PROPS = {
    "event_id": "event_id",
    "json": "CASE event_id % 13 "
    "WHEN 1 THEN '{\"k\": true, \"kind\": \"' || event_type || '\"}' "
    "WHEN 2 THEN '{\"k\": 1.5, \"kind\": \"' || event_type || '\"}' "
    "WHEN 3 THEN '{\"kind\": \"' || event_type || '\", \"host\": \"h\"}' "
    "WHEN 4 THEN '[1, 2]' WHEN 5 THEN '{\"k\": ' "
    "WHEN 6 THEN '{\"k\": null, \"kind\": 7}' "
    "WHEN 7 THEN '{\"k\": 3, \"kind\": \"' || event_type || '\", \"where\": {\"path\": \"/home/bob/x\", \"load\": 2}}' "
    "WHEN 8 THEN '{\"k\": 3, \"kind\": \"' || event_type || '\", \"where\": {\"path\": null, \"load\": \"high\", \"ip\": 1}}' "
    "ELSE substr(props, 1, length(props) - 1) || ', \"kind\": \"' || event_type || '\"}' END",
}
_PROPS_SCHEMA = {
    "k": Field("int"),
    "kind": Field("str", one_of=("click", "view", "purchase", "signup")),
    "where": Field(
        "object",
        required=False,
        members={
            "path": Field("safe_str", nullable=True, required=False),
            "load": Field("float", nullable=True, required=False),
        },
    ),
}


def record_schema_check(spark: SparkSession, directory: str) -> DataFrame:
    records = derive(read_table(spark, directory, "events", spread=True), _PROPS)
    return validate_records(records, "event_id", "json", _PROPS_SCHEMA).select("key", "rule", "label")


_PROPS_SQL = f"""
WITH r AS ({derive_sql("events", _PROPS)}),
g AS (SELECT event_id, json, json_valid(json) AND json_type(CASE WHEN json_valid(json) THEN json END) = 'OBJECT' AS is_obj FROM r),
o AS (SELECT event_id, CAST(json AS JSON) AS j FROM g WHERE is_obj)
SELECT CAST(event_id AS VARCHAR) AS key, 'not_an_object' AS rule, '' AS label FROM g WHERE NOT is_obj
UNION ALL SELECT CAST(event_id AS VARCHAR), 'unknown_field', '' FROM o WHERE len(list_filter(json_keys(j), lambda k: k NOT IN ('k', 'kind', 'where'))) > 0
UNION ALL SELECT CAST(event_id AS VARCHAR), 'missing_field', 'k' FROM o WHERE json_type(j, '$.k') IS NULL
UNION ALL SELECT CAST(event_id AS VARCHAR), 'missing_field', 'kind' FROM o WHERE json_type(j, '$.kind') IS NULL
UNION ALL SELECT CAST(event_id AS VARCHAR), 'wrong_type', 'k' FROM o WHERE json_type(j, '$.k') NOT IN ('UBIGINT', 'BIGINT')
UNION ALL SELECT CAST(event_id AS VARCHAR), 'wrong_type', 'kind' FROM o WHERE json_type(j, '$.kind') <> 'VARCHAR'
UNION ALL SELECT CAST(event_id AS VARCHAR), 'unknown_value', 'kind' FROM o
  WHERE json_type(j, '$.kind') = 'VARCHAR' AND (j->>'$.kind') NOT IN ('click', 'view', 'purchase', 'signup')
UNION ALL SELECT CAST(event_id AS VARCHAR), 'unknown_field', 'where' FROM o
  WHERE json_type(j, '$.where') = 'OBJECT' AND len(list_filter(json_keys(j, '$.where'), lambda k: k NOT IN ('path', 'load'))) > 0
UNION ALL SELECT CAST(event_id AS VARCHAR), 'leak_shaped', 'where.path' FROM o
  WHERE json_type(j, '$.where.path') = 'VARCHAR' AND regexp_matches(j->>'$.where.path', '(?i)/(?:Users|home)/[a-z][a-z0-9_-]+/')
UNION ALL SELECT CAST(event_id AS VARCHAR), 'wrong_type', 'where.load' FROM o
  WHERE json_type(j, '$.where.load') NOT IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'NULL')
"""

# Environment records: the canonical text is assembled in key order, so SQL can digest it too.
_ENV_PAYLOAD = (
    "'{\"determinism_flags\":{},\"determinism_mode\":\"' || CASE WHEN event_id % 17 = 1 THEN 'fast' ELSE 'debug' END || "
    "'\",\"install_mode\":\"local\",\"machine\":\"m' || CAST(user_id AS STRING) || "
    "'\",\"os_release\":\"r\",\"os_system\":\"Linux\",\"package_versions\":{\"a\":' || "
    "CASE WHEN event_id % 17 = 2 THEN '1' ELSE '\"1\"' END || "
    "'},\"processor\":\"p\",\"python_implementation\":\"CPython\",\"python_version\":\"3.13\",\"runtime\":{\"cpu_count\":' || "
    "CASE WHEN event_id % 17 = 3 THEN 'true' ELSE '8' END || '},\"schema_version\":\"1\",\"torch\":{' || "
    "CASE WHEN event_id % 17 = 4 THEN '\"registry_uri\":\"x\"' WHEN event_id % 17 = 5 THEN '' "
    "WHEN event_id % 17 = 6 THEN '\"torch_version\":\"/scratch/bob\"' ELSE '\"torch_version\":\"2.1\"' END || "
    "'},\"uv_lock_sha256\":' || CASE WHEN event_id % 17 = 7 THEN 'null' WHEN event_id % 17 = 8 THEN '\"sha256:12\"' "
    "ELSE '\"sha256:' || <<event_type>> || '\"' END || '}'"
)
_ENV = {"event_id": "event_id", "payload": _ENV_PAYLOAD}
_ENV_JSON = (
    "substr(payload, 1, length(payload) - 1) || ',\"reference_compatibility_status\":\"public-reference-run\"' || "
    "CASE WHEN event_id % 17 = 9 THEN '' ELSE ',\"public_reference_environment_digest\":null' END || "
    "CASE WHEN event_id % 17 = 10 THEN ',\"hostname\":\"h\"' ELSE '' END || ',\"execution_environment_fingerprint\":\"sha256:' || "
    "<<CASE WHEN event_id % 17 = 11 THEN payload || ' ' ELSE payload END>> || '\"}'"
)


def environment_records(spark: SparkSession, directory: str) -> DataFrame:
    payloads = derive(read_table(spark, directory, "events", spread=True), _ENV)
    records = derive(payloads, {"event_id": "event_id", "json": _ENV_JSON})
    return validate_environment_records(records, "event_id", "json").select("key", "rule", "label")


# Rules of single fields by the place they are planted at; the digests are computed again from the canonical text,
# which an unknown key enters, too.
_ENV_EXPECTED = (
    (1, "unknown_value", "determinism_mode"),
    (2, "not_str_to_str", "package_versions"),
    (3, "wrong_type", "runtime.cpu_count"),
    (4, "unknown_field", "torch"),
    (5, "incomplete", "torch"),
    (6, "leak_shaped", "torch.torch_version"),
    (7, "incomplete", "uv_lock_sha256"),
    (8, "bad_digest", "uv_lock_sha256"),
    (9, "missing_field", "public_reference_environment_digest"),
    (10, "unknown_field", ""),
)
_ENV_FIELDS_SQL = " UNION ALL ".join(
    f"SELECT CAST(event_id AS VARCHAR) AS key, '{rule}' AS rule, '{label}' AS label FROM events WHERE event_id % 17 = {k}"
    for k, rule, label in _ENV_EXPECTED
)
_ENV_SQL = f"""
WITH p AS ({derive_sql("events", _ENV)}), r AS ({derive_sql("p", {"event_id": "event_id", "payload": "payload", "json": _ENV_JSON})}),
d AS (SELECT event_id, regexp_extract(json, '"execution_environment_fingerprint":"([^"]*)"', 1) AS stated, 'sha256:' ||
  sha256(CASE WHEN json LIKE '%"hostname"%' THEN replace(payload, ',"install_mode"', ',"hostname":"h","install_mode"') ELSE payload END) AS computed FROM r)
SELECT CAST(event_id AS VARCHAR) AS key, 'fingerprint_mismatch' AS rule, 'execution_environment_fingerprint' AS label
FROM d WHERE stated <> computed
UNION ALL {_ENV_FIELDS_SQL}
"""


def canonical_documents(spark: SparkSession, directory: str) -> DataFrame:
    """Documents as loosely written JSON with nested, unordered and escaped members, and the digest of their canonical text."""
    docs = read_table(spark, directory, "documents", spread=True)
    share = F.col("n_chars") / F.lit(8.0)
    member = lambda name, value: F.concat(F.lit(f' "{name}" :\t'), value)
    inner = F.concat(
        F.lit("{"), member("\\u00fc", F.to_json(F.array("text"))), F.lit(" ,"), member("10", F.to_json(F.struct("source"))), F.lit("}")
    )
    text = F.concat(
        F.lit("\n{"), member("text", inner), F.lit(","), member("share", F.concat(share.cast("decimal(20,4)").cast("string"), F.lit("E0"))),
        F.lit(","), member("lang", F.to_json(F.array("lang", "source"))), F.lit(","), member("doc_id", F.col("doc_id").cast("string")),
        F.lit("}\n"),
    )
    return docs.select("doc_id", tagged_sha256(canonical_json(text)).alias("digest"))


def _escaped_sql(text: str) -> str:
    """A JSON string as Python writes it; the tables hold no control characters but line feeds, tabs and returns."""
    short = "CASE c WHEN '\"' THEN '\\\"' WHEN '\\' THEN '\\\\' WHEN chr(10) THEN '\\n' WHEN chr(9) THEN '\\t' WHEN chr(13) THEN '\\r'"
    unit = "'\\u' || lower(lpad(to_hex({0}), 4, '0'))"
    code = "unicode(c)"
    pair = f"{unit.format(f'55296 + ({code} - 65536) // 1024')} || {unit.format(f'56320 + ({code} - 65536) % 1024')}"
    char = (
        f"{short} ELSE CASE WHEN {code} BETWEEN 32 AND 126 THEN c WHEN {code} < 65536 THEN {unit.format(code)} ELSE {pair} END END"
    )
    return f"'\"' || coalesce(list_aggregate(list_transform(regexp_extract_all({text}, '(?s).'), lambda c: {char}), 'string_agg', ''), '') || '\"'"


_CANONICAL_SQL = f"""
WITH s AS (SELECT doc_id, n_chars / 8.0::DOUBLE AS share, {_escaped_sql("text")} AS text, {_escaped_sql("lang")} AS lang,
  {_escaped_sql("source")} AS source FROM documents)
SELECT doc_id, 'sha256:' || sha256('{{"doc_id":' || doc_id || ',"lang":[' || lang || ',' || source || '],"share":' || CAST(share AS VARCHAR) ||
  ',"text":{{"10":{{"source":' || source || '}},"\\u00fc":[' || text || ']}}}}') AS digest FROM s
"""


def _artifact_json(a: Column, b: Column, c: Column, n: Column) -> Column:
    """Two-feature whitening artifacts; each remainder of ``n`` breaks another rule."""
    case = n % 12
    det = a * c - b * b
    inverse = (c / det, -b / det, a / det)
    off = F.when(case == 1, b + 0.5).otherwise(b)
    scale = F.when(case == 2, F.lit(1.5)).otherwise(F.lit(1.0))
    mean = F.when(case == 3, F.array(a)).otherwise(F.array(a, c))
    body = F.struct(
        F.when(case == 4, "2").otherwise("1").alias("schema_version"),
        F.when(case == 5, "pca").otherwise("zca_whitening").alias("kind"),
        F.when(case == 6, F.lit(-1.0)).otherwise(F.lit(1e-5)).alias("eps"),
        F.when(case == 7, 1).otherwise(100).alias("n_samples"),
        F.lit(2).alias("n_features"),
        F.when(case == 8, "sha256:zz").otherwise(tagged_sha256(n.cast("string"))).alias("input_manifest_sha256"),
        mean.alias("mean"),
        F.array(F.array(a, off), F.array(b, c)).alias("whiten"),
        F.array(
            F.array(inverse[0] * scale, inverse[1]), F.array(inverse[1], inverse[2])
        ).alias("unwhiten"),
        F.when(case == 9, "x").alias("extra"),
    )
    return F.to_json(body)


def whitening_artifacts(spark: SparkSession, directory: str) -> DataFrame:
    """An artifact from each of the 32 pairs of entries of a row; every number decides about its faults."""
    e = embeddings(spark, directory, spread=True)
    pair = lambda k: F.struct(k.alias("k"), F.get("f", k * 2).alias("x"), F.get("f", k * 2 + 1).alias("y"))
    pairs = e.select("vec_id", F.inline(F.transform(F.sequence(F.lit(0), F.lit(31)), pair)))
    number = F.col("vec_id") * 32 + F.col("k")
    records = pairs.select(
        number.alias("number"), _artifact_json(F.col("x") + 2.0, F.col("x") - F.col("y"), F.col("y") + 2.0, number).alias("json")
    )
    return validate_whitening_records(records, "number", "json").select("key", "rule", "label")


# Rules of single fields by the number that plants them; those of the matrices from the values.
_ARTIFACT_FIELDS = (
    (4, "unknown_value", "schema_version"),
    (5, "unknown_value", "kind"),
    (6, "out_of_range", "eps"),
    (7, "out_of_range", "n_samples"),
    (8, "bad_digest", "input_manifest_sha256"),
    (9, "unknown_field", ""),
)
_FIELDS_SQL = " UNION ALL ".join(
    f"SELECT CAST(number AS VARCHAR) AS key, '{rule}' AS rule, '{label}' AS label FROM m WHERE number % 12 = {k}"
    for k, rule, label in _ARTIFACT_FIELDS
)
_ARTIFACT_SQL = f"""
WITH p AS (SELECT vec_id * 32 + k AS number, CAST(embedding[2 * k + 1] AS DOUBLE) AS x, CAST(embedding[2 * k + 2] AS DOUBLE) AS y
  FROM embeddings, range(32) r(k)),
w AS (SELECT number, x + 2 AS a, x - y AS b, y + 2 AS c, x - y + CASE WHEN number % 12 = 1 THEN 0.5 ELSE 0 END AS off,
  CASE WHEN number % 12 = 2 THEN 1.5 ELSE 1 END AS s, CASE WHEN number % 12 = 3 THEN 1 ELSE 2 END AS n_mean FROM p),
m AS (SELECT *, c / (a * c - b * b) * s AS u, -b / (a * c - b * b) AS v, a / (a * c - b * b) AS z FROM w),
f AS (SELECT number, CASE WHEN n_mean <> 2 THEN 'bad_shape'
    WHEN abs(off - b) > 1e-8 + 1e-5 * least(abs(b), abs(off)) THEN 'not_symmetric'
    WHEN abs(a * u + off * v - 1) > 1e-6 + 1e-5 OR abs(a * v + off * z) > 1e-6 OR abs(b * u + c * v) > 1e-6
      OR abs(b * v + c * z - 1) > 1e-6 + 1e-5 THEN 'not_inverse' END AS rule FROM m)
SELECT CAST(number AS VARCHAR) AS key, rule, 'matrices' AS label FROM f WHERE rule IS NOT NULL
UNION ALL {_FIELDS_SQL}
"""


# Two versions of a tree of documents: some changed, some gone, some new.
_TREE_OLD = {"rel": "'docs/' || doc_id", "sha256": "<<coalesce(text, '')>>"}
_TREE_NEW = _TREE_OLD | {"sha256": "CASE WHEN doc_id % 211 = 7 THEN <<'new' || coalesce(text, '')>> ELSE <<coalesce(text, '')>> END"}


def stored_tree_changes(spark: SparkSession, directory: str) -> DataFrame:
    """Both versions stored with their hash levels, and compared from the top."""
    docs = read_table(spark, directory, "documents", "doc_id", "text", spread=True)
    folder = f"{checkpoint_folder(spark)}/trees-{uuid.uuid4().hex}"
    store_tree(derive(docs.filter("doc_id % 173 <> 5"), _TREE_OLD), f"{folder}/old")
    store_tree(derive(docs.filter("doc_id % 197 <> 3"), _TREE_NEW), f"{folder}/new")
    return compare_trees(read_tree(spark, f"{folder}/old"), read_tree(spark, f"{folder}/new"))


_TREES_SQL = f"""
WITH o AS ({derive_sql("documents", _TREE_OLD)} WHERE doc_id % 173 <> 5), n AS ({derive_sql("documents", _TREE_NEW)} WHERE doc_id % 197 <> 3)
SELECT 'missing_file' AS rule, rel AS key, sha256 AS detail FROM o WHERE rel NOT IN (SELECT rel FROM n)
UNION ALL SELECT 'unlisted_file', rel, sha256 FROM n WHERE rel NOT IN (SELECT rel FROM o)
UNION ALL SELECT 'hash_mismatch', rel, n.sha256 FROM o JOIN n USING (rel) WHERE o.sha256 <> n.sha256
"""


def table_fingerprint(spark: SparkSession, directory: str) -> DataFrame:
    docs = read_table(spark, directory, "documents", "text", "lang")
    return table_digest(docs, row_digest("text", "lang"))


def _level_sql(source: str, width: int, level: int) -> str:
    return (
        f"l{level} AS (SELECT p, sha256(string_agg(node, ',' ORDER BY node)) AS h, sum(n) AS n FROM "
        f"(SELECT substr(k, 1, {width}) AS p, node, n FROM {source}) GROUP BY p)"
    )


_FINGERPRINT_SQL = f"""
WITH d AS (SELECT sha256(sha256('v' || text) || '|' || sha256('v' || lang)) AS d FROM documents),
c AS (SELECT d AS k, d || ':' || count(*) AS node, count(*) AS n FROM d GROUP BY d),
{_level_sql("c", LEVELS[0], 0)},
{_level_sql("(SELECT p AS k, p || ':' || h AS node, n FROM l0)", LEVELS[1], 1)},
{_level_sql("(SELECT p AS k, p || ':' || h AS node, n FROM l1)", LEVELS[2], 2)}
SELECT h AS digest, CAST(n AS BIGINT) AS n_rows FROM l2
"""

BOUND = {
    "lineage_fanout": Bound(lineage_fanout, _FANOUT_SQL),
    "file_map": Bound(file_map, _FILE_MAP_SQL),
    "label_coverage": Bound(label_coverage, _LABEL_SQL),
    "leak_scan": Bound(leak_scan, _scan_sql(_CORPUS_SQL, _EXTRA)),
    "leak_scan_planted": Bound(leak_scan_planted, _scan_sql(derive_sql("orders", _PLANTED), ())),
    "record_schema_check": Bound(record_schema_check, _PROPS_SQL),
    "environment_records": Bound(environment_records, _ENV_SQL),
    "canonical_documents": Bound(canonical_documents, _CANONICAL_SQL),
    "whitening_artifacts": Bound(whitening_artifacts, _ARTIFACT_SQL),
    "stored_tree_changes": Bound(stored_tree_changes, _TREES_SQL),
    "table_fingerprint": Bound(table_fingerprint, _FINGERPRINT_SQL),
}
