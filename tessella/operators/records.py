"""Closed-schema validation of JSON records held in a table column."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Collection, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.canonical_json import canonical_json
from tessella.functions.keyed import tagged_sha256
from tessella.functions.text import LEAK_NEEDLES, LEAK_PATTERNS, first_leak, is_digest

# Without one of these, no pattern can match; every pattern has its own.
ALL_NEEDLES = sorted({needle for name, _ in LEAK_PATTERNS for needle in LEAK_NEEDLES[name]})

Violation = tuple[str, str, Column]  # rule, label, condition


@dataclass(frozen=True)
class Field:
    """One permitted key: its kind and whether it may be absent or null.

    Kinds: str, safe_str (leak-scanned), digest, int, float (finite), bool, object, str_map.
    ``members`` closes the keys of an object; ``one_of`` lists the permitted strings; a number must lie
    ``above`` its bound.
    """

    kind: str
    nullable: bool = False
    required: bool = True
    members: Mapping[str, Field] | None = None
    one_of: Sequence[str] | None = None
    above: float | None = None


def _json_path(path: str) -> str:
    return "$" + "".join(f"['{part}']" for part in path.split("."))


class _Record:
    """Typed access to one JSON column through the variant functions.

    Per row the text is parsed once, every object that is asked for is taken apart once into a map of its
    members, and of the members the types and texts that rules read are looked up once. All become columns
    through :meth:`resolve`, each by a projection of its own, which the optimizer keeps as the many rules
    read it more than once.
    """

    PARSED = "_record"
    MEMBERS = "_members"
    LEAKS = "_leaks"

    def __init__(self, json_column: str) -> None:
        self.text = F.col(json_column)
        self.variant = F.col(self.PARSED)
        self.objects: dict[str, str] = {"": self.MEMBERS}
        self.paths: dict[str, str] = {}
        self.texts: dict[str, str] = {}
        self.leak_fields: list[str] = []

    def parse(self, df: DataFrame) -> DataFrame:
        if self.PARSED in df.columns:
            return df
        return df.withColumn(self.PARSED, F.try_parse_json(self.text))

    def resolve(self, df: DataFrame) -> DataFrame:
        types = [F.schema_of_variant(self.member(p)).alias(a) for p, a in self.paths.items()]
        texts = [self._text(p).alias(a) for p, a in self.texts.items()]
        found = self.parse(df)
        for depth in range(1 + max(self._depth(p) for p in self.objects)):
            level = [(p, a) for p, a in self.objects.items() if self._depth(p) == depth]
            whole = [F.try_variant_get(self.member(p) if p else self.variant, "$", "map<string,variant>").alias(a) for p, a in level]
            found = found.select("*", *whole)
        if self.LEAKS not in df.columns and self.leak_fields:
            # All texts that leaks are looked for in are searched together; few records have any needle at all.
            joined = F.lower(F.concat_ws("\n", *[self._text(p) for p in self.leak_fields]))
            near = F.exists(F.array(joined), lambda text: reduce(or_, [text.contains(n) for n in ALL_NEEDLES]))
            texts.append(near.alias(self.LEAKS))
        return found.select("*", *types, *texts)

    @staticmethod
    def _depth(path: str) -> int:
        return path.count(".") + 1 if path else 0

    def object(self, path: str) -> Column:
        """The members of the object at a path; null where there is none."""
        outer = path.rpartition(".")[0]
        if path and outer not in self.objects:
            self.object(outer)
        return F.col(self.objects.setdefault(path, f"{self.MEMBERS}{len(self.objects)}"))

    def member(self, path: str) -> Column:
        outer, _, name = path.rpartition(".")
        return self.object(outer)[name]

    def _text(self, path: str) -> Column:
        return F.try_variant_get(self.member(path), "$", "string")

    def string(self, path: str) -> Column:
        """The text at a path, looked up once per record."""
        self.member(path)
        return F.col(self.texts.setdefault(path, f"_text{len(self.texts)}"))

    def leak_shaped(self, path: str) -> Column:
        text = self.string(path)
        self.leak_fields.append(path)
        return F.col(self.LEAKS) & first_leak(text).isNotNull()

    def is_object(self) -> Column:
        return F.col(self.MEMBERS).isNotNull()

    def type_of(self, path: str) -> Column:
        self.member(path)
        return F.col(self.paths.setdefault(path, f"_type{len(self.paths)}"))

    def get(self, path: str, as_type: str) -> Column:
        return F.try_variant_get(self.variant, _json_path(path), as_type)

    def is_whole_number(self, path: str) -> Column:
        """The number is written without point or exponent, as integers are; short ones tell by their type."""
        written = F.get_json_object(self.text, _json_path(path)).rlike(r"^-?[0-9]+$")
        return (self.type_of(path) == "BIGINT") | written

    def keys(self, path: str | None = None) -> Column:
        return F.map_keys(self.object(path or ""))

    def non_string_members(self, path: str) -> Column:
        wrong = F.map_filter(self.object(path), lambda _, v: F.schema_of_variant(v) != "STRING")
        return F.map_keys(wrong)


_IS_INT = r"^(BIGINT|DECIMAL\(\d+,0\))$"
_IS_REAL = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL\(\d+,\d+\))$"


def _has_kind(kind: str, type_name: Column) -> Column:
    if kind in ("str", "safe_str", "digest"):
        return type_name == "STRING"
    if kind == "bool":
        return type_name == "BOOLEAN"
    if kind == "int":
        return type_name.rlike(_IS_INT)
    if kind == "float":
        return type_name.rlike(_IS_REAL)
    if kind in ("object", "str_map"):
        return type_name.startswith("OBJECT<")
    raise ValueError(f"unknown field kind {kind!r}")


def _field_violations(record: _Record, path: str, field: Field) -> list[Violation]:
    type_name = record.type_of(path)
    present = type_name.isNotNull() & (type_name != "VOID")
    right_kind = _has_kind(field.kind, type_name)
    if field.kind == "int":
        right_kind = right_kind & F.coalesce(record.is_whole_number(path), F.lit(False))
    fits = present & right_kind
    out: list[Violation] = []
    if field.required:
        out.append(("missing_field", path, type_name.isNull()))
    wrong = present & ~right_kind
    if not field.nullable:
        wrong = wrong | (type_name == "VOID")
    out.append(("wrong_type", path, wrong))
    if field.one_of is not None:
        out.append(("unknown_value", path, fits & ~record.string(path).isin(*field.one_of)))
    if field.kind == "digest":
        out.append(("bad_digest", path, fits & ~is_digest(record.string(path))))
    if field.kind == "safe_str":
        out.append(("leak_shaped", path, fits & record.leak_shaped(path)))
    if field.kind == "float":
        number = record.get(path, "double")
        endless = number.isNull() | F.isnan(number) | (F.abs(number) == F.lit(float("inf")))
        out.append(("not_finite", path, fits & endless))
    if field.above is not None:
        beyond = record.get(path, "double") > F.lit(float(field.above))
        out.append(("out_of_range", path, fits & ~F.coalesce(beyond, F.lit(False))))
    if field.kind == "str_map":
        out.append(("not_str_to_str", path, fits & (F.size(record.non_string_members(path)) > 0)))
    return out


def _keys_violation(record: _Record, path: str | None, allowed: Collection[str]) -> Violation:
    known = F.array(*[F.lit(k) for k in sorted(allowed)])
    extra = F.array_except(record.keys(path), known)
    return ("unknown_field", path or "", F.size(extra) > 0)


def closed_schema_violations(
    record: _Record, schema: Mapping[str, Field]
) -> list[Violation]:
    """Rules in the order a reader would meet them: keys, top-level values, nested values."""
    out = [_keys_violation(record, None, schema)]
    for name, field in schema.items():
        out += _field_violations(record, name, field)
    for name, field in schema.items():
        if field.members is None:
            continue
        out.append(_keys_violation(record, name, field.members))
        for member, inner in field.members.items():
            out += _field_violations(record, f"{name}.{member}", inner)
    return out


def _report(df: DataFrame, key: str, record: _Record, violations: Sequence[Violation]) -> DataFrame:
    """Rows ``(key, ordinal, rule, label)``; the lowest ordinal is the first violation."""
    is_object = record.is_object()
    entries = [F.when(~is_object, _entry(0, "not_an_object", ""))]
    for ordinal, (rule, label, condition) in enumerate(violations, 1):
        entries.append(F.when(is_object & condition, _entry(ordinal, rule, label)))
    # Not inside the generator, where nothing is compiled; of a plain column there, the optimizer would infer a
    # filter and push copies of all rules down with it.
    hits = record.resolve(df).select(F.col(key).cast("string").alias("key"), F.array(*entries).alias("hits"))
    return hits.select("key", F.inline(F.array_compact("hits")))


def _entry(ordinal: int, rule: str, label: str) -> Column:
    return F.struct(
        F.lit(ordinal).alias("ordinal"), F.lit(rule).alias("rule"), F.lit(label).alias("label")
    )


def validate_records(
    df: DataFrame, key: str, json_column: str, schema: Mapping[str, Field]
) -> DataFrame:
    record = _Record(json_column)
    return _report(df, key, record, closed_schema_violations(record, schema))


def first_problems(report: DataFrame) -> DataFrame:
    """Only the first violation of each record."""
    first = F.min_by(F.struct("rule", "label"), "ordinal").alias("p")
    return report.groupBy("key").agg(first).select("key", "p.rule", "p.label")


# Fixed values of the execution-environment record.
RECORD_SCHEMA_VERSION = "1"
INSTALL_MODES = ("public-reference-container", "private-mirror", "local", "unknown")
COMPATIBILITY = ("public-reference-run", "equivalence-verified", "pending-equivalence", "unknown")
CANONICAL = ("public-reference-run", "equivalence-verified")
DETERMINISM_MODES = ("debug", "research", "benchmark", "unset")
NOT_FINGERPRINTED = (
    "execution_environment_fingerprint",
    "public_reference_environment_digest",
    "reference_compatibility_status",
)


def _optional(**kinds: str) -> dict[str, Field]:
    return {name: Field(kind, nullable=True, required=False) for name, kind in kinds.items()}


ENVIRONMENT_SCHEMA: dict[str, Field] = {
    "schema_version": Field("str", one_of=(RECORD_SCHEMA_VERSION,)),
    "python_version": Field("str"),
    "python_implementation": Field("str"),
    "os_system": Field("str"),
    "os_release": Field("str"),
    "machine": Field("str"),
    "processor": Field("str"),
    "package_versions": Field("str_map"),
    "torch": Field(
        "object",
        members=_optional(
            torch_version="safe_str",
            torch_cuda_version="safe_str",
            cuda_available="bool",
            cudnn_version="int",
            driver_version="safe_str",
            gpu_model_class="safe_str",
            gpu_compute_capability="safe_str",
            gpu_total_memory_gib="float",
        ),
    ),
    "runtime": Field(
        "object",
        members=_optional(
            cpu_count="int",
            total_ram_gib="float",
            blas_impl="safe_str",
            cxx_version="safe_str",
            openmp_enabled="bool",
            torch_num_threads="int",
            torch_num_interop_threads="int",
            torch_build_config_sha256="digest",
        ),
    ),
    "determinism_flags": Field(
        "object",
        members=_optional(
            deterministic_algorithms="bool", cudnn_deterministic="bool", cudnn_benchmark="bool"
        ),
    ),
    "uv_lock_sha256": Field("digest", nullable=True),
    "determinism_mode": Field("str", one_of=DETERMINISM_MODES),
    "install_mode": Field("str", one_of=INSTALL_MODES),
    "reference_compatibility_status": Field("str", one_of=COMPATIBILITY),
    "public_reference_environment_digest": Field("digest", nullable=True),
    "execution_environment_fingerprint": Field("digest"),
}


def canonical_fingerprint(payload: Mapping[str, object]) -> str:
    text = json.dumps(payload, sort_keys=True, separators=(",", ":"))
    return "sha256:" + hashlib.sha256(text.encode()).hexdigest()


def environment_fingerprint(json_column: Column, parsed: Column | None = None) -> Column:
    """Digest of the canonical JSON of a record without its labelling fields; null unless it is an object."""
    return tagged_sha256(canonical_json(json_column, NOT_FINGERPRINTED, parsed=parsed))


def validate_environment_records(df: DataFrame, key: str, json_column: str) -> DataFrame:
    """Closed schema, completeness of canonical records, and the fingerprint."""
    record = _Record(json_column)
    parsed = record.parse(df)
    prepared = parsed.select("*", environment_fingerprint(record.text, record.variant).alias("expected_fp"))
    violations = closed_schema_violations(record, ENVIRONMENT_SCHEMA)
    canonical = record.string("reference_compatibility_status").isin(*CANONICAL)
    violations.append(
        ("incomplete", "uv_lock_sha256", canonical & (record.type_of("uv_lock_sha256") == "VOID"))
    )
    for parent in ("torch", "runtime"):
        violations.append(("incomplete", parent, canonical & (F.size(record.keys(parent)) == 0)))
    field = "execution_environment_fingerprint"
    stated = record.string(field)
    differs = is_digest(stated) & ~stated.eqNullSafe(F.col("expected_fp"))
    violations.append(("fingerprint_mismatch", field, differs))
    return _report(prepared, key, record, violations)


WHITENING_KEYS = (
    "schema_version",
    "kind",
    "eps",
    "n_samples",
    "n_features",
    "input_manifest_sha256",
    "mean",
    "whiten",
    "unwhiten",
)


def _matrix_faults(
    n_features: pa.Array, mean: pa.Array, whiten: pa.Array, unwhiten: pa.Array
) -> pa.Array:
    """First fault of each artifact's arrays, or null."""

    def fault(n: int | None, *parts: object) -> str | None:
        try:
            mu, w, u = (np.asarray(p, dtype=np.float64) for p in parts)
        except (TypeError, ValueError):
            return "bad_shape"
        if n is None or mu.shape != (n,) or w.shape != (n, n) or u.shape != (n, n):
            return "bad_shape"
        if not all(np.isfinite(a).all() for a in (mu, w, u)):
            return "not_finite"
        if not np.allclose(w, w.T, atol=1e-8):
            return "not_symmetric"
        if not np.allclose(w @ u, np.eye(n), atol=1e-6):
            return "not_inverse"
        return None

    columns = [c.to_pylist() for c in (n_features, mean, whiten, unwhiten)]
    return pa.array([fault(*row) for row in zip(*columns, strict=True)], pa.string())


def validate_whitening_records(df: DataFrame, key: str, json_column: str) -> DataFrame:
    """Whitening artifacts as JSON: closed keys, kinds and ranges, then shapes and inverses."""
    record = _Record(json_column)
    prepared = record.parse(df).withColumn(
        "matrix_fault",
        F.arrow_udf(_matrix_faults, "string")(
            record.get("n_features", "int"),
            record.get("mean", "array<double>"),
            record.get("whiten", "array<array<double>>"),
            record.get("unwhiten", "array<array<double>>"),
        ),
    )
    schema = {
        "schema_version": Field("str", one_of=("1",)),
        "kind": Field("str", one_of=("zca_whitening",)),
        "input_manifest_sha256": Field("digest", nullable=True, required=False),
        "eps": Field("float"),
        "n_samples": Field("int"),
        "n_features": Field("int"),
    }
    violations = [_keys_violation(record, None, WHITENING_KEYS)]
    for name, field in schema.items():
        violations += _field_violations(record, name, field)
    for name, low in (("eps", None), ("n_samples", 2), ("n_features", 1)):
        value = record.get(name, "double")
        violations.append(("out_of_range", name, ~(value > 0) if low is None else value < low))
    for name in ("bad_shape", "not_finite", "not_symmetric", "not_inverse"):
        violations.append((name, "matrices", F.col("matrix_fault") == name))
    return _report(prepared, key, record, violations)
