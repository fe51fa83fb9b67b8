"""Line-level scan of text tables for infrastructure-shaped strings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import (
    LEAK_NEEDLES,
    LEAK_PATTERNS,
    first_leak,
    matches_leak,
    split_lines,
    strip_canaries,
)
from tessella.sources import lines as source_lines

# Name, expression, and optionally lower-case literals every match contains.
Pattern = tuple[str, str] | tuple[str, str, tuple[str, ...]]

# Suffixes treated as binary, the per-line exemption marker, private-note names.
BINARY_SUFFIXES = (
    ".png .jpg .jpeg .gif .pdf .psd .ico .zip .gz .tar .whl .parquet .npy .npz .pt .pth .ckpt "
    ".woff .woff2 .ttf .otf"
).split()
EXEMPT_MARKER = "leak-scan-allow"
FORBIDDEN_PATHS = ("docs/infrastructure.local.md",)
FORBIDDEN_SUFFIXES = (".local.md",)


def is_forbidden_path(path: Column) -> Column:
    hit = path.isin(*FORBIDDEN_PATHS)
    for suffix in FORBIDDEN_SUFFIXES:
        hit = hit | path.endswith(suffix)
    return hit


def has_binary_suffix(path: Column) -> Column:
    # A leading dot in a file name is not a suffix.
    suffix = F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))
    return suffix.isin(*BINARY_SUFFIXES)


def _worth_splitting(text: Column, patterns: Sequence[tuple[str, str, tuple[str, ...]]]) -> Column:
    """Whether any line of a text can match; a superset of the texts with findings.

    A line is changed only by removing a canary, and canaries contain needles themselves, so it
    is enough to look for the needles of all patterns. The lambda binds the text and its lower
    case once; a plain condition would have them computed again for every needle.
    """
    needles = sorted({needle for _, _, group in patterns for needle in group})
    unguarded = [pattern for _, pattern, group in patterns if not group]

    def has_hit(parts: Column) -> Column:
        hit = F.lit(False)
        for needle in needles:
            hit = hit | parts["lowered"].contains(needle)
        for pattern in unguarded:
            hit = hit | parts["raw"].rlike(pattern)
        return hit

    bound = F.array(F.struct(text.alias("raw"), F.lower(text).alias("lowered")))
    return F.exists(bound, has_hit)


def _line_bound(pattern: str) -> bool:
    """Patterns whose meaning depends on where a line or string ends."""
    return any(token in pattern for token in ("^", "$", r"\A", r"\z", r"\Z", r"\G", "(?<", "(?!", "(?="))


def scan_texts(
    texts: DataFrame,
    extra_patterns: Sequence[Pattern] = (),
    *,
    snippet_length: int | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Findings ``(path, lineno, pattern, snippet)`` of a ``(path, text)`` table.

    One finding per line and matching pattern, on the line with canaries removed; lines with the
    exemption marker are skipped. The snippet is the whole line unless a length is given. ``carry`` names further
    columns of the texts to keep. A forbidden path is one finding at line 0 and its text is not read. Null texts (undecodable files) and binary suffixes are skipped. The scan is one narrow
    pass, so it runs unchanged on a stream, and only texts that can contain a finding are split.
    """
    patterns = [(name, pattern, LEAK_NEEDLES[name]) for name, pattern in LEAK_PATTERNS]
    patterns += [(p[0], p[1], p[2] if len(p) > 2 else ()) for p in extra_patterns]
    forbidden = is_forbidden_path(F.col("path"))
    readable = ~has_binary_suffix(F.col("path"))
    if not any(_line_bound(pattern) for _, pattern, *_ in extra_patterns):
        readable = readable & _worth_splitting(F.col("text"), patterns)
    lines = F.when(forbidden, F.array(F.lit(""))).otherwise(split_lines(F.col("text")))
    numbered = texts.filter(forbidden | readable).select(
        "path", *carry, forbidden.alias("forbidden"), F.posexplode(lines).alias("pos", "line")
    )
    probed = (
        numbered.filter(~F.col("line").contains(EXEMPT_MARKER))
        .withColumn("probe", strip_canaries(F.col("line")))
        .withColumn("lowered", F.lower("probe"))
    )
    matched = F.filter(
        F.array(
            *[
                F.when(matches_leak(F.col("probe"), F.col("lowered"), p, needles), F.lit(name))
                for name, p, needles in patterns
            ]
        ),
        lambda name: name.isNotNull(),
    )
    snippet = F.regexp_replace("line", r"^\s+|\s+$", "")
    if snippet_length is not None:
        snippet = F.substring(snippet, 1, snippet_length)
    note = F.lit("this file must never be tracked")
    return probed.select(
        "path",
        *carry,
        F.when(F.col("forbidden"), 0).otherwise(F.col("pos") + 1).cast("int").alias("lineno"),
        F.explode(
            F.when(F.col("forbidden"), F.array(F.lit("tracked-private-note"))).otherwise(matched)
        ).alias("pattern"),
        F.when(F.col("forbidden"), note).otherwise(snippet).alias("snippet"),
    )


def scan_files(
    spark: SparkSession, root: str, extra_patterns: Sequence[Pattern] = (), *, snippet_length: int | None = None
) -> DataFrame:
    """The findings of ``scan_texts`` for the files under ``root``, which may be larger than a task.

    Lines are scanned split by split and numbered afterwards. Files that are not UTF-8 have no findings, and neither do
    binary suffixes; a forbidden path has its one finding even where the file is empty. Paths are judged once a split:
    for every line that takes several times as long as to search it.
    """
    path = source_lines.relative(spark, root)
    lines = source_lines.read_lines(spark, root)
    # A line that is not valid has no text to search; its file is left out afterwards. With its own break back, what
    # stands between a further break and that one is a line, too. An empty path is neither forbidden nor binary.
    ended = F.concat("value", F.lit("\n"))
    texts = lines.select(F.lit("").alias("path"), "file", "block", "id", F.try_validate_utf8(ended).alias("text"))
    found = scan_texts(texts, extra_patterns, snippet_length=snippet_length, carry=("file", "block", "id")).drop("path")
    wanted = ~has_binary_suffix(path) & ~is_forbidden_path(path)
    inside = source_lines.numbered(
        found.withColumnRenamed("lineno", "inner"), lines, inner="inner", lineno="lineno", wanted=wanted
    ).withColumn("path", path)
    listed = source_lines.file_paths(spark, root).withColumn("path", path)
    forbidden = scan_texts(listed.where(is_forbidden_path(F.col("path"))).select("path", F.lit("").alias("text")))
    columns = ["path", F.col("lineno").cast("long").alias("lineno"), "pattern", "snippet"]
    return inside.select(*columns).unionByName(forbidden.select(*columns))


def canaries_all_detected(canaries: DataFrame) -> DataFrame:
    """One row ``(all_detected)``: every ``(value)`` matches at least one pattern."""
    return canaries.agg(F.bool_and(first_leak(F.col("value")).isNotNull()).alias("all_detected"))
