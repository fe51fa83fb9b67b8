"""Stateless operators on streams, and first-seen content with bounded state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessella.operators.leakscan import Pattern, scan_texts
from tessella.plans.representation import FittedRepresentation, apply_representation


def represent_stream(
    patches: DataFrame, rgb: str, fitted: FittedRepresentation, out: str = "features"
) -> DataFrame:
    """Frozen representation of arriving patches."""
    return patches.withColumn(out, apply_representation(F.col(rgb), fitted))


def scan_stream(
    texts: DataFrame, extra_patterns: Sequence[Pattern] = ()
) -> DataFrame:
    """Leak findings of arriving texts ``(path, text)``."""
    return scan_texts(texts, extra_patterns)


def first_seen_content(
    manifest: DataFrame, event_time: str, delay: str, digest: str = "content_sha256"
) -> DataFrame:
    """Arriving rows whose content was not seen within the watermark delay.

    State expires with the watermark, so it is bounded by the delay and not by the history.
    """
    return manifest.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([digest])


def append_to_files(
    stream: DataFrame, path: str, checkpoint: str, *, fmt: str = "parquet"
) -> StreamingQuery:
    """Process what is available and append it exactly once to files."""
    return (
        stream.writeStream.format(fmt)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
