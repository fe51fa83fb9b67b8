"""Content counts and role leakage on a stream of manifest rows, in keyed state that the watermark closes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FINDINGS = "rule string, key string, detail string"
_STATE = "n long, roles string, timer long"
_PARTIAL = "key string, role string, n long, at timestamp"


def use_keyed_state(spark: SparkSession) -> None:
    """Keyed state of any size needs the state store that keeps it on disk."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )


def _content(delay_ms: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """Of one digest: how often it came, under which roles, and the time that closes it.

    State travels with the rows, a batch of digests at a time, so that a digest costs no calls of its own to the store.
    """

    def closed(key: str, n: int, roles: str) -> list[tuple[str, str, str]]:
        found = [("split_leakage", key, roles)] if "," in roles else []
        return found + ([("duplicate_content", key, str(n))] if n > 1 else [])

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, roles, timer = state.get if state.exists else (0, "", 0)
        if state.hasTimedOut:
            state.remove()
            if found := closed(key[0], n, roles):
                yield pd.DataFrame(found, columns=["rule", "key", "detail"])
            return
        known, last = set(filter(None, roles.split(","))), 0
        before = len(known)
        for rows in batches:
            n += int(rows["n"].sum())
            known |= set(rows["role"])
            last = max(last, int(rows["at"].max().timestamp() * 1000))
        due, joined = max(last + delay_ms, timer), ",".join(sorted(known))
        state.update((n, joined, due))
        state.setTimeoutTimestamp(due)
        if len(known) > max(before, 1):
            yield pd.DataFrame({"rule": ["leakage_seen"], "key": [key[0]], "detail": [joined]})

    return update


def _combined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Copies inside a batch travel as one row, so a hot digest is a row a task and batch."""
    for rows in batches:
        yield rows.groupby(["key", "role"], as_index=False).agg(n=("at", "size"), at=("at", "max"))


def content_findings(
    manifest: DataFrame, event_time: str, delay: str, *, digest: str = "content_sha256", role: str = "role"
) -> DataFrame:
    """Findings ``(rule, key, detail)`` of an arriving manifest, in append mode.

    ``leakage_seen`` comes with the row that brings a digest a further role. When the watermark has passed a
    digest's last row by the delay, its state is closed with what the batch rules say of it: ``split_leakage`` with
    its roles, ``duplicate_content`` with its count. State is bounded by the delay. A digest that comes again after
    that starts anew. Rows without a digest or role take no part; an empty role is none.
    """
    spark = manifest.sparkSession
    delay_ms = int(spark.sql(f"SELECT unix_millis(timestamp_seconds(0) + INTERVAL {delay}) AS ms").first()["ms"])
    rows = manifest.select(F.col(digest).alias("key"), F.col(role).alias("role"), F.col(event_time).alias("at"))
    sound = rows.filter("key IS NOT NULL AND role <> '' AND at IS NOT NULL")
    partial = sound.mapInPandas(_combined, _PARTIAL).withWatermark("at", delay)
    return partial.groupBy("key").applyInPandasWithState(_content(delay_ms), FINDINGS, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
