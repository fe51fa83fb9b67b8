"""Sharding by jump consistent hashing: a stable key and the number of shards decide, no ring table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import ranked

_STEP = np.uint64(2862933555777941757)


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key. From n to n + 1 shards a key stays or moves to the new shard.

    The jump of a key always goes forward, so at most ``shards`` rounds are run; each handles only the
    keys that still jump.
    """
    state = keys.astype(np.int64).view(np.uint64).copy()
    place = np.zeros(len(state), dtype=np.int64)
    jumping = np.arange(len(state))
    jump = np.zeros(len(state), dtype=np.int64)
    while len(jumping):
        place[jumping] = jump
        state[jumping] = state[jumping] * _STEP + np.uint64(1)
        draw = ((state[jumping] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        jump = ((place[jumping] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        more = jump < shards
        jumping, jump = jumping[more], jump[more]
    return place


def jump_shard(key: Column, shards: int) -> Column:
    """Column form of ``jump_hash`` over a bigint column; a null key counts as key 0."""
    if shards < 1:
        raise ValueError(f"cannot spread keys over {shards} shards")

    @F.pandas_udf("int")
    def shard(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(dtype=np.int64), shards))

    return shard(F.coalesce(key.cast("long"), F.lit(0).cast("long")))


def assign_shards(
    documents: DataFrame, *, key: str = "doc_id", text: str = "text", shards: int = 24, rows_per_part: int = 1_000
) -> DataFrame:
    """Put every row into a shard: ``key, size, text_crc32, shard, slot, grown_shard``.

    ``size`` is the text's UTF-8 length plus 8; ``slot`` numbers a shard's rows gaplessly, in parts of about
    ``rows_per_part`` rows that are numbered side by side (see ``ranked``). Rows are identified by nothing but
    their key, so repeated keys share a shard and each get a slot; ties are ordered by checksum and size.
    Keys that are no integers are hashed as strings (64 bits) first. Null integer keys count as key 0 for the shard and keep their null; a null text counts as empty. An empty
    table gives an empty result; other columns of the documents are not looked at.
    """
    integral = dict(documents.dtypes)[key] in ("tinyint", "smallint", "int", "bigint")
    rows = documents.select(
        F.col(key).alias("key"),
        (F.col(key).cast("long") if integral else F.xxhash64(F.col(key).cast("string"))).alias("number"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    count = documents.count()
    parts = max(1, -(-count // (shards * rows_per_part)))
    placed = rows.withColumn("shard", jump_shard(F.col("number"), shards)).withColumn(
        "grown_shard", jump_shard(F.col("number"), shards + 1)
    ).drop("number")
    spread = F.pmod(F.xxhash64("key", "text_crc32", "size"), F.lit(parts)).cast("int")
    order = [F.col("key"), F.col("text_crc32"), F.col("size")]
    return ranked(placed, ["shard"], order, spread, "slot")
