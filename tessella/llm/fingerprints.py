"""Document fingerprints: a digest of bucket quartiles, and a bounded difference score between two of them.

Every byte of a text forms six triplets with two of its four neighbours (two to each side; beyond the ends
stand zero bytes). Triplets are hashed into 256 buckets by arrangement and content. A bucket's code is the
number of the text's own quartiles (of the 256 counts) that its count exceeds, so the digest does not depend on
the length of the text; a code of the length in bytes (eight steps to a doubling) stands before the bucket
codes. Texts that share most of their triplets have close codes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import encode, fresh, written

BUCKETS = 256
# Places (0 to 4, the byte itself is 2) of the bytes of a triplet; the six choices of two neighbours.
TRIPLETS = ((0, 1, 2), (0, 2, 3), (0, 2, 4), (1, 2, 3), (1, 2, 4), (2, 3, 4))
MIX = (2654435761, 2246822519)
# Weight of a step of the length code, steps counted at most, and the bound of the score.
LENGTH_WEIGHT, LENGTH_STEPS, BOUND = 6, 64, 600
SLICE = 1 << 20


def bucket_counts(body: bytes) -> np.ndarray:
    """How many triplets of the text fall into each bucket; long texts are counted slice by slice."""
    out = np.zeros(BUCKETS, dtype=np.int64)
    for at in range(0, len(body), SLICE):
        window = np.zeros(min(SLICE, len(body) - at) + 4, dtype=np.uint32)
        taken = np.frombuffer(body[max(0, at - 2) : at + SLICE + 2], dtype=np.uint8)
        lead = 2 - min(at, 2)
        window[lead : lead + len(taken)] = taken
        n = len(window) - 4
        values = np.empty((len(TRIPLETS), n), dtype=np.uint32)
        for k, (a, b, c) in enumerate(TRIPLETS):
            values[k] = window[a : a + n] << 16 | window[b : b + n] << 8 | window[c : c + n] | np.uint32(k << 24)
        values *= np.uint32(MIX[0])
        values ^= values >> 15
        values *= np.uint32(MIX[1])
        out += np.bincount((values >> 24).ravel(), minlength=BUCKETS)
    return out


def length_code(n: int) -> int:
    """Eight steps to a doubling: the bit length and the three bits after the first; 0 for an empty text."""
    bits = n.bit_length()
    return 0 if n == 0 else min(255, 8 * bits + ((n << 3 >> (bits - 1)) & 7))


def fingerprint(text: str | None) -> str:
    """Length code and 256 bucket codes of two bits as hex digits; null counts as empty, which has only zeros."""
    body = encode(text)
    counts = bucket_counts(body)
    quartiles = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = (counts[:, None] > quartiles).sum(axis=1).reshape(-1, 4)
    packed = codes @ np.array([64, 16, 4, 1])
    return bytes([length_code(len(body)), *packed.tolist()]).hex()


def difference(a: str, b: str) -> int:
    """Sum of the distances of the bucket codes and the weighted distance of the lengths, at most ``BOUND``."""
    x, y = (np.frombuffer(bytes.fromhex(f), dtype=np.uint8).astype(np.int64) for f in (a, b))
    shifts = np.array([6, 4, 2, 0])
    codes = lambda v: v[1:, None] >> shifts & 3
    body = int(np.abs(codes(x) - codes(y)).sum())
    return min(BOUND, body + LENGTH_WEIGHT * min(LENGTH_STEPS, abs(int(x[0]) - int(y[0]))))


def likeness(a: str, b: str) -> float:
    """1 for equal fingerprints, 0 at the bound of the difference."""
    return 1 - difference(a, b) / BOUND


def edited(text: str, following: str, share: int = 4) -> str:
    """The last ``1/share`` of the text's characters replaced by the first as many (or all) of the next text."""
    cut = len(text) // share
    return text[: len(text) - cut] + following[:cut]


_ROW = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_COLUMNS = tuple(part.split()[0] for part in _ROW.split(", "))


def _compared(text: str, own: str, following: str, following_print: str, share: int) -> tuple:
    changed = edited(text, following, share)
    digest = hashlib.sha256(encode(changed)).hexdigest()
    print_ = fingerprint(changed) if changed != text else own
    return len(text), digest, own, print_, likeness(own, print_), likeness(own, following_print)


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    parts = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(p, f.type) for p, f in zip(parts, schema, strict=True)], schema=schema)


DONE, FIRST, LAST = 0, 1, 2


def compare_with_edits(documents: DataFrame, *, id: str = "doc_id", text: str = "text", share: int = 4) -> DataFrame:
    """``id`` and the fingerprints of each text and of its edited text, with their likeness and that to the next text.

    Documents follow each other by ascending id (null ids first, repeated ids by the hash of the text, equal
    rows in any order: their results are the same), and after the last comes the first. One range shuffle puts
    neighbours together; a task streams its range and holds two texts at a time. The first and the last text
    of every range are written beside the results and matched afterwards, so no range has to see another.
    A null text counts as empty; a table of one row follows itself; an empty table gives an empty result. Texts
    may be of any length: they are counted in slices. Other columns are not looked at.
    """
    spark = documents.sparkSession
    kind = documents.schema[id].dataType.simpleString()
    target = spark.createDataFrame([], f"range int, state int, id {kind}, text string, {_ROW}").schema
    order = ["id", F.xxhash64("text"), "tie"]
    plain = documents.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("tie"))
    in_order = plain.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, here = to_arrow_schema(target), TaskContext.get().partitionId()
        blank = (None,) * len(_COLUMNS)
        held = None
        for batch in batches:
            rows = []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                body = value.as_py()
                own = fingerprint(body)
                if held is None:
                    rows.append((here, FIRST, key, body, None, None, own, *blank[3:]))
                else:
                    rows.append((here, DONE, held[0], None, *_compared(held[1], held[2], body, own, share)))
                held = key, body, own
            yield _batch(schema, rows)
        if held is not None:
            yield _batch(schema, [(here, LAST, held[0], held[1], None, None, held[2], *blank[3:])])

    made = written(in_order.mapInArrow(stream, target), "fingerprints")
    firsts = made.where(F.col("state") == FIRST)
    # One number for each range that has rows, as many as the shuffle has partitions.
    ranges = sorted(r.range for r in firsts.select("range").collect())
    following = spark.createDataFrame(list(zip(ranges, ranges[1:] + ranges[:1], strict=True)), "range int, following int")
    borders = (
        made.where(F.col("state") == LAST)
        .select("range", "id", "text", "fingerprint")
        .join(F.broadcast(following), "range")
        .join(firsts.select(F.col("range").alias("following"), F.col("text").alias("after"), F.col("fingerprint").alias("after_print")), "following")
        .select("id", "text", "fingerprint", "after", "after_print")
    )
    closed = spark.createDataFrame([], f"id {kind}, {_ROW}").schema

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(closed)
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            yield _batch(schema, [(key, *_compared(body, own, after, after_print, share)) for key, body, own, after, after_print in rows])

    return made.where(F.col("state") == DONE).select("id", *_COLUMNS).union(borders.mapInArrow(close, closed))


def fingerprint_documents(documents: DataFrame, *, text: str = "text") -> DataFrame:
    """The table with a column ``fingerprint`` (or, where it has one in any case, with underscores before it).

    Null texts count as empty; rows stay where they are; an empty table stays empty; columns of any type pass.
    """
    (name,) = fresh(documents, "fingerprint")
    digest = F.udf(fingerprint, "string", useArrow=True)
    return documents.withColumn(name, digest(F.col(text)))
