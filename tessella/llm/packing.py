"""Best-fit packing of tokenized documents into sequences of bounded length.

Pieces of equal length are interchangeable, and so are gaps of equal size, so the rounds of best fit run over
size classes with counts: at most ``max_tokens`` of each, whatever the number of documents. In a round the
longest class still to be placed looks up its successor, the smallest gap it fits; the ranks in both classes
decide who meets whom, gaps are updated, and the round repeats. Counting, ranking and the assignment of every
piece are distributed.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import map_rows, ranked, written

PIECE = "piece int, start long, length long, ids_crc32 long"


@cache
def _encoder(vocabulary: str):
    """The byte-level BPE of a tokenizers file; its ranks are run by the faster of two public encoders."""
    import json

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(vocabulary), encoding="utf-8") as file:
        stored = json.load(file)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    letters |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    special = {t["content"]: t["id"] for t in stored.get("added_tokens", [])}
    ranks = {bytes(letters[c] for c in word): i for word, i in stored["model"]["vocab"].items() if word not in special}
    encoding = tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    allowed = frozenset(special)
    return lambda text: encoding.encode_to_numpy(text, allowed_special=allowed, disallowed_special=())


def cut(count: int, max_tokens: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: only the first may be shorter than ``max_tokens``."""
    first = count % max_tokens or min(count, max_tokens)
    return [(0, first)] + [(at, max_tokens) for at in range(first, count, max_tokens)]


def token_pieces(
    documents: DataFrame, *, text: str = "text", vocabulary: str = "byte_bpe_50k.json", max_tokens: int = 2048,
    closing: int = 0, keep_ids: bool = False,
) -> DataFrame:
    """One row per piece: the documents' other columns, ``piece, start, length, ids_crc32`` and, if wanted, ``ids``."""
    kept = [c for c in documents.columns if c != text]
    types = "".join(f"`{c}` {documents.schema[c].dataType.simpleString()}, " for c in kept)

    def rows(columns: dict[str, list]):
        encode = _encoder(vocabulary)
        for i, value in enumerate(columns[text]):
            ids = np.append(encode(value or ""), closing).astype("<u4")
            for piece, (start, length) in enumerate(cut(len(ids), max_tokens)):
                own = ids[start : start + length]
                row = (*(columns[c][i] for c in kept), piece, start, length, zlib.crc32(own.tobytes()))
                yield (*row, own.astype(np.int64).tolist()) if keep_ids else row

    return map_rows(documents, types + PIECE + (", ids array<int>" if keep_ids else ""), rows)


def best_fit(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Where the pieces of each length go, as ``(length, first rank, end rank, first sequence, each, offset)``.

    Ranks from the first on fill sequences from the first sequence on, ``each`` of them side by side in a
    sequence from the offset. The number of entries depends on the number of lengths, not of pieces.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first sequence, sequences)
    order: list[int] = []
    plan, opened = [], 0

    def leave(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(order, length)
            if at == len(order):
                each = size // length
                full, rest = divmod(left, each)
                plan.append((length, rank, rank + left, opened, each, 0))
                leave(size - each * length, opened, full)
                leave(size - rest * length, opened + full, 1 if rest else 0)
                opened += full + (1 if rest else 0)
                break
            gap = order[at]
            first, n = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], order[at]
            used = min(n, left)
            plan.append((length, rank, rank + used, first, 1, size - gap))
            leave(gap, first + used, n - used)
            leave(gap - length, first, used)
            rank, left = rank + used, left - used
    return plan


def pack_pieces(pieces: DataFrame, order: list[str], *, max_tokens: int = 2048, rows_per_part: int = 1_000) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to ``max_tokens``.

    Reads ``pieces`` several times, so it should be a written table.
    """
    spark = pieces.sparkSession
    # At most max_tokens rows: one for each length.
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = np.array(best_fit(counts, max_tokens) or np.empty((0, 6)), dtype=np.int64).reshape(-1, 6)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    shared = spark.sparkContext.broadcast(plan)
    parts = max(1, -(-max(counts.values(), default=1) // rows_per_part))
    spread = F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int")

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        table = shared.value
        wide = np.int64(1) << np.int64(48)
        found = np.searchsorted(table[:, 0] * wide + table[:, 1], length.to_numpy() * wide + rank.to_numpy(), side="right") - 1
        _, first_rank, _, first, each, offset = table[found].T
        nth = rank.to_numpy() - first_rank
        return pd.DataFrame({"sequence_id": first + nth // each, "offset": offset + nth % each * length.to_numpy()})

    numbered = ranked(pieces, ["length"], [F.col(c) for c in order], spread, "_rank")
    return numbered.withColumn("_place", place("length", "_rank")).select(
        *pieces.columns, "_place.sequence_id", "_place.offset"
    )


def pack_documents(documents: DataFrame, *, text: str = "text", id: str = "doc_id", max_tokens: int = 2048, **options) -> DataFrame:
    """Pieces of all documents with their place: ``id, piece, start, length, ids_crc32, sequence_id, offset``.

    A document is its token ids and a closing id; only longer ones are cut. Null texts are empty: one closing
    id. Repeated ids and rows are packed like any other (equal pieces are interchangeable); null ids stay
    null. An empty table packs into nothing. Columns other than id and text are not looked at.
    """
    plain = documents.select(F.col(id).alias("id"), F.col(text).alias("text"))
    pieces = written(token_pieces(plain, max_tokens=max_tokens, **options), "pieces")
    return pack_pieces(pieces, ["id", "piece", "ids_crc32"], max_tokens=max_tokens).withColumnRenamed("id", id)
