"""SimHash near-duplicate groups by covering locality-sensitive hashing.

Fingerprints within ``radius`` bits share a masked value in at least one of ``2**(radius + 1) - 1`` tables:
every bit position gets a code of ``radius + 1`` bits, and table v keeps the positions whose code has odd
overlap with v. The codes of ``radius`` differing positions span at most ``radius`` dimensions, so some v is
orthogonal to all of them, and its mask leaves every differing bit out. Nothing is missed by chance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import fresh, map_rows, row_hash, space_words, written

# Distinct fingerprints of one bucket that a task compares at a time; larger buckets are cut into cells.
CELL = 8192


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """64-bit SimHash over word shingles as a signed integer; without words it is zero."""
    words = space_words(text)
    if not words:
        return 0
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)]
    drawn = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(drawn), 1 << 15):
        ones += np.unpackbits(drawn[at : at + (1 << 15)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(drawn), bitorder="little")
    return int(bits.view("<i8")[0])


def covering_masks(radius: int) -> list[int]:
    """Signed 64-bit masks of the tables; position i has the code i mod (2**(radius + 1) - 1) + 1."""
    tables = (1 << (radius + 1)) - 1
    codes = [i % tables + 1 for i in range(64)]
    masks = [sum(1 << i for i, code in enumerate(codes) if (code & v).bit_count() & 1) for v in range(1, tables + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _stars(values: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Links (smallest member, member) of the components of ``values`` under the radius.

    A search over what is not yet reached: every value leaves the pool once, compared as a row block, so
    neither pairs nor a distance matrix are kept.
    """
    pool = np.sort(values)
    while len(pool) > 1:
        root, front, pool = pool[0], pool[:1], pool[1:]
        while len(front) and len(pool):
            near = np.zeros(len(pool), dtype=bool)
            for value in front:
                near |= np.bitwise_count(pool ^ value) <= radius
            front, pool = pool[near], pool[~near]
            for member in front.tolist():
                yield int(root), member


def _bucket_links(radius: int, cell: int):
    """Streams sorted (table, key, part, value) rows; a bucket beyond ``cell`` rows is passed on, uncut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        count, at, hot = 0, None, False

        def links() -> list[tuple]:
            if hot or count < 2:
                return []
            values = np.unique(np.concatenate(held))
            return [(at[0], at[1], a, b) for a, b in _stars(values.view(np.uint64), radius)]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            table, key, a, b = zip(*rows, strict=True)
            signed = lambda x: pa.array(np.array(x, dtype=np.uint64).view(np.int64))
            columns = [pa.array(table, pa.int32()), pa.array(key, pa.int64()), signed(a), signed(b), pa.array([False] * len(a))]
            return pa.RecordBatch.from_arrays(columns, names=["table", "key", "a", "b", "hot"])

        def passed(values: np.ndarray) -> pa.RecordBatch:
            n = len(values)
            same = pa.array(values)
            columns = [pa.array(np.full(n, at[0], np.int32)), pa.array(np.full(n, at[1], np.int64)), same, same, pa.array([True] * n)]
            return pa.RecordBatch.from_arrays(columns, names=["table", "key", "a", "b", "hot"])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy() for c in batch.columns]
            key = np.stack([c.astype(np.int64) for c in columns[:-1]])
            values = columns[-1]
            cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            bounds = np.concatenate(([0], cuts, [len(values)]))
            # Buckets of one row inside a batch have no links; the outer two may go on in other batches.
            worth = np.diff(bounds) > 1
            worth[[0, -1]] = True
            made: list[tuple] = []
            for start, end in zip(bounds[:-1][worth].tolist(), bounds[1:][worth].tolist(), strict=True):
                here = tuple(key[:, start].tolist())
                if here != at:
                    made += links()
                    held, count, at, hot = [], 0, here, False
                count += end - start
                if hot:
                    yield passed(values[start:end])
                    continue
                held.append(values[start:end])
                if count > cell and len(at) == 2:
                    hot = True
                    yield passed(np.concatenate(held))
                    held = []
            if made:
                yield batch_of(made)
        if rows := links():
            yield batch_of(rows)

    return run


_LINK = "table int, key long, a long, b long, hot boolean"


def near_links(values: DataFrame, *, radius: int = 4, cell: int = CELL) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints (column ``fp``) that span every group under the radius.

    A bucket is compared by one task only up to ``cell`` fingerprints. A larger one is cut into chunks, and
    each pair of chunks is a cell of its own, so memory and time of a task stay bounded and no link is lost.
    """
    tables = [F.struct(F.lit(i).alias("table"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(covering_masks(radius))]
    keyed = values.select("fp", F.explode(F.array(*tables)).alias("t")).select("t.table", "t.key", "fp")
    bucketed = keyed.repartition("table", "key").sortWithinPartitions("table", "key")
    found = written(bucketed.mapInArrow(_bucket_links(radius, cell), _LINK), "simhash-links")
    links = found.where(~F.col("hot")).select("a", "b")
    large = found.where("hot")
    if large.isEmpty():
        return links.distinct()
    sizes = large.groupBy("table", "key").agg(F.ceil(F.count(F.lit(1)) / (cell / 2)).cast("int").alias("chunks"))
    chunked = large.join(sizes, ["table", "key"]).withColumn("chunk", F.pmod(F.xxhash64("a"), F.col("chunks")).cast("int"))
    cells = chunked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "table", "key", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), F.col("a").alias("fp")
    )
    dealt = cells.repartition("table", "key", "i", "j").sortWithinPartitions("table", "key", "i", "j")
    more = dealt.mapInArrow(_bucket_links(radius, cell), _LINK).select("a", "b")
    return links.union(more).distinct()


def components(links: DataFrame) -> DataFrame:
    """``(fp, component)`` of every linked value, by rounds of contraction.

    In a round each value takes the first of itself and its neighbours in that round's order (values xor a
    constant), and links are renamed accordingly; links inside one name vanish. The order changes from round
    to round, so chains shrink geometrically. Every round is written to the shared folder.
    """
    names, constant = None, 0
    edges = written(links, "components")
    while not edges.isEmpty():
        constant = xxhash.xxh64_intdigest(constant.to_bytes(8, "little")) >> 1
        turn = lambda c, x=constant: F.col(c).bitwiseXOR(F.lit(x))
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(turn("b")).alias("least"))
        hooks = written(
            first.select(
                F.col("a").alias("fp"),
                F.least(F.col("least"), turn("a")).bitwiseXOR(F.lit(constant)).alias("component"),
            ),
            "components",
        )
        left, right = hooks.toDF("a", "new_a"), hooks.toDF("b", "new_b")
        renamed = edges.join(left, "a").join(right, "b").where("new_a <> new_b")
        edges = written(
            renamed.select(F.least("new_a", "new_b").alias("a"), F.greatest("new_a", "new_b").alias("b")).distinct(),
            "components",
        )
        if names is None:
            names = hooks
        else:
            then = hooks.toDF("component", "next")
            names = names.join(then, "component", "left").select("fp", F.coalesce("next", "component").alias("component"))
    if names is None:
        return edges.select(F.col("a").alias("fp"), F.col("b").alias("component"))
    return names


def simhash_groups(
    documents: DataFrame, *, id: str = "doc_id", text: str = "text", radius: int = 4, width: int = 4, cell: int = CELL
) -> DataFrame:
    """``id, fingerprint, component, component_id`` for every row.

    Equal fingerprints are joined first, so copies cost one row in the search. ``component`` is a fingerprint
    that names the group; ``component_id`` is the smallest id in it (null ids are passed over; null if there
    is no other). Null, empty and wordless texts have fingerprint 0 and are linked like any other. Repeated
    rows each get their row; an empty table gives an empty result; other columns are not looked at.
    """
    kind = documents.schema[id].dataType.simpleString()

    def rows(columns: dict[str, list]):
        for key, value in zip(columns["id"], columns["text"], strict=True):
            yield key, fingerprint(value, width)

    plain = documents.select(F.col(id).alias("id"), F.col(text).alias("text"))
    prints = written(map_rows(plain, f"id {kind}, fp long", rows), "simhash")
    classes = written(prints.groupBy("fp").agg(F.min("id").alias("first_id")), "simhash")
    named = classes.join(components(near_links(classes, radius=radius, cell=cell)), "fp", "left").select(
        "fp", "first_id", F.coalesce("component", "fp").alias("component")
    )
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of_class = named.join(smallest, "component").select("fp", "component", "component_id")
    return prints.join(of_class, "fp").select("id", F.col("fp").alias("fingerprint"), "component", "component_id")


def drop_near_copies(documents: DataFrame, *, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each group stays: the one with the smallest id, with its own columns.

    Rows without an id stay only when no row of their group has one, and then one of them. Of rows that
    repeat the chosen id, the one with the smallest row hash stays.
    """
    hash_, keep = fresh(documents, "hash", "keep")
    marked = documents.withColumn(hash_, row_hash(documents))
    key = F.struct(F.col(id).isNull().alias("none"), F.col(id).alias("id"), F.col(hash_).alias("row"))
    groups = simhash_groups(marked.select(key.alias("key"), F.col(text).alias("text")), id="key", **options)
    chosen = groups.select(F.col("component_id").alias(keep)).distinct()
    same = (F.col(hash_) == F.col(f"{keep}.row")) & F.col(id).eqNullSafe(F.col(f"{keep}.id"))
    return marked.join(chosen, same, "left_semi").dropDuplicates([id, hash_]).select(*documents.columns)
