"""Hard-negative mining by threshold joins of anchors with all rows.

Anchors are dealt into blocks of bounded size, and every block passes over all rows twice: for the positives of
its anchors, then for the negatives between two shares of each positive's score. A task joins a block with a few
rows at a time above a score threshold for each anchor, through an inverted index of the rows by groups of
dimensions. The leading dimensions of a row are left out of the index where their norm alone cannot reach any
threshold; partial scores are accumulated from the last group on, and a pair is pruned once its score and the
norms that remain stay below the threshold. Thresholds start high and are lowered until the windows of an anchor
are filled or their lower end is reached; the scores a task holds already are thresholds for its next rows.
Components are integers and all scores exact, so nothing depends on the order of rows or on their partitions.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.llm.common import written
from tessella.llm.vector_codes import finite_vector, scaled_floor
from tessella.session import checkpoint_folder

# Anchors of a block, dimensions of an index group, share of live pairs below which pairs are followed one by one.
BLOCK_ROWS, GROUP, SPARSE = 1024, 8, 1 / 16
# Gaps between the upper end of a window and its thresholds, as shares of the window.
RUNGS = (1 / 16, 1 / 4, 1.0)


@dataclass(frozen=True)
class Vectors:
    """Integer vectors in index order, with the norms of their leading groups: ``norms[:, g]`` covers groups before g."""

    values: np.ndarray
    norms: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray, dims: np.ndarray) -> Vectors:
        values = np.asarray(values, dtype=np.float64)[:, dims]
        squares = np.add.reduceat(values * values, np.arange(0, values.shape[1], GROUP), axis=1)
        return cls(values, np.sqrt(np.concatenate((np.zeros((len(values), 1)), np.cumsum(squares, axis=1)), axis=1)))

    def take(self, rows: np.ndarray) -> Vectors:
        return Vectors(self.values[rows], self.norms[rows])

    def check_exact(self, other: Vectors) -> None:
        """Sums of products stay exact in double precision below 2**53; by Cauchy-Schwarz norms bound them all."""
        if len(self.values) and len(other.values) and self.norms[:, -1].max() * other.norms[:, -1].max() >= 1 << 53:
            raise ValueError("scaled components too large for exact scores")


def pairs_above(anchors: Vectors, rows: Vectors, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ``(anchor, row, score)`` whose score is at least the anchor's threshold in ``least`` (integers)."""
    groups = anchors.norms.shape[1] - 1
    n_anchors, n_rows = len(anchors.values), len(rows.values)
    if not n_anchors or not n_rows:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    # A row's leading groups are covered while their norm is below every threshold for a unit of anchor norm.
    lengths = np.maximum(anchors.norms[:, -1], 1e-300)
    unit = (least / lengths).min() * (1 - 1e-12)
    covered = (rows.norms[:, 1:] < unit).sum(axis=1)
    span = lambda g: slice(g * GROUP, (g + 1) * GROUP)
    slack = lambda bound: bound * (1 + 1e-12) + 1e-6
    score = np.zeros((n_anchors, n_rows))
    live_anchors, live_rows = np.arange(n_anchors), np.arange(n_rows)
    g = groups
    while True:
        # What is not accumulated yet is at most the product of the norms before that group.
        at = np.maximum(g, covered[live_rows])
        rest = anchors.norms[live_anchors][:, at] * rows.norms[live_rows, at]
        live = slack(score + rest) >= least[live_anchors, None]
        if not live.any():
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        some = live.any(axis=1), live.any(axis=0)
        live_anchors, live_rows = live_anchors[some[0]], live_rows[some[1]]
        score, live = score[some[0]][:, some[1]], live[some[0]][:, some[1]]
        if g == 0 or live.mean() < SPARSE:
            break
        g -= 1
        listed = np.flatnonzero(covered[live_rows] <= g)
        if len(listed):
            score[:, listed] += anchors.values[live_anchors, span(g)] @ rows.values[live_rows[listed], span(g)].T
    a, r = np.nonzero(live)
    found, a, r = score[a, r], live_anchors[a], live_rows[r]
    while g > 0 and len(a):
        g -= 1
        listed = covered[r] <= g
        found[listed] += np.einsum("ij,ij->i", anchors.values[a[listed], span(g)], rows.values[r[listed], span(g)])
        at = np.maximum(g, covered[r])
        keep = slack(found + anchors.norms[a, at] * rows.norms[r, at]) >= least[a]
        a, r, found = a[keep], r[keep], found[keep]
    # Verification: the covered leading groups of the few rows that are left.
    for g in range(int(covered[r].max(initial=0))):
        unlisted = covered[r] > g
        found[unlisted] += np.einsum("ij,ij->i", anchors.values[a[unlisted], span(g)], rows.values[r[unlisted], span(g)])
    keep = found >= least[a]
    return a[keep], r[keep], np.rint(found[keep]).astype(np.int64)


class Best:
    """The first ``size`` entries of every slot by descending score, then ascending id; equal entries count once."""

    def __init__(self, size: int, ids_like: np.ndarray) -> None:
        self.size = size
        self.slot, self.score, self.id = np.empty(0, np.int64), np.empty(0, np.int64), ids_like[:0]

    def add(self, slot: np.ndarray, score: np.ndarray, id: np.ndarray) -> None:
        if not len(slot):
            return
        slot, score, id = np.concatenate((self.slot, slot)), np.concatenate((self.score, score)), np.concatenate((self.id, id))
        order = np.lexsort((id, -score, slot))
        slot, score, id = slot[order], score[order], id[order]
        new = np.concatenate(([True], (slot[1:] != slot[:-1]) | (score[1:] != score[:-1]) | (id[1:] != id[:-1])))
        slot, score, id = slot[new], score[new], id[new]
        starts = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1])))
        nth = np.arange(len(slot)) - np.repeat(starts, np.diff(np.concatenate((starts, [len(slot)]))))
        first = nth < self.size
        self.slot, self.score, self.id = slot[first], score[first], id[first]

    def floors(self, slots: int, empty: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each slot is full, and the score an entry needs to get in (``empty`` where it is not full)."""
        full = np.bincount(self.slot, minlength=slots) >= self.size
        least = empty.copy()
        last = np.full(slots, np.iinfo(np.int64).max)
        np.minimum.at(last, self.slot, self.score)
        least[full] = last[full]
        return full, least


@dataclass(frozen=True)
class AnchorBlock:
    """Anchors of one block: ids, label numbers, vectors, and the windows of their positives."""

    ids: np.ndarray
    labels: list
    vectors: Vectors
    dims: np.ndarray


def _positives(block: AnchorBlock, size: int, best: Best, ids: np.ndarray, labels: list, rows: Vectors) -> None:
    """Fold rows into the best ones of the same label for each anchor; rows with the anchor's id are not others."""
    at_label: dict[object, list[int]] = {}
    for i, label in enumerate(labels):
        at_label.setdefault(label, []).append(i)
    anchors_of: dict[object, list[int]] = {}
    for i, label in enumerate(block.labels):
        if label in at_label:
            anchors_of.setdefault(label, []).append(i)
    for label, own in anchors_of.items():
        own, here = np.array(own), np.array(at_label[label])
        same = rows.take(here)
        top = block.vectors.norms[own, -1] * same.norms[:, -1].max()
        ends = np.zeros(len(block.ids), dtype=np.int64)
        for rung in (0.5, 0.25, 0.0, -1.0):
            # The last threshold lies below every score.
            ends[own] = np.floor(rung * top).astype(np.int64) - 1
            _, least = best.floors(len(block.ids), ends)
            a, r, score = pairs_above(block.vectors.take(own), same, least[own])
            other = block.ids[own[a]] != ids[here[r]]
            best.add(own[a[other]], score[other], ids[here[r[other]]])
            # A slot is done once all its entries reach the threshold: nothing below can get in.
            now, floor = best.floors(len(block.ids), ends)
            open_ = ~(now & (floor >= least))[own]
            own, top = own[open_], top[open_]
            if not len(own):
                break


@dataclass(frozen=True)
class Windows:
    """Score windows, those of an anchor side by side: anchor, both ends (inclusive), the positive they come from."""

    anchor: np.ndarray
    low: np.ndarray
    high: np.ndarray
    positive: list
    positive_score: np.ndarray


def _negatives(block: AnchorBlock, windows: Windows, best: Best, ids: np.ndarray, labels: list, rows: Vectors) -> None:
    """Fold rows of other labels into the windows, from their upper ends down until they are filled."""
    n = len(windows.anchor)
    starts = np.searchsorted(windows.anchor, np.arange(len(block.ids) + 1))
    numbers = {label: k for k, label in enumerate(set(block.labels))}
    own_label = np.array([numbers[x] for x in block.labels])
    row_label = np.array([numbers.get(x, -1) for x in labels])
    open_ = windows.low <= windows.high
    for rung in RUNGS:
        gap = np.floor(rung * (windows.high - windows.low)).astype(np.int64)
        least = np.maximum(best.floors(n, windows.high - gap)[1], windows.low)
        of_anchor = np.full(len(block.ids), np.iinfo(np.int64).max)
        np.minimum.at(of_anchor, windows.anchor[open_], least[open_])
        own = np.unique(windows.anchor[open_])
        if not len(own):
            return
        a, r, score = pairs_above(block.vectors.take(own), rows, of_anchor[own])
        a = own[a]
        other = own_label[a] != row_label[r]
        a, r, score = a[other], r[other], score[other]
        many = starts[a + 1] - starts[a]
        pair = np.repeat(np.arange(len(a)), many)
        w = np.repeat(starts[a] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(len(pair))
        inside = open_[w] & (score[pair] >= least[w]) & (score[pair] <= windows.high[w])
        w, pair = w[inside], pair[inside]
        best.add(w, score[pair], ids[r[pair]])
        full, floor = best.floors(n, least)
        open_ = open_ & ~(full & (floor >= least)) & (least > windows.low)


def _search(block: AnchorBlock, windows: Windows | None, size: int, id_kind: str):
    """Streams rows ``(id, label, v)`` and yields what a task has found: ``(slot, id, score)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, width = None, block.vectors.values.shape[1]
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, labels = np.array(batch.column(0).to_pylist()), batch.column(1).to_pylist()
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            if set(np.diff(batch.column(2).offsets.to_numpy()).tolist()) != {width}:
                raise ValueError("vectors differ in width")
            rows = Vectors.of(flat.reshape(-1, width), block.dims)
            rows.check_exact(block.vectors)
            best = best or Best(size, ids)
            if windows is None:
                _positives(block, size, best, ids, labels, rows)
            else:
                _negatives(block, windows, best, ids, labels, rows)
        if best is not None and len(best.slot):
            kind = pa.int64() if id_kind == "bigint" else pa.string()
            yield pa.RecordBatch.from_arrays([pa.array(best.slot), pa.array(best.id.tolist(), kind), pa.array(best.score)], names=["slot", "id", "score"])

    return run


def _merged(found: DataFrame, size: int) -> DataFrame:
    """The best entries of every slot over all tasks, with their rank from 1."""
    order = Window.partitionBy("slot").orderBy(F.desc("score"), F.asc("id"))
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)


def mine_hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    *,
    id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of the rows where ``anchors`` holds.

    A row's score is its integer inner product with the anchor; higher scores come first, ties by smaller id.
    An anchor's positives are its first ``positives`` other rows of its label. For each, the first ``negatives``
    rows of other labels are returned whose score lies between ``low`` and ``high`` hundredths of the positive's.

    Rows with a null id or label, or a vector that is null, empty or not finite, take no part. Ids are integers, or
    are taken as strings. Anchors that repeat in id, label and vector count once; rows that share an id and a score
    with an anchor count once, and rows with the anchor's id are no positives of it. Anchors without a positive, and
    windows without a row, give no rows; so does an empty table. Vectors of differing widths and components too
    large for exact scores are errors. Other columns, and columns named like the results, are not looked at.

    The driver and every task hold one block of at most about ``block_rows`` anchors, its positives and windows; each
    block's results are a written table, so a lost executor repeats only tasks of the block at hand.
    """
    spark = vectors.sparkSession
    integral = dict(vectors.dtypes)[id] in ("tinyint", "smallint", "int", "bigint")
    id_kind = "bigint" if integral else "string"
    sound = finite_vector(F.col(vector)) & F.col(label).isNotNull() & F.col(id).isNotNull()
    kept = written(
        vectors.where(sound).select(
            F.col(id).cast(id_kind).alias("id"), F.col(label).alias("label"), scaled_floor(F.col(vector), scale).alias("v"), F.coalesce(anchors, F.lit(False)).alias("anchor")
        ),
        "hard-negative-rows",
    )
    schema = f"anchor_id {id_kind}, positive_id {id_kind}, rank int, negative_id {id_kind}, positive_score long, negative_score long"
    chosen = written(kept.where("anchor").select("id", "label", "v").distinct(), "anchors")
    n = chosen.count()
    if not n:
        return spark.createDataFrame([], schema)
    blocks = -(-n // block_rows)
    rows = kept.select("id", "label", "v")
    path = f"{checkpoint_folder(spark)}/hard-negatives-{uuid.uuid4().hex}"
    spark.createDataFrame([], schema).write.parquet(path)
    for at in range(blocks):
        taken = chosen.where(F.pmod(F.xxhash64("id", "label", "v"), F.lit(blocks)) == at).orderBy("id", "label", "v").collect()
        if not taken:
            continue
        if len({len(r.v) for r in taken}) > 1:
            raise ValueError("vectors differ in width")
        values = np.array([r.v for r in taken], dtype=np.float64)
        # Dimensions with little weight come first: they are the ones the index can do without.
        dims = np.argsort((values * values).sum(axis=0), kind="stable")
        block = AnchorBlock(np.array([r.id for r in taken]), [r.label for r in taken], Vectors.of(values, dims), dims)
        found = rows.mapInArrow(_search(block, None, positives, id_kind), f"slot long, id {id_kind}, score long")
        positive = sorted(_merged(found, positives).collect(), key=lambda r: (r.slot, r.rank))
        if not positive:
            continue
        score = np.array([r.score for r in positive])
        windows = Windows(np.array([r.slot for r in positive]), -(-low * score // 100), high * score // 100, [r.id for r in positive], score)
        between = rows.mapInArrow(_search(block, windows, negatives, id_kind), f"slot long, id {id_kind}, score long")
        origin = spark.createDataFrame(
            [(w, taken[a].id, p, s) for w, (a, p, s) in enumerate(zip(windows.anchor.tolist(), windows.positive, score.tolist(), strict=True))],
            f"slot long, anchor_id {id_kind}, positive_id {id_kind}, positive_score long",
        )
        mined = _merged(between, negatives).join(F.broadcast(origin), "slot")
        mined.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)
