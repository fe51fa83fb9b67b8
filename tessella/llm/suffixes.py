"""Removal of repeated byte strings by distributed prefix doubling.

A rank stands for the string of some length at a position; ranks of twice the length are ranks of pairs
(rank here, rank that many bytes on). Two things keep the sorted pairs few:

* The first offsets (1, 2, 4, ...) need no exchange: a task has the text, so it names pairs by 64-bit mixing.
* At the first sorted offset, only sampled positions are ranked: in every string of ``length`` bytes, the
  smallest rank of ``gram`` bytes. Equal strings sample the same rank, so a string whose sample is unique is
  unique. Neighbouring strings with one sample form a run, and a run is one row: (sample's rank, rank of the
  whole run). Spark sorts these pairs; a sample with one run is unique and leaves, a run that was ranked
  before is repeated as a whole, and what is left are the runs of one sample in differing contexts.

Of these, every position is ranked at the full length by the pair (rank of the first power of two, rank of the
last) and sorted once more, which is past the threshold. Strings count as equal when 128 bits of ranks agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType

from tessella.llm.common import fresh, sent_if_small, written

SPAN = 1 << 19  # string starts handled at a time; longer texts are walked span by span
GROUP = 1024  # runs of one sample that a task ranks together; more are dealt out by wider ranks, then by string

_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_AGAIN = np.uint64(0xD6E8FEB86659FD93)
_BYTE_RANKS = np.random.default_rng(7).integers(0, 1 << 64, 256, dtype=np.uint64)

RUN, REPEATED, DIFFERING = 0, 1, 2  # kinds of a packed place


def pack(start: np.ndarray, count: np.ndarray, kind: int) -> np.ndarray:
    """Start of a run in its document, number of its strings (under 2**22) and its kind in one integer."""
    return (start.astype(np.int64) << 24) | (count.astype(np.int64) << 2) | kind


def unpack(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return place >> 24, (place >> 2) & ((1 << 22) - 1), place & 3


def doubled(data: np.ndarray, size: int) -> np.ndarray:
    """Ranks of the ``size`` bytes (a power of two) at every position, by doubling."""
    ranks, offset = _BYTE_RANKS[data], 1
    while offset < size and len(ranks) > offset:
        pairs = ranks[:-offset] * _MULTIPLY
        pairs += ranks[offset:]
        pairs ^= pairs >> np.uint64(32)
        pairs *= _AGAIN
        pairs ^= pairs >> np.uint64(29)
        ranks, offset = pairs, 2 * offset
    return ranks if offset == size else ranks[:0]


def sliding(values: np.ndarray, width: int, pick=np.minimum) -> np.ndarray:
    """Minimum (or maximum) of every ``width`` neighbours."""
    if len(values) < width:
        return values[:0]
    have = 1
    while 2 * have <= width:
        values = pick(values[:-have], values[have:])
        have *= 2
    rest = width - have
    return pick(values[:-rest], values[rest:]) if rest else values


@cache
def _powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    def row(base: int) -> np.ndarray:
        out = np.full(count, base, dtype=np.uint64)
        out[:1] = 1
        return np.cumprod(out)

    return row(int(_MULTIPLY)), row(pow(int(_MULTIPLY), -1, 1 << 64))


class Sampling:
    """Sizes that belong to a string length: ``gram`` bytes of a sample, ``half`` of the ranks paired last."""

    def __init__(self, length: int):
        if length < 4:
            raise ValueError(f"repeated strings need at least 4 bytes, not {length}")
        self.length = length
        self.half = 1 << (length.bit_length() - 1)
        self.gram = max(1, self.half // 2)
        self.width = length - self.gram + 1
        # Bytes by which the blocks of wider ranks fall short of the length: halved until few are left.
        side = (length - self.gram) // 2
        self.steps = [s for s in (side, side // 2, side // 4) if s]

    def string_ranks(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both ranks of the string that starts at each position."""
        ranks = doubled(data, self.half)
        starts = max(0, len(data) - self.length + 1)
        return ranks[:starts], ranks[self.length - self.half :][:starts]

    def samples(self, data: np.ndarray) -> np.ndarray:
        return sliding(doubled(data, self.gram), self.width)

    def runs(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """Runs of the documents in ``data``: sample, rank of the run, document, start, count, repeats inside.

        A run never reaches beyond ``SPAN`` starts, so long texts need no more memory than short ones.
        """
        found = []
        for low in range(0, len(data), SPAN):
            part = data[low : low + SPAN + self.length - 1]
            if len(part) >= self.length:
                found.append(self._span(part, low, offsets))
        if not found:
            return (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int64),) * 3 + (np.empty(0, bool),)
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))

    def _span(self, part: np.ndarray, low: int, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        ranks = doubled(part, self.gram)
        least = sliding(ranks, self.width)
        n = len(least)
        # A string must end in its document.
        first, last = offsets[:-1] - low, offsets[1:] - low - self.length
        whole = (last >= first) & (last >= 0) & (first < n)
        edge = np.zeros(n + 1, dtype=np.int8)
        np.add.at(edge, np.maximum(first[whole], 0), 1)
        np.add.at(edge, np.minimum(last[whole] + 1, n), -1)
        valid = np.cumsum(edge[:n], dtype=np.int8).astype(bool)
        change = np.empty(n + 1, dtype=bool)
        change[0] = change[n] = True
        np.not_equal(least[1:], least[:-1], out=change[1:n])
        before = np.concatenate(([False], valid[:-1]))
        after = np.concatenate((valid[1:], [False]))
        starts = np.flatnonzero(valid & (change[:n] | ~before))
        ends = np.flatnonzero(valid & (change[1:] | ~after))
        power, inverse = _powers(SPAN + self.length)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(ranks * power[: len(ranks)])))
        run = (total[ends + self.width] - total[starts]) * inverse[starts]
        run ^= run >> np.uint64(31)
        run *= _AGAIN
        run ^= (ends - starts).astype(np.uint64)
        document = np.searchsorted(offsets, starts + low, side="right") - 1
        return least[starts], run, document, starts + low - offsets[document], ends - starts + 1, self._inside(ranks, least, valid, starts, ends)

    def _inside(self, ranks, least, valid, starts, ends) -> np.ndarray:
        """Runs that may repeat a string of their own: their sample stands twice at most ``width`` apart."""
        padded = np.zeros(len(least) + 2 * (self.width - 1), dtype=np.uint64)
        padded[self.width - 1 : self.width - 1 + len(least)] = np.where(valid, least, np.uint64(0))
        taken = np.flatnonzero(sliding(padded, self.width, np.maximum)[: len(ranks)] == ranks)
        again = taken[1:][(ranks[taken[1:]] == ranks[taken[:-1]]) & (np.diff(taken) <= self.width)]
        if not len(again):
            return np.zeros(len(starts), dtype=bool)
        return np.searchsorted(again, starts) < np.searchsorted(again, ends + self.width)


def _new(*columns: np.ndarray) -> np.ndarray:
    """Rows of sorted columns that differ from the row before."""
    out = np.ones(len(columns[0]), dtype=bool)
    if len(out) > 1:
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column without a copy; null is empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _record(names: list[str], *columns: np.ndarray) -> pa.RecordBatch:
    as_long = lambda c: c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(as_long(c)) for c in columns], names=names)


def _sample_runs(sampling: Sampling):
    """Documents (ord, text) to rows (sample, run, ord, place). What is already decided here is scattered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ords = batch.column(0).to_numpy()
            sample, whole, document, start, count, inside = sampling.runs(*_texts(batch.column(1)))
            document = ords[document]
            kind = np.full(len(sample), RUN)
            # Settle copies and shared samples inside the batch, so that a hot one leaves it in two rows.
            _, group, size = np.unique(sample, return_inverse=True, return_counts=True)
            often = np.flatnonzero(size[group] > 1)
            order = often[np.lexsort((start[often], document[often], whole[often], sample[often]))]
            first = _new(sample[order], whole[order])
            kind[order[~first]] = REPEATED
            kept = order[first]
            opening = _new(sample[kept])
            closing = np.concatenate((opening[1:], [True])) if len(kept) else opening
            kind[kept[~opening & ~closing]] = DIFFERING
            extra = np.flatnonzero(inside & (kind == RUN))
            rows = np.concatenate((np.arange(len(sample)), extra))
            kind = np.concatenate((kind, np.full(len(extra), DIFFERING)))
            settled = kind != RUN
            scatter = (document[rows] * 1_000_003 + start[rows]).astype(np.uint64) * _MULTIPLY
            yield _record(
                ["sample", "run", "ord", "place"],
                np.where(settled, scatter, sample[rows]),
                np.where(settled, np.uint64(0), whole[rows]),
                document[rows],
                pack(start[rows], count[rows], 0) | kind,
            )

    return run


def _judge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (sample, run, ord, place): tells repeated runs and runs of one sample that differ.

    Holds one row: the first run of a sample, until a second one is seen.
    """
    last_sample = last_run = None
    shared, held = False, None

    for batch in batches:
        sample, run, ord_, place = (c.to_numpy() for c in batch.columns)
        settled = (place & 3) != RUN
        yield _record(["ord", "place"], ord_[settled], place[settled])
        sample, run, ord_, place = (c[~settled] for c in (sample, run, ord_, place))
        if not len(sample):
            continue
        opens, first = _new(sample), _new(sample, run)
        if last_sample is not None and sample[0] == last_sample:
            opens[0] = False
            first[0] = run[0] != last_run
        yield _record(["ord", "place"], ord_[~first], place[~first] | REPEATED)
        group = np.cumsum(opens)  # 0: the sample that the batches before ended with
        n_first = np.bincount(group[first], minlength=int(group[-1]) + 1)
        if held is not None and n_first[0]:
            yield _record(["ord", "place"], np.array([held[0]]), np.array([held[1] | DIFFERING]))
            held, shared = None, True
        if group[-1] > 0:
            held = None
        many = n_first > 1
        many[0] = shared
        tell = first & many[group]
        yield _record(["ord", "place"], ord_[tell], place[tell] | DIFFERING)
        if group[-1] > 0:
            shared = bool(many[-1])
            if not shared:
                at = np.flatnonzero(first)[-1]
                held = (ord_[at], place[at])
        last_sample, last_run = sample[-1], run[-1]


def _run_bytes(sampling: Sampling):
    """Documents with their differing runs to rows (sample, ord, place, bytes of the run)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ords = batch.column(0).to_numpy()
            data, offsets = _texts(batch.column(1))
            lists = batch.column(2)
            counts = lists.value_lengths().to_numpy()
            document = np.repeat(np.arange(len(ords)), counts)
            start, count, _ = unpack(lists.flatten().to_numpy())
            sizes = count + sampling.length - 1
            ends = np.cumsum(sizes)
            begins = ends - sizes
            # Slices of bounded size, so that long runs are gathered bit by bit.
            piece, row = SPAN << 2, 0
            while row < len(sizes):
                stop = max(row + 1, int(np.searchsorted(ends, begins[row] + piece, side="right")))
                some = slice(row, stop)
                base = begins[some] - begins[row]
                at = np.repeat(offsets[document[some]] + start[some] - base, sizes[some]) + np.arange(int(sizes[some].sum()))
                taken = data[at]
                least = sampling.samples(taken)[base]
                bounds = np.concatenate((base, [len(taken)])).astype(np.int32)
                held = pa.Array.from_buffers(pa.binary(), stop - row, [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(taken.tobytes())])
                columns = [pa.array(least.view(np.int64)), pa.array(ords[document[some]]), pa.array(pack(start[some], count[some], DIFFERING)), held]
                yield pa.RecordBatch.from_arrays(columns, names=["sample", "ord", "place", "bytes"])
                row = stop

    return run


def _string_table(sampling: Sampling, batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, ...]:
    """Ranks, document and start of every string of the runs of a batch."""
    ords = batch.column("ord").to_numpy()
    start, count, _ = unpack(batch.column("place").to_numpy())
    column = batch.column("bytes")
    data, offsets = _texts(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)
    left, right = sampling.string_ranks(data)
    row = np.repeat(np.arange(len(ords)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    at = offsets[row] + nth
    return left[at], right[at], ords[row], start[row] + nth


def _joined(ord_: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring starts of a document as (ord, first start, count), cut at every 2**20 starts."""
    order = np.lexsort((start, ord_))
    ord_, start = ord_[order], start[order]
    fresh = np.ones(len(ord_), dtype=bool)
    fresh[1:] = (ord_[1:] != ord_[:-1]) | (start[1:] > start[:-1] + 1) | (start[1:] >> 20 != start[:-1] >> 20)
    first = np.flatnonzero(fresh)
    final = np.concatenate((first[1:], [len(ord_)])) - 1
    return ord_[first], start[first], (start[final] - start[first] + 1) if len(first) else start[first]


def _later(left, right, ord_, start) -> np.ndarray:
    """Rows whose string starts earlier in another row; rows of one start are one occurrence."""
    order = np.lexsort((start, ord_, right, left))
    left, right, ord_, start = (c[order] for c in (left, right, ord_, start))
    opens = _new(left, right)
    lead = np.maximum.accumulate(np.where(opens, np.arange(len(opens)), 0))
    return order[(ord_ != ord_[lead]) | (start != start[lead])]


def _judge_strings(sampling: Sampling):
    """Rows sorted by sample to (ord, place): ranks all strings of the runs of one sample together."""

    def found(table: pa.Table) -> pa.RecordBatch:
        left, right, ord_, start = _string_table(sampling, table)
        late = _later(left, right, ord_, start)
        ord_, first, count = _joined(ord_[late], start[late])
        return _record(["ord", "place"], ord_, pack(first, count, REPEATED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            done = int(np.flatnonzero(_new(table.column("sample").to_numpy()))[-1])  # the last sample goes on, perhaps
            if done:
                yield found(table.slice(0, done))
            held = table.slice(done)
        if held is not None:
            yield found(held)

    return run


def _wider_ranks(sampling: Sampling, step: int):
    """Runs of hot samples to parts of them whose strings share all but ``step`` of their bytes.

    Such a block begins whole steps before the first sample of a string, so equal strings have the same one,
    and neighbouring strings mostly share it: a run becomes a few rows, and contexts that differ part.
    """
    size = sampling.length - step
    power = 1 << (size.bit_length() - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ords = batch.column("ord").to_numpy()
            start, count, _ = unpack(batch.column("place").to_numpy())
            data, offsets = _texts(batch.column("bytes"))
            ranks = doubled(data, sampling.gram)
            least = sliding(ranks, sampling.width)[offsets[:-1]]
            places = np.flatnonzero(ranks == np.repeat(least, np.diff(offsets))[: len(ranks)])
            row = np.repeat(np.arange(len(ords)), count)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            at = offsets[row] + nth
            sample_at = places[np.searchsorted(places, at)]
            steps = (sample_at - at) // step
            begin = sample_at - step * steps
            wide = doubled(data, power)
            key = wide[begin] * _MULTIPLY + wide[begin + size - power]
            key ^= key >> np.uint64(32)
            key = key * _AGAIN ^ steps.astype(np.uint64)
            first = np.flatnonzero(_new(row, key))
            number = np.diff(np.concatenate((first, [len(row)])))
            pieces = [data[a:b].tobytes() for a, b in zip(at[first].tolist(), (at[first] + number - 1 + sampling.length).tolist(), strict=True)]
            place = pack(start[row[first]] + nth[first], number, DIFFERING)
            columns = [pa.array(key[first].view(np.int64)), pa.array(ords[row[first]]), pa.array(place), pa.array(pieces, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["sample", "ord", "place", "bytes"])

    return run


def _strings(sampling: Sampling):
    """Runs to rows (left, right, ord, place) of their strings; those repeated inside the batch are settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right, ord_, start = _string_table(sampling, batch)
            late = np.zeros(len(left), dtype=bool)
            late[_later(left, right, ord_, start)] = True
            names = ["sample", "run", "ord", "place"]
            alone = np.ones(int((~late).sum()), np.int64)
            yield _record(names, left[~late], right[~late], ord_[~late], pack(start[~late], alone, RUN))
            ord_, start, count = _joined(ord_[late], start[late])
            scatter = (ord_ * 1_000_003 + start).astype(np.uint64) * _MULTIPLY
            yield _record(names, scatter, np.zeros_like(scatter), ord_, pack(start, count, REPEATED))

    return run


def _judge_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (left, right, ord, place): places of strings that were seen before."""
    last = None
    for batch in batches:
        left, right, ord_, place = (c.to_numpy() for c in batch.columns)
        settled = (place & 3) == REPEATED
        yield _record(["ord", "place"], ord_[settled], place[settled])
        left, right, ord_, place = (c[~settled] for c in (left, right, ord_, place))
        if not len(left):
            continue
        opens = _new(left, right)
        if last is not None:
            opens[0] = (left[0], right[0]) != last[:2]
        at = np.where(opens, np.arange(len(opens)), -1)
        lead = np.maximum.accumulate(at)
        known = (last[2], last[3]) if last is not None else (0, 0)
        lead_ord = np.where(lead < 0, known[0], ord_[lead])
        lead_place = np.where(lead < 0, known[1], place[lead])
        late = (ord_ != lead_ord) | (place != lead_place)
        yield _record(["ord", "place"], ord_[late], place[late] | REPEATED)
        last = (left[-1], right[-1], lead_ord[-1], lead_place[-1])


_RANKED = "sample long, run long, ord long, place long"
_BYTES = "sample long, ord long, place long, bytes binary"


def _by_size(runs: DataFrame, group: int) -> tuple[DataFrame, DataFrame | None]:
    """Runs of samples that have at most ``group`` runs, and the others, if any."""
    sizes = runs.groupBy("sample").agg(F.count(F.lit(1)).alias("n"))
    hot = written(sizes.where(F.col("n") > group).select("sample"), "suffix-hot")
    if hot.isEmpty():
        return runs, None
    hot = sent_if_small(hot)
    few, many = (runs.join(hot, "sample", how).select(*runs.columns) for how in ("left_anti", "left_semi"))
    return few, many


def repeated_places(documents: DataFrame, length: int, group: int = GROUP) -> DataFrame:
    """``(ord, start, count)``: starts of strings that also start earlier; ``documents`` has (ord, text)."""
    sampling = Sampling(length)
    ranked = documents.mapInArrow(_sample_runs(sampling), _RANKED)
    ranked = ranked.repartition("sample").sortWithinPartitions("sample", "run", "ord", "place")
    judged = written(ranked.mapInArrow(_judge_runs, "ord long, place long"), "suffix-runs")
    kind = F.col("place").bitwiseAND(F.lit(3))
    span = [F.shiftright("place", 24).alias("start"), F.shiftright("place", 2).bitwiseAND(F.lit((1 << 22) - 1)).alias("count")]
    wholly = judged.where(kind == REPEATED).select("ord", *span)
    # A document's runs are bounded by its text.
    differing = judged.where(kind == DIFFERING).groupBy("ord").agg(F.collect_list("place").alias("places"))
    runs = documents.join(differing, "ord").select("ord", "text", "places")
    few, many = _by_size(written(runs.mapInArrow(_run_bytes(sampling), _BYTES), "suffix-bytes"), group)
    for step in sampling.steps:
        if many is not None:
            refined, many = _by_size(written(many.mapInArrow(_wider_ranks(sampling, step), _BYTES), "suffix-bytes"), group)
            few = few.union(refined)
    if many is not None:
        pairs = many.mapInArrow(_strings(sampling), _RANKED)
        pairs = pairs.repartition("sample").sortWithinPartitions("sample", "run", "ord", "place")
        wholly = wholly.union(pairs.mapInArrow(_judge_places, "ord long, place long").select("ord", *span))
    few = few.repartition("sample").sortWithinPartitions("sample")
    return wholly.union(few.mapInArrow(_judge_strings(sampling), "ord long, place long").select("ord", *span))


def _cut_texts(length: int, schema: pa.Schema, text_at: int):
    """Documents with their repeated places to kept bytes and removed spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = _texts(batch.column(text_at))
            lists = batch.column(batch.num_columns - 1)
            counts = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            flat = lists.flatten()
            start, count = flat.field("start").to_numpy(), flat.field("count").to_numpy()
            kept, spans, at = [], [], 0
            for i in range(batch.num_rows):
                body = data[offsets[i] : offsets[i + 1]]
                own = slice(at, at + counts[i])
                at = own.stop
                if not counts[i]:
                    kept.append(body.tobytes())
                    spans.append([])
                    continue
                order = np.argsort(start[own], kind="stable")
                low = start[own][order]
                high = np.maximum.accumulate(low + count[own][order] - 1 + length)
                fresh = np.concatenate(([True], low[1:] > high[:-1]))
                low = low[fresh]
                high = high[np.concatenate((np.flatnonzero(fresh)[1:] - 1, [len(high) - 1]))]
                spans.append([{"start": a, "stop": b} for a, b in zip(low.tolist(), high.tolist(), strict=True)])
                edges = zip([0, *high.tolist()], [*low.tolist(), len(body)], strict=True)
                kept.append(b"".join(body[a:b].tobytes() for a, b in edges))
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            made = [pa.array(kept, pa.binary()), pa.array(spans, schema.field("removed_spans").type)]
            yield pa.RecordBatch.from_arrays(
                [c.cast(f.type) for c, f in zip(columns, schema, strict=False)] + made, schema=schema
            )

    return run


def _ordered(documents: DataFrame, id: str, text: str, order: str) -> tuple[DataFrame, DataFrame]:
    """The documents with their place in the order, and the (ord, text) rows to search.

    Unique integer ids are the order. Else rows are ordered by id (null first) and a hash of the text, and
    rows equal in both are one document.
    """
    kind = documents.schema[id].dataType.typeName()
    if kind in ("byte", "short", "integer", "long"):
        repeats = documents.groupBy(id).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col(id).isNull())
        if repeats.isEmpty():
            marked = documents.withColumn(order, F.coalesce(F.col(id).cast("long"), F.lit(0).cast("long")))
            return marked, marked.select(F.col(order).alias("ord"), F.col(text).alias("text"))
    hash_, own = fresh(documents, "hash", "own")
    hashed = documents.withColumn(hash_, F.sha2(F.coalesce(text, F.lit("")), 256))
    keys = hashed.select(F.col(id).alias(own), F.col(hash_).alias("text_hash")).distinct()
    keys = written(keys.orderBy(F.asc_nulls_first(own), "text_hash"), "suffix-order")
    numbered = keys.rdd.zipWithIndex().map(lambda x: (*x[0], x[1])).toDF(keys.schema.add(order, "long"))
    numbered = written(numbered, "suffix-order").withColumn(order, F.coalesce(order, F.lit(0).cast("long")))
    same = (hashed[hash_] == numbered["text_hash"]) & hashed[id].eqNullSafe(numbered[own])
    marked = hashed.join(numbered, same).select(*[hashed[c] for c in documents.columns], numbered[order])
    return marked, marked.select(F.col(order).alias("ord"), F.col(text).alias("text")).dropDuplicates(["ord"])


def remove_repeats(
    documents: DataFrame, *, id: str = "doc_id", text: str = "text", length: int = 100, group: int = GROUP
) -> DataFrame:
    """Add ``kept`` (the bytes left) and ``removed_spans`` (byte ranges ``[start, stop)``) to documents.

    A byte goes when a string of ``length`` bytes that covers it also starts earlier: in a document of a
    smaller id, or earlier in the same one, overlaps included. Strings are judged on the input and never cross
    documents. Null texts are empty; texts shorter than ``length`` stay as they are. Ids need not be unique:
    see ``_ordered``; rows equal in id and text get the same result. An empty table stays empty. Columns of
    the documents are kept; those named ``kept`` or ``removed_spans`` are replaced.
    """
    documents = documents.drop("kept", "removed_spans")
    order, found, spans = fresh(documents, "order", "found", "spans")
    marked, searched = _ordered(documents, id, text, order)
    places = repeated_places(searched, length, group)
    # A document's places are bounded by its text.
    of_document = places.groupBy(F.col("ord").alias(found)).agg(F.collect_list(F.struct("start", "count")).alias(spans))
    columns = documents.columns
    joined = marked.join(of_document, F.col(order) == F.col(found), "left").select(*columns, spans)
    types = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in columns)
    result = f"{types}, kept binary, removed_spans array<struct<start:long,stop:long>>"
    arrow = to_arrow_schema(documents.sparkSession.createDataFrame([], result).schema)
    return joined.mapInArrow(_cut_texts(length, arrow, columns.index(text)), result)


def drop_repeats(documents: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """The documents with their texts cut; where a cut splits a character, what is left of it goes too.

    Null texts stay null.
    """
    cut = remove_repeats(documents, text=text, **options)
    left = F.when(F.size("removed_spans") == 0, F.col(text)).otherwise(_whole_characters("kept"))
    return cut.withColumn(text, left).select(*documents.columns)


@F.pandas_udf(StringType())
def _whole_characters(kept: pd.Series) -> pd.Series:
    return kept.map(lambda body: bytes(body).decode("utf-8", "ignore"))
