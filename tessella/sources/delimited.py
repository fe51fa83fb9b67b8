"""CSV whose quoted fields hold line breaks, read split by split.

Whether a line starts inside quotes depends on all lines before it, so files are read in two passes. The first
parses every split under both states and keeps where each ends; composing these by prefix over a file's splits
gives the state each split starts in. The second parses the lines of a split from that state. A record that
crosses a border leaves pieces in its splits, which are put together afterwards. Records are parsed by Python's
csv reader, so the result is what it gives on the whole file (line breaks of any kind are line feeds).
"""

from __future__ import annotations

import csv
import sys
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Lines of whole records that are parsed at a time.
_FLUSH = 1000


def ends_inside(line: str, inside: bool) -> bool:
    """Whether the end of the line lies inside quotes, if its start does or does not.

    Quotes open a field only as its first character; inside quotes two of them stand for one.
    """
    at = line.find('"')
    if at < 0:
        return inside
    at = 0
    while True:
        if not inside:
            if line.startswith('"', at):
                at, inside = at + 1, True
            else:
                comma = line.find(",", at)
                if comma < 0:
                    return False
                at = comma + 1
                continue
        quote = line.find('"', at)
        if quote < 0:
            return True
        if line.startswith('"', quote + 1):
            at = quote + 2
            continue
        # What follows a closing quote belongs to the field, quotes included, up to the next comma.
        comma = line.find(",", quote + 1)
        if comma < 0:
            return False
        at, inside = comma + 1, False


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[str]]]:
    """Lines of one split at a time, in pieces of an Arrow batch: ``((file, block, ...), lines)``."""
    for batch in batches:
        *keys, values = (c.to_pylist() for c in batch.columns)
        places, start = list(zip(*keys, strict=True)), 0
        for at in range(1, len(places) + 1):
            if at == len(places) or places[at] != places[start]:
                yield places[start], values[start:at]
                start = at


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a split: the state at its end for both states at its start, and whether a record starts in it."""
    held: list | None = None

    def row() -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_()]
        names = ["file", "block", "from_outside", "from_inside", "restarts"]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(held, kinds, strict=True)], names=names)

    for place, lines in _runs(batches):
        if held is None or (held[0], held[1]) != place:
            if held is not None:
                yield row()
            held = [*place, False, True, False]
        for line in lines:
            # A line that starts outside under the inside state makes both parses one.
            held[4] = held[4] or not held[3]
            held[2], held[3] = ends_inside(line, held[2]), ends_inside(line, held[3])
    if held is not None:
        yield row()


def split_states(lines: DataFrame) -> DataFrame:
    """``(file, block, inside, owner)`` of every split: its first state, and the split whose record it goes on with."""
    ends = lines.select("file", "block", "value").mapInArrow(
        _ends, "file string, block long, from_outside boolean, from_inside boolean, restarts boolean"
    )
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    settled = F.when(F.col("from_outside") == F.col("from_inside"), F.col("from_outside").cast("int"))
    flips = (F.col("from_outside") & ~F.col("from_inside")).cast("int")
    # The state after the last split that ends alike either way, changed by every flip since.
    summed = ends.withColumn("flips", F.sum(flips).over(upto.rowsBetween(Window.unboundedPreceding, 0)))
    known = F.last(F.when(settled.isNotNull(), F.struct(settled.alias("state"), F.col("flips").alias("at"))), ignorenulls=True).over(upto)
    before = F.coalesce(F.lag("flips").over(Window.partitionBy("file").orderBy("block")), F.lit(0))
    state = summed.withColumn("known", known).withColumn("so_far", before)
    inside = (F.coalesce(F.col("known.state"), F.lit(0)) + F.col("so_far") - F.coalesce(F.col("known.at"), F.lit(0))) % 2 == 1
    placed = state.withColumn("inside", inside)
    ends_open = F.when(F.col("inside"), F.col("from_inside") & F.col("restarts")).otherwise(F.col("from_outside"))
    owner = F.last(F.when(ends_open, F.col("block")), ignorenulls=True).over(upto)
    final = F.when(F.col("inside"), F.col("from_inside")).otherwise(F.col("from_outside"))
    last = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("block"))) == 1
    checked = F.when(last & final, F.raise_error(F.concat(F.lit("a quoted field is not closed at the end of "), F.col("file"))).cast("boolean"))
    return placed.select("file", "block", F.coalesce(checked, F.col("inside")).alias("inside"), owner.alias("owner"))


def parse_records(lines: Sequence[str]) -> Iterator[tuple[int, list[str]]]:
    """``(number of its first line, fields)`` of every record of whole lines; blank lines are no records."""
    csv.field_size_limit(sys.maxsize)
    reader, start = csv.reader(f"{line}\n" for line in lines), 0
    for fields in reader:
        if fields:
            yield start, fields
        start = reader.line_num


_RECORD = "file string, block long, row long, fields array<string>, piece string"


class _Parser:
    """The lines of one split: whole records, and the pieces of those that cross its borders."""

    def __init__(self, file: str, block: int, inside: bool, names: Sequence[str]) -> None:
        self.file, self.block, self.names = file, block, names
        self.head, self.body, self.open_ = ([] if inside else None), [], []
        self.count, self.flushed = 0, 0
        # The header is no row, so rows of a file's first split count from it.
        self.header_due, self.skipped = block == 0, 0
        self.rows: list[tuple] = []

    def feed(self, lines: list[str]) -> None:
        for line in lines:
            if self.head is not None:
                self.head.append(line)
                if not ends_inside(line, True):
                    self.piece(self.count - len(self.head) + 1, self.head)
                    self.head = None
                    self.flushed = self.count + 1
            else:
                self.open_.append(line)
                if not ends_inside(line, len(self.open_) > 1):
                    self.body += self.open_
                    self.open_ = []
            self.count += 1
        if len(self.body) >= _FLUSH:
            self.flush()

    def piece(self, row: int, lines: list[str]) -> None:
        self.rows.append((self.file, self.block, row - self.skipped, None, "\n".join(lines)))

    def flush(self) -> None:
        for at, fields in parse_records(self.body):
            row = self.flushed + at
            if self.header_due:
                self.header_due, self.skipped = False, row + 1
                if fields != list(self.names):
                    raise ValueError(f"columns {fields} != expected {list(self.names)} in {self.file}")
                continue
            if len(fields) != len(self.names):
                raise ValueError(f"{len(fields)} fields, not {len(self.names)}, in {self.file}: {fields[:3]}")
            self.rows.append((self.file, self.block, row - self.skipped, fields, None))
        self.flushed += len(self.body)
        self.body = []

    def close(self) -> None:
        self.flush()
        if self.head is not None:
            self.piece(0, self.head)
        elif self.open_:
            if self.header_due:
                raise ValueError(f"no header of {list(self.names)} in {self.file}")
            self.piece(self.count - len(self.open_), self.open_)


def _records(names: Sequence[str]):
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("row", pa.int64()), ("fields", pa.list_(pa.string())), ("piece", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = None
        for (file, block, inside), lines in _runs(batches):
            if parser is None or (parser.file, parser.block) != (file, block):
                if parser is not None:
                    parser.close()
                    yield batch_of(parser)
                parser = _Parser(file, block, bool(inside), names)
            parser.feed(lines)
            if len(parser.rows) >= _FLUSH:
                yield batch_of(parser)
        if parser is not None:
            parser.close()
            yield batch_of(parser)

    def batch_of(parser: _Parser) -> pa.RecordBatch:
        rows, parser.rows = parser.rows, []
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def _joined_pieces(names: Sequence[str]):
    def run(pieces: pa.Array) -> pa.Array:
        out = []
        for text in pieces.to_pylist():
            ((_, fields),) = parse_records(text.split("\n"))
            if len(fields) != len(names):
                raise ValueError(f"{len(fields)} fields, not {len(names)}: {fields[:3]}")
            out.append(fields)
        return pa.array(out, pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>")


def read_records(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """``(file, block, row, fields)`` of every record of the files under ``path``, ordered by the first three.

    Every file starts with a header that equals ``names``. A header that differs, a record of another length, bytes that
    are not UTF-8 and quotes that a file does not close fail the job. Empty files have no records.
    """
    source = spark.read.text(path)
    valid = F.when(F.is_valid_utf8("value"), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("not UTF-8: "), F.col("_metadata.file_path"))))
    lines = source.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), valid.alias("value"))
    states = split_states(lines)
    # Splits that start inside quotes: at most one row a split, and the hash join keeps the order of the lines.
    within = states.where("inside").select("file", "block", "inside")
    known = lines.join(F.broadcast(within), ["file", "block"], "left").select("file", "block", "inside", "value")
    parsed = known.mapInArrow(_records(names), _RECORD)
    whole = parsed.where("piece is null").drop("piece")
    pieces = parsed.where("piece is not null").join(states, ["file", "block"])
    # A piece goes with the split its record starts in: a piece from the start of a split that begins inside
    # quotes with the owner, any other with its own split. The rest of a record never comes before its start.
    starts = ~F.col("inside") | (F.col("row") > 0)
    of = pieces.select("file", F.when(starts, F.col("block")).otherwise(F.col("owner")).alias("of"), "block", F.when(starts, F.col("row")).alias("row"), "piece")
    together = of.groupBy("file", "of").agg(
        F.max("row").alias("row"), F.array_sort(F.collect_list(F.struct("block", "piece"))).alias("pieces")
    )
    text = F.array_join(F.transform("pieces", lambda p: p["piece"]), "\n")
    crossing = together.select("file", F.col("of").alias("block"), "row", _joined_pieces(names)(text).alias("fields"))
    return whole.unionByName(crossing)
