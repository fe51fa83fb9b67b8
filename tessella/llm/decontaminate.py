"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Every window of ``width`` consecutive words of a test item is a pattern (an item of fewer words is one
shorter pattern). Patterns of one length share a shift table over blocks of two words, which tells how far
the scan may jump, and buckets by their last block and first word; a bucket's windows are then compared
word by word, so an occurrence is never a hash match only.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import alnum_words, fresh, map_rows, written

# Item text of one block of the benchmark, in bytes. Its windows, up to one for each word, take some hundred
# times as much in the driver and in every Python worker.
BLOCK_BYTES = 1 << 20

HITS = "n_words long, spans array<struct<first:long,last:long>>, items array<string>"
RESULTS = ("n_words", "spans", "items")


class WordSearch:
    """Shift tables and buckets for the windows of some items."""

    def __init__(self, items: Iterable[tuple[str | None, str | None]], width: int):
        windows: dict[int, dict[tuple, set]] = {}
        for item, text in items:
            words = alnum_words(text)
            size = min(width, len(words))
            for i in range(len(words) - size + 1 if words else 0):
                found = windows.setdefault(size, {}).setdefault(tuple(words[i : i + size]), set())
                if item is not None:
                    found.add(item)
        self.tables = [(size, *self._table(size, patterns)) for size, patterns in sorted(windows.items())]

    @staticmethod
    def _table(size: int, patterns: dict[tuple, set]) -> tuple[dict, dict]:
        block = min(2, size)
        shift: dict[tuple, int] = {}
        buckets: dict[tuple, dict[bytes, list]] = {}
        for window, items in patterns.items():
            for end in range(block, size + 1):
                key = window[end - block : end]
                shift[key] = min(shift.get(key, size), size - end)
            first = buckets.setdefault(window[-block:], {}).setdefault(window[0], [])
            first.append((list(window), items))
        return shift, buckets

    def hits(self, words: list[bytes]) -> tuple[bytearray, set]:
        """Marked words, and the items whose windows occur."""
        marked, items, n = bytearray(len(words)), set(), len(words)
        for size, shift, buckets in self.tables:
            block = min(2, size)
            jump = size - block + 1
            at = size
            while at <= n:
                key = tuple(words[at - block : at])
                step = shift.get(key, jump)
                if step:
                    at += step
                    continue
                start = at - size
                for window, owners in buckets[key].get(words[start], ()):
                    if words[start:at] == window:
                        marked[start:at] = b"\x01" * size
                        items |= owners
                at += 1
        return marked, items


def marked_spans(marked: bytearray) -> list[dict]:
    """Maximal runs of marked words."""
    spans, at = [], marked.find(1)
    while at >= 0:
        end = marked.find(0, at)
        end = len(marked) if end < 0 else end
        spans.append({"first": at, "last": end - 1})
        at = marked.find(1, end)
    return spans


def find_benchmark(
    documents: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = 10,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Add ``n_words``, ``spans`` (word ranges hit) and ``items`` (occurring, as sorted strings) to documents.

    Whole texts of any length are searched. The benchmark is the query set: it is sent to the tasks in blocks of bounded size, and documents pass
    the blocks one after the other without a shuffle. Between blocks the documents are written to the shared
    folder, so a task never holds two blocks.

    Null and empty texts have no words and no hits; items without words are no pattern; items with a null id
    mark words but are not listed; rows of one item id are one item. An empty benchmark hits nothing, repeated
    documents each get their row. Columns of the documents are kept; those named like a result, in any case, are replaced.
    """
    wanted = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("words"))
    volume = wanted.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    blocks = max(1, -(-volume // block_bytes))
    kept = [c for c in documents.columns if c.lower() not in RESULTS]
    fields = {f.name: f for f in documents.schema.fields}
    types = "".join(f"`{c}` {fields[c].dataType.simpleString()}, " for c in kept)
    out = documents.select(*kept)
    for number in range(blocks):
        part = wanted.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == number) if blocks > 1 else wanted
        search = documents.sparkSession.sparkContext.broadcast(
            WordSearch(((r.item, r.words) for r in part.toLocalIterator()), width)
        )
        if number:
            out = written(out, "decontaminate")
        out = map_rows(out, types + HITS, _block_pass(search, kept, text, bool(number)))
    return out


def _block_pass(search, kept: list[str], text: str, again: bool):
    def rows(columns: dict[str, list]):
        for i, value in enumerate(columns[text]):
            words = alnum_words(value)
            marked, items = search.value.hits(words)
            if again:
                for span in columns["spans"][i]:
                    marked[span["first"] : span["last"] + 1] = b"\x01" * (span["last"] + 1 - span["first"])
                items = items.union(columns["items"][i])
            yield (*(columns[c][i] for c in kept), len(words), marked_spans(marked), sorted(items))

    return rows


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """Documents in which no benchmark window occurs, with their own columns, those named like a result included.

    Null and empty texts have no window and stay, and so do all documents where the benchmark has no words; repeated
    documents stay or go together; an empty table stays empty. Texts are searched whole, whatever their length.
    """
    # Columns named like a result step aside for the search.
    aside = {c: name for c in documents.columns if c.lower() in RESULTS for (name,) in [fresh(documents, f"{c}_own")]}
    found = find_benchmark(documents.withColumnsRenamed(aside), benchmark, text=aside.get(text, text), **options)
    clean = found.where(F.size("spans") == 0).select(*[aside.get(c, c) for c in documents.columns])
    return clean.withColumnsRenamed({name: c for c, name in aside.items()})
