"""The eight flips and quarter turns of a square channel-last patch."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.guards import choice

# Fixed order: a keyed choice indexes this list.
AUGMENTATIONS = (
    "identity",
    "rot90",
    "rot180",
    "rot270",
    "flip_h",
    "flip_v",
    "transpose",
    "anti_transpose",
)


def _source(name: str, i: Column, j: Column, last: int) -> tuple[Column, Column]:
    """Input position that lands on output position ``(i, j)``."""
    ri, rj = F.lit(last) - i, F.lit(last) - j
    positions = {
        "identity": (i, j),
        "rot90": (j, ri),
        "rot180": (ri, rj),
        "rot270": (rj, i),
        "flip_h": (i, rj),
        "flip_v": (ri, j),
        "transpose": (j, i),
        "anti_transpose": (rj, ri),
    }
    return positions[name]


_INVERSE = {"rot90": "rot270", "rot270": "rot90"}


def moved_position(name: str, y: Column, x: Column, size: int) -> tuple[Column, Column]:
    """Where pixel ``(y, x)`` of a long-form patch goes under a named operation."""
    choice("operation", name, tuple(AUGMENTATIONS))
    return _source(_INVERSE.get(name, name), y, x, size - 1)


def augment(values: Column, name: Column | str, size: int, channels: int) -> Column:
    """Apply a named operation to flattened ``size x size x channels`` patches.

    ``name`` may be a column; a name outside the list fails the job.
    """
    name = F.lit(name) if isinstance(name, str) else name

    def permuted(op: str) -> Column:
        if op == "identity":
            return values

        def source_value(t: Column) -> Column:
            c = t % channels
            p = ((t - c) / channels).cast("int")
            j = p % size
            i = ((p - j) / size).cast("int")
            y, x = _source(op, i, j, size - 1)
            return F.get(values, ((y * size + x) * channels + c).cast("int"))

        cells = F.sequence(F.lit(0), F.lit(size * size * channels - 1))
        return F.transform(cells, source_value)

    chain = F.when(name == AUGMENTATIONS[0], permuted(AUGMENTATIONS[0]))
    for op in AUGMENTATIONS[1:]:
        chain = chain.when(name == op, permuted(op))
    return chain.otherwise(F.raise_error(F.concat(F.lit("unknown augmentation "), name)))
