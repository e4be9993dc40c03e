"""Questions to count-min sketches, with built-in functions.

A sketch of count_min_sketch holds, big-endian: version (4 bytes), total (8), depth (4), width (4), a factor for each row (8 each), and the
counts row by row (8 each). An item's place in a row is its product with the row's factor, folded into 31 bits, modulo the width.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

_HEAD = 20
_PRIME = 2**31 - 1


def _number(sketch: Column, at: Column | int, size: int) -> Column:
    """The number in ``size`` bytes from position ``at`` (from 0)."""
    at = at if isinstance(at, Column) else F.lit(at)
    return F.conv(F.hex(F.substring(sketch, (at + 1).cast("int"), F.lit(size))), 16, 10).cast("long")


def count_min_total(sketch: Column) -> Column:
    return _number(sketch, 4, 8)


def count_min_estimate(sketch: Column, item: Column, depth: int) -> Column:
    """How often a whole number below 2^31 in size is in a sketch of ``depth`` rows: never too low, and too high by at most eps of the total, with the sketch's confidence.

    Null for a null sketch or item.
    """
    item, width = item.cast("long"), _number(sketch, 16, 4)

    def of(row: int) -> Column:
        mixed = item * _number(sketch, _HEAD + 8 * row, 8)
        place = (mixed + F.shiftright(mixed, 32)).bitwiseAND(F.lit(_PRIME)) % width
        return _number(sketch, _HEAD + 8 * depth + 8 * (width * row + place), 8)

    return reduce(lambda a, b: F.least(a, b), [of(i) for i in range(depth)]) if depth > 1 else of(0)
