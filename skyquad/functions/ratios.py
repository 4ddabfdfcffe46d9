"""Quad ratios: six distances to five ratios, and their packed 48-bit form."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import Value, col, narrow

#: Fixed values of the packed form: bits of each ratio, from the lowest.
BITS = (10, 10, 10, 9, 9)
NAMES = ["r0", "r1", "r2", "r3", "r4"]


def quad_ratios(distances: Column) -> tuple[Column, Column]:
    """(five ascending single-precision ratios, the longest) of an array of six distances, none of them null.
    Without functions of higher order, which aren't compiled and sorted the distances anew for each ratio."""
    ordered = F.sort_array(distances)
    longest = F.element_at(ordered, 6)
    return F.array(*[narrow(F.element_at(ordered, i) / longest) for i in range(1, 6)]), narrow(longest)


def pack(ratios: list[Column]) -> Column:
    """One long; halves are rounded away from zero."""
    out, shift = F.lit(0).cast("long"), 0
    for ratio, bits in zip(ratios, BITS, strict=True):
        level = F.round(ratio.cast("double") * float((1 << bits) - 1)).cast("long")
        out = out.bitwiseOR(F.shiftleft(level, shift))
        shift += bits
    return out


def unpack(packed: Value) -> list[Column]:
    """Single-precision ratios; the reciprocal of the top level is a single-precision constant."""
    found, shift = [], 0
    for bits in BITS:
        level = F.shiftright(col(packed), shift).bitwiseAND(F.lit((1 << bits) - 1))
        found.append(narrow(level.cast("float") * narrow(F.lit(1e0 / ((1 << bits) - 1)))))
        shift += bits
    return found


def quantized(ratios: list[Column]) -> list[Column]:
    """The ratios as they come back from the packed form."""
    out = []
    for ratio, bits in zip(ratios, BITS, strict=True):
        top = (1 << bits) - 1
        out.append(narrow(F.round(ratio.cast("double") * float(top)).cast("float") * narrow(F.lit(1e0 / top))))
    return out


def scale_ratio(image_largest: Value, catalog_largest: Value) -> Column:
    """Pixels per degree, computed in single precision and widened."""
    return narrow(col(image_largest) / col(catalog_largest)).cast("double")


def scaled(ratio: Value, factor: float) -> Column:
    """A ratio times a number, in single precision."""
    return narrow(col(ratio) * narrow(F.lit(factor)))


def window(tolerance: float = 0.011) -> tuple[float, float]:
    """Bounds of the prefilter's factor, in single precision."""
    one, t = np.float32(1), np.float32(tolerance)
    return float(one - t), float(one + t)


def within(image: Column, catalog: Column, tolerance: float = 0.011) -> Column:
    """Single-precision window test of the prefilter, inclusive."""
    low, high = (narrow(F.lit(v)) for v in window(tolerance))
    return (image >= narrow(catalog * low)) & (image <= narrow(catalog * high))


def agrees(image: Column, catalog: Column, tolerance: float = 0.011) -> Column:
    """Final test: relative difference of at most the tolerance."""
    return F.abs(narrow(image / catalog).cast("double") - 1e0) <= tolerance
