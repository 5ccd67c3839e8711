"""Hierarchical cells of coordinates as column arithmetic.

The globe in degrees is halved in longitude and latitude at every level, so a
cell at resolution r has four children at r + 1 and lies wholly in its parent.
A cell id is a bigint: a leading 1 bit, then two bits a level (latitude half,
longitude half). Its resolution is the number of bit pairs; a parent is a shift.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Finest resolution: 2 bits a level and the leading bit fit a bigint.
FINEST = 30


def _cell(x: Column, y: Column, resolution: int) -> Column:
    """Bits of ``x`` and ``y`` interleaved below the leading 1 bit: binary digits read as digits to the base 4."""
    spread = lambda v: F.conv(F.bin(v), 4, 10).cast("bigint")
    return F.lit(1 << (2 * resolution)) + spread(x) + spread(y) * 2


def cell(lat: Column, lon: Column, resolution: int) -> Column:
    """Cell id of a point; null for a null or non-finite coordinate or a latitude beyond the poles.

    Longitudes wrap; the north pole lies in the topmost cells.
    """
    if not 0 <= resolution <= FINEST:
        raise ValueError(f"resolution is 0 to {FINEST}")
    n = 1 << resolution
    x = F.pmod(F.floor((lon + F.lit(180.0)) / F.lit(360.0) * F.lit(float(n))), F.lit(n)).cast("bigint")
    y = F.least(F.floor((lat + F.lit(90.0)) / F.lit(180.0) * F.lit(float(n))).cast("bigint"), F.lit(n - 1))
    good = lat.between(-90.0, 90.0) & (F.abs(lon) <= 1e6)
    return F.when(good, _cell(x, y, resolution))


def cell_resolution(c: Column) -> Column:
    return ((F.length(F.bin(c)) - 1) / 2).cast("int")


def cell_parent(c: Column, levels: int = 1) -> Column:
    """The cell ``levels`` levels up; null above the top."""
    up = F.shiftright(c, 2 * levels)
    return F.when(up > 0, up)


def cell_children(c: Column) -> Column:
    first = F.shiftleft(c, 2)
    return F.array(*[first + k for k in range(4)])


def cell_path(c: Column) -> Column:
    """Digits 0 to 3 of the path from the top; a cell's path starts with its parent's."""
    return F.substring(F.conv(c.cast("string"), 10, 4), 2, FINEST)


def cell_contains(outer: Column, inner: Column) -> Column:
    """Whether ``inner`` is ``outer`` or lies in it."""
    levels = F.length(F.bin(inner)) - F.length(F.bin(outer))
    return (levels >= 0) & (F.call_function("shiftright", inner, F.greatest(levels, F.lit(0))) == outer)


def cell_neighbours(c: Column, resolution: int) -> Column:
    """The (up to eight) cells around a cell of ``resolution``, sorted: longitudes wrap, there is none beyond a pole."""
    n = 1 << resolution
    bits = lambda digits: F.conv(F.concat(F.lit("0"), F.translate(cell_path(c), "0123", digits)), 2, 10).cast("bigint")
    around = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for j in (-1, 0, 1) for i in (-1, 0, 1) if i or j]
    # Bound by the lambdas, so that the place is worked out once.
    place = F.array(F.struct(bits("0101").alias("x"), bits("0011").alias("y")))
    found = F.transform(place, lambda p: F.transform(
        F.filter(F.array(*around), lambda d: (p["y"] + d["j"] >= 0) & (p["y"] + d["j"] < n)),
        lambda d: _cell(F.pmod(p["x"] + d["i"], F.lit(n)), p["y"] + d["j"], resolution),
    ))
    return F.when(c.isNotNull(), F.array_sort(F.array_except(F.array_distinct(F.flatten(found)), F.array(c))))
