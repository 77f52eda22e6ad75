"""Z-order codes as Catalyst expressions: y in the higher bit of each pair, x in the lower.

Codes stay in whole-stage code; an index table stores its code, so queries don't compute it again.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .region import Region


def _sum(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def axis_code(v: Column, low: float, extent: float, bits: int, truncate: bool = False) -> Column:
    """The cell of `v` on one axis: rounded half to even, or truncated; values at or beyond an edge go to the last cell there."""
    scaled = (v - F.lit(low)) * F.lit(float(1 << bits)) / F.lit(extent)
    cell = (F.floor(scaled) if truncate else F.rint(scaled)).cast("long")
    return F.greatest(F.least(cell, F.lit((1 << bits) - 1)), F.lit(0).cast("long"))


def bisected_code(v: Column, low: float, extent: float, bits: int) -> Column:
    """The cell of `v` if each halving gives a tie to the lower half."""
    scaled = (v - F.lit(low)) * F.lit(float(1 << bits)) / F.lit(extent)
    return F.greatest(F.least(F.ceil(scaled).cast("long") - 1, F.lit((1 << bits) - 1)), F.lit(0).cast("long"))


def interleave(x: Column, y: Column, bits: int) -> Column:
    one = F.lit(1).cast("long")
    return _sum([F.shiftleft(F.shiftright(c, i).bitwiseAND(one), 2 * i + up) for c, up in ((x, 0), (y, 1)) for i in range(bits)])


def x_of(z: Column, bits: int) -> Column:
    one = F.lit(1).cast("long")
    return _sum([F.shiftleft(F.shiftright(z, 2 * i).bitwiseAND(one), i) for i in range(bits)])


def y_of(z: Column, bits: int) -> Column:
    return x_of(F.shiftright(z, 1), bits)


def encode(x: Column, y: Column, region: Region, bits: int, truncate: bool = False) -> Column:
    return interleave(axis_code(x, region.left, region.width, bits, truncate), axis_code(y, region.bottom, region.height, bits, truncate), bits)


def code_of(x: float, y: float, region: Region, bits: int) -> int:
    """encode() of one place, without a job."""
    cell = lambda v, low, extent: max(0, min((1 << bits) - 1, round((v - low) * float(1 << bits) / extent)))
    a, b = cell(x, region.left, region.width), cell(y, region.bottom, region.height)
    return sum((a >> i & 1) << 2 * i | (b >> i & 1) << 2 * i + 1 for i in range(bits))


def decode(z: Column, region: Region, bits: int, precision: int) -> tuple[Column, Column]:
    """(x, y) of a code's cell, rounded half to even."""
    scale = float(1 << bits)
    return (
        F.bround(x_of(z, bits) * F.lit(region.width) / F.lit(scale) + F.lit(region.left), precision),
        F.bround(y_of(z, bits) * F.lit(region.height) / F.lit(scale) + F.lit(region.bottom), precision),
    )


def prefix(z: Column, bits: int, depth: int) -> Column:
    """The cell of a code after `depth` quarterings."""
    return F.shiftright(z, 2 * (bits - depth))


def first_of(cell: Column, bits: int, depth: int) -> Column:
    """The smallest code in a cell."""
    return F.shiftleft(cell, 2 * (bits - depth))


def compatible(a: Column, depth_a: Column, b: Column, depth_b: Column) -> Column:
    """Whether one of two cells lies in the other."""
    least = F.least(depth_a, depth_b)
    up = lambda c, d: F.call_function("shiftright", c, (2 * (d - least)).cast("int"))
    return up(a, depth_a) == up(b, depth_b)


def neighbours(cell: Column, depth: int, lng_first: bool = False) -> Column:
    """The cell and those around it that lie in the region, bottom row first, left to right. lng_first: x has the higher bit of each pair."""
    x, y, side = x_of(cell, depth), y_of(cell, depth), F.lit(1 << depth)
    x, y = (y, x) if lng_first else (x, y)
    around = F.array(*[F.struct((x + dx).alias("x"), (y + dy).alias("y")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    inside = F.filter(around, lambda c: (c["x"] >= 0) & (c["y"] >= 0) & (c["x"] < side) & (c["y"] < side))
    return F.transform(inside, lambda c: interleave(c["y"], c["x"], depth) if lng_first else interleave(c["x"], c["y"], depth))


def bit_string(code: Column, length: int) -> Column:
    return F.lpad(F.bin(code), length, "0")


# Fixed value: the alphabet of base-32 geohashes.
BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def geohash_bits(lng: Column, lat: Column, bits: int = 30, lng_first: bool = False, bisect: bool = False) -> Column:
    """A geohash as a string of 2 * bits binary digits."""
    def cell(v: Column, low: float, extent: float) -> Column:
        return bisected_code(v, low, extent, bits) if bisect else axis_code(v, low, extent, bits, True)

    x, y = cell(lng, -180.0, 360.0), cell(lat, -90.0, 180.0)
    return bit_string(interleave(y, x, bits) if lng_first else interleave(x, y, bits), 2 * bits)


def geohash32(lng: Column, lat: Column, chars: int = 12) -> Column:
    """The usual geohash of an even number of characters: longitude first, five bits a character."""
    bits = chars * 5 // 2
    code = interleave(axis_code(lat, -90.0, 180.0, bits, True), axis_code(lng, -180.0, 360.0, bits, True), bits)
    return F.concat(*[F.substring(F.lit(BASE32), (F.shiftright(code, 5 * i).bitwiseAND(F.lit(31).cast("long")) + 1).cast("int"), F.lit(1)) for i in reversed(range(chars))])


def geohash32_bits(text: Column) -> Column:
    """The binary digits of a base-32 geohash."""
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.lpad(F.bin(F.instr(F.lit(BASE32), c) - 1), 5, "0")), "")


def geohash32_decode(text: Column, chars: int = 12) -> tuple[Column, Column, Column, Column]:
    """(lng, lat, lng margin, lat margin): the cell's centre and half its sides."""
    bits = chars * 5 // 2
    code = F.conv(geohash32_bits(text), 2, 10).cast("long")
    x, y, n = y_of(code, bits), x_of(code, bits), float(1 << bits)
    return (x + 0.5) * F.lit(360.0 / n) - 180.0, (y + 0.5) * F.lit(180.0 / n) - 90.0, F.lit(180.0 / n), F.lit(90.0 / n)


def geohash32_digits(text: Column, chars: int = 12) -> tuple[Column, Column]:
    """(lng, lat) as text, with the decimals that a geohash of so many characters tells, and no zeros at the end."""
    lng, lat, _, _ = geohash32_decode(text, chars)
    bits = chars * 5 // 2

    def digits(v: Column, margin: float) -> Column:
        places = max(1, round(-math.log10(margin))) - 1
        shown = F.format_string(f"%.{places}f", v)
        return F.rtrim(shown, F.lit("0")) if places else shown

    return digits(lng, 180.0 / (1 << bits)), digits(lat, 90.0 / (1 << bits))
