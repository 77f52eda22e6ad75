"""Distances and relations of points and boxes as Catalyst expressions. A Box is four columns, y first."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .region import Region


@dataclass(frozen=True)
class Box:
    bottom: Column
    up: Column
    left: Column
    right: Column

    @classmethod
    def of(cls, prefix: str = "") -> Box:
        return cls(*(F.col(prefix + n) for n in ("bottom", "up", "left", "right")))

    @classmethod
    def region(cls, r: Region) -> Box:
        return cls(*map(F.lit, (r.bottom, r.up, r.left, r.right)))


def distance2(x: Column, y: Column, qx: Column, qy: Column) -> Column:
    """Squared, without pow or sqrt, so equal on any engine."""
    return (x - qx) * (x - qx) + (y - qy) * (y - qy)


def distance(x: Column, y: Column, qx: Column, qy: Column) -> Column:
    return F.sqrt(distance2(x, y, qx, qy))


def same_integer_part(x: Column, y: Column, qx: Column, qy: Column) -> Column:
    return (x.cast("long") == qx.cast("long")) & (y.cast("long") == qy.cast("long"))


def contains(b: Box, x: Column, y: Column) -> Column:
    """Closed on all sides."""
    return y.between(b.bottom, b.up) & x.between(b.left, b.right)


def contains_half_open(b: Box, x: Column, y: Column) -> Column:
    """Without the upper and right edges."""
    return (y >= b.bottom) & (y < b.up) & (x >= b.left) & (x < b.right)


def contains_or_on_low_line(b: Box, x: Column, y: Column) -> Column:
    """Also true of every point at the height of the lower edge or below or above the left edge, wherever it is."""
    return (y == b.bottom) | (x == b.left) | ((y > b.bottom) & (y < b.up) & (x > b.left) & (x < b.right))


def covers(a: Box, b: Box) -> Column:
    return (a.bottom <= b.bottom) & (a.up >= b.up) & (a.left <= b.left) & (a.right >= b.right)


def overlaps(a: Box, b: Box) -> Column:
    return (a.bottom <= b.up) & (b.bottom <= a.up) & (a.left <= b.right) & (b.left <= a.right)


def relation(a: Box, b: Box) -> Column:
    """0: apart; 2: a covers b; 3: b covers a; 1: they meet otherwise. Edges belong to boxes."""
    return F.when(~overlaps(a, b), 0).when(covers(a, b), 2).when(covers(b, a), 3).otherwise(1)


def shared(a: Box, b: Box) -> Box:
    return Box(F.greatest(a.bottom, b.bottom), F.least(a.up, b.up), F.greatest(a.left, b.left), F.least(a.right, b.right))


def nearest2(b: Box, x: Column, y: Column) -> Column:
    """Squared distance from a point to a box, 0 inside."""
    zero = F.lit(0.0)
    dx, dy = F.greatest(b.left - x, zero, x - b.right), F.greatest(b.bottom - y, zero, y - b.up)
    return dx * dx + dy * dy


def within(b: Box, x: Column, y: Column, d: Column) -> Column:
    """Whether a box comes within distance d of a point."""
    return nearest2(b, x, y) <= d * d


def farthest2(b: Box, x: Column, y: Column) -> Column:
    dx, dy = F.greatest(F.abs(b.left - x), F.abs(b.right - x)), F.greatest(F.abs(b.bottom - y), F.abs(b.up - y))
    return dx * dx + dy * dy


def clipped(b: Box, r: Region) -> Box:
    return shared(b, Box.region(r))
