"""Regions and what follows from their size."""

from __future__ import annotations

import math
from dataclasses import dataclass


@dataclass(frozen=True)
class Region:
    """A box, y first: bottom, up, left, right."""

    bottom: float
    up: float
    left: float
    right: float

    @property
    def height(self) -> float:
        return self.up - self.bottom

    @property
    def width(self) -> float:
        return self.right - self.left

    def bits(self, precision: int) -> int:
        """Bits per axis at which a cell is finer than a tenth of a unit of the last decimal."""
        return math.ceil(math.log2(min(self.height, self.width) * 10 ** (precision + 1)))

    def max_depth(self, precision: int) -> int:
        """Quarterings after which a cell's side is below a unit of the last decimal."""
        return math.ceil(math.log2(min(self.height, self.width) * 10**precision))

    def shrunk(self, precision: int) -> Region:
        """Without the upper and right edges, by a tenth of a unit of the last decimal."""
        step = 10.0 ** -(precision + 1)
        return Region(self.bottom, self.up - step, self.left, self.right - step)

    def grown(self, precision: int) -> Region:
        step = 10.0 ** -(precision + 1)
        return Region(self.bottom, self.up + step, self.left, self.right + step)

    def quarters(self) -> list[Region]:
        """Lower left, lower right, upper left, upper right: the order of their Z codes."""
        y, x = (self.bottom + self.up) / 2, (self.left + self.right) / 2
        return [Region(self.bottom, y, self.left, x), Region(self.bottom, y, x, self.right), Region(y, self.up, self.left, x), Region(y, self.up, x, self.right)]


UNIT = Region(0.0, 1.0, 0.0, 1.0)
