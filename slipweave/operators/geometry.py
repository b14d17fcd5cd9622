"""Box geometry as column expressions; inputs are non-null doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import strip

TINY = 1e-6


def y_center(y1: Column, y2: Column) -> Column:
    return (y1 + y2) / F.lit(2.0)


def height(y1: Column, y2: Column) -> Column:
    return F.greatest(y2 - y1, F.lit(TINY))


def char_width(text: Column, x1: Column, x2: Column) -> Column:
    """Box width over stripped length in code points, both floored."""
    return F.greatest(x2 - x1, F.lit(TINY)) / F.greatest(F.length(strip(text)), F.lit(1))


def overlap_ratio(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Shared span over the shorter span; 0 when either is not positive."""
    shared = F.least(a2, b2) - F.greatest(a1, b1)
    shorter = F.least(a2 - a1, b2 - b1)
    return F.when((shared > 0) & (shorter > 0), F.try_divide(shared, shorter)).otherwise(F.lit(0.0))
