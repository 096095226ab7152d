"""Numeric helpers that stay safe under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_double(c: Column | str) -> Column:
    """String to double, unparsable to NULL (F9; the graph store's ``toFloat``)."""
    c = F.col(c) if isinstance(c, str) else c
    return c.try_cast("double")


def std_floor(std: Column, floor: float = 1.0) -> Column:
    """Sample std with one point read as 0.0, floored."""
    return F.greatest(F.coalesce(std, F.lit(0.0)), F.lit(float(floor)))


def fmt2(c: Column) -> Column:
    """Two-decimal text (F14); ``format_number`` would add grouping commas."""
    return F.format_string("%.2f", c)
