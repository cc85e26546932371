"""Pixel places to map coordinates, and directions of steps between pixels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def pixel_to_xy(transform: Sequence[Column | float], row: Column, col: Column) -> tuple[Column, Column]:
    """Centre of a pixel under the affine ``(a, b, c, d, e, f)``."""
    a, b, c, d, e, f = (x if isinstance(x, Column) else F.lit(float(x)) for x in transform)
    return c + (col + 0.5) * a + (row + 0.5) * b, f + (col + 0.5) * d + (row + 0.5) * e


def step_orientation(d_row: Column, d_col: Column) -> Column:
    """Axial direction of a step in pixel space, degrees in [0, 180); rows point down."""
    return F.pmod(F.degrees(F.atan2(d_row.cast("double"), d_col.cast("double"))), F.lit(180.0))
