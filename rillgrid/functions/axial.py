"""Means of directions without sense: 0 and 180 degrees are one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stands for "no direction".
NONE = -1.0


def doubled(theta: Column) -> tuple[Column, Column]:
    """Sine and cosine of twice an angle in degrees."""
    return F.sin(F.radians(2 * theta)), F.cos(F.radians(2 * theta))


def half_angle(s: Column, c: Column) -> Column:
    return F.pmod(F.degrees(F.atan2(s, c)) / 2, F.lit(180.0))


def axial_mean(theta: Column, weight: Column | None = None, *, negative: str = "wrap", tolerance: float = 1e-9) -> Column:
    """Aggregate: the axial mean in [0, 180), or -1 where there is none.

    ``negative`` says what a negative angle is: ``wrap`` takes it modulo 180, so the mark -1
    counts as 179; ``skip`` leaves it out, with non-positive weights. The mean is -1
    without positive weight, and where the doubled directions cancel to within
    ``tolerance`` of the whole weight.
    """
    w = F.lit(1.0) if weight is None else weight
    if negative == "skip":
        w = F.when((w > 0) & (theta >= 0), w)
        angle = theta
    elif negative == "wrap":
        w = F.when(theta.isNotNull(), w)
        angle = F.pmod(theta, F.lit(180.0))
    else:
        raise ValueError("negative is 'wrap' or 'skip'")
    s, c = (F.sum(w * x) for x in doubled(angle))
    total = F.sum(w)
    flat = (F.abs(s) <= tolerance * total) & (F.abs(c) <= tolerance * total)
    return F.when(total.isNull() | (total <= 0) | flat, F.lit(NONE)).otherwise(half_angle(s, c))
