"""Rounding, clamping and coercion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def round_half_even(x: Column) -> Column:
    """Nearest integer, halves to the even one."""
    return F.bround(x, 0).cast("long")


def round16(n: Column) -> Column:
    """The multiple of 16 at or below ``n``, 16 at least: a tile size of a raster file."""
    return F.greatest(F.lit(16), F.floor(n / 16) * 16).cast("long")


def as_float(x: Column) -> Column:
    """A number, or 0 where there is none."""
    return F.coalesce(x.try_cast("double"), F.lit(0.0))


def as_int(x: Column) -> Column:
    """A number rounded half to even, or null."""
    return round_half_even(x.try_cast("double"))


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, 0 where ``b`` is not positive."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0)).cast("double")


def fmt6(x: Column) -> Column:
    return F.format_string("%.6f", x.cast("double"))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def pixel_size(a: Column, e: Column) -> Column:
    return F.struct(F.abs(a).alias("width"), F.abs(e).alias("height"))


def step_length(a: Column, e: Column, default: float = 0.5) -> Column:
    """The pixel size if pixels are square within one part in a million, else ``default``."""
    width, height = F.abs(a), F.abs(e)
    square = (width > 0) & (height > 0) & (F.abs(width - height) / F.greatest(width, height) < 1e-6)
    return F.when(square, (width + height) / 2).otherwise(F.lit(default))
