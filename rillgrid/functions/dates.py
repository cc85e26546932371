"""How near a date lies to the yearly peak of exposure."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The peak's month and day, and the spread in days.
PEAK, SIGMA = (7, 15), 25.0


def try_date(x: Column) -> Column:
    """A date from a date, timestamp or text; null where it is none."""
    return F.coalesce(x.try_cast("date"), F.to_date(x.try_cast("timestamp")))


def peak_for_year(date: Column, month: int = PEAK[0], day: int = PEAK[1], mode: str = "nominal") -> Column:
    """The peak in the year of ``date``.

    ``nominal`` clamps the day to the month's length; ``first_of_month`` is the first of
    the month whatever the day, which is what an off-by-one in published results used.
    """
    first = F.make_date(F.year(date), F.lit(month), F.lit(1))
    if mode == "first_of_month":
        return first
    if mode != "nominal":
        raise ValueError("mode is 'nominal' or 'first_of_month'")
    return F.make_date(F.year(date), F.lit(month), F.least(F.lit(day), F.day(F.last_day(first))))


def delta_days(date: Column, month: int = PEAK[0], day: int = PEAK[1], mode: str = "nominal", circular: bool = False) -> Column:
    """Days between a date and its year's peak; null dates give null.

    ``circular`` measures around the year, by day of year and the length of that year.
    """
    peak = peak_for_year(date, month, day, mode)
    if not circular:
        return F.abs(F.datediff(date, peak))
    length = F.dayofyear(F.make_date(F.year(date), F.lit(12), F.lit(31)))
    apart = F.abs(F.dayofyear(date) - F.dayofyear(peak))
    return F.least(apart, length - apart)


def gauss(days: Column, sigma: float = SIGMA) -> Column:
    """exp(-(days / sigma)**2 / 2)."""
    if sigma <= 0:
        raise ValueError("sigma must be positive")
    return F.exp(F.lit(-0.5) * F.pow(days / F.lit(float(sigma)), F.lit(2.0)))


def exposure(date: Column, sigma: float = SIGMA, **peak) -> Column:
    """The Gaussian weight of a date; null without a date."""
    return gauss(delta_days(date, **peak).cast("double"), sigma)
