"""Ellipsoidal map projections of columns or, with ``m=Arrays``, of numpy arrays (Snyder 1987).

The datum shift between NAD83 and WGS84 is left out: both are taken as one ellipsoid.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class Arrays:
    """The functions of columns that projections use, for arrays."""

    lit, sin, cos, tan, asin, atan, atan2 = float, np.sin, np.cos, np.tan, np.arcsin, np.arctan, np.arctan2
    sqrt, log, pow, radians, degrees, least, greatest = np.sqrt, np.log, np.power, np.radians, np.degrees, np.minimum, np.maximum


@dataclass(frozen=True)
class Albers:
    """Albers equal-area conic; the defaults are EPSG:3338."""

    lat1: float = 55.0
    lat2: float = 65.0
    lat0: float = 50.0
    lon0: float = -154.0
    a: float = 6378137.0
    f: float = 1 / 298.257222101

    def _constants(self) -> tuple[float, float, float, float]:
        e2 = self.f * (2 - self.f)
        e = math.sqrt(e2)

        def m(p):
            return math.cos(p) / math.sqrt(1 - e2 * math.sin(p) ** 2)

        def q(p):
            s = math.sin(p)
            return (1 - e2) * (s / (1 - e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))

        p1, p2, p0 = (math.radians(x) for x in (self.lat1, self.lat2, self.lat0))
        n = (m(p1) ** 2 - m(p2) ** 2) / (q(p2) - q(p1))
        c = m(p1) ** 2 + n * q(p1)
        return n, c, self.a * math.sqrt(c - n * q(p0)) / n, e

    def forward(self, lon: Column, lat: Column, m=F) -> tuple[Column, Column]:
        n, c, rho0, e = self._constants()
        e2, s = e * e, m.sin(m.radians(lat))
        q = m.lit(1 - e2) * (s / (1 - e2 * s * s) - m.log((1 - e * s) / (1 + e * s)) / m.lit(2 * e))
        rho = m.lit(self.a / n) * m.sqrt(m.lit(c) - m.lit(n) * q)
        theta = m.radians(lon - m.lit(self.lon0)) * m.lit(n)
        return rho * m.sin(theta), m.lit(rho0) - rho * m.cos(theta)

    def inverse(self, x: Column, y: Column, m=F) -> tuple[Column, Column]:
        n, c, rho0, e = self._constants()
        e2 = e * e
        rho = m.sqrt(x * x + (m.lit(rho0) - y) * (m.lit(rho0) - y))
        theta = m.atan2(x, m.lit(rho0) - y)
        q = (m.lit(c) - rho * rho * m.lit(n * n / self.a**2)) / m.lit(n)
        qp = 1 - (1 - e2) / (2 * e) * math.log((1 - e) / (1 + e))
        beta = m.asin(m.greatest(m.lit(-1.0), m.least(m.lit(1.0), q / m.lit(qp))))
        e4, e6 = e2 * e2, e2**3
        lat = (
            beta
            + m.lit(e2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) * m.sin(2 * beta)
            + m.lit(23 * e4 / 360 + 251 * e6 / 3780) * m.sin(4 * beta)
            + m.lit(761 * e6 / 45360) * m.sin(6 * beta)
        )
        return m.lit(self.lon0) + m.degrees(theta / m.lit(n)), m.degrees(lat)


@dataclass(frozen=True)
class PolarStereographic:
    """North polar stereographic with a true-scale parallel; the defaults are EPSG:3413."""

    lat_ts: float = 70.0
    lon0: float = -45.0
    a: float = 6378137.0
    f: float = 1 / 298.257223563

    def _constants(self) -> tuple[float, float, float]:
        e2 = self.f * (2 - self.f)
        e, p = math.sqrt(e2), math.radians(self.lat_ts)
        t = math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)
        m = math.cos(p) / math.sqrt(1 - e2 * math.sin(p) ** 2)
        return e, t, m

    def forward(self, lon: Column, lat: Column, m=F) -> tuple[Column, Column]:
        e, tc, mc = self._constants()
        p = m.radians(lat)
        t = m.tan(m.lit(math.pi / 4) - p / 2) / m.pow((1 - e * m.sin(p)) / (1 + e * m.sin(p)), m.lit(e / 2))
        rho = m.lit(self.a * mc / tc) * t
        d = m.radians(lon - m.lit(self.lon0))
        return rho * m.sin(d), -rho * m.cos(d)

    def inverse(self, x: Column, y: Column, m=F) -> tuple[Column, Column]:
        e, tc, mc = self._constants()
        t = m.sqrt(x * x + y * y) * m.lit(tc / (self.a * mc))
        chi = m.lit(math.pi / 2) - 2 * m.atan(t)
        e2, e4, e6 = e**2, e**4, e**6
        lat = (
            chi
            + m.lit(e2 / 2 + 5 * e4 / 24 + e6 / 12) * m.sin(2 * chi)
            + m.lit(7 * e4 / 48 + 29 * e6 / 240) * m.sin(4 * chi)
            + m.lit(7 * e6 / 120) * m.sin(6 * chi)
        )
        return m.lit(self.lon0) + m.degrees(m.atan2(x, -y)), m.degrees(lat)


class Geographic:
    """Degrees as they are: EPSG:4326."""

    def forward(self, lon: Column, lat: Column, m=F) -> tuple[Column, Column]:
        return lon, lat

    inverse = forward


SYSTEMS = {3338: Albers(), 3413: PolarStereographic(), 4326: Geographic()}
#: Units in which each system measures.
UNITS = {3338: "metre", 3413: "metre", 4326: "degree"}


def reproject(x: Column, y: Column, source: int, target: int, m=F) -> tuple[Column, Column]:
    if source == target:
        return x, y
    return SYSTEMS[target].forward(*SYSTEMS[source].inverse(x, y, m), m)
