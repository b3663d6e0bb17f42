"""Map projections as Column arithmetic (after Snyder, Map Projections: A Working Manual, 1987).

A projection's constants are computed once on the driver; what remains is plain
arithmetic inside whole-stage code. Ellipsoidal inverses use the latitude series,
which stay well below a metre.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Semi-axes in metres. Fixed values.
ELLIPSOIDS = {
    "sphere": (6370997.0, 6370997.0),
    "wrf": (6370000.0, 6370000.0),
    "WGS84": (6378137.0, 6356752.314245179),
    "GRS80": (6378137.0, 6356752.314140356),
    "clrk66": (6378206.4, 6356583.8),
    "WGS72": (6378135.0, 6356750.52),
    "bessel": (6377397.155, 6356078.9628181886),
    "intl": (6378388.0, 6356911.9461279465),
}
#: Named semi-axes in metres, to a tenth, and radii of spheres. Fixed values.
NAMED_ELLIPSOIDS = {
    "airy_1830": (6377563.4, 6356256.9),
    "modified_airy": (6377340.2, 6356034.4),
    "andrae_1876": (6377104.4, 6355847.4),
    "applied_physics_1965": (6378137.0, 6356751.8),
    "australian_natl_sa_1969": (6378160.0, 6356774.7),
    "bessel_1841": (6377397.2, 6356079.0),
    "bessel_namibia_1841": (6377483.9, 6356165.4),
    "clarke_1866": (6378206.4, 6356583.8),
    "clarke_1880": (6378249.1, 6356515.0),
    "comm_des_poids_et_mesures_1799": (6375738.7, 6356666.2),
    "delambre_1810_belgium": (6376428.0, 6355957.9),
    "engelis_1985": (6378136.1, 6356751.3),
    "everest_1830": (6377276.3, 6356075.4),
    "everest_1948": (6377304.1, 6356103.0),
    "everest_1956": (6377301.2, 6356100.2),
    "everest_1969": (6377295.7, 6356094.7),
    "everest_sabah_sarawak": (6377298.6, 6356097.6),
    "fischer_mercury_datum_1960": (6378166.0, 6356784.3),
    "modified_fischer_1960": (6378155.0, 6356773.3),
    "fischer_1968": (6378150.0, 6356768.3),
    "grs_iugg_1967": (6378160.0, 6352363.3),
    "grs_iugg_1980": (6378137.0, 6356752.3),
    "helmert_1906": (6378200.0, 6356818.2),
    "hough": (6378270.0, 6356794.3),
    "iau_1976": (6378140.0, 6356755.3),
    "intl_hayford_1909": (6378388.0, 6356911.9),
    "krassovsky_1942": (6378245.0, 6356863.0),
    "kaula_1961": (6378163.0, 6356777.0),
    "lerch_1979": (6378139.0, 6356754.3),
    "maupertius_1738": (6397300.0, 6363806.3),
    "merit_1983": (6378137.0, 6356752.3),
    "naval_weapons_lab_1965": (6378145.0, 6356759.8),
    "new_international_1967": (6378157.5, 6356772.2),
    "plessis_1817": (6376523.0, 6355863.0),
    "sgs_1985": (6378136.0, 6356751.3),
    "southeast_asia": (6378155.0, 6356773.0),
    "walbeck": (6376896.0, 6355835.0),
    "wgs_1960": (6378165.0, 6356783.3),
    "wgs_1966": (6378145.0, 6356759.8),
    "wgs_1972": (6378135.0, 6356750.5),
    "wgs_1984": (6378137.0, 6356752.3),
    "mars": (3394500.0, 3376400.0),
    "mm5": (6370997.0, 6370997.0),
    "mcidas": (6371230.0, 6371230.0),
    "moon": (1738000.0, 1738000.0),
    "venus": (6051000.0, 6051000.0),
}


def ellipsoid(name: str) -> tuple[float, float]:
    """The semi-axes of a name of either table."""
    return ELLIPSOIDS[name] if name in ELLIPSOIDS else NAMED_ELLIPSOIDS[name.lower()]


_HALF_PI, _QUARTER_PI = math.pi / 2, math.pi / 4


def wrap(degrees: Column) -> Column:
    """Longitude in -180 to 180."""
    return degrees - 360.0 * F.floor((degrees + 180.0) / 360.0)


def signed(lon: Column) -> Column:
    """0-360 longitudes as -180 to 180."""
    return F.when(lon > 180.0, lon - 360.0).otherwise(lon)


@dataclass(frozen=True)
class LonLat:
    """Degrees as they are."""

    def project(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        return lon.cast("double"), lat.cast("double")

    def unproject(self, x: Column, y: Column) -> tuple[Column, Column]:
        return x.cast("double"), y.cast("double")


@dataclass(frozen=True)
class _OnEllipsoid:
    major: float = ELLIPSOIDS["sphere"][0]
    minor: float = ELLIPSOIDS["sphere"][1]
    centre_lon: float = 0.0
    centre_lat: float = 0.0

    def __post_init__(self):
        if not self.major >= self.minor > 0:
            raise ValueError("the major semi-axis must be at least the minor")

    @cached_property
    def e(self) -> float:
        return math.sqrt(1 - (self.minor / self.major) ** 2)

    def _t(self, lat: float) -> float:
        s = self.e * math.sin(lat)
        return math.tan(_QUARTER_PI - lat / 2) / ((1 - s) / (1 + s)) ** (self.e / 2)

    def _m(self, lat: float) -> float:
        return math.cos(lat) / math.sqrt(1 - (self.e * math.sin(lat)) ** 2)

    def _t_col(self, lat: Column) -> Column:
        t = F.tan(F.lit(_QUARTER_PI) - lat / 2)
        if not self.e:
            return t
        s = F.sin(lat) * self.e
        return t / F.pow((1 - s) / (1 + s), F.lit(self.e / 2))

    def _lat_of_t(self, t: Column) -> Column:
        """Latitude of which t is the isometric tangent."""
        lat = _HALF_PI - 2 * F.atan(t)
        # the conformal latitude's series in place of iteration: columns would double with every step
        if not self.e:
            return lat
        e2 = self.e**2
        a = e2 / 2 + 5 * e2**2 / 24 + e2**3 / 12 + 13 * e2**4 / 360
        b = 7 * e2**2 / 48 + 29 * e2**3 / 240 + 811 * e2**4 / 11520
        c = 7 * e2**3 / 120 + 81 * e2**4 / 1120
        d = 4279 * e2**4 / 161280
        return lat + a * F.sin(2 * lat) + b * F.sin(4 * lat) + c * F.sin(6 * lat) + d * F.sin(8 * lat)

    def _from_centre(self, lon: Column) -> Column:
        return F.radians(wrap(lon - self.centre_lon))


@dataclass(frozen=True)
class Mercator(_OnEllipsoid):
    def project(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        return self._from_centre(lon) * self.major, -F.log(self._t_col(F.radians(lat))) * self.major

    def unproject(self, x: Column, y: Column) -> tuple[Column, Column]:
        return wrap(F.degrees(x / self.major) + self.centre_lon), F.degrees(self._lat_of_t(F.exp(-y / self.major)))


@dataclass(frozen=True)
class Lambert(_OnEllipsoid):
    """Conformal conic with two standard parallels, or one twice."""

    lat1: float = 30.0
    lat2: float = 60.0

    @cached_property
    def constants(self) -> tuple[float, float, float]:
        p1, p2, p0 = (math.radians(x) for x in (self.lat1, self.lat2, self.centre_lat))
        m1, t1 = self._m(p1), self._t(p1)
        n = math.sin(p1) if abs(p1 - p2) < 1e-10 else math.log(m1 / self._m(p2)) / math.log(t1 / self._t(p2))
        f = self.major * m1 / (n * t1**n)
        return n, f, f * self._t(p0) ** n

    def project(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        n, f, rho0 = self.constants
        rho = F.pow(self._t_col(F.radians(lat)), F.lit(n)) * f
        theta = self._from_centre(lon) * n
        return rho * F.sin(theta), rho0 - rho * F.cos(theta)

    def unproject(self, x: Column, y: Column) -> tuple[Column, Column]:
        n, f, rho0 = self.constants
        sign = math.copysign(1.0, n)
        dy = rho0 - y
        rho = F.sqrt(x * x + dy * dy) * sign
        t = F.pow(rho / f, F.lit(1 / n))
        return wrap(F.degrees(F.atan2(x * sign, dy * sign) / n) + self.centre_lon), F.degrees(self._lat_of_t(t))


@dataclass(frozen=True)
class Albers(_OnEllipsoid):
    """Equal-area conic."""

    lat1: float = 30.0
    lat2: float = 60.0

    def _q(self, lat: float) -> float:
        s, e = math.sin(lat), self.e
        if not e:
            return 2 * s
        return (1 - e * e) * (s / (1 - (e * s) ** 2) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))

    def _q_col(self, lat: Column) -> Column:
        s, e = F.sin(lat), self.e
        if not e:
            return s * 2
        es = s * e
        return (s / (1 - es * es) - F.log((1 - es) / (1 + es)) / (2 * e)) * (1 - e * e)

    @cached_property
    def constants(self) -> tuple[float, float, float]:
        p1, p2, p0 = (math.radians(x) for x in (self.lat1, self.lat2, self.centre_lat))
        m1, m2, q1, q2 = self._m(p1), self._m(p2), self._q(p1), self._q(p2)
        n = math.sin(p1) if abs(p1 - p2) < 1e-10 else (m1 * m1 - m2 * m2) / (q2 - q1)
        c = m1 * m1 + n * q1
        return n, c, self.major / n * math.sqrt(c - n * self._q(p0))

    def project(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        n, c, rho0 = self.constants
        rho = F.sqrt(F.greatest(F.lit(0.0), c - self._q_col(F.radians(lat)) * n)) * (self.major / n)
        theta = self._from_centre(lon) * n
        return rho * F.sin(theta), rho0 - rho * F.cos(theta)

    def unproject(self, x: Column, y: Column) -> tuple[Column, Column]:
        n, c, rho0 = self.constants
        sign = math.copysign(1.0, n)
        dy = rho0 - y
        q = (c - (x * x + dy * dy) * (n / self.major) ** 2) / n
        beta = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), q / self._q(_HALF_PI))))
        e2 = self.e**2
        lat = beta
        if self.e:
            lat = beta + (e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040) * F.sin(2 * beta) + (23 * e2**2 / 360 + 251 * e2**3 / 3780) * F.sin(4 * beta) + 761 * e2**3 / 45360 * F.sin(6 * beta)
        return wrap(F.degrees(F.atan2(x * sign, dy * sign) / n) + self.centre_lon), F.degrees(lat)


@dataclass(frozen=True)
class Stereographic(_OnEllipsoid):
    """Polar, about the pole of secant_lat's sign, true to scale at secant_lat."""

    secant_lat: float = 90.0

    @cached_property
    def constants(self) -> tuple[float, float]:
        pole = math.copysign(1.0, self.secant_lat)
        p = math.radians(abs(self.secant_lat))
        if abs(p - _HALF_PI) < 1e-10:
            e = self.e
            return pole, 2 * self.major / math.sqrt((1 + e) ** (1 + e) * (1 - e) ** (1 - e))
        return pole, self.major * self._m(p) / self._t(p)

    def project(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        pole, k = self.constants
        rho = self._t_col(F.radians(lat) * pole) * k
        theta = self._from_centre(lon) * pole
        return rho * F.sin(theta) * pole, -rho * F.cos(theta) * pole

    def unproject(self, x: Column, y: Column) -> tuple[Column, Column]:
        pole, k = self.constants
        t = F.sqrt(x * x + y * y) / k
        return wrap(F.degrees(F.atan2(x * pole, -y * pole) * pole) + self.centre_lon), F.degrees(self._lat_of_t(t)) * pole
