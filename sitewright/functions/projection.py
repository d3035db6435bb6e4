"""Map projections and grid references: Column expressions, and Arrow functions where iteration needs numpy."""

from __future__ import annotations

from math import degrees, radians

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitewright.functions.geometry import C, _c

# The ellipsoid of GRS80 and the National Grid's projection.
GRS80_A = 6378137.0
GRS80_B = 6356752.314140356
GRID_SCALE = 0.9996012717
GRID_LAT0 = radians(49.0)
GRID_LON0 = radians(-2.0)
GRID_E0 = 400_000.0
GRID_N0 = -100_000.0
# The lettering of grid squares and of UTM latitude bands.
GRID_LETTERS = "ABCDEFGHJKLMNOPQRSTUVWXYZ"
BAND_LETTERS = "CDEFGHJKLMNPQRSTUVWX"

_E2 = (GRS80_A**2 - GRS80_B**2) / GRS80_A**2
_N = (GRS80_A - GRS80_B) / (GRS80_A + GRS80_B)


class _ColumnMath:
    sin, cos, tan, sqrt = staticmethod(F.sin), staticmethod(F.cos), staticmethod(F.tan), staticmethod(F.sqrt)


def _arc(lat, m):  # noqa: ANN001, ANN202
    """Meridian distance from the true origin, for columns or arrays (``m`` has sin, cos, tan, sqrt)."""
    d, s = lat - GRID_LAT0, lat + GRID_LAT0
    n1, n2, n3 = _N, _N**2, _N**3
    terms = (
        (1 + n1 + 5 / 4 * (n2 + n3)) * d
        - (3 * (n1 + n2) + 21 / 8 * n3) * m.sin(d) * m.cos(s)
        + 15 / 8 * (n2 + n3) * m.sin(2 * d) * m.cos(2 * s)
        - 35 / 24 * n3 * m.sin(3 * d) * m.cos(3 * s)
    )
    return GRS80_B * GRID_SCALE * terms


def _radii(lat, m):  # noqa: ANN001, ANN202
    w = 1 - _E2 * m.sin(lat) * m.sin(lat)
    nu = GRS80_A * GRID_SCALE / m.sqrt(w)
    rho = GRS80_A * GRID_SCALE * (1 - _E2) / (w * m.sqrt(w))
    return nu, rho, nu / rho - 1


def _forward(lat, dl, m):  # noqa: ANN001, ANN202
    nu, rho, eta = _radii(lat, m)
    s, c, t2 = m.sin(lat), m.cos(lat), m.tan(lat) * m.tan(lat)
    c3, c5, d2 = c * c * c, c * c * c * c * c, dl * dl
    north = _arc(lat, m) + GRID_N0 + d2 * (
        nu / 2 * s * c + d2 * (nu / 24 * s * c3 * (5 - t2 + 9 * eta) + d2 * (nu / 720 * s * c5 * (61 - 58 * t2 + t2 * t2)))
    )
    east = GRID_E0 + dl * (nu * c + d2 * (nu / 6 * c3 * (nu / rho - t2) + d2 * (nu / 120 * c5 * (5 - 18 * t2 + t2 * t2 + 14 * eta - 58 * t2 * eta))))
    return east, north


def tm_forward(lat: C, lon: C) -> Column:
    """struct<e, n>: degrees to metres on the grid's projection, without datum shift."""
    east, north = _forward(F.radians(_c(lat)), F.radians(_c(lon)) - GRID_LON0, _ColumnMath)
    return F.struct(east.alias("e"), north.alias("n"))


def tm_forward_array(lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _forward(np.radians(lat), np.radians(lon) - GRID_LON0, np)


def tm_inverse_array(east: np.ndarray, north: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Latitude and longitude in degrees; the footpoint latitude is found by iteration."""
    lat = (north - GRID_N0) / (GRS80_A * GRID_SCALE) + GRID_LAT0
    for _ in range(10):
        rest = north - GRID_N0 - _arc(lat, np)
        if np.all(np.abs(rest) < 1e-5):
            break
        lat = lat + np.where(np.abs(rest) < 1e-5, 0, rest) / (GRS80_A * GRID_SCALE)
    nu, rho, eta = _radii(lat, np)
    t, sec, d = np.tan(lat), 1 / np.cos(lat), east - GRID_E0
    t2, d2 = t * t, d * d
    out_lat = lat - d2 * t / rho * (1 / (2 * nu) - d2 * ((5 + 3 * t2 + eta - 9 * t2 * eta) / (24 * nu**3) - d2 * (61 + 90 * t2 + 45 * t2 * t2) / (720 * nu**5)))
    series = (1 / nu, -(nu / rho + 2 * t2) / (6 * nu**3), (5 + 28 * t2 + 24 * t2 * t2) / (120 * nu**5), -(61 + 662 * t2 + 1320 * t2**2 + 720 * t2**3) / (5040 * nu**7))
    out_lon = GRID_LON0 + sec * sum(k * d ** (2 * i + 1) for i, k in enumerate(series))
    return np.degrees(out_lat), np.degrees(out_lon)


@F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in ("lat", "lon")]))
def tm_inverse(east: pd.Series, north: pd.Series) -> pd.DataFrame:
    lat, lon = tm_inverse_array(east.to_numpy(float), north.to_numpy(float))
    return pd.DataFrame({"lat": lat, "lon": lon})


class ShiftGrid:
    """A datum's shifts at the nodes of a 1 km grid, for bilinear interpolation; NaN where it does not reach."""

    def __init__(self, de: np.ndarray, dn: np.ndarray, spacing: float = 1000.0):
        self.de, self.dn, self.spacing = de, dn, spacing

    def at(self, east: np.ndarray, north: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows, columns = self.de.shape
        x, y = east / self.spacing, north / self.spacing
        i, j = np.floor(x), np.floor(y)
        good = (i >= 0) & (j >= 0) & (i < columns - 1) & (j < rows - 1)
        i, j = np.where(good, i, 0).astype(int), np.where(good, j, 0).astype(int)
        u, v = x - i, y - j
        mean = lambda g: g[j, i] * (1 - u) * (1 - v) + g[j, i + 1] * u * (1 - v) + g[j + 1, i] * (1 - u) * v + g[j + 1, i + 1] * u * v
        return np.where(good, mean(self.de), np.nan), np.where(good, mean(self.dn), np.nan)

    def to_grid(self, lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        e, n = tm_forward_array(lat, lon)
        de, dn = self.at(e, n)
        return e + de, n + dn

    def extent(self, west: float, south: float, east: float, north: float, pad: float) -> tuple[float, float, float, float]:
        """A box in degrees as a padded rectangle in metres; where the shifts do not reach a corner, without them."""
        lat, lon = np.array([south, south, north, north]), np.array([west, east, west, east])
        e, n = self.to_grid(lat, lon)
        if np.isnan(e).any():
            e, n = tm_forward_array(lat, lon)
        return float(e.min() - pad), float(n.min() - pad), float(e.max() + pad), float(n.max() + pad)

    def from_grid(self, east: np.ndarray, north: np.ndarray, tolerance: float = 1e-4, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
        """Degrees of grid metres: the shift is looked up again where it led until it stays."""
        e, n = east, north
        for _ in range(rounds):
            de, dn = self.at(e, n)
            new_e, new_n = east - de, north - dn
            moved = np.hypot(new_e - e, new_n - n)
            e, n = new_e, new_n
            if np.nanmax(moved, initial=0.0) < tolerance:
                break
        return tm_inverse_array(e, n)


def grid_udf(shifts: ShiftGrid):  # noqa: ANN201
    """Column function (lat, lon) -> struct<e, n> through a datum's shift grid; null where it does not reach."""

    @F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in ("e", "n")]))
    def project(lat: pd.Series, lon: pd.Series) -> pd.DataFrame:
        e, n = shifts.to_grid(lat.to_numpy(float), lon.to_numpy(float))
        return pd.DataFrame({"e": e, "n": n})

    return project


def utm_zone(lat: C, lon: C) -> Column:
    """Zone number and latitude band, with the exceptions of south-west Norway and Svalbard."""
    la, lo = _c(lat), _c(lon)
    good = (la >= -80) & (la < 80) & (lo >= -180) & (lo < 180)
    band = F.substring(F.lit(BAND_LETTERS), F.floor(la / 8 + 10).cast("int") + 1, F.lit(1))
    plain = F.floor((lo + 180) / 6 + 1).cast("int")
    zone = F.when((plain == 31) & (band == "V") & (lo >= 3), 32)
    for odd, middle in ((32, 9), (34, 21), (36, 33)):
        zone = zone.when((plain == odd) & (band == "X"), F.when(lo < middle, odd - 1).otherwise(odd + 1))
    named = F.concat(zone.otherwise(plain).cast("string"), band)
    return F.when(good, named).otherwise(F.raise_error(F.lit("outside the bands of UTM")).cast("string"))


# UTM on WGS84.
UTM_A = 6378137.0
UTM_F = 1 / 298.257223563
UTM_SCALE = 0.9996


def _utm_series() -> tuple[float, list[float], list[float]]:
    """Rectifying radius and the coefficients of Krueger's series in the third flattening, to its fourth power."""
    n = UTM_F / (2 - UTM_F)
    radius = UTM_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    to = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    back = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
    return radius, to, back


def utm_project(lat: C, lon: C, zone: C) -> Column:
    """struct<e, n> in a zone such as 30U; within a millimetre of the exact projection inside the zone."""
    radius, series, _ = _utm_series()
    name = _c(zone)
    centre = F.regexp_extract(name, r"^(\d+)", 1).cast("int") * 6 - 183
    south = F.substring(name, -1, 1) < "N"
    phi, dl = F.radians(_c(lat)), F.radians(_c(lon) - centre)
    e = (UTM_F * (2 - UTM_F)) ** 0.5
    tau = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(tau, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(1 + tau * tau))
    x, y = eta, xi
    for k, a in enumerate(series, 1):
        x = x + a * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
        y = y + a * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
    north = UTM_SCALE * radius * y
    return F.struct((500_000 + UTM_SCALE * radius * x).alias("e"), F.when(south, north + 10_000_000).otherwise(north).alias("n"))


def utm_unproject_array(east: np.ndarray, north: np.ndarray, zone: str) -> tuple[np.ndarray, np.ndarray]:
    """Degrees of metres in a zone."""
    radius, _, series = _utm_series()
    n0 = 10_000_000 if zone[-1] < "N" else 0
    xi, eta = (north - n0) / (UTM_SCALE * radius), (east - 500_000) / (UTM_SCALE * radius)
    x, y = xi, eta
    for k, b in enumerate(series, 1):
        x = x - b * np.sin(2 * k * xi) * np.cosh(2 * k * eta)
        y = y - b * np.cos(2 * k * xi) * np.sinh(2 * k * eta)
    chi = np.arcsin(np.sin(x) / np.cosh(y))
    e = (UTM_F * (2 - UTM_F)) ** 0.5
    phi = chi
    for _ in range(8):
        phi = np.arcsin(np.tanh(np.arctanh(np.sin(chi)) + e * np.arctanh(e * np.sin(phi))))
    return np.degrees(phi), degrees(radians(int(zone[:-1]) * 6 - 183)) + np.degrees(np.arctan2(np.sinh(y), np.cos(x)))


def _letter(row: Column, column: Column) -> Column:
    return F.substring(F.lit(GRID_LETTERS), (row * 5 + column + 1).cast("int"), F.lit(1))


def grid_square(east: C, north: C) -> Column:
    """Two letters of the 100 km square; an error outside the grid's envelope."""
    e, n = _c(east), _c(north)
    good = (e >= 0) & (e < 700_000) & (n >= 0) & (n < 1_300_000)
    large = _letter(3 - F.floor(n / 500_000), F.floor(e / 500_000) + 2)
    small = _letter(4 - F.pmod(F.floor(n / 100_000), F.lit(5)), F.pmod(F.floor(e / 100_000), F.lit(5)))
    return F.when(good, F.concat(large, small)).otherwise(F.raise_error(F.lit("outside the National Grid")).cast("string"))


def grid_cell(east: C, north: C) -> Column:
    """The 10 km cell: the square's letters and a digit each way."""
    digit = lambda v: F.pmod(F.floor(_c(v) / 10_000), F.lit(10)).cast("string")
    return F.concat(grid_square(east, north), digit(east), digit(north))


def _clamped(low: Column, high: Column, size: int, most: int) -> Column:
    last = (most // size) - 1
    at = lambda v: F.greatest(F.lit(0), F.least(F.lit(last), F.floor(v / size)))
    return F.sequence(at(low), at(high))


def squares_of(box: Column) -> Column:
    """Sorted names of the 100 km squares that a rectangle touches, clamped to the grid."""
    xs, ys = _clamped(box["x0"], box["x1"], 100_000, 700_000), _clamped(box["y0"], box["y1"], 100_000, 1_300_000)
    return F.array_sort(F.array_distinct(F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: grid_square(x * 100_000, y * 100_000))))))


def cells_of(box: Column) -> Column:
    """The same for 10 km cells."""
    xs, ys = _clamped(box["x0"], box["x1"], 10_000, 700_000), _clamped(box["y0"], box["y1"], 10_000, 1_300_000)
    return F.array_sort(F.array_distinct(F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: grid_cell(x * 10_000, y * 10_000))))))
