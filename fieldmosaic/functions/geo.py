"""Map projections as column arithmetic.

Transverse Mercator in Krueger's n-series to n^4 (sub-millimetre inside a zone)
and the ellipsoidal Lambert azimuthal equal-area projection, both from the
published EPSG guidance formulas. A projection is one select whose later columns
name earlier ones, so a sine used five times is written and evaluated once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmosaic.functions.naming import TARGET_EPSG, UNKNOWN_ZONE

# WGS 84 and GRS 80 ellipsoids, UTM grid, and the EPSG:3035 grid.
WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563
GRS80_A, GRS80_F = 6378137.0, 1 / 298.257222101
UTM_SCALE, UTM_FALSE_EASTING, UTM_SOUTH_NORTHING = 0.9996, 500000.0, 10000000.0
LAEA_LAT0, LAEA_LON0 = math.radians(52.0), math.radians(10.0)
LAEA_FALSE_EASTING, LAEA_FALSE_NORTHING = 4321000.0, 3210000.0
GEOGRAPHIC_EPSG = "EPSG4326"
#: Metres of a degree at most, that of latitude at a pole.
DEGREE = math.radians(1) * WGS84_A / (1 - WGS84_F)

def _krueger(flattening: float) -> dict[str, tuple[float, ...]]:
    """Krueger series of an ellipsoid, geographic -> grid (alpha), grid ->
    geographic (beta), and conformal -> geographic latitude (delta), with the radius of the
    rectifying sphere and the constant of the conformal latitude."""
    n = flattening / (2 - flattening)
    return {
        "radius": (WGS84_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64) * UTM_SCALE,),
        "e": (2 * math.sqrt(n) / (1 + n),),
        "alpha": (
            n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
            13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
            61 * n**3 / 240 - 103 * n**4 / 140,
            49561 * n**4 / 161280,
        ),
        "beta": (
            n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
            n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
            17 * n**3 / 480 - 37 * n**4 / 840,
            4397 * n**4 / 161280,
        ),
        "delta": (
            2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45,
            7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45,
            56 * n**3 / 15 - 136 * n**4 / 35,
            4279 * n**4 / 630,
        ),
    }


_WGS84, _GRS80 = _krueger(WGS84_F), _krueger(GRS80_F)

_E2 = GRS80_F * (2 - GRS80_F)
_E = math.sqrt(_E2)


def _authalic_q(sin_lat: float) -> float:
    return (1 - _E2) * (
        sin_lat / (1 - _E2 * sin_lat**2)
        - math.log((1 - _E * sin_lat) / (1 + _E * sin_lat)) / (2 * _E)
    )


_QP = _authalic_q(1.0)
_BETA0 = math.asin(_authalic_q(math.sin(LAEA_LAT0)) / _QP)
LAEA_RADIUS = GRS80_A * math.sqrt(_QP / 2)
_D = (
    GRS80_A
    * math.cos(LAEA_LAT0)
    / math.sqrt(1 - _E2 * math.sin(LAEA_LAT0) ** 2)
    / (LAEA_RADIUS * math.cos(_BETA0))
)
_N80 = GRS80_F / (2 - GRS80_F)
# Authalic -> geographic latitude, series in the third flattening to n^4.
_AUTHALIC = (
    4 * _N80 / 3 + 4 * _N80**2 / 45 - 16 * _N80**3 / 35 - 2582 * _N80**4 / 14175,
    46 * _N80**2 / 45 + 152 * _N80**3 / 945 - 11966 * _N80**4 / 14175,
    3044 * _N80**3 / 2835 + 3802 * _N80**4 / 14175,
    6059 * _N80**4 / 4725,
)


def _total(terms) -> Column:
    total = None
    for term in terms:
        total = term if total is None else total + term
    return total


def _steps(df: DataFrame, steps: dict[str, Column], first: str, second: str) -> DataFrame:
    """Add two results of named steps, passed through a one-element generator.

    A filter on a result would otherwise be pushed below the steps with the whole
    formula written out in place of every name, many times over.
    """
    taken = set(df.columns) & set(steps)
    if taken:
        raise ValueError(f"columns already there: {sorted(taken)}")
    stepped = df.select("*", *(step.alias(name) for name, step in steps.items()))
    return stepped.select(*df.columns, F.inline(F.array(F.struct(first, second))))


def utm_code(epsg: Column) -> Column:
    """Integer UTM code of ``'EPSG326zz'`` (WGS 84, 326zz north, 327zz south) or
    ``'EPSG258zz'`` (ETRS 89, zones 28 to 38); null otherwise."""
    code = F.regexp_extract(epsg, "^EPSG(32[67](?:0[1-9]|[1-5][0-9]|60)|258(?:2[89]|3[0-8]))$", 1)
    return F.when(code != "", code.cast("int"))


def source_code(zone: Column) -> Column:
    """Code of a zone that can be brought to the target: a UTM code, that of geographic
    degrees, or the target's own.

    Null for the unknown zone alone. Every other readable system stops the job, for
    leaving its tiles out would make a hole nobody hears of.
    """
    problem = F.raise_error(F.concat(F.lit("no way from this coordinate system: "), zone)).cast("int")
    others = [F.when(zone == epsg, F.lit(int(epsg[4:]))) for epsg in (TARGET_EPSG, GEOGRAPHIC_EPSG)]
    known = F.coalesce(utm_code(zone), *others, problem)
    return F.when(zone.isNotNull() & (zone != UNKNOWN_ZONE), known)


def is_target(code: Column) -> Column:
    return code == int(TARGET_EPSG[4:])


def is_geographic(code: Column) -> Column:
    return code == int(GEOGRAPHIC_EPSG[4:])


def _of(code: Column, name: str) -> list[Column]:
    """Constants of the code's ellipsoid: GRS 80 for ETRS 89, else WGS 84."""
    return [F.when(code < 26000, F.lit(e)).otherwise(F.lit(w)) for e, w in zip(_GRS80[name], _WGS84[name])]


def _central_meridian(code: Column) -> Column:
    return F.radians((code % 100) * 6 - F.lit(183.0))


def _false_northing(code: Column) -> Column:
    return F.when(code >= 32700, F.lit(UTM_SOUTH_NORTHING)).otherwise(F.lit(0.0))


def utm_to_geographic(df: DataFrame, x: str, y: str, code: str, lat: str, lon: str) -> DataFrame:
    """Add latitude and longitude (radians) of UTM coordinates."""
    c = F.col
    xi, eta, chi = c("_xi"), c("_eta"), c("_chi")
    (radius,), beta, delta = (_of(c(code), name) for name in ("radius", "beta", "delta"))
    steps = {
        "_xi": (c(y) - _false_northing(c(code))) / radius,
        "_eta": (c(x) - UTM_FALSE_EASTING) / radius,
        "_xi1": xi
        - _total(b * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, b in enumerate(beta, 1)),
        "_eta1": eta
        - _total(b * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, b in enumerate(beta, 1)),
        "_chi": F.asin(F.sin("_xi1") / F.cosh("_eta1")),
        lat: chi + _total(d * F.sin(2 * j * chi) for j, d in enumerate(delta, 1)),
        lon: _central_meridian(c(code)) + F.atan2(F.sinh("_eta1"), F.cos("_xi1")),
    }
    return _steps(df, steps, lat, lon)


def geographic_to_utm(df: DataFrame, lat: str, lon: str, code: str, x: str, y: str) -> DataFrame:
    """Add UTM coordinates of latitude and longitude (radians)."""
    c = F.col
    xi, eta, t, cos = c("_xi1"), c("_eta1"), c("_t"), c("_cos_dlon")
    (radius,), (e,), alpha = (_of(c(code), name) for name in ("radius", "e", "alpha"))
    steps = {
        "_sin": F.sin(lat),
        "_dlon": c(lon) - _central_meridian(c(code)),
        "_cos_dlon": F.cos("_dlon"),
        "_t": F.sinh(F.atanh("_sin") - e * F.atanh(e * c("_sin"))),
        "_xi1": F.atan2(t, cos),
        "_eta1": F.asinh(F.sin("_dlon") / F.sqrt(t * t + cos * cos)),
        x: UTM_FALSE_EASTING
        + radius
        * (eta + _total(a * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(alpha, 1))),
        y: _false_northing(c(code))
        + radius
        * (xi + _total(a * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(alpha, 1))),
    }
    return _steps(df, steps, x, y)


def to_geographic(df: DataFrame, x: str, y: str, code: str, lat: str, lon: str) -> DataFrame:
    """Add latitude and longitude (radians) of coordinates in the code's system: UTM, or
    degrees with the longitude as ``x``."""
    degrees = is_geographic(F.col(code))
    return utm_to_geographic(df, x, y, code, "_utm_lat", "_utm_lon").select(
        *df.columns,
        F.when(degrees, F.radians(y)).otherwise(F.col("_utm_lat")).alias(lat),
        F.when(degrees, F.radians(x)).otherwise(F.col("_utm_lon")).alias(lon),
    )


def from_geographic(df: DataFrame, lat: str, lon: str, code: str, x: str, y: str) -> DataFrame:
    """Add coordinates in the code's system; longitudes lie from -180 to below 180 degrees."""
    degrees, east = is_geographic(F.col(code)), F.degrees(lon)
    wrapped = F.when(east >= 180, east - 360).when(east < -180, east + 360).otherwise(east)
    return geographic_to_utm(df, lat, lon, code, "_utm_x", "_utm_y").select(
        *df.columns,
        F.when(degrees, wrapped).otherwise(F.col("_utm_x")).alias(x),
        F.when(degrees, F.degrees(lat)).otherwise(F.col("_utm_y")).alias(y),
    )


def geographic_to_laea(df: DataFrame, lat: str, lon: str, x: str, y: str) -> DataFrame:
    """Add EPSG:3035 coordinates of latitude and longitude (radians)."""
    c = F.col
    s = c("_s")
    sin0, cos0 = math.sin(_BETA0), math.cos(_BETA0)
    steps = {
        "_s": F.sin(lat),
        "_dl": c(lon) - LAEA_LON0,
        "_q": (1 - _E2)
        * (s / (1 - _E2 * s * s) - F.ln((1 - _E * s) / (1 + _E * s)) / (2 * _E)),
        "_b": F.asin(c("_q") / _QP),
        "_sb": F.sin("_b"),
        "_cb": F.cos("_b"),
        "_cbc": c("_cb") * F.cos("_dl"),
        "_k": LAEA_RADIUS * F.sqrt(2 / (1 + sin0 * c("_sb") + cos0 * c("_cbc"))),
        x: LAEA_FALSE_EASTING + c("_k") * _D * c("_cb") * F.sin("_dl"),
        y: LAEA_FALSE_NORTHING + c("_k") / _D * (cos0 * c("_sb") - sin0 * c("_cbc")),
    }
    return _steps(df, steps, x, y)


def laea_to_geographic(df: DataFrame, x: str, y: str, lat: str, lon: str) -> DataFrame:
    """Add latitude and longitude (radians) of EPSG:3035 coordinates."""
    c = F.col
    dx, dy, rho, beta = c("_dx"), c("_dy"), c("_rho"), c("_ba")
    sin0, cos0 = math.sin(_BETA0), math.cos(_BETA0)
    # At the projection centre rho is 0 and this term vanishes.
    tilt = F.when(rho == 0, F.lit(0.0)).otherwise(
        dy * c("_sc") * cos0 / F.when(rho != 0, rho)
    )
    steps = {
        "_dx": (c(x) - LAEA_FALSE_EASTING) / _D,
        "_dy": (c(y) - LAEA_FALSE_NORTHING) * _D,
        "_rho": F.sqrt(dx * dx + dy * dy),
        "_arc": 2 * F.asin(rho / (2 * LAEA_RADIUS)),
        "_sc": F.sin("_arc"),
        "_cc": F.cos("_arc"),
        "_ba": F.asin(c("_cc") * sin0 + tilt),
        lat: beta + _total(k * F.sin(2 * j * beta) for j, k in enumerate(_AUTHALIC, 1)),
        lon: LAEA_LON0 + F.atan2(dx * c("_sc"), rho * cos0 * c("_cc") - dy * sin0 * c("_sc")),
    }
    return _steps(df, steps, lat, lon)
