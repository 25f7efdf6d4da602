"""Geometry as column functions: distances, bearings, projection to a segment, a square grid.

The earth's radius is an argument everywhere. Cells are integers of a square lattice in degrees, 0.001 * 2**(11 - res); they
take the place of hexagons: same algebra (cell, coarser cell, ring), other tessellation, other ids.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MEAN_RADIUS, SPHERE_RADIUS, DEGREE_M = 6_371_000.0, 6_371_008.8, 111_195.0
BASE_RES, BASE_STEP = 11, 0.001
_OFFSET, _ROW = 2_000_000, 8_000_000


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = MEAN_RADIUS) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """0 to 360 degrees from north."""
    y = F.sin(F.radians(lon2 - lon1)) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(F.radians(lon2 - lon1))
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def heading_difference(a: Column, b: Column) -> Column:
    """0 to 180 degrees."""
    d = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.least(d, 360.0 - d)


def planar(lat: Column, lon: Column, lat0: Column, lon0: Column, degree: float = DEGREE_M) -> tuple[Column, Column]:
    """(east, north) in metres from an origin, on the plane through it."""
    return (lon - lon0) * F.cos(F.radians(lat0)) * degree, (lat - lat0) * degree


def project(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> tuple[Column, Column]:
    """(distance to the segment, share of its length at the foot), in the plane."""
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    share = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / length))).otherwise(0.0)
    return F.sqrt(F.pow(px - (ax + share * dx), 2) + F.pow(py - (ay + share * dy), 2)), share


def grid_cell(lat: Column, lon: Column, res: int = BASE_RES) -> Column:
    step = BASE_STEP * 2 ** (BASE_RES - res)
    return (F.floor(lat / step) + _OFFSET) * _ROW + F.floor(lon / step) + _OFFSET


def coarser(cell: Column, by: int = 1) -> Column:
    row, col = F.floor(cell / _ROW) - _OFFSET, F.pmod(cell, F.lit(_ROW)) - _OFFSET
    return (F.shiftright(row.cast("long"), by) + _OFFSET) * _ROW + F.shiftright(col.cast("long"), by) + _OFFSET


def ring(cell: Column, k: int = 1) -> Column:
    """All cells at most k rows and columns away, itself included."""
    return F.array(*[cell + F.lit(i * _ROW + j) for i in range(-k, k + 1) for j in range(-k, k + 1)])


def normal_heading(heading: Column) -> Column:
    """360 degrees are 0."""
    return F.when(heading == 360, 0).otherwise(heading)


def in_box(lat: Column, lon: Column, south: float, west: float, north: float, east: float) -> Column:
    return lat.between(south, north) & lon.between(west, east)


def boxes_meet(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Boxes (south, west, north, east), borders included."""
    return (F.greatest(a[0], b[0]) <= F.least(a[2], b[2])) & (F.greatest(a[1], b[1]) <= F.least(a[3], b[3]))


def close(a: Column, b: Column, absolute: float, relative: float) -> Column:
    """Equal within the larger of both tolerances."""
    return F.coalesce(F.abs(a - b) <= F.greatest(F.lit(absolute), relative * F.abs(b)), F.lit(False))


def between(lat1: Column, lon1: Column, lat2: Column, lon2: Column, share: Column) -> tuple[Column, Column]:
    """(lat, lon) on the great circle, `share` of the way; at most half around the earth, across the antimeridian too."""
    d = haversine(lat1, lon1, lat2, lon2, 1.0)
    a, b = F.try_divide(F.sin((1 - share) * d), F.sin(d)), F.try_divide(F.sin(share * d), F.sin(d))
    a, b = F.coalesce(a, 1 - share), F.coalesce(b, share)
    r = F.radians
    x = a * F.cos(r(lat1)) * F.cos(r(lon1)) + b * F.cos(r(lat2)) * F.cos(r(lon2))
    y = a * F.cos(r(lat1)) * F.sin(r(lon1)) + b * F.cos(r(lat2)) * F.sin(r(lon2))
    z = a * F.sin(r(lat1)) + b * F.sin(r(lat2))
    return F.degrees(F.atan2(z, F.sqrt(x * x + y * y))), F.degrees(F.atan2(y, x))


def shared_interval(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column, dx: Column, dy: Column) -> tuple[Column, Column]:
    """(from, to) in metres along the segment a-b that the segment c-d covers in the same direction; null where it does not."""
    length = F.sqrt(F.pow(bx - ax, 2) + F.pow(by - ay, 2))
    along = lambda x, y: F.try_divide((x - ax) * (bx - ax) + (y - ay) * (by - ay), length)
    lo, hi = F.greatest(F.lit(0.0), along(cx, cy)), F.least(length, along(dx, dy))
    return F.when(hi > lo, lo), F.when(hi > lo, hi)


#: The WGS 84 ellipsoid and the scale on a UTM zone's central meridian: fixed values.
WGS84_A, WGS84_F, UTM_SCALE = 6_378_137.0, 1 / 298.257223563, 0.9996


def utm(lat: Column, lon: Column, zone: int) -> tuple[Column, Column]:
    """(east, north) in metres of WGS 84 degrees in a UTM zone of the northern half, by the series in the third flattening; south of
    the equator north is negative."""
    n = WGS84_F / (2 - WGS84_F)
    radius = WGS84_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    terms = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * n**0.5 / (1 + n)
    sin, turn = F.sin(F.radians(lat)), F.radians(lon - (6 * zone - 183))
    t = F.sinh(F.atanh(sin) - e * F.atanh(e * sin))
    xi, eta = F.atan2(t, F.cos(turn)), F.atanh(F.sin(turn) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, alpha in enumerate(terms, 1):
        east, north = east + alpha * F.cos(2 * j * xi) * F.sinh(2 * j * eta), north + alpha * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500_000.0 + UTM_SCALE * radius * east, UTM_SCALE * radius * north
