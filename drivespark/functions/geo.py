"""Geometry on columns: distances, local frames, angles, tiles and cells. Degrees and metres; null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAP_RADIUS_M = 6_371_008.8
BACKEND_RADIUS_M = 6_378_137.0
# WGS-84 ellipsoid.
SEMI_MAJOR_M, ECCENTRICITY_2 = 6_378_137.0, 6.69437999014e-3


def clamp(x: Column, lo: float, hi: float) -> Column:
    """``x`` within [lo, hi]; unlike least and greatest, null stays null."""
    return F.when(x < lo, F.lit(lo)).when(x > hi, F.lit(hi)).otherwise(x)


def haversine_m(lat0: Column, lon0: Column, lat1: Column, lon1: Column, radius: float = MAP_RADIUS_M) -> Column:
    """Great-circle distance."""
    half_lat, half_lon = F.sin(F.radians(lat1 - lat0) / 2), F.sin(F.radians(lon1 - lon0) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat0)) * F.cos(F.radians(lat1)) * half_lon * half_lon
    return F.lit(2 * radius) * F.asin(F.sqrt(clamp(a, 0.0, 1.0)))


def wrap_pi(rad: Column) -> Column:
    """The same angle in (-pi, pi]."""
    return F.lit(F.pi()) - F.pmod(F.pi() - rad, 2 * F.pi())


def wrap_360(deg: Column) -> Column:
    """The same angle in [0, 360)."""
    return F.pmod(deg, F.lit(360.0))


def angle_diff_deg(a: Column, b: Column) -> Column:
    """The signed smallest difference a - b in (-180, 180]."""
    return F.lit(180.0) - F.pmod(F.lit(180.0) - (a - b), F.lit(360.0))


def compass_to_math_rad(deg: Column) -> Column:
    """Heading clockwise from north as an angle anticlockwise from east."""
    return wrap_pi(F.radians(F.lit(90.0) - deg))


def math_to_compass_deg(rad: Column) -> Column:
    return wrap_360(F.lit(90.0) - F.degrees(rad))


def _radii(lat: Column) -> tuple[Column, Column]:
    s = F.sin(F.radians(lat))
    w = F.lit(1.0) - F.lit(ECCENTRICITY_2) * s * s
    return F.lit(SEMI_MAJOR_M * (1 - ECCENTRICITY_2)) / (w * F.sqrt(w)), F.lit(SEMI_MAJOR_M) / F.sqrt(w)


def ned_between(lat0: Column, lon0: Column, lat1: Column, lon1: Column) -> tuple[Column, Column]:
    """(north, east) of the second point, in metres of the first point's local frame; short baselines."""
    meridian, normal = _radii(lat0)
    return F.radians(lat1 - lat0) * meridian, wrap_pi(F.radians(lon1 - lon0)) * normal * F.cos(F.radians(lat0))


def horizontal_distance_m(lat0: Column, lon0: Column, lat1: Column, lon1: Column) -> Column:
    north, east = ned_between(lat0, lon0, lat1, lon1)
    return F.sqrt(north * north + east * east)


def add_ned(lat: Column, lon: Column, north: Column, east: Column) -> tuple[Column, Column]:
    """The point moved by metres; at a pole the longitude stays."""
    meridian, normal = _radii(lat)
    around = normal * F.cos(F.radians(lat))
    return lat + F.degrees(north / meridian), F.when(F.abs(around) < 1e-3, lon).otherwise(lon + F.degrees(F.try_divide(east, around)))


def bearing_deg(lat0: Column, lon0: Column, lat1: Column, lon1: Column) -> Column:
    """Compass course from the first point to the second."""
    north, east = ned_between(lat0, lon0, lat1, lon1)
    return wrap_360(F.degrees(F.atan2(east, north)))


def latlon_to_enu(lat: Column, lon: Column, lat0: Column, lon0: Column, radius: float = BACKEND_RADIUS_M) -> tuple[Column, Column]:
    """(east, north) in metres around an anchor, equirectangular."""
    return F.radians(lon - lon0) * radius * F.cos(F.radians(lat0)), F.radians(lat - lat0) * radius


def enu_to_latlon(east: Column, north: Column, lat0: Column, lon0: Column, radius: float = BACKEND_RADIUS_M) -> tuple[Column, Column]:
    return lat0 + F.degrees(north / radius), lon0 + F.degrees(east / (F.lit(radius) * F.cos(F.radians(lat0))))


def polyline_length_m(line: Column, radius: float = MAP_RADIUS_M) -> Column:
    """Length of a flat [lat, lon, lat, lon, ...] array; a single point has length 0."""
    at = lambda i: F.element_at(line, i.cast("int"))
    steps = F.when(F.size(line) >= 4, F.sequence(F.lit(1), F.size(line) - 3, F.lit(2))).otherwise(F.array().cast("array<int>"))
    lengths = F.transform(steps, lambda i: haversine_m(at(i), at(i + 1), at(i + 2), at(i + 3), radius))
    return F.aggregate(lengths, F.lit(0.0), lambda total, x: total + x)


def project_point_to_segment(lat: Column, lon: Column, a_lat: Column, a_lon: Column, b_lat: Column, b_lon: Column) -> Column:
    """Struct of the foot on a segment (clamped to its ends): ``perp_m, along_m, foot_lat, foot_lon, heading_deg``."""
    # Metres of a radian first, and short ways not wrapped: two segments at one distance shall not differ by rounding.
    meridian, normal = _radii(a_lat)
    around = normal * F.cos(F.radians(a_lat))
    turn = lambda d: F.when(F.abs(d) <= 180, F.radians(d)).otherwise(wrap_pi(F.radians(d)))
    bn, be = F.radians(b_lat - a_lat) * meridian, turn(b_lon - a_lon) * around
    pn, pe = F.radians(lat - a_lat) * meridian, turn(lon - a_lon) * around
    # A lambda over an array of one names a value: what is used again is evaluated once, and the code stays small.
    ends = F.array(F.struct(bn.alias("bn"), be.alias("be"), pn.alias("pn"), pe.alias("pe")))
    square = lambda v: v.bn * v.bn + v.be * v.be
    share = lambda v: F.when(square(v) < 1e-9, F.lit(0.0)).otherwise(clamp(F.try_divide(v.pn * v.bn + v.pe * v.be, square(v)), 0.0, 1.0))
    parted = F.transform(ends, lambda v: F.struct(v.bn.alias("bn"), v.be.alias("be"), v.pn.alias("pn"), v.pe.alias("pe"), F.sqrt(square(v)).alias("len"), share(v).alias("t")))

    def foot(v):
        dn, de = v.pn - v.bn * v.t, v.pe - v.be * v.t
        foot_lat, foot_lon = add_ned(a_lat, a_lon, v.bn * v.t, v.be * v.t)
        return F.struct(F.sqrt(dn * dn + de * de).alias("perp_m"), (v.len * v.t).alias("along_m"), foot_lat.alias("foot_lat"), foot_lon.alias("foot_lon"), wrap_360(F.degrees(F.atan2(v.be, v.bn))).alias("heading_deg"))

    return F.get(F.transform(parted, foot), F.lit(0))


def point_at_distance(line: Column, upto: Column, along_m: Column) -> Column:
    """Struct ``lat, lon`` at ``along_m`` of a flat polyline whose running length at each point is ``upto``; clamped."""
    along = F.greatest(F.lit(0.0), F.least(along_m, F.element_at(upto, -1)))
    behind = F.greatest(F.lit(1), F.least(F.size(F.filter(upto, lambda d: d <= along)), F.size(upto) - 1))
    lat, lon = lambda i: F.element_at(line, i * 2 - 1), lambda i: F.element_at(line, i * 2)
    span = F.element_at(upto, behind + 1) - F.element_at(upto, behind)
    t = F.when(span > 0, F.try_divide(along - F.element_at(upto, behind), span)).otherwise(0.0)
    return F.struct((lat(behind) + (lat(behind + 1) - lat(behind)) * t).alias("lat"), (lon(behind) + (lon(behind + 1) - lon(behind)) * t).alias("lon"))


def tile_of(lat: Column, lon: Column, z: int) -> tuple[Column, Column]:
    """Slippy tile (x, y) of a point, clamped to the world."""
    n = 1 << z
    rad = F.radians(clamp(lat, -85.0511, 85.0511))
    y = (F.lit(1.0) - F.log(F.tan(rad) + F.lit(1.0) / F.cos(rad)) / F.pi()) / 2 * n
    inside = lambda v: clamp(F.floor(v), 0, n - 1).cast("int")
    return inside((lon + 180) / 360 * n), inside(y)


def tile_corner(z: int, x: Column, y: Column) -> tuple[Column, Column]:
    """North-west corner (lat, lon) of a tile; fractions are fine."""
    n = float(1 << z)
    mercator = F.pi() * (F.lit(1.0) - F.lit(2.0) * y / n)
    return F.degrees(F.lit(2.0) * F.atan(F.exp(mercator)) - F.pi() / 2), x / n * 360 - 180


def mercator_cell(lat: Column, lon: Column, cell_m: float = 250.0) -> tuple[Column, Column]:
    """Web-Mercator cell (x, y)."""
    y = F.lit(BACKEND_RADIUS_M) * F.log(F.tan(F.pi() / 4 + F.radians(lat) / 2))
    return F.floor(F.lit(BACKEND_RADIUS_M) * F.radians(lon) / cell_m), F.floor(y / cell_m)


def grid_cell(lat: Column, lon: Column, cell_m: float, ref_lat: float) -> tuple[Column, Column]:
    """Cell (gx, gy) of a grid of fixed metres, with one reference latitude for a whole region."""
    import math

    per_lat = MAP_RADIUS_M * math.pi / 180
    return F.floor(lon * (per_lat * math.cos(math.radians(ref_lat)) / cell_m)), F.floor(lat * (per_lat / cell_m))
