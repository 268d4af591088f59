"""Spherical geometry as column expressions; latitudes and longitudes in degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS_KM = 6371.0
BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"
COMPASS = ["north", "northeast", "east", "southeast", "south", "southwest", "west", "northwest"]


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * RADIUS_KM * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    return haversine_km(lat1, lon1, lat2, lon2) * 1000


def bearing(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing from the first point to the second, from 0 to below 360."""
    lat1, lon1, lat2, lon2 = (F.radians(_c(x)) for x in (lat1, lon1, lat2, lon2))
    y = F.sin(lon2 - lon1) * F.cos(lat2)
    x = F.cos(lat1) * F.sin(lat2) - F.sin(lat1) * F.cos(lat2) * F.cos(lon2 - lon1)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def compass(theta) -> Column:
    """One of eight directions; halves round to even."""
    return F.get(F.array(*map(F.lit, COMPASS)), F.pmod(F.bround(_c(theta) / 45).cast("int"), F.lit(8)))


def angular_difference(a, b) -> Column:
    return F.abs(F.pmod(_c(a) - _c(b) + 180, F.lit(360.0)) - 180)


def geohash(lat, lon, precision: int) -> Column:
    """Geohash of ``precision`` characters: scaled coordinates whose bits interleave, longitude first."""
    bits = 5 * precision
    nx, ny = (bits + 1) // 2, bits // 2
    scaled = lambda v, low, span, n: F.least(F.greatest(F.floor((_c(v) - low) / span * (1 << n)), F.lit(0)), F.lit((1 << n) - 1)).cast("long")
    x, y = scaled(lon, -180, 360, nx), scaled(lat, -90, 180, ny)
    out = []
    for k in range(precision):
        code = F.lit(0).cast("long")
        for i in range(5 * k, 5 * k + 5):
            source, at = (x, nx - 1 - i // 2) if i % 2 == 0 else (y, ny - 1 - i // 2)
            code = code * 2 + F.shiftright(source, at).bitwiseAND(F.lit(1).cast("long"))
        out.append(F.substring(F.lit(BASE32), code.cast("int") + 1, F.lit(1)))
    return F.concat(*out)


def cell_sizes(precision: int) -> tuple[float, float]:
    """Height and width in degrees of a geohash cell."""
    bits = 5 * precision
    return 180 / (1 << (bits // 2)), 360 / (1 << ((bits + 1) // 2))


def cell_center(value, low: float, size: float) -> Column:
    return (F.floor((_c(value) - low) / size) + 0.5) * size + low


def inverse_distance_weight(km) -> Column:
    """max(1 / ln(max(d, 1.1)), e)."""
    return F.greatest(1 / F.log(F.greatest(_c(km), F.lit(1.1))), F.lit(2.718281828459045))


def in_box(lat, lon, south: float, west: float, north: float, east: float) -> Column:
    return _c(lat).between(south, north) & _c(lon).between(west, east)


def in_polygon(lat, lon, ring: list[tuple[float, float]]) -> Column:
    """Even-odd rule over the edges of a ring of (lon, lat) points; the box comes first."""
    x, y = _c(lon), _c(lat)
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if y1 != y2:
            crossings = crossings + F.when(((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1), 1).otherwise(0)
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    return in_box(y, x, min(ys), min(xs), max(ys), max(xs)) & (crossings % 2 == 1)


def geo_score(km, reach_km: float) -> Column:
    """1 - d / reach, within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - _c(km) / reach_km))


def radius_metres(text) -> Column:
    """Metres of the first number with an optional unit; null without one."""
    t = F.lower(_c(text))
    n = F.regexp_extract(t, r"(\d+)\s*(km|m)?", 1)
    return F.when(n != "", F.try_to_number(n, F.lit("999999999")).cast("double") * F.when(F.regexp_extract(t, r"(\d+)\s*(km|m)?", 2) == "km", 1000).otherwise(1))


def is_located(lat, lon) -> Column:
    """Neither null nor the not-a-number point of elements without coordinates."""
    lat, lon = _c(lat), _c(lon)
    return lat.isNotNull() & lon.isNotNull() & ~(F.isnan(lat) & F.isnan(lon))


# The semi-major axis in metres and the flattening of WGS 84.
MAJOR, FLATTENING = 6378137.0, 1 / 298.257223563


def ellipsoidal_m(lat1, lon1, lat2, lon2, steps: int = 20) -> Column:
    """Metres along the ellipsoid by Vincenty's inverse formula, iterated ``steps`` times; between nearly opposite points, where it doesn't settle, metres along the sphere."""
    minor = MAJOR * (1 - FLATTENING)
    reduced = lambda lat: F.atan((1 - FLATTENING) * F.tan(F.radians(_c(lat))))
    difference = F.radians(_c(lon2) - _c(lon1))
    difference = F.atan2(F.sin(difference), F.cos(difference))

    def parts(s: Column) -> dict[str, Column]:
        su1, cu1, su2, cu2, lam = s["su1"], s["cu1"], s["su2"], s["cu2"], s["lam"]
        sin_s = F.sqrt(F.pow(cu2 * F.sin(lam), 2) + F.pow(cu1 * su2 - su1 * cu2 * F.cos(lam), 2))
        cos_s = su1 * su2 + cu1 * cu2 * F.cos(lam)
        sin_a = F.when(sin_s == 0, 0.0).otherwise(cu1 * cu2 * F.sin(lam) / F.when(sin_s == 0, 1.0).otherwise(sin_s))
        cos2a = 1 - sin_a * sin_a
        mid = F.when(cos2a == 0, 0.0).otherwise(cos_s - 2 * su1 * su2 / F.when(cos2a == 0, 1.0).otherwise(cos2a))
        return {"sin_s": sin_s, "cos_s": cos_s, "sigma": F.atan2(sin_s, cos_s), "sin_a": sin_a, "cos2a": cos2a, "mid": mid}

    def held(s: Column, lam: Column, was: Column) -> Column:
        return F.struct(*[s[c].alias(c) for c in ("su1", "cu1", "su2", "cu2", "dl")], lam.alias("lam"), was.alias("was"))

    def turn(s: Column, _: Column) -> Column:
        def next_(p: Column) -> Column:
            c = FLATTENING / 16 * p["cos2a"] * (4 + FLATTENING * (4 - 3 * p["cos2a"]))
            lam = s["dl"] + (1 - c) * FLATTENING * p["sin_a"] * (p["sigma"] + c * p["sin_s"] * (p["mid"] + c * p["cos_s"] * (2 * p["mid"] * p["mid"] - 1)))
            return held(s, lam, s["lam"])

        return F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in parts(s).items()])), next_), F.lit(0))

    def metres(s: Column) -> Column:
        def of(p: Column) -> Column:
            u2 = p["cos2a"] * (MAJOR**2 - minor**2) / minor**2
            a = 1 + u2 / 16384 * (4096 + u2 * (-768 + u2 * (320 - 175 * u2)))
            b = u2 / 1024 * (256 + u2 * (-128 + u2 * (74 - 47 * u2)))
            m2 = p["mid"] * p["mid"]
            d = b * p["sin_s"] * (p["mid"] + b / 4 * (p["cos_s"] * (2 * m2 - 1) - b / 6 * p["mid"] * (4 * p["sin_s"] * p["sin_s"] - 3) * (4 * m2 - 3)))
            return F.when(F.abs(s["lam"] - s["was"]) < 1e-9, minor * a * (p["sigma"] - d))

        return F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in parts(s).items()])), of), F.lit(0))

    u1, u2 = reduced(lat1), reduced(lat2)
    start = F.struct(F.sin(u1).alias("su1"), F.cos(u1).alias("cu1"), F.sin(u2).alias("su2"), F.cos(u2).alias("cu2"), difference.alias("dl"), difference.alias("lam"), (difference + 1).alias("was"))
    return F.coalesce(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, turn, metres), haversine_m(lat1, lon1, lat2, lon2))
