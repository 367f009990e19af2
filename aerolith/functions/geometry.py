"""Planar geometry as column expressions: a point is a struct (x, y), a ring an array of points that ends where it begins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def box_ring(xmin: Column, ymin: Column, xmax: Column, ymax: Column, clockwise: bool = False) -> Column:
    a, b, c, d = point(xmin, ymin), point(xmax, ymin), point(xmax, ymax), point(xmin, ymax)
    return F.array(a, d, c, b, a) if clockwise else F.array(a, b, c, d, a)


def with_box(df: DataFrame, clockwise: bool = False) -> DataFrame:
    """``df`` with ``geom``, the ring of its columns xmin, ymin, xmax, ymax."""
    return df.withColumn("geom", box_ring(*map(F.col, ("xmin", "ymin", "xmax", "ymax")), clockwise=clockwise))


def segments(ring: Column) -> Column:
    """Array of structs (a, b)."""
    n = F.size(ring)
    return F.zip_with(F.slice(ring, 1, n - 1), F.slice(ring, 2, n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _fold(ring: Column, f) -> Column:
    return F.aggregate(segments(ring), F.lit(0.0), lambda s, g: s + f(g["a"], g["b"]))


def signed_area(ring: Column) -> Column:
    return _fold(ring, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]) / 2


def area(ring: Column, *holes: Column) -> Column:
    out = F.abs(signed_area(ring))
    for h in holes:
        out = out - F.abs(signed_area(h))
    return out


def length(line: Column) -> Column:
    return _fold(line, distance)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.pow(b["x"] - a["x"], 2) + F.pow(b["y"] - a["y"], 2))


def azimuth(a: Column, b: Column) -> Column:
    """Angle from north, clockwise, 0 .. 2π."""
    t = F.atan2(b["x"] - a["x"], b["y"] - a["y"])
    return F.when(t < 0, t + 2 * math.pi).otherwise(t)


def centroid(ring: Column) -> Column:
    """Centre of gravity of a ring's area."""
    s = signed_area(ring) * 6
    cross = lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]
    return point(F.try_divide(_fold(ring, lambda a, b: (a["x"] + b["x"]) * cross(a, b)), s), F.try_divide(_fold(ring, lambda a, b: (a["y"] + b["y"]) * cross(a, b)), s))


def bounds(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd rule, half-open crossings; a point on the border may count either way."""

    def crosses(g: Column) -> Column:
        a, b = g["a"], g["b"]
        return F.when((a["y"] > y) != (b["y"] > y), x < a["x"] + (y - a["y"]) * (b["x"] - a["x"]) / (b["y"] - a["y"])).otherwise(F.lit(False))

    return F.size(F.filter(segments(ring), crosses)) % 2 == 1


def vertical_crossings(ring: Column, x: Column) -> Column:
    """Ordinates at which the vertical through ``x`` crosses the ring."""
    across = F.filter(segments(ring), lambda g: (g["a"]["x"] > x) != (g["b"]["x"] > x))
    return F.transform(across, lambda g: g["a"]["y"] + (x - g["a"]["x"]) * (g["b"]["y"] - g["a"]["y"]) / (g["b"]["x"] - g["a"]["x"]))


def translate(ring: Column, dx: Column | float, dy: Column | float) -> Column:
    return F.transform(ring, lambda p: point(p["x"] + dx, p["y"] + dy))


def rotate(ring: Column, angle: Column | float, cx: Column | float = 0.0, cy: Column | float = 0.0) -> Column:
    """Counter-clockwise by ``angle`` radians about (cx, cy)."""
    a = angle if isinstance(angle, Column) else F.lit(float(angle))
    s, c = F.sin(a), F.cos(a)
    return F.transform(ring, lambda p: point(cx + (p["x"] - cx) * c - (p["y"] - cy) * s, cy + (p["x"] - cx) * s + (p["y"] - cy) * c))


def scale(ring: Column, factor: float, cx: Column, cy: Column) -> Column:
    return F.transform(ring, lambda p: point(cx + (p["x"] - cx) * factor, cy + (p["y"] - cy) * factor))


def circle(x: Column, y: Column, radius: Column | float, corners: int = 64) -> Column:
    k = F.sequence(F.lit(0), F.lit(corners))
    return F.transform(k, lambda i: point(x + radius * F.cos(i * (2 * math.pi / corners)), y + radius * F.sin(i * (2 * math.pi / corners))))


def densify(a: Column, b: Column, parts: int) -> Column:
    k = F.sequence(F.lit(0), F.lit(parts))
    return F.transform(k, lambda i: point(a["x"] + (b["x"] - a["x"]) * i / parts, a["y"] + (b["y"] - a["y"]) * i / parts))


def to_mercator(lon: Column, lat: Column) -> Column:
    """Spherical web Mercator, metres."""
    r = 6378137.0
    return point(F.radians(lon) * r, F.ln(F.tan(math.pi / 4 + F.radians(lat) / 2)) * r)


def from_mercator(x: Column, y: Column) -> Column:
    r = 6378137.0
    return point(F.degrees(x / r), F.degrees(2 * F.atan(F.exp(y / r)) - math.pi / 2))


# The national conic projection of metropolitan France on the GRS80 ellipsoid.
_N, _C, _XS, _YS, _LON0, _E = 0.7256077650532670, 11754255.426096, 700000.0, 12655612.049876, 3.0, 0.0818191910428158


def to_conic(lon: Column, lat: Column) -> Column:
    """Lambert conic, metres, of degrees."""
    phi = F.radians(lat)
    iso = F.ln(F.tan(math.pi / 4 + phi / 2)) - _E / 2 * F.ln((1 + _E * F.sin(phi)) / (1 - _E * F.sin(phi)))
    r, g = _C * F.exp(-_N * iso), _N * F.radians(lon - _LON0)
    return point(_XS + r * F.sin(g), _YS - r * F.cos(g))


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = 6371008.8) -> Column:
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def hexagon(x: Column, y: Column, size: float) -> Column:
    """The axial coordinates (q, r) of the planar hexagon of side ``size`` that holds a point: cube coordinates rounded, the one that is off most set right."""
    q, r = (math.sqrt(3.0) / 3 * x - y / 3) / size, 2.0 / 3 * y / size
    rq, rr, rs = F.rint(q), F.rint(r), F.rint(-q - r)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs + q + r)
    first = (dq > dr) & (dq > ds)
    return F.struct(F.when(first, -rr - rs).otherwise(rq).cast("long").alias("q"), F.when(~first & (dr > ds), -rq - rs).otherwise(rr).cast("long").alias("r"))


def hexagon_sql(source: str, x: str, y: str, size: float, keep: str) -> str:
    """The same as SQL: ``keep``, ``q`` and ``r`` of the rows of ``source``."""
    return (
        f"SELECT {keep}, CAST(CASE WHEN abs(rq - q0) > abs(rr - r0) AND abs(rq - q0) > abs(rs + q0 + r0) THEN -rr - rs ELSE rq END AS BIGINT) AS q, "
        f"CAST(CASE WHEN abs(rq - q0) > abs(rr - r0) AND abs(rq - q0) > abs(rs + q0 + r0) THEN rr WHEN abs(rr - r0) > abs(rs + q0 + r0) THEN -rq - rs ELSE rr END AS BIGINT) AS r "
        f"FROM (SELECT *, round_even(q0, 0) AS rq, round_even(r0, 0) AS rr, round_even(-q0 - r0, 0) AS rs FROM (SELECT *, (sqrt(3.0) / 3 * {x} - {y} / 3) / {size} AS q0, 2.0 / 3 * {y} / {size} AS r0 FROM {source}) h0) h1"
    )
