"""Geometry functions one by one, on building rings and stations."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import clip
from ..operators import joins as J
from .base import Book, view

book = Book()
query = book.query
B = "f_building"
_W, _L = "(xmax - xmin)", "(ymax - ymin)"


def _b(s: SparkSession, d: str) -> DataFrame:
    return G.with_box(view(s, d, B))


def _g():
    return F.col("geom")


def r6(c, name):
    return F.round(c, 6).alias(name)


@query("st_area", f"SELECT id, {_W} * {_L} AS area FROM f_building")
def st_area(s, d):
    return _b(s, d).select("id", G.area(_g()).alias("area"))


@query("st_area_holes", f"SELECT id, {_W} * {_L} - ({_W} - 2) * ({_L} - 2) AS area FROM f_building")
def st_area_holes(s, d):
    """A ring one metre wide: the box less the box inside it."""
    hole = G.box_ring(F.col("xmin") + 1, F.col("ymin") + 1, F.col("xmax") - 1, F.col("ymax") - 1)
    return _b(s, d).select("id", G.area(_g(), hole).alias("area"))


@query("st_length", f"SELECT id, 2 * ({_W} + {_L}) AS length FROM f_building")
def st_length(s, d):
    return _b(s, d).select("id", G.length(_g()).alias("length"))


@query("st_distance", "SELECT a.sid AS a, b.sid AS b, ROUND(sqrt(pow(a.lon - b.lon, 2) + pow(a.lat - b.lat, 2)), 6) AS dist FROM f_station a JOIN f_station b ON b.sid = a.sid + 1")
def st_distance(s, d):
    a = view(s, d, "f_station").select("sid", G.point(F.col("lon"), F.col("lat")).alias("p"))
    b = a.select((F.col("sid") - 1).alias("sid"), F.col("p").alias("q"))
    return a.join(b, "sid").select(F.col("sid").alias("a"), (F.col("sid") + 1).alias("b"), r6(G.distance(F.col("p"), F.col("q")), "dist"))


@query("st_azimuth", f"SELECT id, ROUND(atan2({_W}, {_L}), 6) AS azimuth FROM f_building")
def st_azimuth(s, d):
    return _b(s, d).select("id", r6(G.azimuth(_g()[0], _g()[2]), "azimuth"))


@query("st_centroid", "SELECT id, ROUND((xmin + xmax) / 2, 6) AS x, ROUND((ymin + ymax) / 2, 6) AS y FROM f_building")
def st_centroid(s, d):
    c = _b(s, d).select("id", G.centroid(_g()).alias("c"))
    return c.select("id", r6(F.col("c.x"), "x"), r6(F.col("c.y"), "y"))


@query("st_envelope", "SELECT id, xmin, ymin, xmax, ymax FROM f_building")
def st_envelope(s, d):
    return _b(s, d).select("id", G.bounds(_g()).alias("b")).select("id", "b.*")


@query("st_zminmax", "SELECT id, least(hauteur, 10) AS zmin, greatest(hauteur, 10) AS zmax FROM f_building WHERE hauteur IS NOT NULL")
def st_zminmax(s, d):
    z = F.array("hauteur", F.lit(10.0))
    return view(s, d, B).where("hauteur IS NOT NULL").select("id", F.array_min(z).alias("zmin"), F.array_max(z).alias("zmax"))


@query("st_expand", "SELECT id, xmin - 3 AS xmin, ymax + 3 AS ymax FROM f_building")
def st_expand(s, d):
    b = _b(s, d).select("id", G.bounds(_g()).alias("b"))
    return b.select("id", (F.col("b.xmin") - 3).alias("xmin"), (F.col("b.ymax") + 3).alias("ymax"))


@query("st_intersects", "SELECT a.id AS a, b.id AS b FROM f_building a JOIN f_landcover b ON a.xmin <= b.xmax AND a.xmax >= b.xmin AND a.ymin <= b.ymax AND a.ymax >= b.ymin")
def st_intersects(s, d):
    return J.boxes_that_meet(view(s, d, B), view(s, d, "f_landcover"), 64.0).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


@query("st_contains", "SELECT a.id AS a, b.id AS b FROM f_landcover a JOIN f_building b ON b.xmin >= a.xmin AND b.xmax <= a.xmax AND b.ymin >= a.ymin AND b.ymax <= a.ymax")
def st_contains(s, d):
    inside = (F.col("b.xmin") >= F.col("a.xmin")) & (F.col("b.xmax") <= F.col("a.xmax")) & (F.col("b.ymin") >= F.col("a.ymin")) & (F.col("b.ymax") <= F.col("a.ymax"))
    return J.boxes_that_meet(view(s, d, "f_landcover"), view(s, d, B), 64.0).where(inside).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


@query("st_equals", "SELECT id FROM f_building WHERE xmax - xmin = ymax - ymin")
def st_equals(s, d):
    """Boxes that a quarter turn about their corner maps onto a box of the same bounds, that is, squares."""
    turned = G.rotate(_g(), math.pi / 2, F.col("xmin"), F.col("ymin"))
    b, t = G.bounds(_g()), G.bounds(turned)
    same = (F.abs((b["xmax"] - b["xmin"]) - (t["xmax"] - t["xmin"])) < 1e-6) & (F.abs((b["ymax"] - b["ymin"]) - (t["ymax"] - t["ymin"])) < 1e-6)
    return _b(s, d).where(same).select("id")


@query("st_intersection", f"SELECT id, ROUND({_W} * {_L} / 4, 6) AS area FROM f_building")
def st_intersection(s, d):
    """Each ring within its lower left quarter."""
    q = G.box_ring(F.col("xmin"), F.col("ymin"), (F.col("xmin") + F.col("xmax")) / 2, (F.col("ymin") + F.col("ymax")) / 2)
    x = clip.clipped(_b(s, d).select("id", "geom", q.alias("q")), "geom", "q")
    return x.select("id", r6(G.area(F.col("clipped")), "area"))


@query("st_split", f"SELECT id, CAST(k AS INTEGER) AS part, ROUND({_W} * {_L} / 2, 6) AS area FROM f_building CROSS JOIN (SELECT unnest([0, 1]) AS k) g")
def st_split(s, d):
    """Each ring cut along its vertical middle."""
    m = (F.col("xmin") + F.col("xmax")) / 2
    halves = F.array(G.box_ring(F.col("xmin"), F.col("ymin"), m, F.col("ymax")), G.box_ring(m, F.col("ymin"), F.col("xmax"), F.col("ymax")))
    x = _b(s, d).select("id", "geom", F.posexplode(halves).alias("part", "half"))
    return clip.clipped(x, "geom", "half").select("id", "part", r6(G.area(F.col("clipped")), "area"))


@query("st_buffer", f"SELECT id, ROUND({_W} * {_L} + 2 * 2 * ({_W} + {_L}) + 16, 6) AS mitre, ROUND(32 * 4 * sin(2 * pi() / 64), 6) AS disc FROM f_building")
def st_buffer(s, d):
    """Mitre offset of a box by 2 m, and a point's 64-cornered disc of 2 m."""
    wide = G.box_ring(F.col("xmin") - 2, F.col("ymin") - 2, F.col("xmax") + 2, F.col("ymax") + 2)
    return _b(s, d).select("id", r6(G.area(wide), "mitre"), r6(G.area(G.circle(F.lit(0.0), F.lit(0.0), 2.0, 64)), "disc"))


@query("st_simplify", "SELECT id, CAST(5 AS INTEGER) AS corners FROM f_building")
def st_simplify(s, d):
    """Rings with a superfluous corner on every side, simplified (Douglas-Peucker): the corners are left."""

    def thin(p: np.ndarray, tol: float) -> np.ndarray:
        keep, stack = {0, len(p) - 1}, [(0, len(p) - 1)]
        while stack:
            a, b = stack.pop()
            if b - a < 2:
                continue
            ab, ap = p[b] - p[a], p[a + 1 : b] - p[a]
            n = np.hypot(*ab)
            dist = np.abs(ab[0] * ap[:, 1] - ab[1] * ap[:, 0]) / n if n else np.hypot(ap[:, 0], ap[:, 1])
            k = int(dist.argmax())
            if dist[k] > tol:
                keep.add(a + 1 + k)
                stack += [(a, a + 1 + k), (a + 1 + k, b)]
        return p[sorted(keep)]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"id": b.column("id"), "corners": pa.array([len(thin(r, 0.25)) for r in clip._rings(b.column("g"))], pa.int32())})

    dense = F.flatten(F.transform(G.segments(_g()), lambda g: F.slice(G.densify(g["a"], g["b"], 2), 1, 2)))
    return _b(s, d).select("id", F.concat(dense, F.slice(_g(), 1, 1)).alias("g")).mapInArrow(kernel, "id bigint, corners int")


@query("st_snap", "SELECT id, ROUND(xmin / 10) * 10 AS x, ROUND(ymin / 10) * 10 AS y FROM f_building")
def st_snap(s, d):
    p = F.transform(_g(), lambda q: G.point(F.round(q["x"] / 10) * 10, F.round(q["y"] / 10) * 10))
    return _b(s, d).select("id", p[0]["x"].alias("x"), p[0]["y"].alias("y"))


@query("st_densify", "SELECT id, CAST(11 AS INTEGER) AS n, xmin + (xmax - xmin) / 2 AS mid FROM f_building")
def st_densify(s, d):
    x = G.densify(_g()[0], _g()[1], 10)
    return _b(s, d).select("id", F.size(x).alias("n"), x[5]["x"].alias("mid"))


@query("st_precision", "SELECT id, ROUND(xmin / 7, 2) AS x FROM f_building WHERE CAST(xmin AS BIGINT) % 7 <> 0")
def st_precision(s, d):
    x = F.transform(_g(), lambda q: G.point(F.round(q["x"] / 7, 2), q["y"]))
    return _b(s, d).where("CAST(xmin AS BIGINT) % 7 <> 0").select("id", x[0]["x"].alias("x"))


@query("st_reverse", f"SELECT id, -1.0 * {_W} * {_L} AS signed FROM f_building".replace("-1.0", "CAST(-1 AS DOUBLE)"))
def st_reverse(s, d):
    return _b(s, d).select("id", G.signed_area(F.reverse(_g())).alias("signed"))


@query("st_rotate", f"SELECT id, {_L} AS width, {_W} AS height FROM f_building")
def st_rotate(s, d):
    b = _b(s, d).select("id", G.bounds(G.rotate(_g(), math.pi / 2)).alias("b"))
    return b.select("id", F.round(F.col("b.xmax") - F.col("b.xmin"), 6).alias("width"), F.round(F.col("b.ymax") - F.col("b.ymin"), 6).alias("height"))


@query("st_translate", "SELECT id, xmin + 100 AS xmin, ymin - 50 AS ymin FROM f_building")
def st_translate(s, d):
    b = _b(s, d).select("id", G.bounds(G.translate(_g(), 100.0, -50.0)).alias("b"))
    return b.select("id", "b.xmin", "b.ymin")


@query("st_scale", f"SELECT id, ROUND({_W} * {_L} * 0.85 * 0.85, 6) AS area FROM f_building")
def st_scale(s, d):
    x = G.scale(_g(), 0.85, (F.col("xmin") + F.col("xmax")) / 2, (F.col("ymin") + F.col("ymax")) / 2)
    return _b(s, d).select("id", r6(G.area(x), "area"))


_E = "0.0818191910428158"
_ISO = f"(ln(tan(pi() / 4 + radians(lat) / 2)) - {_E} / 2 * ln((1 + {_E} * sin(radians(lat))) / (1 - {_E} * sin(radians(lat)))))"


@query("st_transform", f"SELECT sid, ROUND(700000 + 11754255.426096 * exp(-0.725607765053267 * {_ISO}) * sin(0.725607765053267 * radians(lon - 3)), 4) AS x, ROUND(12655612.049876 - 11754255.426096 * exp(-0.725607765053267 * {_ISO}) * cos(0.725607765053267 * radians(lon - 3)), 4) AS y FROM f_station")
def st_transform(s, d):
    m = view(s, d, "f_station").select("sid", G.to_conic(F.col("lon"), F.col("lat")).alias("m"))
    return m.select("sid", F.round("m.x", 4).alias("x"), F.round("m.y", 4).alias("y"))


@query("st_transform_back", "SELECT sid, ROUND(lon, 8) AS lon, ROUND(lat, 8) AS lat FROM f_station")
def st_transform_back(s, d):
    m = view(s, d, "f_station").select("sid", G.to_mercator(F.col("lon"), F.col("lat")).alias("m")).select("sid", G.from_mercator(F.col("m.x"), F.col("m.y")).alias("p"))
    return m.select("sid", F.round("p.x", 8).alias("lon"), F.round("p.y", 8).alias("lat"))


@query("st_makeline", "SELECT tail, CAST(COUNT(*) AS BIGINT) AS n, MIN(head) AS first_head FROM f_edge GROUP BY tail")
def st_makeline(s, d):
    line = F.array_sort(F.collect_list(F.struct("head", "len")))
    return view(s, d, "f_edge").groupBy("tail").agg(line.alias("l")).select("tail", F.size("l").cast("long").alias("n"), F.col("l")[0]["head"].alias("first_head"))


@query("st_makeellipse", f"SELECT id, ROUND(50 * {_W} / 2 * {_L} / 2 * sin(2 * pi() / 100), 6) AS area FROM f_building")
def st_makeellipse(s, d):
    """Ellipses of 100 corners."""
    w, h = (F.col("xmax") - F.col("xmin")) / 2, (F.col("ymax") - F.col("ymin")) / 2
    ring = F.transform(G.circle(F.lit(0.0), F.lit(0.0), 1.0, 100), lambda p: G.point(p["x"] * w, p["y"] * h))
    return _b(s, d).select("id", r6(G.area(ring), "area"))


@query("st_makegridpoints", "SELECT CAST(i AS BIGINT) AS id_col, CAST(j AS BIGINT) AS id_row, CAST(i * 50 AS DOUBLE) AS x, CAST(j * 50 AS DOUBLE) AS y FROM (SELECT unnest(generate_series(0, 20)) AS i) a CROSS JOIN (SELECT unnest(generate_series(0, 25)) AS j) b")
def st_makegridpoints(s, d):
    g = s.range(21 * 26).select((F.col("id") % 21).alias("id_col"), F.floor(F.col("id") / 21).alias("id_row"))
    return g.withColumns({"x": F.col("id_col") * 50.0, "y": F.col("id_row") * 50.0})


@query("st_ends", "SELECT id, xmin AS start_x, ymax AS before_last_y FROM f_building")
def st_ends(s, d):
    return _b(s, d).select("id", F.element_at(_g(), 1)["x"].alias("start_x"), F.element_at(_g(), -2)["y"].alias("before_last_y"))


@query("st_tomultisegments", f"SELECT id, CAST(k + 1 AS INTEGER) AS explod_id, CASE WHEN k % 2 = 0 THEN {_W} ELSE {_L} END AS length FROM f_building CROSS JOIN (SELECT unnest(generate_series(0, 3)) AS k) g")
def st_tomultisegments(s, d):
    """Sides as rows, numbered from 1."""
    x = _b(s, d).select("id", F.posexplode(G.segments(_g())).alias("k", "g"))
    return x.select("id", (F.col("k") + 1).alias("explod_id"), G.distance(F.col("g.a"), F.col("g.b")).alias("length"))


@query("st_dimension", "SELECT zone_id, CAST(2 AS INTEGER) AS dim, CAST(len(regexp_extract_all(geometry, '\\(([-0-9][^()]*)\\)', 1)) AS INTEGER) AS rings FROM lcz_zones")
def st_dimension(s, d):
    """Dimension and number of rings of zones."""
    rings = F.expr(r"size(regexp_extract_all(geometry, '\\(([-0-9][^()]*)\\)', 1))")
    dim = F.when(F.col("geometry").contains("POLYGON"), 2).when(F.col("geometry").contains("LINE"), 1).otherwise(0)
    return view(s, d, "lcz_zones").select("zone_id", dim.alias("dim"), rings.alias("rings"))


@query("fn_hexagon", "SELECT id, ROUND(3 * sqrt(3) / 2 * 9, 6) AS area FROM f_building")
def fn_hexagon(s, d):
    return _b(s, d).select("id", r6(G.area(G.circle(F.col("xmin"), F.col("ymin"), 3.0, 6)), "area"))


@query("fn_circumscribed", f"SELECT id, ROUND(sqrt({_W} * {_W} + {_L} * {_L}) / 2, 6) AS radius FROM f_building")
def fn_circumscribed(s, d):
    """The circle about a ring's bounds."""
    c = G.point((F.col("xmin") + F.col("xmax")) / 2, (F.col("ymin") + F.col("ymax")) / 2)
    far = F.array_max(F.transform(_g(), lambda p: G.distance(p, c)))
    return _b(s, d).select("id", r6(far, "radius"))


@query("fn_geodesic_box", "SELECT sid, ROUND(lat + degrees(500 / 6371008.8), 8) AS north, ROUND(lon + degrees(500 / 6371008.8 / cos(radians(lat))), 8) AS east FROM f_station")
def fn_geodesic_box(s, d):
    """500 m to the north and to the east, on the sphere."""
    a = 500 / 6371008.8
    return view(s, d, "f_station").select("sid", F.round(F.col("lat") + math.degrees(a), 8).alias("north"), F.round(F.col("lon") + F.degrees(a / F.cos(F.radians("lat"))), 8).alias("east"))


@query("fn_haversine", "SELECT sid, ROUND(2 * 6371008.8 * asin(sqrt(pow(sin(radians(48 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(48)) * pow(sin(radians(2 - lon) / 2), 2))), 3) AS metres FROM f_station")
def fn_haversine(s, d):
    return view(s, d, "f_station").select("sid", F.round(G.haversine(F.col("lon"), F.col("lat"), F.lit(2.0), F.lit(48.0)), 3).alias("metres"))


_Q, _R2 = "((sqrt(3.0) / 3 * x - y / 3) / 10)", "(2.0 / 3 * y / 10)"


@query("fn_hex_index", f"WITH f AS (SELECT oid, lno, {_Q} AS q, {_R2} AS r FROM f_point), c AS (SELECT *, round_even(q, 0) AS rq, round_even(r, 0) AS rr, round_even(-q - r, 0) AS rs FROM f) SELECT oid, lno, CAST(CASE WHEN abs(rq - q) > abs(rr - r) AND abs(rq - q) > abs(rs + q + r) THEN -rr - rs ELSE rq END AS BIGINT) AS hex_q, CAST(CASE WHEN abs(rq - q) > abs(rr - r) AND abs(rq - q) > abs(rs + q + r) THEN rr WHEN abs(rr - r) > abs(rs + q + r) THEN -rq - rs ELSE rr END AS BIGINT) AS hex_r FROM c")
def fn_hex_index(s, d):
    """Axial hexagons of 10 m: a planar index of this repository, not the public hexagon system."""
    x = view(s, d, "f_point").select("oid", "lno", ((math.sqrt(3.0) / 3 * F.col("x") - F.col("y") / 3) / 10).alias("q"), (2.0 / 3 * F.col("y") / 10).alias("r"))
    x = x.withColumns({"rq": F.rint("q"), "rr": F.rint("r"), "rs": F.rint(-F.col("q") - F.col("r"))})
    dq, dr, ds = F.abs(F.col("rq") - F.col("q")), F.abs(F.col("rr") - F.col("r")), F.abs(F.col("rs") + F.col("q") + F.col("r"))
    first = (dq > dr) & (dq > ds)
    q = F.when(first, -F.col("rr") - F.col("rs")).otherwise(F.col("rq"))
    r = F.when(~first & (dr > ds), -F.col("rq") - F.col("rs")).otherwise(F.col("rr"))
    return x.select("oid", "lno", q.cast("long").alias("hex_q"), r.cast("long").alias("hex_r"))


QUERIES, ORACLES = book.queries, book.oracles
