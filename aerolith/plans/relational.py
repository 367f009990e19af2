"""Projections, filters, joins, aggregations, windows and set operations on layers, as plain Spark plans."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.lookups import LANDCOVER_CODES, LANDCOVER_COLOURS, LANDCOVER_NAMES, case, lookup
from ..operators import joins as J
from .base import Book, view

book = Book()
query = book.query
B = "f_building"


# Projections and filters ---------------------------------------------------------------------------------------------------------------


@query("proj_columns", "SELECT id, hauteur FROM f_building")
def proj_columns(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, B).select("id", "hauteur")


@query("proj_drop_datetime", "SELECT event_id, user_id, CAST(year(ts) AS INTEGER) AS ts_year FROM events")
def proj_drop_datetime(s: SparkSession, d: str) -> DataFrame:
    """Timestamps replaced by their year, found from the schema."""
    e = view(s, d, "events").select("event_id", "user_id", "ts")
    times = [f.name for f in e.schema if f.dataType.typeName().startswith(("timestamp", "date"))]
    return e.withColumns({f"{c}_year": F.year(c) for c in times}).drop(*times)


@query("proj_literal", "SELECT id, 'tree' AS type, CAST(6.0 AS DOUBLE) AS height, CAST(0.3 AS DOUBLE) AS trunk_zone, CAST(4.0 AS DOUBLE) AS diameter FROM f_landcover WHERE class_id IN (8, 9)")
def proj_literal(s: SparkSession, d: str) -> DataFrame:
    t = view(s, d, "f_landcover").where(F.col("class_id").isin(8, 9))
    return t.select("id", F.lit("tree").alias("type"), F.lit(6.0).alias("height"), F.lit(0.3).alias("trunk_zone"), F.lit(4.0).alias("diameter"))


@query("proj_dict_map", f"SELECT id, class_id, {case('class_id', LANDCOVER_NAMES)} AS class_name, CAST({case('class_id', LANDCOVER_CODES)} AS INTEGER) AS code, {case('class_id', LANDCOVER_COLOURS)} AS colour FROM f_landcover")
def proj_dict_map(s: SparkSession, d: str) -> DataFrame:
    t = view(s, d, "f_landcover")
    return t.select("id", "class_id", lookup(F.col("class_id"), LANDCOVER_NAMES).alias("class_name"), lookup(F.col("class_id"), LANDCOVER_CODES).alias("code"), lookup(F.col("class_id"), LANDCOVER_COLOURS).alias("colour"))


_FILL = """
WITH m AS (SELECT SUM((xmax - xmin) * (ymax - ymin) * hauteur) / SUM((xmax - xmin) * (ymax - ymin)) AS mean_h FROM f_building)
SELECT id, ROUND(CASE WHEN hauteur IS NOT NULL THEN hauteur WHEN nombre_d_etages IS NOT NULL THEN CAST(3.0 AS DOUBLE) * nombre_d_etages ELSE mean_h END, 6) AS height FROM f_building, m"""


def _filled(s: SparkSession, d: str) -> DataFrame:
    b = view(s, d, B).withColumn("area", (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin")))
    mean = b.agg((F.sum(F.col("area") * F.col("hauteur")) / F.sum("area")).alias("mean_h"))
    return b.crossJoin(F.broadcast(mean)).select("id", F.round(F.coalesce("hauteur", 3.0 * F.col("nombre_d_etages"), "mean_h"), 6).alias("height"))


@query("proj_coalesce_case", _FILL)
def proj_coalesce_case(s: SparkSession, d: str) -> DataFrame:
    """Heights: the given one, else three metres a storey, else the district's area-weighted mean (one row, so it may be broadcast)."""
    return _filled(s, d)


@query("building_height_fill", _FILL)
def building_height_fill(s: SparkSession, d: str) -> DataFrame:
    return _filled(s, d)


@query("proj_rename_defaults", "SELECT id AS id_veg, hauteur AS max_height, COALESCE(0.25 * hauteur, CAST(0 AS DOUBLE)) AS min_height, CAST(1.0 AS DOUBLE) AS attenuatio FROM f_building WHERE hauteur IS NOT NULL")
def proj_rename_defaults(s: SparkSession, d: str) -> DataFrame:
    v = view(s, d, B).where("hauteur IS NOT NULL").withColumnsRenamed({"id": "id_veg", "hauteur": "max_height"})
    return v.select("id_veg", "max_height", F.coalesce(0.25 * F.col("max_height"), F.lit(0.0)).alias("min_height"), F.lit(1.0).alias("attenuatio"))


@query("filter_min_height", "SELECT id, CAST(ROUND(hauteur) AS INTEGER) AS height FROM f_building WHERE hauteur > 5.5")
def filter_min_height(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, B).where("hauteur > 5.5").select("id", F.round("hauteur").cast("int").alias("height"))


@query("filter_geom_type", "SELECT zone_id, lcz_int FROM lcz_zones WHERE geometry LIKE 'POLYGON%'")
def filter_geom_type(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "lcz_zones").where(F.col("geometry").startswith("POLYGON")).select("zone_id", "lcz_int")


@query("filter_area", "SELECT id, (xmax - xmin) * (ymax - ymin) AS area FROM f_building WHERE (xmax - xmin) * (ymax - ymin) > 100")
def filter_area(s: SparkSession, d: str) -> DataFrame:
    b = G.with_box(view(s, d, B))
    return b.select("id", G.area(F.col("geom")).alias("area")).where("area > 100")


@query("filter_time_slice", "SELECT ts_h, td FROM f_weather WHERE ts_h BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-10 12:00:00'")
def filter_time_slice(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "f_weather").where(F.col("ts_h").between(F.lit("2024-01-05 00:00:00").cast("timestamp_ntz"), F.lit("2024-01-10 12:00:00").cast("timestamp_ntz"))).select("ts_h", "td")


@query("filter_hour_range", "SELECT ts_h, kdn FROM f_weather WHERE hour(ts_h) > 8 AND hour(ts_h) < 22")
def filter_hour_range(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "f_weather").where((F.hour("ts_h") > 8) & (F.hour("ts_h") < 22)).select("ts_h", "kdn")


@query("filter_enum", "SELECT id, class_id FROM f_landcover WHERE class_id IN (3, 5, 8)")
def filter_enum(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "f_landcover").where(F.col("class_id").isin(3, 5, 8)).select("id", "class_id")


@query("filter_bbox_points", "SELECT oid, lno, x, y, z FROM f_point WHERE x BETWEEN 20 AND 120 AND y BETWEEN 40 AND 90 AND z BETWEEN -10 AND 5000")
def filter_bbox_points(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "f_point").where("x BETWEEN 20 AND 120 AND y BETWEEN 40 AND 90 AND z BETWEEN -10 AND 5000").select("oid", "lno", "x", "y", "z")


_SEGMENTS = """
WITH seg AS (
  SELECT id, 1 AS k, xmin AS x1, ymin AS y1, xmin AS x2, ymax AS y2 FROM f_building UNION ALL
  SELECT id, 2, xmin, ymax, xmax, ymax FROM f_building UNION ALL SELECT id, 3, xmax, ymax, xmax, ymin FROM f_building UNION ALL SELECT id, 4, xmax, ymin, xmin, ymin FROM f_building),
az AS (SELECT id, k, CASE WHEN atan2(x2 - x1, y2 - y1) < 0 THEN atan2(x2 - x1, y2 - y1) + 2 * pi() ELSE atan2(x2 - x1, y2 - y1) END AS azimuth, sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)) AS len FROM seg)
"""


def _segments(s: SparkSession, d: str) -> DataFrame:
    """The four sides of each box, clockwise, as rows with azimuth and length."""
    b = G.with_box(view(s, d, B), clockwise=True)
    seg = b.select("id", F.posexplode(G.segments(F.col("geom"))).alias("k0", "g"))
    return seg.select("id", (F.col("k0") + 1).alias("k"), G.azimuth(F.col("g.a"), F.col("g.b")).alias("azimuth"), G.distance(F.col("g.a"), F.col("g.b")).alias("len"))


@query("filter_facade_upwind", _SEGMENTS + "SELECT id, k, ROUND(azimuth, 6) AS azimuth, len FROM az WHERE azimuth > 0.000001 AND azimuth < pi() - 0.000001")
def filter_facade_upwind(s: SparkSession, d: str) -> DataFrame:
    return _segments(s, d).where((F.col("azimuth") > 1e-6) & (F.col("azimuth") < math.pi - 1e-6)).withColumn("azimuth", F.round("azimuth", 6))


@query("filter_facade_downwind", _SEGMENTS + "SELECT id, k, ROUND(azimuth, 6) AS azimuth, len FROM az WHERE azimuth > pi() + 0.000001")
def filter_facade_downwind(s: SparkSession, d: str) -> DataFrame:
    return _segments(s, d).where(F.col("azimuth") > math.pi + 1e-6).withColumn("azimuth", F.round("azimuth", 6))


@query("filter_angle_band", "SELECT ts_h, wd FROM f_weather WHERE radians(wd) BETWEEN radians(30) AND radians(70)")
def filter_angle_band(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "f_weather").where(F.radians("wd").between(F.radians(F.lit(30)), F.radians(F.lit(70)))).select("ts_h", "wd")


@query("filter_notnull", "SELECT id, hauteur, nombre_d_etages FROM f_building WHERE hauteur IS NOT NULL AND nombre_d_etages IS NOT NULL")
def filter_notnull(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, B).select("id", "hauteur", "nombre_d_etages").na.drop(subset=["hauteur", "nombre_d_etages"])


@query("subquery_scalar", "SELECT id, hauteur FROM f_building WHERE hauteur = (SELECT MAX(hauteur) FROM f_building)")
def subquery_scalar(s: SparkSession, d: str) -> DataFrame:
    b = view(s, d, B).select("id", "hauteur")
    return b.join(F.broadcast(b.agg(F.max("hauteur").alias("top"))), F.col("hauteur") == F.col("top")).select("id", "hauteur")


# Joins ---------------------------------------------------------------------------------------------------------------------------------


@query("join_equi_left", "SELECT c.id, c.class_id, b.hauteur FROM f_landcover c LEFT JOIN f_building b ON c.id = b.id")
def join_equi_left(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "f_landcover").select("id", "class_id").join(view(s, d, B).select("id", "hauteur"), "id", "left")


@query("join_equi_right", "SELECT b.id, b.hauteur, c.class_id FROM f_landcover c RIGHT JOIN f_building b ON c.id = b.id")
def join_equi_right(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "f_landcover").select("id", "class_id").join(view(s, d, B).select("id", "hauteur"), "id", "right").select("id", "hauteur", "class_id")


@query("join_anti_null", "SELECT b.id, b.hauteur FROM f_building b LEFT JOIN f_landcover c ON b.id = c.id AND c.class_id > 5 WHERE c.id IS NULL")
def join_anti_null(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, B).select("id", "hauteur").join(view(s, d, "f_landcover").where("class_id > 5").select("id"), "id", "left_anti")


@query("join_semi", "SELECT id, hauteur FROM f_building WHERE id IN (SELECT id FROM f_landcover WHERE class_id > 5)")
def join_semi(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, B).select("id", "hauteur").join(view(s, d, "f_landcover").where("class_id > 5").select("id"), "id", "left_semi")


@query("join_self_stack", "SELECT a.id AS upper_id, b.id AS lower_id FROM f_building a JOIN f_building b ON a.xmin = b.xmin AND a.hauteur > b.hauteur + 20 AND abs(a.ymin - b.ymin) <= 100")
def join_self_stack(s: SparkSession, d: str) -> DataFrame:
    b = view(s, d, B).select("id", "xmin", "ymin", "hauteur")
    a = b.alias("a")
    on = (F.col("a.xmin") == F.col("b.xmin")) & (F.col("a.hauteur") > F.col("b.hauteur") + 20) & (F.abs(F.col("a.ymin") - F.col("b.ymin")) <= 100)
    return a.join(b.alias("b"), on).select(F.col("a.id").alias("upper_id"), F.col("b.id").alias("lower_id"))


@query("join_self_theta", "SELECT a.id AS a_id, b.id AS b_id FROM f_building a JOIN f_building b ON a.xmin = b.xmin AND a.ymin < b.ymin AND b.ymin <= a.ymin + 200 AND b.hauteur > a.hauteur + GREATEST(CAST(5 AS DOUBLE), 0.1 * (b.ymin - a.ymin))")
def join_self_theta(s: SparkSession, d: str) -> DataFrame:
    b = view(s, d, B).select("id", "xmin", "ymin", "hauteur")
    gap = F.col("b.ymin") - F.col("a.ymin")
    on = (F.col("a.xmin") == F.col("b.xmin")) & (gap > 0) & (gap <= 200) & (F.col("b.hauteur") > F.col("a.hauteur") + F.greatest(F.lit(5.0), 0.1 * gap))
    return b.alias("a").join(b.alias("b"), on).select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"))


@query("join_spatial_intersects", "SELECT b.id AS building_id, c.id AS tile_id FROM f_building b JOIN f_landcover c ON b.xmin <= c.xmax AND b.xmax >= c.xmin AND b.ymin <= c.ymax AND b.ymax >= c.ymin")
def join_spatial_intersects(s: SparkSession, d: str) -> DataFrame:
    """Boxes onto the cells that they touch, an equi-join on cells, each pair kept in one cell only, then the exact test."""
    return J.boxes_that_meet(view(s, d, B), view(s, d, "f_landcover"), 64.0).select(F.col("a.id").alias("building_id"), F.col("b.id").alias("tile_id"))


@query("join_point_in_polygon", "SELECT p.oid, p.lno, b.id AS building_id FROM f_point p JOIN f_building b ON p.x >= b.xmin AND p.x < b.xmax AND p.y >= b.ymin AND p.y < b.ymax")
def join_point_in_polygon(s: SparkSession, d: str) -> DataFrame:
    pts, boxes = view(s, d, "f_point").select("oid", "lno", "x", "y"), G.with_box(view(s, d, B))
    inside = J.points_in_cells(pts, boxes, 32.0).where(G.contains(F.col("geom"), F.col("x"), F.col("y")))
    return inside.select("oid", "lno", F.col("id").alias("building_id"))


@query("join_line_zone_cut", "SELECT CAST(g.i AS BIGINT) AS line, b.id, b.ymax AS y_wall, b.ymax - b.ymin AS cut_length FROM f_building b JOIN (SELECT unnest(generate_series(0, 250)) AS i) g ON g.i * 5 + 2.5 > b.xmin AND g.i * 5 + 2.5 < b.xmax")
def join_line_zone_cut(s: SparkSession, d: str) -> DataFrame:
    """Vertical grid lines through polygons: each polygon generates the lines that cross it; crossings from its edges."""
    b = G.with_box(view(s, d, B))
    k = F.sequence(F.ceil((F.col("xmin") - 2.5) / 5), F.floor((F.col("xmax") - 2.5) / 5))
    lines = b.where(F.ceil((F.col("xmin") - 2.5) / 5) <= F.floor((F.col("xmax") - 2.5) / 5)).select("id", "geom", F.explode(k).alias("line"))
    ys = G.vertical_crossings(F.col("geom"), F.col("line") * 5 + 2.5)
    cut = lines.select("line", "id", F.array_max(ys).alias("y_wall"), (F.array_max(ys) - F.array_min(ys)).alias("cut_length"))
    return cut.where("cut_length > 0")


@query("join_cross_levels", "SELECT b.id, CAST(g.k AS BIGINT) AS id_z, CAST(g.k * 2.0 + 1.0 AS DOUBLE) AS z FROM f_building b JOIN (SELECT unnest(generate_series(0, 40)) AS k) g ON g.k * 2.0 + 1.0 < b.hauteur")
def join_cross_levels(s: SparkSession, d: str) -> DataFrame:
    """Points times height levels below their top: the levels are generated, not joined."""
    b = view(s, d, B).where("hauteur > 1").select("id", "hauteur")
    top = F.least(F.ceil((F.col("hauteur") - 1.0) / 2.0) - 1, F.lit(40))
    return b.select("id", F.explode(F.sequence(F.lit(0).cast("long"), top)).alias("id_z")).withColumn("z", F.col("id_z") * 2.0 + 1.0)


@query(
    "join_spatial_nearest",
    """SELECT id, near_id, ROUND(dist, 6) AS dist FROM (SELECT c.id, b.id AS near_id, sqrt(pow((c.xmin+c.xmax)/2-(b.xmin+b.xmax)/2,2)+pow((c.ymin+c.ymax)/2-(b.ymin+b.ymax)/2,2)) AS dist,
       row_number() OVER (PARTITION BY c.id ORDER BY ROUND(sqrt(pow((c.xmin+c.xmax)/2-(b.xmin+b.xmax)/2,2)+pow((c.ymin+c.ymax)/2-(b.ymin+b.ymax)/2,2)), 9), b.id) AS k FROM f_landcover c JOIN f_building b
       ON abs((c.xmin+c.xmax)/2-(b.xmin+b.xmax)/2) <= 100 AND abs((c.ymin+c.ymax)/2-(b.ymin+b.ymax)/2) <= 100) t WHERE k = 1 AND dist <= 100""",
)
def join_spatial_nearest(s: SparkSession, d: str) -> DataFrame:
    mid = lambda t: t.select("id", ((F.col("xmin") + F.col("xmax")) / 2).alias("x"), ((F.col("ymin") + F.col("ymax")) / 2).alias("y"))
    return J.nearest_within(mid(view(s, d, "f_landcover")), mid(view(s, d, B)), 100.0).withColumn("dist", F.round("dist", 6))


@query("join_knn_k", "SELECT sid, ROUND(sqrt(pow(lat - 46.5, 2) + pow(lon - 2.5, 2)), 6) AS dist FROM f_station ORDER BY sqrt(pow(lat - 46.5, 2) + pow(lon - 2.5, 2)), sid LIMIT 5")
def join_knn_k(s: SparkSession, d: str) -> DataFrame:
    dist = F.sqrt(F.pow(F.col("lat") - 46.5, 2) + F.pow(F.col("lon") - 2.5, 2))
    return view(s, d, "f_station").orderBy(dist, "sid").limit(5).select("sid", F.round(dist, 6).alias("dist"))


_NEAR_STATION = """SELECT id, sid FROM (SELECT q.id, s.sid, row_number() OVER (PARTITION BY q.id ORDER BY ROUND(pow(s.lat - q.lat, 2) + pow(s.lon - q.lon, 2), 9), s.sid) AS k
 FROM (SELECT id, 42.0 + (id % 90) / 10.0 AS lat, -4.0 + (id % 120) / 10.0 AS lon FROM f_landcover) q CROSS JOIN f_station s) t WHERE k = 1"""


@query("join_nearest_station", _NEAR_STATION)
def join_nearest_station(s: SparkSession, d: str) -> DataFrame:
    """Nearest station in degrees, by growing rings of cells, ties to the smaller id."""
    q = view(s, d, "f_landcover").select("id", (42.0 + (F.col("id") % 90) / 10.0).alias("y"), (-4.0 + (F.col("id") % 120) / 10.0).alias("x"))
    st = view(s, d, "f_station").select(F.col("sid").alias("id"), F.col("lat").alias("y"), F.col("lon").alias("x"))
    return J.nearest_any(q, st, 1.0).select("id", F.col("near_id").alias("sid"))


@query(
    "join_nearest_value",
    "SELECT ts_h, wd, CAST(dir AS BIGINT) AS direction FROM (SELECT w.ts_h, w.wd, g.dir, row_number() OVER (PARTITION BY w.ts_h ORDER BY abs(w.wd - g.dir), g.dir) AS k FROM f_weather w CROSS JOIN (SELECT unnest(generate_series(0, 350, 10)) AS dir) g) t WHERE k = 1",
)
def join_nearest_value(s: SparkSession, d: str) -> DataFrame:
    """The nearest of the directions 0, 10 .. 350 (not circular; of two as near, the smaller): arithmetic, no join."""
    down = F.floor(F.col("wd") / 10) * 10
    near = F.when(F.col("wd") - down <= 5, down).otherwise(down + 10)
    return view(s, d, "f_weather").select("ts_h", "wd", F.least(near, F.lit(350)).alias("direction"))


@query("join_interval_bounds", "SELECT w.ts_h, w.td, (SELECT MAX(v) FROM (VALUES (10.0), (15.0), (20.0), (25.0), (30.0)) t(v) WHERE v < w.td)::DOUBLE AS lower, (SELECT MIN(v) FROM (VALUES (10.0), (15.0), (20.0), (25.0), (30.0)) t(v) WHERE v > w.td)::DOUBLE AS upper FROM f_weather w")
def join_interval_bounds(s: SparkSession, d: str) -> DataFrame:
    steps = F.array(*[F.lit(float(v)) for v in (10, 15, 20, 25, 30)])
    return view(s, d, "f_weather").select("ts_h", "td", F.array_max(F.filter(steps, lambda v: v < F.col("td"))).alias("lower"), F.array_min(F.filter(steps, lambda v: v > F.col("td"))).alias("upper"))


@query(
    "join_radius",
    "SELECT v.oid, v.lno, CAST(COUNT(*) AS BIGINT) AS n_ground, CAST(SUM(CASE WHEN g.z >= v.z THEN 1 ELSE 0 END) AS BIGINT) AS n_above FROM f_point v JOIN f_point g ON g.cls = 2 AND pow(v.x - g.x, 2) + pow(v.y - g.y, 2) <= 4 WHERE v.cls = 5 GROUP BY v.oid, v.lno",
)
def join_radius(s: SparkSession, d: str) -> DataFrame:
    p = view(s, d, "f_point")
    veg = p.where("cls = 5").select("oid", "lno", "x", "y", "z")
    near = J.within(veg, p.where("cls = 2").select("x", "y", "z"), 2.0)
    return near.groupBy(F.col("a.oid").alias("oid"), F.col("a.lno").alias("lno")).agg(F.count("*").alias("n_ground"), F.count_if(F.col("b.z") >= F.col("a.z")).alias("n_above"))


@query("join_time_align", "SELECT a.ts_h, a.td, b.kdn FROM f_weather a JOIN f_weather b ON a.ts_h = b.ts_h WHERE b.kdn > 100")
def join_time_align(s: SparkSession, d: str) -> DataFrame:
    w = view(s, d, "f_weather")
    return w.select("ts_h", "td").join(w.where("kdn > 100").select("ts_h", "kdn"), "ts_h")


@query("join_merge_left", "SELECT e.tail, e.head, t.z AS z_tail, h.z AS z_head FROM f_edge e LEFT JOIN (SELECT id AS n, hauteur AS z FROM f_building) t ON e.tail = t.n LEFT JOIN (SELECT id AS n, hauteur AS z FROM f_building) h ON e.head = h.n")
def join_merge_left(s: SparkSession, d: str) -> DataFrame:
    nodes = view(s, d, B)
    e = view(s, d, "f_edge").select("tail", "head")
    return e.join(nodes.select(F.col("id").alias("tail"), F.col("hauteur").alias("z_tail")), "tail", "left").join(nodes.select(F.col("id").alias("head"), F.col("hauteur").alias("z_head")), "head", "left")


_OCCUPANCY = """
WITH b AS (SELECT class_id AS k, SUM((xmax-xmin)*(ymax-ymin)) AS a FROM f_landcover GROUP BY class_id), f AS (SELECT CASE WHEN class_id > 12 THEN 20 ELSE class_id + id % 2 END AS k, SUM((xmax-xmin)*(ymax-ymin)) AS a FROM f_landcover GROUP BY 1)
SELECT COALESCE(b.k, f.k) AS class_id, COALESCE(b.a, 0) AS before_area, COALESCE(f.a, 0) AS after_area, ROUND(100 * COALESCE(b.a, 0) / (SELECT SUM(a) FROM b), 6) AS before_pct, ROUND(100 * COALESCE(f.a, 0) / (SELECT SUM(a) FROM b), 6) AS after_pct FROM b FULL JOIN f ON b.k = f.k"""


def _occupancy(s: SparkSession, d: str) -> DataFrame:
    """Areas by class before and after; both percentages over the area before."""
    c = view(s, d, "f_landcover").withColumn("area", (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin")))
    after = F.when(F.col("class_id") > 12, F.lit(20).cast("long")).otherwise(F.col("class_id") + F.col("id") % 2)
    one = lambda k, n: c.groupBy(k.alias("class_id")).agg(F.sum("area").alias(n))
    both = one(F.col("class_id"), "before_area").join(one(after, "after_area"), "class_id", "full").na.fill(0.0)
    total = F.broadcast(c.agg(F.sum("area").alias("total")))
    return both.crossJoin(total).select("class_id", "before_area", "after_area", F.round(100 * F.col("before_area") / F.col("total"), 6).alias("before_pct"), F.round(100 * F.col("after_area") / F.col("total"), 6).alias("after_pct"))


@query("join_merge_outer", _OCCUPANCY)
def join_merge_outer(s: SparkSession, d: str) -> DataFrame:
    return _occupancy(s, d)


@query("land_occupancy", _OCCUPANCY)
def land_occupancy(s: SparkSession, d: str) -> DataFrame:
    return _occupancy(s, d)


@query("join_merge_inner", "SELECT b.id, b.hauteur, c.class_id FROM f_building b JOIN f_landcover c ON b.id = c.id")
def join_merge_inner(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, B).select("id", "hauteur").join(view(s, d, "f_landcover").select("id", "class_id"), "id")


@query("join_concat_cols", "SELECT COALESCE(b.id, c.id) AS id, b.hauteur, c.class_id FROM f_building b FULL JOIN f_landcover c ON b.id = c.id WHERE b.hauteur IS NOT NULL AND c.class_id IS NOT NULL")
def join_concat_cols(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, B).select("id", "hauteur").join(view(s, d, "f_landcover").select("id", "class_id"), "id", "full").na.drop()


# Aggregations --------------------------------------------------------------------------------------------------------------------------


@query("agg_group_min_max", "SELECT xmin, MIN(hauteur) AS lo, MAX(hauteur) AS hi, CAST(COUNT(*) AS BIGINT) AS n FROM f_building GROUP BY xmin")
def agg_group_min_max(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, B).groupBy("xmin").agg(F.min("hauteur").alias("lo"), F.max("hauteur").alias("hi"), F.count("*").alias("n"))


@query("agg_veg_min_factor", "SELECT x, y, MIN(f) AS factor FROM (SELECT floor(x) AS x, floor(y) AS y, z / 60 AS f FROM f_point WHERE cls = 4 UNION ALL SELECT floor(x), floor(y), z / 50 FROM f_point WHERE cls = 5) t GROUP BY x, y")
def agg_veg_min_factor(s: SparkSession, d: str) -> DataFrame:
    p = view(s, d, "f_point")
    one = lambda c, top: p.where(F.col("cls") == c).select(F.floor("x").cast("double").alias("x"), F.floor("y").cast("double").alias("y"), (F.col("z") / top).alias("f"))
    return one(4, 60).unionByName(one(5, 50)).groupBy("x", "y").agg(F.min("f").alias("factor"))


@query("agg_veg_max_canopy", "SELECT floor(x) AS x, floor(y) AS y, MAX(z) AS canopy FROM f_point WHERE cls IN (3, 4, 5) GROUP BY floor(x), floor(y)")
def agg_veg_max_canopy(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "f_point").where("cls IN (3, 4, 5)").groupBy(F.floor("x").cast("double").alias("x"), F.floor("y").cast("double").alias("y")).agg(F.max("z").alias("canopy"))


_EXTENT = "SELECT MIN(xmin) AS xmin, MIN(ymin) AS ymin, MAX(xmax) AS xmax, MAX(ymax) AS ymax FROM f_building"


@query("agg_extent", _EXTENT)
def agg_extent(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, B).agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"))


@query("bbox_of_layer", _EXTENT)
def bbox_of_layer(s: SparkSession, d: str) -> DataFrame:
    g = G.with_box(view(s, d, B)).select(G.bounds(F.col("geom")).alias("b"))
    return g.agg(F.min("b.xmin").alias("xmin"), F.min("b.ymin").alias("ymin"), F.max("b.xmax").alias("xmax"), F.max("b.ymax").alias("ymax"))


@query("agg_geo_mean_height", "SELECT ROUND(exp(SUM((xmax-xmin)*(ymax-ymin)*ln(hauteur)) / SUM((xmax-xmin)*(ymax-ymin))), 6) AS h_r, MAX(hauteur) AS h_max FROM f_building WHERE hauteur IS NOT NULL")
def agg_geo_mean_height(s: SparkSession, d: str) -> DataFrame:
    b = G.with_box(view(s, d, B).where("hauteur IS NOT NULL")).withColumn("a", G.area(F.col("geom")))
    return b.agg(F.round(F.exp(F.sum(F.col("a") * F.ln("hauteur")) / F.sum("a")), 6).alias("h_r"), F.max("hauteur").alias("h_max"))


@query("agg_frontal_density", "SELECT ROUND(SUM((xmax - xmin) * hauteur) / ((MAX(xmax) - MIN(xmin)) * (MAX(ymax) - MIN(ymin))), 6) AS lambda_f FROM f_building WHERE hauteur IS NOT NULL")
def agg_frontal_density(s: SparkSession, d: str) -> DataFrame:
    b = view(s, d, B).where("hauteur IS NOT NULL")
    return b.agg(F.round(F.sum((F.col("xmax") - F.col("xmin")) * F.col("hauteur")) / ((F.max("xmax") - F.min("xmin")) * (F.max("ymax") - F.min("ymin"))), 6).alias("lambda_f"))


@query("agg_weighted_mean_height", "SELECT ROUND(SUM((xmax-xmin)*(ymax-ymin)*hauteur) / SUM((xmax-xmin)*(ymax-ymin)), 6) AS mean_height FROM f_building")
def agg_weighted_mean_height(s: SparkSession, d: str) -> DataFrame:
    a = (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))
    return view(s, d, B).agg(F.round(F.sum(a * F.col("hauteur")) / F.sum(a), 6).alias("mean_height"))


@query("agg_area_weighted_rsu", "SELECT CAST(id % 10 AS BIGINT) AS block, ROUND(SUM(a*hauteur)/SUM(CASE WHEN hauteur IS NOT NULL THEN a END), 6) AS mean_height, ROUND(SUM(a)/CAST(COUNT(*)*625 AS DOUBLE), 6) AS built FROM (SELECT *, (xmax-xmin)*(ymax-ymin) AS a FROM f_building) t GROUP BY id % 10")
def agg_area_weighted_rsu(s: SparkSession, d: str) -> DataFrame:
    b = view(s, d, B).withColumn("a", (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin")))
    return b.groupBy((F.col("id") % 10).alias("block")).agg(F.round(F.sum(F.col("a") * F.col("hauteur")) / F.sum(F.when(F.col("hauteur").isNotNull(), F.col("a"))), 6).alias("mean_height"), F.round(F.sum("a") / (F.count("*") * 625.0), 6).alias("built"))


@query("agg_sum_by_class", "SELECT class_id, SUM((xmax-xmin)*(ymax-ymin)) AS area FROM f_landcover GROUP BY class_id")
def agg_sum_by_class(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "f_landcover").groupBy("class_id").agg(F.sum((F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))).alias("area"))


@query("agg_distinct_heights", "SELECT DISTINCT CAST(hauteur AS INTEGER) AS height FROM f_building WHERE hauteur IS NOT NULL")
def agg_distinct_heights(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, B).where("hauteur IS NOT NULL").select(F.col("hauteur").cast("int").alias("height")).distinct()


@query("agg_monthly", "SELECT date_trunc('month', ts_h)::TIMESTAMP AS month, ROUND(AVG(td), 6) AS t_mean, MIN(td) AS t_min, MAX(td) AS t_max FROM f_weather GROUP BY date_trunc('month', ts_h)")
def agg_monthly(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "f_weather").groupBy(F.date_trunc("month", "ts_h").cast("timestamp_ntz").alias("month")).agg(F.round(F.avg("td"), 6).alias("t_mean"), F.min("td").alias("t_min"), F.max("td").alias("t_max"))


@query("agg_first_per_key", "SELECT CAST(o_custkey AS BIGINT) AS k, MIN(o_orderkey)::BIGINT AS first_key FROM orders GROUP BY o_custkey")
def agg_first_per_key(s: SparkSession, d: str) -> DataFrame:
    o = view(s, d, "orders").select(F.col("o_custkey").cast("long").alias("k"), F.col("o_orderkey").cast("long").alias("o_orderkey"))
    return o.groupBy("k").agg(F.min_by("o_orderkey", "o_orderkey").alias("first_key"))


@query("agg_nanmean", "SELECT site_id, CAST(COUNT(*) AS BIGINT) AS n, ROUND(AVG(utci), 6) AS utci_mean FROM comfort_cells WHERE utci IS NOT NULL AND NOT isnan(utci) AND utci <> -9999 GROUP BY site_id")
def agg_nanmean(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "comfort_cells").where("utci IS NOT NULL AND NOT isnan(utci) AND utci <> -9999").groupBy("site_id").agg(F.count("*").alias("n"), F.round(F.avg("utci"), 6).alias("utci_mean"))


@query("agg_value_counts", "SELECT site_id, time, ROUND(CASE WHEN COUNT(*) FILTER (shadow IN (0, 1)) = 0 THEN 1.0 ELSE COUNT(*) FILTER (shadow = 0) / CAST(COUNT(*) FILTER (shadow IN (0, 1)) AS DOUBLE) END, 6) AS shaded FROM comfort_cells GROUP BY site_id, time")
def agg_value_counts(s: SparkSession, d: str) -> DataFrame:
    """Share of shaded cells (shadow 0) among those known; 1 where none is."""
    dark, known = F.count_if(F.col("shadow") == 0), F.count_if(F.col("shadow").isin(0.0, 1.0))
    return view(s, d, "comfort_cells").groupBy("site_id", "time").agg(F.round(F.when(known == 0, 1.0).otherwise(F.try_divide(dark, known)), 6).alias("shaded"))


@query("agg_bin2d_max_min", "SELECT CAST(floor(x) AS BIGINT) AS col, CAST(floor(y) AS BIGINT) AS row, MAX(CASE WHEN cls IN (3,4,5) THEN z END) AS veg_max, MIN(CASE WHEN cls = 2 THEN z END) AS ground_min FROM f_point GROUP BY floor(x), floor(y)")
def agg_bin2d_max_min(s: SparkSession, d: str) -> DataFrame:
    p = view(s, d, "f_point")
    return p.groupBy(F.floor("x").alias("col"), F.floor("y").alias("row")).agg(F.max(F.when(F.col("cls").isin(3, 4, 5), F.col("z"))).alias("veg_max"), F.min(F.when(F.col("cls") == 2, F.col("z"))).alias("ground_min"))


@query("agg_shab", "SELECT CAST(SUM(GREATEST(CAST(floor(COALESCE(hauteur, 3) / 3) AS INTEGER), 1) * (xmax-xmin)*(ymax-ymin)) AS DOUBLE) AS shab FROM f_building")
def agg_shab(s: SparkSession, d: str) -> DataFrame:
    floors = F.greatest(F.floor(F.coalesce("hauteur", F.lit(3.0)) / 3), F.lit(1))
    return view(s, d, B).agg(F.sum(floors * (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))).alias("shab"))


@query("agg_tree_heights", "SELECT CAST(floor(x/10)*100 + floor(y/10) AS BIGINT) AS tree_id, MAX(z) AS height FROM f_point WHERE cls = 5 GROUP BY floor(x/10)*100 + floor(y/10)")
def agg_tree_heights(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "f_point").where("cls = 5").groupBy((F.floor(F.col("x") / 10) * 100 + F.floor(F.col("y") / 10)).alias("tree_id")).agg(F.max("z").alias("height"))


@query("agg_density_integrals", "SELECT r, ROUND(SUM(v * 0.5), 6) AS integral FROM f_pixel GROUP BY r")
def agg_density_integrals(s: SparkSession, d: str) -> DataFrame:
    """Compensated sums over ordered layers, folded within one row: the layers of a column are an array of bounded length."""
    layers = view(s, d, "f_pixel").groupBy("r").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "v"))), lambda x: x["v"] * 0.5).alias("l"))
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("e"))

    def add(a, x):
        y = x - a["e"]
        t = a["s"] + y
        return F.struct(t.alias("s"), ((t - a["s"]) - y).alias("e"))

    return layers.select("r", F.round(F.aggregate("l", zero, add, lambda a: a["s"]), 6).alias("integral"))


_DAILY = "SELECT ts_h, td FROM (SELECT ts_h, td, MAX(td) OVER (PARTITION BY date_trunc('day', ts_h)) AS m FROM f_weather) t WHERE td = m"


@query("agg_daily_max_rows", _DAILY)
def agg_daily_max_rows(s: SparkSession, d: str) -> DataFrame:
    w = view(s, d, "f_weather").select("ts_h", "td")
    return w.withColumn("m", F.max("td").over(Window.partitionBy(F.date_trunc("day", "ts_h")))).where("td = m").drop("m")


@query("win_daily_max", _DAILY)
def win_daily_max(s: SparkSession, d: str) -> DataFrame:
    w = view(s, d, "f_weather").select("ts_h", "td").withColumn("day", F.date_trunc("day", "ts_h"))
    top = w.groupBy("day").agg(F.max("td").alias("m"))
    return w.join(top, "day").where("td = m").select("ts_h", "td")


@query("agg_pivot_hour_day", "SELECT CAST(hour(ts_h) AS INTEGER) AS h, MAX(CASE WHEN dayofweek(ts_h) = 0 THEN td END) AS d1, MAX(CASE WHEN dayofweek(ts_h) = 1 THEN td END) AS d2, MAX(CASE WHEN dayofweek(ts_h) = 2 THEN td END) AS d3 FROM f_weather GROUP BY hour(ts_h)")
def agg_pivot_hour_day(s: SparkSession, d: str) -> DataFrame:
    w = view(s, d, "f_weather").withColumn("h", F.hour("ts_h")).withColumn("day", F.concat(F.lit("d"), F.dayofweek("ts_h").cast("string")))
    return w.groupBy("h").pivot("day", ["d1", "d2", "d3"]).agg(F.max("td"))


@query("agg_percentile_nbhd", "SELECT CAST(r AS BIGINT) AS r, quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.5) AS q50, quantile_cont(v, 0.75) AS q75 FROM (SELECT a.r, b.v FROM (SELECT DISTINCT r FROM f_pixel) a JOIN f_pixel b ON b.r BETWEEN a.r - 1 AND a.r + 1) t GROUP BY r")
def agg_percentile_nbhd(s: SparkSession, d: str) -> DataFrame:
    """Quartiles over a row and its neighbours: each value goes to the rows that see it."""
    p = view(s, d, "f_pixel")
    seen = p.select(F.explode(F.array(F.col("r") - 1, F.col("r"), F.col("r") + 1)).alias("r"), "v").join(p.select("r").distinct(), "r", "left_semi")
    return seen.groupBy("r").agg(*[F.percentile("v", q).alias(n) for q, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))])


@query("agg_zscore", "SELECT id, ROUND((hauteur - (SELECT AVG(hauteur) FROM f_building)) / (SELECT stddev_samp(hauteur) FROM f_building), 6) AS z FROM f_building WHERE hauteur IS NOT NULL")
def agg_zscore(s: SparkSession, d: str) -> DataFrame:
    b = view(s, d, B).where("hauteur IS NOT NULL").select("id", "hauteur")
    m = F.broadcast(b.agg(F.avg("hauteur").alias("m"), F.stddev_samp("hauteur").alias("sd")))
    return b.crossJoin(m).select("id", F.round((F.col("hauteur") - F.col("m")) / F.col("sd"), 6).alias("z"))


# Windows, order, duplicates ------------------------------------------------------------------------------------------------------------


@query("win_upstreamer", "SELECT r, c, v, n FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY v DESC, n DESC, c ASC) AS k FROM f_pixel) t WHERE k = 1")
def win_upstreamer(s: SparkSession, d: str) -> DataFrame:
    """One row per key by (value, height) descending, then priority: an aggregate, combined before the shuffle, where a window would sort."""
    best = F.max(F.struct("v", "n", (-F.col("c")).alias("nc"))).alias("b")
    return view(s, d, "f_pixel").groupBy("r").agg(best).select("r", (-F.col("b.nc")).alias("c"), "b.v", "b.n")


@query("win_extremum_point", "SELECT r, v AS top, MIN(c) AS c_first, AVG(c) AS c_mean FROM (SELECT r, c, v, MAX(v) OVER (PARTITION BY r) AS m FROM f_pixel) t WHERE v = m GROUP BY r, v")
def win_extremum_point(s: SparkSession, d: str) -> DataFrame:
    p = view(s, d, "f_pixel").withColumn("m", F.max("v").over(Window.partitionBy("r"))).where("v = m")
    return p.groupBy("r", F.col("v").alias("top")).agg(F.min("c").alias("c_first"), F.avg("c").alias("c_mean"))


@query("dedupe_edges", "SELECT LEAST(tail, head) AS a, GREATEST(tail, head) AS b, MIN(len) AS len FROM f_edge GROUP BY LEAST(tail, head), GREATEST(tail, head)")
def dedupe_edges(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "f_edge").groupBy(F.least("tail", "head").alias("a"), F.greatest("tail", "head").alias("b")).agg(F.min("len").alias("len"))


@query("dedupe_first_uid", "SELECT CAST(l_orderkey AS BIGINT) AS k, CAST(MIN(l_linenumber) AS BIGINT) AS line FROM lineitem GROUP BY l_orderkey")
def dedupe_first_uid(s: SparkSession, d: str) -> DataFrame:
    x = view(s, d, "lineitem").select(F.col("l_orderkey").cast("long").alias("k"), F.col("l_linenumber").cast("long").alias("line"))
    return x.groupBy("k").agg(F.min("line").alias("line"))


@query("dedupe_index", "SELECT DISTINCT floor(x)::BIGINT AS i, floor(y)::BIGINT AS j, floor(z/5)::BIGINT AS k FROM f_point")
def dedupe_index(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "f_point").select(F.floor("x").alias("i"), F.floor("y").alias("j"), F.floor(F.col("z") / 5).alias("k")).distinct()


@query("dedupe_feature_id", "SELECT CAST(v AS BIGINT) AS v, fid FROM (SELECT obs_id AS v, CASE WHEN obs_id % 11 = 0 THEN NULL ELSE station_id END AS fid, row_number() OVER (PARTITION BY CASE WHEN obs_id % 11 = 0 THEN NULL ELSE station_id END ORDER BY obs_id) AS k FROM station_hourly) t WHERE fid IS NULL OR k = 1")
def dedupe_feature_id(s: SparkSession, d: str) -> DataFrame:
    """The first row per id; rows without one all stay."""
    x = view(s, d, "station_hourly").select(F.col("obs_id").alias("v"), F.when(F.col("obs_id") % 11 != 0, F.col("station_id")).alias("fid"))
    first = x.where("fid IS NOT NULL").groupBy("fid").agg(F.min("v").alias("v")).select("v", "fid")
    return first.unionByName(x.where("fid IS NULL"))


@query("ordered_distinct", "SELECT CAST(wd % 16 AS BIGINT) AS d, MIN(ts_h) AS first_seen FROM f_weather GROUP BY wd % 16 ORDER BY first_seen")
def ordered_distinct(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "f_weather").groupBy((F.col("wd") % 16).alias("d")).agg(F.min("ts_h").alias("first_seen")).orderBy("first_seen")


@query("sort_painter", "SELECT r, MAX(c) AS c FROM (SELECT r, c, v, MAX(v) OVER (PARTITION BY r) AS m FROM f_pixel) t WHERE v = m GROUP BY r")
def sort_painter(s: SparkSession, d: str) -> DataFrame:
    """What is painted last shows: per cell the highest, of equal ones the later."""
    return view(s, d, "f_pixel").groupBy("r").agg(F.max(F.struct("v", "c")).alias("m")).select("r", "m.c")


@query("sort_priority_overlay", "SELECT r, cls FROM (SELECT floor(x)::BIGINT AS r, cls, row_number() OVER (PARTITION BY floor(x) ORDER BY CASE cls WHEN 6 THEN 3 WHEN 5 THEN 2 ELSE 1 END DESC, cls DESC) AS k FROM f_point) t WHERE k = 1")
def sort_priority_overlay(s: SparkSession, d: str) -> DataFrame:
    weight = F.when(F.col("cls") == 6, 3).when(F.col("cls") == 5, 2).otherwise(1)
    return view(s, d, "f_point").groupBy(F.floor("x").alias("r")).agg(F.max(F.struct(weight.alias("w"), "cls")).alias("m")).select("r", "m.cls")


@query("sort_edges", "SELECT tail, head, len FROM f_edge WHERE tail <> head ORDER BY tail, head")
def sort_edges(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "f_edge").where("tail <> head").orderBy("tail", "head")


@query("topk_nearest", "SELECT sid FROM f_station ORDER BY pow(lat - 45, 2) + pow(lon, 2), sid LIMIT 1")
def topk_nearest(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "f_station").orderBy(F.pow(F.col("lat") - 45, 2) + F.pow("lon", F.lit(2)), "sid").limit(1).select("sid")


@query("limit_one_srid", "SELECT 2154 AS srid")
def limit_one_srid(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, B).select(F.lit(2154).alias("srid")).limit(1)


@query("chunked", "SELECT id, CAST(floor((row_number() OVER (ORDER BY id) - 1) / 100) AS BIGINT) AS chunk FROM (SELECT sid AS id FROM f_station) t")
def chunked(s: SparkSession, d: str) -> DataFrame:
    """Chunks of a hundred in order of the id: the rank comes from a sort by range and counts per partition, no single task sees all rows."""
    return J.ranked(view(s, d, "f_station").select(F.col("sid").alias("id")), "id").select("id", F.floor(F.col("rank") / 100).alias("chunk"))


# Sets ----------------------------------------------------------------------------------------------------------------------------------


@query("set_union_all", "SELECT id, hauteur, CAST(NULL AS BIGINT) AS class_id FROM f_building UNION ALL SELECT id, NULL, class_id FROM f_landcover")
def set_union_all(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, B).select("id", "hauteur").unionByName(view(s, d, "f_landcover").select("id", "class_id"), allowMissingColumns=True)


@query("set_concat_layers", "SELECT id, xmin, ymin, 'b' AS layer FROM f_building UNION ALL SELECT id, xmin, ymin, 'c' FROM f_landcover")
def set_concat_layers(s: SparkSession, d: str) -> DataFrame:
    part = lambda n, k: view(s, d, n).select("id", "xmin", "ymin", F.lit(k).alias("layer"))
    return part(B, "b").unionByName(part("f_landcover", "c"))


@query("set_cartesian", "SELECT CAST(a.d AS INTEGER) AS direction, CAST(b.v AS DOUBLE) AS speed FROM (SELECT unnest(generate_series(0, 350, 10)) AS d) a CROSS JOIN (SELECT unnest([1.0, 3.0, 5.0]) AS v) b")
def set_cartesian(s: SparkSession, d: str) -> DataFrame:
    """The parameter grid of a sweep: directions times speeds, exploded from one row."""
    return s.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(350), F.lit(10))).alias("direction"), F.array(*map(F.lit, (1.0, 3.0, 5.0))).alias("v")).select("direction", F.explode("v").alias("speed"))


@query("set_index_ops", "(SELECT r, c FROM f_pixel WHERE v > 40 UNION SELECT r, c FROM f_pixel WHERE n > 3) INTERSECT SELECT r, c FROM f_pixel WHERE r > 10")
def set_index_ops(s: SparkSession, d: str) -> DataFrame:
    p = view(s, d, "f_pixel")
    k = lambda w: p.where(w).select("r", "c")
    return k("v > 40").union(k("n > 3")).distinct().intersect(k("r > 10"))


@query("set_index_difference", "SELECT r, c FROM f_pixel WHERE v > 30 EXCEPT SELECT r, c FROM f_pixel WHERE n > 3")
def set_index_difference(s: SparkSession, d: str) -> DataFrame:
    p = view(s, d, "f_pixel")
    return p.where("v > 30").select("r", "c").subtract(p.where("n > 3").select("r", "c"))


@query("set_append_ground", "SELECT r, c, CAST(1 AS BIGINT) AS z FROM f_pixel WHERE v > 45 UNION ALL SELECT i, j, CAST(0 AS BIGINT) FROM (SELECT unnest(generate_series(0, 63))::BIGINT AS i) a CROSS JOIN (SELECT unnest(generate_series(0, 63))::BIGINT AS j) b")
def set_append_ground(s: SparkSession, d: str) -> DataFrame:
    ground = s.range(64 * 64).select(F.floor(F.col("id") / 64).alias("r"), (F.col("id") % 64).alias("c"), F.lit(0).cast("long").alias("z"))
    return view(s, d, "f_pixel").where("v > 45").select("r", "c", F.lit(1).cast("long").alias("z")).unionByName(ground)


QUERIES, ORACLES = book.queries, book.oracles
